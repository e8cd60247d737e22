"""Turns at any depth of JSON documents: VARIANT levels against a plain walk."""

import json
import math
import random

import pytest

from weftline.sources import readers

START, END, TEXT = readers.TURN_START, readers.TURN_END, readers.TURN_TEXT


def plain(node):
    def number(x):
        try:
            return math.nan if isinstance(x, bool) else float(x)
        except (TypeError, ValueError):
            return math.nan

    if isinstance(node, list):
        return [t for x in node for t in plain(x)]
    if not isinstance(node, dict):
        return []
    first = lambda names: next((node[n] for n in names if node.get(n) is not None), None)
    a, b, t = number(first(START)), number(first(END)), first(TEXT)
    own = [(a, b, t.strip())] if math.isfinite(a) and math.isfinite(b) and b > a and isinstance(t, str) and t.strip() else []
    return own + [t for x in node.values() for t in plain(x)]


def made(rnd, depth):
    kind = rnd.random()
    if depth == 0 or kind < 0.2:
        return rnd.choice([None, True, 1, 2.5, "3", "x", "", [], {}])
    if kind < 0.45:
        return [made(rnd, depth - 1) for _ in range(rnd.randint(0, 3))]
    fields = {rnd.choice(["a", "b", "speaker", *START, *END, *TEXT]): made(rnd, depth - 1) for _ in range(rnd.randint(0, 3))}
    if rnd.random() < 0.6:
        fields |= {rnd.choice(START): rnd.choice([0, 1.5, "2", "no", True, None, 9]), rnd.choice(END): rnd.choice([3, 4.5, "5", None, False]), rnd.choice(TEXT): rnd.choice(["hola", "  amén \n", "", " ", 5, None])}
    return fields


@pytest.mark.parametrize("depth", [12, 2, 0])
def test_walk_matches_a_plain_one(spark, depth):
    rnd = random.Random(depth)
    documents = [made(rnd, rnd.randint(0, 6)) for _ in range(300)]
    rows = [(i, json.dumps(d, ensure_ascii=False)) for i, d in enumerate(documents)]
    deep = [{"start": 1, "end": 2, "text": "bottom"}]
    for _ in range(40):
        deep = {"x": [deep]}
    rows += [(1000, json.dumps(deep)), (1001, '{"start": 1, "start": 2, "end": 3, "text": "twice"}'), (1002, "{broken"), (1003, None), (1004, ""), (1005, "[]")]
    got = readers.walk_turns(spark.createDataFrame(rows, "id long, text string"), ["id"], "text", depth).collect()
    want = [(i, *t) for i, d in enumerate(documents) for t in plain(d)] + [(1000, 1.0, 2.0, "bottom"), (1001, 2.0, 3.0, "twice")]
    assert sorted((r.id, r.start, r.end, r.text) for r in got) == sorted(want)
