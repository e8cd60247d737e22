"""Groups of duplicates against a comparison with every first member."""

import random
import time
from difflib import SequenceMatcher

import pytest

from weftline.operators import folds

SCHEMA = "key int, id long, start double, type string, hash long, text string, confidence double"


def signed(h):
    return h - 2**64 if h >= 2**63 else h


def plain(rows, p):
    out, firsts, members = {}, [], {}
    for key, id_, start, kind, h, text, sure in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        best = None
        for n, (k, i, t, g, x) in enumerate(firsts):
            if (k, t) != (key, kind):
                continue
            bits = bin((g ^ (h or 0)) & (2**64 - 1)).count("1")
            alike = 0.0 if not x or not text else SequenceMatcher(None, x, text).ratio()
            if (bits <= p.strict or (bits <= p.near and alike >= p.ratio)) and (best is None or 64 - bits + 20 * alike > best[0]):
                best = (64 - bits + 20 * alike, n)
        if best is None:
            firsts.append((key, id_, kind, h or 0, text))
            best = (0, len(firsts) - 1)
        out[key, id_] = firsts[best[1]][1]
        members.setdefault(best[1], []).append((-sure, -len(text or ""), start, id_, key))
    reps = {(m[4], m[3]) for m in map(min, members.values())}
    return {k: (leader, k in reps) for k, leader in out.items()}


@pytest.mark.parametrize("p", [folds.DuplicateParams(), folds.DuplicateParams(strict=0, near=0), folds.DuplicateParams(strict=9, near=3, ratio=0.5)])
def test_groups_match_a_full_comparison(spark, p):
    rnd = random.Random(p.near)
    bases = [rnd.getrandbits(64) for _ in range(6)]
    texts = ["feliz sabado", "feliz sabado a todos", "himno 245", "", None]
    rows = []
    for i in range(500):
        h = rnd.choice(bases)
        for _ in range(rnd.randint(0, 8)):
            h ^= 1 << rnd.randint(0, 63)
        rows.append((rnd.randint(0, 2), i, float(rnd.randint(0, 50)), rnd.choice(["name", "verse"]), signed(h) if rnd.random() > 0.02 else None, rnd.choice(texts), rnd.choice([0.5, 0.7])))
    got = folds.duplicate_groups(spark.createDataFrame(rows, SCHEMA), ["key"], p).collect()
    assert {(r.key, r.id): (r.leader, r.is_representative) for r in got} == plain(rows, p)


def test_time_is_near_linear_in_first_members():
    """20,000 first members that are far from each other: each new one meets few of them."""
    rnd = random.Random(1)
    blocks, met = folds._Blocks(5), 0
    began = time.process_time()
    for _ in range(20_000):
        h = rnd.getrandbits(64)
        met += len(blocks.sharing(h))
        blocks.add(h)
    assert met < 20_000 * 100  # a full comparison meets 2e8
    assert time.process_time() - began < 20
