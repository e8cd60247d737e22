"""The trie against a plain one built turn by turn."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from weftline.llm import conversation_trie as T

SCHEMA = "conv_id long, turn long, role string, text string, key binary"


def plain(rows, block=100, most=6):
    """Nodes by walking each rebuilt conversation down from the root."""
    own = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()[:16]
            own[conv].append(((turn is not None, turn or 0), digest, (role, text)))
    own = {c: [x[2] for x in sorted(v)] for c, v in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(own):
        h = zlib.crc32(str(c).encode()) % most
        base = own.get(c - (abs(c) % block) * (1 if c >= 0 else -1), [])
        path = (*base[:h], *own[c][h:])
        ends[path].append(c)
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    children = defaultdict(list)
    for path in members:
        if path:
            children[path[:-1]].append(path)
    sums = {}
    for path in sorted(members, key=len, reverse=True):
        leaves = sum(sums[x][0] for x in children[path]) or 1
        saved = sum(sums[x][1] for x in children[path]) + ((len(members[path]) - 1) * len(path[-1][1]) if path else 0)
        sums[path] = leaves, saved
    return sorted(
        (min(m), len(path), min(members[path[:-1]]) if path else None, len(m), len(children[path]), *sums[path], hashlib.sha256(",".join(map(str, sorted(ends.get(path, [])))).encode()).hexdigest())
        for path, m in members.items()
    )


def got(df):
    return sorted(tuple(r) for r in df.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect())


def made(seed, n, words, longest):
    """Conversations that share beginnings, with a group of equal ones, repeated rows, nulls and equal turns."""
    rnd = random.Random(seed)
    rows = []
    for c in range(-3, n):
        turns = [("user", "same")] * rnd.randint(0, 3) if c % 3 else [("user", "hot"), ("assistant", "hot"), ("user", "end")]
        turns += [(rnd.choice(["user", "assistant", None]), rnd.choice([*words, None, "é" * rnd.randint(1, 4)])) for _ in range(rnd.randint(0, longest) if c % 3 else 0)]
        rows += [(c, k if rnd.random() > 0.05 else None, role, text, b"x") for k, (role, text) in enumerate(turns)]
        if turns and rnd.random() < 0.1:
            rows.append(rows[-1])
    rows += [(None, 0, "user", "nobody", None), (7 * n, 1, None, None, None)]
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("run_bytes, held, partitions", [(64 << 20, 256, 4), (2000, 1, 7), (2000, 0, 1)])
def test_trie_matches_plain(spark, run_bytes, held, partitions):
    rows = made(partitions, 400, ["a", "b", "ab"], 6)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        nodes = got(T.trie(T.rebuilt(spark.createDataFrame(rows, SCHEMA)), T.TrieParams(run_bytes, held)))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert nodes == plain(rows)


def test_long_shared_paths_reach_over_ranges(spark):
    """Copies of one conversation of 300 turns are split between ranges; their ids are hashed in order."""
    rows = [(c, t, "user", f"turn {t}", None) for c in range(1000, 1040) for t in range(300)]
    assert got(T.trie(T.rebuilt(spark.createDataFrame(rows, SCHEMA)), T.TrieParams(20_000))) == plain(rows)


def test_ids_go_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(T, "PIECE", 7)
    rows = [(c, 0, "user", "x", None) for c in range(500)]
    assert got(T.trie(T.rebuilt(spark.createDataFrame(rows, SCHEMA)))) == plain(rows)


def test_odd_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert got(T.trie(T.rebuilt(empty))) == []
    assert got(T.trie(T.rebuilt(spark.createDataFrame([(None, 1, "a", "b", None)], SCHEMA)))) == []
    one = [(1, 0, "user", "only turn", None)]  # crc32("1") % 6 turns of conversation 0, which is absent, then nothing: no turn is left
    assert got(T.trie(T.rebuilt(spark.createDataFrame(one, SCHEMA)))) == plain(one)
    wide = spark.createDataFrame([(0, 0, "u", "t", 1, 2, 3)], "conv_id int, turn int, role string, text string, depth int, n_convs int, ends string")
    assert got(T.trie(T.rebuilt(wide))) == plain([(0, 0, "u", "t")])


def test_runs_merge_in_order():
    rnd = random.Random(5)
    rows = [(bytes(rnd.choice(b"ab") for _ in range(rnd.randint(0, 3)) for _ in range(16)), c) for c in range(300)]
    runs = [T._run([(p, c, None) for p, c in rows[k::7]]) for k in range(7)]
    out = list(T.merged(runs))
    assert [(p, c) for p, c, *_ in out] == sorted(rows)
    assert [x[3] for x in out] == [T.shared(a[0], b[0], 0) for a, b in zip([(b"",), *out], out)]


def test_texts_of_nodes(spark):
    df = spark.createDataFrame([(0, 0, "user", "a", None), (0, 1, None, "b", None)], SCHEMA)
    found = T.with_texts(T.trie(T.paths(df)), df).select("depth", "role", "text").orderBy("depth").collect()
    assert [tuple(r) for r in found] == [(0, None, None), (1, "user", "a"), (2, "", "b")]
