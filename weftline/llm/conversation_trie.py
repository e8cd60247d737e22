"""Prefix trie of conversations by an external mergesort that knows common prefixes.

A conversation is a row: 16 bytes for each turn (of the SHA-256 of role and text) and its number of code points; texts
are not moved. Rows are dealt out by ranges of (turns, conv_id), so equal conversations can lie in several ranges and none
is too large for a task. Each task sorts runs of bounded size, whose rows carry the number of turns they share with the row
before, writes them to its scratch folder if there are several, and merges them with a loser tree: two rows that share
different numbers of turns with the last row are in order without being looked at, else they are compared behind the shared
turns. A stack holds the open path of the merged stream; a node is finished when a row leaves it.

Nodes on the first and the last path of a range may reach into other ranges. Their partial sums, at most two paths a range,
are merged in order of the ranges by a second stack. A child that is finished long before its parent (more than ``held`` wait
already, or the parent reaches into another range) gets its parent's conv_id by a join on the key of the path.
"""

from __future__ import annotations

import hashlib
import os
import tempfile
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import cut, join_uneven

#: Bytes of a turn's digest.
SIZE = 16
#: Bytes of the ids of one node that go into one row between ranges.
PIECE = 1 << 20


@dataclass(frozen=True)
class TrieParams:
    """run_bytes: turns sorted in memory at once. held: finished children that wait for their parent."""

    run_bytes: int = 64 << 20
    held: int = 256


def _digest() -> Column:
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    return F.unhex(F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * SIZE))


def paths(conversations: DataFrame) -> DataFrame:
    """conv_id, turns (array of digest and chars) of conversations (conv_id, turn, role, text) in order of turn, null first.

    Null roles and texts count as empty. Turns with equal numbers are in order of their digests, repeated rows are turns
    of their own. Rows without a conv_id belong to no conversation.
    """
    chars = F.length(F.coalesce(F.col("text").cast("string"), F.lit(""))).cast("long")
    turns = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.struct("turn", _digest().alias("digest"), chars.alias("chars")).alias("t"))
    ordered = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return ordered.select("conv_id", F.transform("t", lambda t: F.struct(t.digest.alias("digest"), t.chars.alias("chars"))).alias("turns"))


def rebuilt(conversations: DataFrame, block: int = 100, most: int = 6) -> DataFrame:
    """conv_id, turns of each conversation c: the first h of conversation c - c % block, then its own after the first h; h = crc32(c) % most."""
    own = paths(conversations)
    first = own.where(F.col("conv_id") % block == 0).select(F.col("conv_id").alias("_base"), F.slice("turns", 1, most).alias("_head"))
    h = (F.crc32(F.col("conv_id").cast("string")) % most).cast("int")
    joined = own.withColumns({"_base": F.col("conv_id") - F.col("conv_id") % block, "_h": h}).join(first, "_base", "left")
    head = F.when(F.col("_head").isNull(), F.slice("turns", 1, 0)).otherwise(F.slice("_head", 1, F.col("_h")))
    rest = F.slice("turns", F.col("_h") + 1, F.greatest(F.size("turns") - F.col("_h"), F.lit(0)))
    return joined.select("conv_id", F.concat(head, rest).alias("turns"))


def shared(a: bytes, b: bytes, known: int) -> int:
    """Turns that two paths have in common, if the first ``known`` are."""
    n = min(len(a), len(b))
    at = known * SIZE
    while at < n and a[at : at + SIZE] == b[at : at + SIZE]:
        at += SIZE
    return at // SIZE


#: path, conv_id, code points of each turn, turns shared with the row before
Row = tuple[bytes, int, np.ndarray, int]


def _run(rows: list[tuple[bytes, int, np.ndarray]]) -> Iterator[Row]:
    """The rows in order, with what each shares with the one before."""
    rows.sort(key=lambda r: (r[0], r[1]))
    before = b""
    for path, conv, chars in rows:
        yield path, conv, chars, shared(before, path, 0)
        before = path


_RUN = pa.schema([("path", pa.binary()), ("conv", pa.int64()), ("chars", pa.binary()), ("lcp", pa.int64())])


def _written(run: Iterator[Row], path: str) -> Iterator[Row]:
    """The run, from a file in the task's scratch folder."""
    with pa.OSFile(path, "wb") as sink, pa.ipc.new_stream(sink, _RUN) as out:
        held: list[Row] = []

        def flush() -> None:
            columns = [[r[0] for r in held], [r[1] for r in held], [r[2].tobytes() for r in held], [r[3] for r in held]]
            out.write_batch(pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, _RUN, strict=True)], schema=_RUN))
            held.clear()

        for row in run:
            held.append(row)
            if len(held) == 1024:
                flush()
        flush()

    def read() -> Iterator[Row]:
        with pa.OSFile(path, "rb") as source, pa.ipc.open_stream(source) as batches:
            for batch in batches:
                for p, conv, chars, lcp in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    yield p, conv, np.frombuffer(chars, np.int64), lcp

    return read()


def merged(runs: list[Iterator[Row]]) -> Iterator[Row]:
    """The rows of sorted runs in order, with what each shares with the one before, by a loser tree."""
    n = max(1, len(runs))
    heads: list[Row | None] = [next(r, None) for r in runs] + [None] * (n - len(runs))
    known = [0] * n  # turns that a head shares with the row that went out last

    def wins(a: int, b: int) -> bool:
        x, y = heads[a], heads[b]
        if x is None or y is None:
            return x is not None
        if known[a] != known[b]:
            return known[a] > known[b]
        k = shared(x[0], y[0], known[a])
        first = (x[0][k * SIZE : (k + 1) * SIZE], x[1]) < (y[0][k * SIZE : (k + 1) * SIZE], y[1])
        known[b if first else a] = k
        return first

    losers = [0] * n

    def play(node: int) -> int:
        """The winner below a node of the tree, whose leaves n to 2n - 1 are the runs."""
        if node >= n:
            return node - n
        a, b = play(2 * node), play(2 * node + 1)
        won = wins(a, b)
        losers[node] = b if won else a
        return a if won else b

    best = play(1)
    while heads[best] is not None:
        path, conv, chars, _ = heads[best]
        yield path, conv, chars, known[best]
        heads[best] = next(runs[best], None)
        known[best] = heads[best][3] if heads[best] is not None else 0
        node = (best + n) // 2
        while node:
            if wins(losers[node], best):
                best, losers[node] = losers[node], best
            node //= 2


class _Node:
    """An open node: sums over what is finished below it."""

    __slots__ = ("key", "turn", "chars", "convs", "least", "children", "leaves", "saved", "ends", "sha", "held", "first")

    def __init__(self, key: bytes, turn: bytes, chars: int, first: bool):
        self.key, self.turn, self.chars, self.first = key, turn, chars, first
        self.convs, self.least, self.children, self.leaves, self.saved = 0, (1 << 63) - 1, 0, 0, 0
        self.ends, self.sha, self.held = array("q"), None, []

    def ids(self) -> bytes:
        return ",".join(map(str, self.ends)).encode()


NODE, ORPHAN, SPINE, IDS = 0, 1, 2, 3
_OUT = pa.schema(
    [("kind", pa.int32()), ("part", pa.int32()), ("side", pa.int32()), ("piece", pa.int32()), ("key", pa.binary()), ("parent_key", pa.binary()), ("turn", pa.binary()), ("depth", pa.int64()), ("conv_id", pa.int64())]
    + [("parent_conv_id", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("chars", pa.int64()), ("ends", pa.binary())]
)
_DDL = "kind int, part int, side int, piece int, key binary, parent_key binary, turn binary, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, chars long, ends binary"


class _Path:
    """The stack of open nodes; finished ones go to ``out``."""

    def __init__(self, held: int):
        self.stack: list[_Node] = []
        self.out: list[tuple] = []
        self.most = held

    def push(self, key: bytes, turn: bytes, chars: int, first: bool = False) -> _Node:
        node = _Node(key, turn, chars, first)
        self.stack.append(node)
        return node

    def let_go(self, node: _Node) -> None:
        """Children that wait no longer: their parent is found by its key."""
        self.out.extend((ORPHAN, 0, 0, 0, r[0], node.key, *r[1:4], None, *r[4:]) for r in node.held)
        node.held = []

    def pop(self) -> None:
        """The top is finished: all its members have been seen."""
        node, depth = self.stack.pop(), len(self.stack)
        node.saved += (node.convs - 1) * node.chars
        node.leaves = node.leaves or 1
        sha = node.sha if node.sha is not None else hashlib.sha256(node.ids()) if node.ends else None
        row = (node.key, node.turn, depth, node.least, node.convs, node.children, node.leaves, node.saved, node.chars, sha.digest() if sha else None)
        self.out.extend((NODE, 0, 0, 0, r[0], None, *r[1:4], node.least, *r[4:]) for r in node.held)
        if not self.stack:
            self.out.append((NODE, 0, 0, 0, row[0], None, *row[1:4], None, *row[4:]))
            return
        up = self.stack[-1]
        up.convs, up.least, up.children = up.convs + node.convs, min(up.least, node.least), up.children + 1
        up.leaves, up.saved = up.leaves + node.leaves, up.saved + node.saved
        up.held.append(row)
        if len(up.held) > self.most:
            self.let_go(up)

    def leave(self, part: int, side: int) -> None:
        """The top may have members in other ranges: its sums so far go out, and its ids in pieces."""
        node, depth = self.stack.pop(), len(self.stack)
        self.let_go(node)
        ids = node.ids()
        pieces = [ids[k : k + PIECE] for k in range(0, max(1, len(ids)), PIECE)]
        self.out.append((SPINE, part, side, 0, node.key, None, node.turn, depth, node.least, None, node.convs, node.children, node.leaves, node.saved, node.chars, pieces[0]))
        self.out.extend((IDS, part, side, k, node.key, None, node.turn, depth, None, None, None, None, None, None, None, x) for k, x in enumerate(pieces) if k)

    def batches(self, all_: bool = False) -> Iterator[pa.RecordBatch]:
        if len(self.out) >= 4096 or (all_ and self.out):
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*self.out, strict=True), _OUT, strict=True)], schema=_OUT)
            self.out = []


def trie(conversations: DataFrame, p: TrieParams = TrieParams()) -> DataFrame:
    """The nodes of the trie of conversations (conv_id, turns as array of digest and chars; one row for each conv_id).

    A node is a sequence of first turns of one or more conversations, its members; the root is the empty one. Columns: key (16
    bytes that tell the path), turn (digest of its last turn), depth, conv_id (smallest member), parent_conv_id (the parent's;
    root: null), n_convs, n_children, n_leaves (childless nodes in the subtree), saved_tokens (over the subtree: members less
    one, times the code points of the last turn), ends_sha256 (of the ascending ids, with commas, of members that end here).
    (conv_id, depth) tells nodes apart. Conversations without turns are members of the root. Without conversations there is no node. A task
    holds ``run_bytes`` of turns, its open path, and the digests of single conversations, which are not split.
    """
    spark = conversations.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = conversations.select("conv_id", F.col("turns.digest").alias("path"), F.col("turns.chars").alias("chars")).repartitionByRange(ranges, "path", "conv_id")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        with tempfile.TemporaryDirectory() as scratch:
            runs: list[Iterator[Row]] = []
            rows: list[tuple[bytes, int, np.ndarray]] = []
            size = 0
            for batch in batches:
                chars = batch.column("chars")
                for conv, path, at in zip(batch.column("conv_id").to_pylist(), batch.column("path").to_pylist(), range(batch.num_rows), strict=True):
                    rows.append((b"".join(path), conv, chars[at].values.to_numpy(zero_copy_only=False).astype(np.int64)))
                    size += 24 * len(path) + 200
                    if size >= p.run_bytes:
                        runs.append(_written(_run(rows), os.path.join(scratch, str(len(runs)))))
                        rows, size = [], 0
            runs.append(_run(rows))
            open_ = _Path(p.held)
            first = True
            for path, conv, chars, lcp in merged(runs):
                if first:
                    open_.push(b"", b"", 0, True)
                while len(open_.stack) > lcp + 1:
                    if open_.stack[-1].first:
                        open_.leave(part, 0)
                    else:
                        open_.pop()
                for k in range(lcp, len(path) // SIZE):
                    turn = path[k * SIZE : (k + 1) * SIZE]
                    open_.push(hashlib.blake2b(open_.stack[-1].key + turn, digest_size=SIZE).digest(), turn, int(chars[k]), first)
                top = open_.stack[-1]
                top.ends.append(conv)
                top.convs, top.least = top.convs + 1, min(top.least, conv)
                first = False
                yield from open_.batches()
            while open_.stack:
                open_.leave(part, 0 if open_.stack[-1].first else 1)
            yield from open_.batches(True)

    def join_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Partial nodes in order of ranges, depth first: equal keys at one depth are one node."""
        open_ = _Path(p.held)
        for batch in batches:
            for r in batch.to_pylist():
                depth, stack = r["depth"], open_.stack
                if r["kind"] == SPINE:
                    if len(stack) <= depth or stack[depth].key != r["key"]:
                        while len(stack) > depth:
                            open_.pop()
                        open_.push(r["key"], r["turn"], r["chars"])
                    node = stack[depth]
                    node.convs, node.least, node.children = node.convs + r["n_convs"], min(node.least, r["conv_id"]), node.children + r["n_children"]
                    node.leaves, node.saved = node.leaves + r["n_leaves"], node.saved + r["saved_tokens"]
                if r["ends"]:
                    node = stack[depth]
                    if node.sha is None:
                        node.sha = hashlib.sha256()
                    elif r["kind"] == SPINE:
                        node.sha.update(b",")
                    node.sha.update(r["ends"])
                yield from open_.batches()
        while open_.stack:
            open_.pop()
        yield from open_.batches(True)

    made = cut(dealt.mapInArrow(build, _DDL))
    spine = made.where(F.col("kind") >= SPINE).repartition(1).sortWithinPartitions("part", "side", "depth", "piece")
    ends = cut(spine.mapInArrow(join_ranges, _DDL))
    nodes = made.where(F.col("kind") <= ORPHAN).unionByName(ends)
    orphans = nodes.where(F.col("kind") == ORPHAN)
    far = made.where((F.col("kind") <= ORPHAN) & (F.col("n_children") > p.held)).unionByName(ends)
    parents = far.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("_conv"), F.col("n_children").alias("_n"))
    found = join_uneven(orphans, parents, ["parent_key"], "_n", orphans.count()).withColumn("parent_conv_id", F.col("_conv"))
    all_ = nodes.where(F.col("kind") == NODE).unionByName(found.select(*nodes.columns))
    sha = F.when(F.col("ends").isNull(), F.sha2(F.lit(b""), 256)).otherwise(F.lower(F.hex("ends")))
    return all_.select("key", "turn", "depth", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", sha.alias("ends_sha256"))


def with_texts(nodes: DataFrame, conversations: DataFrame) -> DataFrame:
    """Nodes with role and text of their last turn (the root's are null)."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    texts = conversations.groupBy(_digest().alias("turn")).agg(F.first(role).alias("role"), F.first(text).alias("text"))
    return nodes.join(texts, "turn", "left")
