"""Phrases whose words go together, counted exactly behind merged count-min sketches.

Texts are read where they lie, never shuffled. A first pass sketches words and pairs: a task adds up its own cells, cells are
dealt out in blocks of 65,536, and blocks of all tasks are merged by addition. A cell never counts too little, so an n-gram with a cell
below ``least`` in either row of the sketch isn't frequent. A second sketch does the same for longer n-grams whose pairs all
passed (an n-gram is at most as frequent as its rarest pair). The last pass counts only survivors, by their words, and adds them up in the same blocks. So nothing
frequent is lost, whatever the width; the width, which follows the bytes of all texts, only decides how much is counted in vain.
What is broadcast is a bit for each cell, at most ``2 ** most_bits`` bits a row: wider sketches share bits among neighbours.
Within a slice of a megabyte n-grams are told apart by 64 bits of hashes (about 1e-9 for two in one slice to be taken for one).
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.llm.common import MULTIPLIER, as_bytes, cut, hash_words, mix


@dataclass(frozen=True)
class CollocationParams:
    """least: occurrences of a frequent phrase. longest: words of the longest one. covered: percent of a phrase's occurrences that lie in a
    longer one and make it superfluous. top: phrases reported for a language. cell_bytes: bytes of text for each cell of a
    sketch. most_bits: log2 of the bits that are broadcast for a row of a sketch. slice_bytes: text handled at once."""

    least: int = 100
    longest: int = 5
    covered: int = 100
    top: int = 2000
    cell_bytes: int = 64
    most_bits: int = 26
    slice_bytes: int = 1 << 20


#: Ends a piece: a byte that UTF-8 never has.
_END = b"\xff"
_TABLE = bytearray(range(256))
for _c in b"ABCDEFGHIJKLMNOPQRSTUVWXYZ":
    _TABLE[_c] = _c + 32
for _c in b".,;:!?\n\x0b\x0c\r":
    _TABLE[_c] = _END[0]
_TABLE = bytes(_TABLE)
_END_HASH = np.uint64(xxhash.xxh3_64_intdigest(_END))

_BLOCK = 16  # log2 of the cells of a block
_ROWS = 2  # rows of a sketch: the halves of a 64-bit hash


def slices(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[str, bytes]]:
    """Language and lower-cased text of rows (lang, text), whole pieces, about ``most`` bytes at once; a null language is ``und``."""
    held: dict[str, list[bytes]] = defaultdict(list)
    sizes: dict[str, int] = defaultdict(int)
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), as_bytes(batch.column("text")), strict=True):
            if not text:
                continue
            lang, text, start = "und" if lang is None else lang, text.translate(_TABLE), 0
            while len(text) - start > most:
                end = text.rfind(_END, start, start + most)
                end = end if end > start else text.find(_END, start + most)
                if end < 0:
                    break
                yield lang, text[start:end]
                start = end + 1
            held[lang].append(text[start:])
            sizes[lang] += len(text) - start
            if sizes[lang] >= most:
                yield lang, _END.join(held.pop(lang))
                del sizes[lang]
    for lang, texts in held.items():
        yield lang, _END.join(texts)


class Grams:
    """The words of a slice and the hashes of its n-grams."""

    def __init__(self, lang: str, data: bytes):
        self.words = data.replace(_END, b" \xff ").split()
        plain = hash_words(self.words)
        end = plain == _END_HASH
        self.n = len(plain) - int(end.sum())
        self._ends = np.concatenate([[0], np.cumsum(end)])
        self._hashes = plain ^ np.uint64(xxhash.xxh3_64_intdigest(lang.encode()))

    def starts(self, k: int) -> np.ndarray:
        """Whether k words of one piece start at each place."""
        return self._ends[k:] == self._ends[:-k] if len(self._hashes) >= k else np.zeros(0, bool)

    def hashes(self, k: int, at: np.ndarray) -> np.ndarray:
        """Hashes of the n-grams of k words that start at the places."""
        total = np.zeros(len(at), np.uint64)
        for j in range(k):
            total = total * np.uint64(MULTIPLIER) + self._hashes[at + j]
        return mix(total)


@dataclass
class Passed:
    """Which n-grams may be frequent: a bit for 2 ** shift neighbouring cells in each row of a sketch."""

    bits: list[np.ndarray]
    cells: int  # log2
    shift: int

    def parts(self) -> tuple:
        """What is broadcast: arrays and numbers, which executors read without this package."""
        return self.bits, self.cells, self.shift

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        ok = np.ones(len(hashes), bool)
        for r, bits in enumerate(self.bits):
            at = _cells(hashes, r, self.cells) >> np.uint64(self.shift)
            ok &= (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
        return ok


def _cells(hashes: np.ndarray, row: int, cells: int) -> np.ndarray:
    return hashes >> np.uint64(32 * row) & np.uint64((1 << cells) - 1)


def survivors(grams: Grams, longest: int, pairs: Passed | None, longer: Passed | None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """k, places and hashes of the n-grams that pass: words and pairs by ``pairs``, others if all their pairs pass and by ``longer``.

    Without ``pairs`` all words and pairs pass, and nothing longer is asked for; without ``longer`` only longer ones are given.
    """
    for k in (1, 2):
        at = np.flatnonzero(grams.starts(k))
        hashes = grams.hashes(k, at)
        if pairs is not None:
            ok = pairs(hashes)
            at, hashes = at[ok], hashes[ok]
        if pairs is None or longer is not None:
            yield k, at, hashes
    if pairs is None:
        return
    good = np.zeros(max(0, len(grams.words) - 1), bool)  # whether a pair that passes starts here
    good[at] = True
    run = good
    for k in range(3, longest + 1):
        run = run[:-1] & good[k - 2 :] if len(run) else run
        at = np.flatnonzero(run)
        hashes = grams.hashes(k, at)
        if longer is not None:
            ok = longer(hashes)
            at, hashes = at[ok], hashes[ok]
        yield k, at, hashes


def _sketch(docs: DataFrame, p: CollocationParams, cells: int, pairs: Passed | None) -> Passed:
    """Sketches words and pairs or, if ``pairs`` is given, longer n-grams of which all pairs pass."""
    spark = docs.sparkSession
    known = spark.sparkContext.broadcast(pairs and pairs.parts())
    shift = max(0, cells - p.most_bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def added() -> Iterator[pa.RecordBatch]:
            """Cells with their counts, in blocks."""
            every = np.concatenate(held)
            for row in range(_ROWS):
                at, counts = np.unique(_cells(every, row, cells).astype(np.uint32), return_counts=True)
                blocks, first = np.unique(at >> np.uint32(_BLOCK), return_index=True)
                parts = zip(np.split(at.astype(np.uint16), first[1:]), np.split(counts, first[1:]), strict=True)
                packed = [(a.tobytes(), c.astype(np.uint8 if c.max() < 256 else np.uint32).tobytes()) for a, c in parts]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(blocks), row, np.int32)), pa.array(blocks.astype(np.int64)), pa.array([a for a, _ in packed], pa.binary()), pa.array([c for _, c in packed], pa.binary())], names=["row", "block", "cells", "counts"])

        passed = Passed(*known.value) if known.value else None
        for lang, data in slices(batches, p.slice_bytes):
            for _, _, hashes in survivors(Grams(lang, data), p.longest, passed, None):
                held.append(hashes)
                size += len(hashes)
            if size >= 1 << 22:
                yield from added()
                held, size = [], 0
        if size:
            yield from added()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, np.zeros(1 << _BLOCK, np.int64)

        def bits() -> pa.RecordBatch:
            hot = (total >= p.least).reshape(-1, 1 << shift).any(axis=1)
            return pa.RecordBatch.from_arrays([pa.array([now[0]], pa.int32()), pa.array([now[1]], pa.int64()), pa.array([np.packbits(hot, bitorder="little").tobytes()], pa.binary())], names=["row", "block", "bits"])

        for batch in batches:
            for row, block, at, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now != (row, block):
                    if now is not None:
                        yield bits()
                    now, total = (row, block), np.zeros(1 << _BLOCK, np.int64)
                at = np.frombuffer(at, np.uint16)
                total[at] += np.frombuffer(counts, np.uint8 if len(counts) == len(at) else np.uint32)
        if now is not None:
            yield bits()

    made = docs.mapInArrow(run, "row int, block long, cells binary, counts binary")
    merged = made.repartition("row", "block").sortWithinPartitions("row", "block").mapInArrow(merge, "row int, block long, bits binary")
    size = 1 << (_BLOCK - shift - 3)
    out = Passed([np.zeros(size << (cells - _BLOCK), np.uint8) for _ in range(_ROWS)], cells, shift)
    for r in merged.collect():  # a bit a cell, at most 2 ** most_bits in each row
        out.bits[r.row][r.block * size : (r.block + 1) * size] = np.frombuffer(r.bits, np.uint8)
    return out


def frequent(docs: DataFrame, p: CollocationParams = CollocationParams()) -> DataFrame:
    """lang, phrase, n of docs (lang, text): all n-grams of up to ``longest`` words that occur ``least`` times or more in their language, and for
    each language with words an empty phrase whose n is the number of its words."""
    docs = docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    cells = min(32, max(_BLOCK, (size // p.cell_bytes).bit_length()))
    pairs = _sketch(docs, p, cells, None)
    longer = _sketch(docs, p, cells, pairs) if p.longest > 2 else pairs
    known = docs.sparkSession.sparkContext.broadcast((pairs.parts(), longer.parts()))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[int, str], dict[bytes, int]] = defaultdict(lambda: defaultdict(int))

        def out() -> pa.RecordBatch:
            columns = [pa.array([b for b, _ in counts], pa.int64()), pa.array([k for _, k in counts], pa.string())]
            columns += [pa.array([b"\n".join(x) for x in counts.values()], pa.binary()), pa.array([np.array(list(x.values()), np.int64).tobytes() for x in counts.values()], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=["block", "lang", "phrases", "counts"])

        passed, size = [Passed(*x) for x in known.value], 0
        for lang, data in slices(batches, p.slice_bytes):
            grams = Grams(lang, data)
            if grams.n:
                counts[0, lang][b""] += grams.n
            for k, at, hashes in survivors(grams, p.longest, *passed):
                each, first, n = np.unique(hashes, return_index=True, return_counts=True)
                blocks = _cells(each, 0, cells) >> np.uint64(_BLOCK)
                for block, i, x in zip(blocks.tolist(), at[first].tolist(), n.tolist(), strict=True):
                    own = counts[block, lang]
                    phrase = b" ".join(grams.words[i : i + k])
                    size += phrase not in own
                    own[phrase] += x
            if size >= 1 << 19:
                yield out()
                counts.clear()
                size = 0
        if counts:
            yield out()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, defaultdict(int)

        def out() -> pa.RecordBatch:
            kept = [(x, n) for x, n in total.items() if n >= p.least or not x]
            return pa.RecordBatch.from_arrays([pa.array([now[1]] * len(kept), pa.string()), pa.array([x for x, _ in kept], pa.binary()).cast(pa.string()), pa.array([n for _, n in kept], pa.int64())], names=["lang", "phrase", "n"])

        for batch in batches:
            for block, lang, phrases, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now != (block, lang):
                    if now is not None:
                        yield out()
                    now, total = (block, lang), defaultdict(int)
                for x, k in zip(phrases.split(b"\n"), np.frombuffer(n, np.int64).tolist(), strict=True):
                    total[x] += k
        if now is not None:
            yield out()

    dealt = docs.mapInArrow(count, "block long, lang string, phrases binary, counts binary").repartition("block", "lang")
    return dealt.sortWithinPartitions("block", "lang").mapInArrow(add, "lang string, phrase string, n long")


def score(a: Column, n: Column, left: Column, right: Column) -> Column:
    """floor(1000 * a * n / (left * right)) of longs, exact up to 38 digits."""
    wide = [x.cast("decimal(19,0)") for x in (a, n, left, right)]
    return F.call_function("div", wide[0] * F.lit(1000).cast("decimal(4,0)") * wide[1], wide[2] * wide[3])


def collocations(docs: DataFrame, p: CollocationParams = CollocationParams()) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of docs (lang, text): each language's best phrases of 2 to ``longest`` words.

    Words are runs of other characters than space and tab in pieces between ``.,;:!?`` and line ends, A-Z in lower case. a:
    occurrences of the phrase, overlaps included; n: words of the language; the phrase is cut after its first k words where
    floor(1000 * a * n / (l * r)) is least (l, r: occurrences of the parts; ties to the smallest k). A phrase that lies within a
    longer frequent one which covers ``covered`` percent of it is dropped. Best: score, then a, then the phrase's bytes.

    A null lang counts as ``und``, a null or empty text has no words, repeated rows count each time, columns besides lang and text are not
    read. Without frequent phrases (as in an empty table) the result is empty. A piece longer than a slice is handled whole.
    """
    counts = cut(frequent(docs, p))
    totals = counts.where("phrase = ''").select("lang", F.col("n"))
    phrases = counts.where("phrase <> ''").select("lang", "phrase", F.col("n").alias("a"))
    words = phrases.withColumn("w", F.split("phrase", " ")).where(F.size("w") > 1)
    inner = words.where(F.size("w") > 2).select("lang", "a", "w", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("s"))
    inner = inner.select("lang", "a", "w", "s", F.explode(F.sequence(F.lit(2), F.least(F.size("w") - F.col("s") + 1, F.size("w") - 1))).alias("k"))
    covers = inner.groupBy("lang", F.array_join(F.slice("w", F.col("s"), F.col("k")), " ").alias("phrase")).agg(F.max("a").alias("_longer"))
    kept = words.join(covers, ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("_longer") < p.covered * F.col("a"), F.lit(True)))
    cuts = kept.select("lang", "phrase", "a", "w", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("_left"), F.array_join(F.slice("w", F.col("k") + 1, F.size("w")), " ").alias("_right"))
    part = lambda name, n: phrases.select("lang", F.col("phrase").alias(name), F.col("a").alias(n))
    scored = cuts.join(part("_left", "l"), ["lang", "_left"]).join(part("_right", "r"), ["lang", "_right"]).join(totals, "lang")
    scored = scored.withColumn("score", score(F.col("a"), F.col("n"), F.col("l"), F.col("r")))
    least = scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("b"))
    best = least.select("lang", "phrase", "a", "b.l", "b.r", "n", "b.score")
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    return best.withColumn("rank", rank).where(F.col("rank") <= p.top).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
