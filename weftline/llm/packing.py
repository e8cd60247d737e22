"""Documents as token ids, packed into as few sequences of a fixed length as a local search finds.

A text is encoded where it lies and leaves the task as pieces of at most ``size`` ids: only lengths and checksums go on.
Pieces of one length are interchangeable, so packing looks at the number of pieces of each length (at most ``size`` numbers,
added up in Spark): bins of equal content are one kind with a number of bins. Best fit from the longest length down makes the
first bins, then a local search exchanges pieces between underfull kinds until the number of bins is the least possible or no
exchange helps. Pieces then find their place by their length and their rank among all of that length, which needs one shuffle of
(task, length), so no length or document is hot. The plan is small and does not grow with the number of documents.
"""

from __future__ import annotations

import codecs
import json
import os
import re
import sys
import types
import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.llm.common import as_bytes, cut


@dataclass(frozen=True)
class PackingParams:
    """path: a .json of tokenizers, as every executor sees it. size: ids of a sequence. end: id behind each document. batch_bytes:
    text encoded at once. most_tests: pairs of kinds of bins that the local search looks at."""

    path: str
    size: int = 2048
    end: int = 0
    batch_bytes: int = 1 << 20
    most_tests: int = 1_000_000


# Letters, digits and marks for which the byte-level pattern is plain; "<" may begin a special token.
_LETTERS = "A-Za-zÀ-ÖØ-öø-ſ"
_MARKS = re.escape("!\"#$%&'()*+,-./:;=>?@[\\]^_`{|}~")
_PART = rf"[{_LETTERS}0-9{_MARKS}]++(?:\n[{_LETTERS}0-9{_MARKS}]++)*+"
_PLAIN = re.compile(_PART)
_PLAIN_TEXT = re.compile(rf"{_PART}(?: {_PART})*+")
_ATOM = re.compile(rf" ?[{_LETTERS}]++|'(?:s|t|re|ve|m|ll|d)| ?[{_MARKS}]++| ?[0-9]++|\n")


def _byte_chars() -> str:
    """The character that stands for each byte in byte-level vocabularies: printable ones for themselves, the others behind 255 in
    order. Byte 0 is a space here: it parts what is encoded together, and plain text doesn't hold it."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return " " + "".join(chr(b if b in printable else next(others)) for b in range(256))[1:]


class _Numbers(dict):
    """Numbers strings in the order in which they come first."""

    def __init__(self):
        super().__init__()
        self.fresh: list[str] = []

    def __missing__(self, key: str) -> int:
        n = self[key] = len(self)
        self.fresh.append(key)
        return n


class _Grown:
    """An array that grows at its end."""

    def __init__(self, kind: str):
        self.room, self.n = np.empty(1 << 16, kind), 0

    def add(self, values: np.ndarray) -> None:
        if self.n + len(values) > len(self.room):
            self.room = np.concatenate([self.room[: self.n], np.empty(max(self.n, len(values)), self.room.dtype)])
        self.room[self.n : self.n + len(values)] = values
        self.n += len(values)


class Encoder:
    """Ids of texts as the tokenizer of a file gives them, without added special tokens.

    A byte-level tokenizer parts a text before its merges. Parts of plain text (letters, digits, marks, single spaces and
    line ends between them) are encoded once and remembered. All else is given to the library in stretches between single spaces that
    stand between two characters that are no white space: no token reaches over such a space, and one begins with it.
    """

    def __init__(self, path: str, most: int = 3 << 18):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a worker for each core
        import tokenizers

        self.whole = tokenizers.Tokenizer.from_file(path)
        self.whole.no_truncation()
        self.whole.no_padding()
        spec = json.loads(self.whole.to_str())
        pre = spec["pre_tokenizer"] or {}
        level = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not spec["normalizer"]
        plain_model = spec["model"]["type"] == "BPE" and not spec["model"].get("dropout") and not spec["model"].get("end_of_word_suffix") and not spec["model"].get("continuing_subword_prefix")
        apart = all("<" in t["content"] and " " not in t["content"] and not t["lstrip"] and not t["rstrip"] and not t["single_word"] for t in spec["added_tokens"])
        self.fast = bool(level and plain_model and apart)
        self.chars = _byte_chars()
        self.most = most
        self._forget()

    def _forget(self) -> None:
        self.numbers, self.weight = _Numbers(), 0
        self.ids, self.starts, self.lengths = _Grown("<u4"), _Grown("i8"), _Grown("i8")

    def _library(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, "<u4") for x in self.whole.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self) -> None:
        """Ids of the strings numbered since the last time."""
        fresh, self.numbers.fresh = self.numbers.fresh, []
        plain = [x for x in fresh if _ATOM.fullmatch(x)]
        known = iter(codecs.charmap_decode("\0".join(plain).encode(), "strict", self.chars)[0].split(" "))
        odd = iter(self._library([x for x in fresh if not _ATOM.fullmatch(x)]) if len(plain) < len(fresh) else ())
        tokenize = self.whole.model.tokenize
        found = [[t.id for t in tokenize(next(known))] if _ATOM.fullmatch(x) else next(odd).tolist() for x in fresh]
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        self.starts.add(self.ids.n + np.cumsum(lengths) - lengths)
        self.lengths.add(lengths)
        self.ids.add(np.fromiter(chain.from_iterable(found), np.uint32, int(lengths.sum())))
        self.weight += sum(map(len, fresh))

    def _parts(self, text: str) -> list[str]:
        """A text that isn't plain, as strings that are encoded on their own."""
        parts = text.split(" ")
        joined = [parts[0]]
        for before, part in zip(parts, parts[1:]):
            if before and part and _firm(before[-1]) and _firm(part[0]):
                joined.append(" " + part)
            else:
                joined[-1] += " " + part
        out: list[str] = []
        for j in joined:
            out.extend(_ATOM.findall(j) if _PLAIN.fullmatch(j, int(j[:1] == " ")) else [j])
        return out

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        if not self.fast:
            return self._library(texts)
        if len(self.numbers) > self.most or self.weight > 64 * self.most:
            self._forget()
        split = [_ATOM.findall(t) if _PLAIN_TEXT.fullmatch(t) else self._parts(t) for t in texts]
        sizes = np.fromiter(map(len, split), np.int64, len(split))
        numbers = np.fromiter(map(self.numbers.__getitem__, chain.from_iterable(split)), np.int64, int(sizes.sum()))
        self._learn()
        lengths, starts = self.lengths.room[numbers], self.starts.room[numbers]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        ids = self.ids.room[np.repeat(starts - ends[:-1], lengths) + np.arange(ends[-1])]
        return np.split(ids, ends[np.cumsum(sizes)[:-1]])


def encoder(path: str) -> Encoder:
    """This process's encoder for a file: what one task has learnt serves the next on the same worker."""
    held = sys.modules.setdefault("_packing_encoders", types.ModuleType("_packing_encoders")).__dict__
    if path not in held:
        held[path] = Encoder(path)
    return held[path]


def _firm(c: str) -> bool:
    """Whether a character is certainly no white space."""
    return "!" <= c <= "~" or c.isalnum()


_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int"


def pieces(docs: DataFrame, p: PackingParams, keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, part (the task that made it) and, if asked for, ids (little-endian) of docs (doc_id, text).

    A document is the ids of its text and ``end``; one longer than ``size`` is cut so that all pieces but the first have
    that length.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = encoder(p.path), TaskContext.get().partitionId()
        end = np.array([p.end], "<u4")
        names = [*(x.split()[0] for x in _PIECES.split(", ")), *["ids"] * keep_ids]
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), *[pa.binary()] * keep_ids]

        def cut_up(ids: list[int | None], texts: list[str]) -> pa.RecordBatch:
            rows = []
            for doc, found in zip(ids, encode(texts), strict=True):
                found = np.concatenate([found, end])
                n = len(found)
                first = (n - 1) % p.size + 1
                for k, a in enumerate([0, *range(first, n, p.size)]):
                    b = first if k == 0 else a + p.size
                    own = found[a:b]
                    rows.append((doc, k, a, b - a, zlib.crc32(own), part, *[own.tobytes()] * keep_ids))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

        for batch in batches:
            ids, texts, size = [], [], 0
            for doc, text in zip(batch.column("doc_id").to_pylist(), as_bytes(batch.column("text")), strict=True):
                ids.append(doc)
                texts.append((text or b"").decode())
                size += len(text or b"")
                if size >= p.batch_bytes:
                    yield cut_up(ids, texts)
                    ids, texts, size = [], [], 0
            if ids:
                yield cut_up(ids, texts)

    columns = F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")
    return docs.select(*columns).mapInArrow(run, _PIECES + ", ids binary" * keep_ids)


class Kind:
    """Bins of equal content. items: how many pieces of each length a bin has."""

    __slots__ = ("items", "n", "fill", "known")

    def __init__(self, items: dict[int, int], n: int):
        self.items, self.n = items, n
        self.fill = sum(k * v for k, v in items.items())
        self.known = None

    def sums(self) -> tuple[dict[int, tuple[int, ...]], dict[int, tuple[int, ...]], int]:
        """One or two pieces by the sum of their lengths, the same with nothing too (what a bin may give back), and a bit for each sum."""
        if self.known is None:
            lengths = sorted(self.items)
            two = {a + b: (a, b) for a in lengths for b in lengths if a < b or a == b and self.items[a] > 1}
            out = two | {a: (a,) for a in lengths}
            self.known = out, {0: ()} | out, sum(1 << s for s in out)
        return self.known


def best_fit(counts: dict[int, int], size: int) -> list[Kind]:
    """Best fit from the longest length down; all pieces of a length and all bins of a kind at once."""
    by_room: dict[int, list[Kind]] = defaultdict(list)  # underfull kinds by the room they have left
    for length in sorted(counts, reverse=True):
        left = counts[length]
        for room in range(length, size):
            while left and by_room.get(room):
                kind = by_room[room].pop()
                each = min(room // length, left)
                n = min(kind.n, left // each)
                if kind.n > n:
                    by_room[room].append(Kind(kind.items, kind.n - n))
                by_room[room - each * length].append(Kind(kind.items | {length: each}, n))
                left -= each * n
            if not left:
                break
        if left:
            each = size // length
            if left >= each:
                by_room[size - each * length].append(Kind({length: each}, left // each))
            if rest := left % each:
                by_room[size - rest * length].append(Kind({length: rest}, 1))
    return [k for kinds in by_room.values() for k in kinds]


def exchange(giver: Kind, taker: Kind, size: int) -> tuple[tuple[int, ...], tuple[int, ...]] | None:
    """What to move from a bin to another one and back so that the sum of squared fills grows most: one piece for none or one, two for one or
    one for two, two for none."""
    out, _, bits = giver.sums()
    _, back, _ = taker.sums()
    room, best, found = size - taker.fill, 0, None
    for given, parts in back.items():
        window = bits >> (given + best + 1) & ((1 << (room - best)) - 1)  # sums that gain more than the best and still fit
        while window:
            gain = best + window.bit_length()
            moved = out[given + gain]
            if len(moved) + len(parts) < 4 and taker.fill + gain > giver.fill:
                best, found = gain, (moved, parts)
                break
            window ^= 1 << (window.bit_length() - 1)
    return found


def _without(items: dict[int, int], gone: Iterable[int], come: Iterable[int]) -> dict[int, int]:
    now = defaultdict(int, items)
    for x in gone:
        now[x] -= 1
    for x in come:
        now[x] += 1
    return {k: v for k, v in now.items() if v}


def improve(kinds: list[Kind], size: int, most_tests: int) -> list[Kind]:
    """Exchanges between underfull bins, from the emptiest to the fullest that can take something, until bins are empty.

    Each exchange makes the sum of squared fills larger, so the search ends: when the number of bins is the least possible,
    when no pair of kinds has an exchange, or after ``most_tests`` pairs.
    """
    least = -(-sum(k.fill * k.n for k in kinds) // size)
    full = [k for k in kinds if k.fill == size]
    bins, tests = sum(k.n for k in kinds), 0
    merged: dict[tuple, Kind] = {}

    def add(items: dict[int, int], n: int) -> None:
        """n more bins of a content; equal ones are one kind."""
        nonlocal bins
        kind = Kind(items, n)
        if not items:
            bins -= n
        elif kind.fill == size:
            full.append(kind)
        elif (same := tuple(sorted(items.items()))) in merged:
            merged[same].n += n
        else:
            merged[same] = kind

    for k in kinds:
        if k.fill < size:
            add(k.items, k.n)
    stuck: set[tuple] = set()
    while bins > least and tests < most_tests:
        order = sorted(merged.items(), key=lambda x: (x[1].fill, x[0]))
        change = None
        for key, giver in order:
            if key in stuck:
                continue
            for other, taker in reversed(order):
                tests += 1
                if (other != key or giver.n > 1) and (change := exchange(giver, taker, size)):
                    break
            if change:
                break
            stuck.add(key)
        if not change:
            break
        moved, back = change
        n = giver.n // 2 if key == other else min(giver.n, taker.n)
        for k in {key, other}:
            merged[k].n -= n * (2 if key == other else 1)
            if not merged[k].n:
                del merged[k]
        before = set(merged)
        add(_without(giver.items, moved, back), n)
        add(_without(taker.items, back, moved), n)
        if set(merged) - before:  # a new kind may help those that were stuck
            stuck.clear()
    return full + list(merged.values())


@dataclass
class Plan:
    """Where the pieces of each length go. Entries are in order of (length, first rank): a run of ranks, ``each`` of which lie in one
    bin from ``offset`` on, in bins from ``base`` on."""

    lengths: np.ndarray
    first: np.ndarray
    each: np.ndarray
    offset: np.ndarray
    base: np.ndarray
    sequences: int

    def parts(self) -> tuple:
        """What is broadcast: arrays and a number, which executors read without this package."""
        return self.lengths, self.first, self.each, self.offset, self.base, self.sequences

    def places(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of the piece with this rank (from 0) of this length."""
        at = np.searchsorted(self.lengths << 48 | self.first, length << 48 | rank, "right") - 1
        q = rank - self.first[at]
        return self.base[at] + q // self.each[at], self.offset[at] + q % self.each[at] * length


def plan(counts: dict[int, int], size: int, most_tests: int) -> Plan:
    """Packs so many pieces of each length."""
    kinds = improve(best_fit(counts, size), size, most_tests)
    used: dict[int, int] = defaultdict(int)
    rows, base = [], 0
    for kind in kinds:
        offset = 0
        for length in sorted(kind.items, reverse=True):
            each = kind.items[length]
            rows.append((length, used[length], each, offset, base))
            used[length] += each * kind.n
            offset += each * length
        base += kind.n
    columns = np.array(sorted(rows), np.int64).reshape(-1, 5).T
    return Plan(*columns, base)


def pack(docs: DataFrame, p: PackingParams, keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids, if asked for) of docs (doc_id, text).

    A null text counts as empty: its document is the end id alone. Documents are packed row by row: repeated rows and rows with a null or
    repeated doc_id have places of their own. Which of several pieces of one length gets which place follows from the task that made
    them and their doc_id; equal rows are interchangeable. Other columns are not read. An empty table gives an empty result.
    """
    made = cut(pieces(docs, p, keep_ids))
    by_task = made.groupBy("part", "length").count()
    counts = {r.length: r.n for r in by_task.groupBy("length").agg(F.sum("count").alias("n")).collect()}  # at most ``size`` rows
    known = docs.sparkSession.sparkContext.broadcast(plan(counts, p.size, p.most_tests).parts())
    before = F.sum("count").over(W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    starts = by_task.select("part", "length", F.coalesce(before, F.lit(0)).alias("_before"))
    order = F.row_number().over(W.partitionBy("part", "length").orderBy("doc_id", "piece", "start", "ids_crc32"))
    ranked = made.withColumn("_k", order - 1).join(starts, ["part", "length"]).withColumn("_rank", F.col("_before") + F.col("_k")).drop("part", "_before", "_k")
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * keep_ids]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Plan(*known.value)
        for batch in batches:
            if batch.num_rows:
                sequence, offset = found.places(batch.column("length").to_numpy(), batch.column("_rank").to_numpy())
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, " + "ids binary, " * keep_ids + "sequence_id long, offset long"
    return ranked.select(*names, "_rank").mapInArrow(place, schema)
