"""Removal of passages that occur more than once, located by sharded Aho-Corasick automata.

A window is a run of ``window`` consecutive words. Every word is removed that a window covers whose
words also start anywhere else. The whole corpus is never compared with itself: each window has an
anchor, the least hash of its runs of ``anchor`` words, and equal windows have equal anchors.

1. Documents give the anchors of their windows. Anchors that occur once can't belong to a repeated window.
2. Around every recurring anchor a document gives a segment: the words of the consecutive windows
   that share this anchor. Equal segments are counted once per task and then per anchor.
3. A task takes the segments of many anchors (a shard), confirms word by word which windows recur,
   joins consecutive ones into passages, compiles them into an automaton and streams the segments
   through it. All words of all occurrences are found there: a repeated window's segments share its shard.
4. The places found in a segment go back to every document that has this segment.

A passage that a third of all documents share is one segment in step 3, whatever its number of copies. An
anchor that stands in very many documents may still have as many different segments: a phrase of some words
that many writers use. Such an anchor is no task's work. The windows of its segments are dealt out and counted one
by one, by 128 bits of their words' hashes, and those that recur are places as in step 3.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.llm.common import as_bytes, cut, groups, hash_words, join_uneven, mix, rolling


#: Three joins by document read these columns, no fewer, so that Spark shuffles the texts once for all of them.
SHUFFLED = ["doc_key", "text", "row"]


@dataclass(frozen=True)
class SubstringParams:
    """window: words of a window. anchor: words of an anchor. shard: segments of an automaton, at least
    (an anchor is not split). hot and most_hot: an anchor that stands more than ``hot`` times, and more often than
    one in ``most_hot`` of all anchors, is dealt out by its windows; so there are at most ``most_hot`` such anchors,
    which every worker gets (8 bytes each). held: distinct segments that a task counts before it hands them on.
    untouched: a text that loses nothing is kept as it is, white space and null included."""

    window: int = 35
    anchor: int = 8
    shard: int = 8_000
    hot: int = 2_000
    most_hot: int = 1_000_000
    held: int = 50_000
    untouched: bool = False


def window_anchors(words: list[bytes], p: SubstringParams) -> tuple[np.ndarray, np.ndarray]:
    """The anchor of each window, and the hash of each run of ``anchor`` words."""
    runs = rolling(hash_words(words), p.anchor)
    span = p.window - p.anchor + 1  # runs in a window
    if len(runs) < span:
        return np.empty(0, np.uint64), runs
    least, width = runs, 1
    while 2 * width <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < span:
        least = np.minimum(least[: len(runs) - span + 1], least[span - width :])
    return least, runs


def _stretches(anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last window of each stretch of consecutive windows with one anchor."""
    change = np.flatnonzero(anchors[1:] != anchors[:-1]) + 1
    return np.concatenate([[0], change]), np.concatenate([change, [len(anchors)]]) - 1


def document_anchors(docs: DataFrame, p: SubstringParams) -> DataFrame:
    """doc_key and the anchors of a document; anchors that may recur inside the document stand twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for text in as_bytes(batch.column("text")):
                least, runs = window_anchors((text or b"").split(), p)
                if not len(least):
                    found.append(least.view(np.int64))
                    continue
                first, _ = _stretches(least)
                anchors, times = np.unique(least[first], return_counts=True)
                twice = times > 1
                if len(np.unique(runs)) < len(runs):  # a stretch may hold its anchor at two places
                    values, counts = np.unique(runs, return_counts=True)
                    twice |= np.isin(anchors, values[counts > 1])
                found.append(np.concatenate([anchors, anchors[twice]]).view(np.int64))
            ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
            flat = np.concatenate(found) if found else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_key"), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["doc_key", "anchors"])

    return docs.select("doc_key", "text").mapInArrow(run, "doc_key long, anchors array<long>")


def _segments(text: bytes, recurring: np.ndarray, p: SubstringParams) -> Iterator[tuple[int, int, bytes, bytes]]:
    """Anchor, start word, words and 128-bit digest of each segment around a recurring anchor (sorted)."""
    words = text.split() if len(recurring) else []
    least, _ = window_anchors(words, p)
    if not len(least):
        return
    first, last = _stretches(least)
    at = np.minimum(np.searchsorted(recurring, least[first]), len(recurring) - 1)
    for k in np.flatnonzero(recurring[at] == least[first]):
        body = b" ".join(words[first[k] : last[k] + p.window])
        yield int(least[first[k]].view(np.int64)), int(first[k]), body, xxhash.xxh3_128_digest(body)


def _long_pairs(digests: list[bytes]) -> tuple[pa.Array, pa.Array]:
    halves = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
    return pa.array(halves[:, 0]), pa.array(halves[:, 1])


def _distinct_segments(texts: Iterator[tuple[bytes | None, np.ndarray]], p: SubstringParams) -> Iterator[list[tuple[bytes, int, int, bytes]]]:
    """Digest, anchor, number and words of the distinct segments of texts around their anchors, about p.held at a time."""
    counts: Counter[bytes] = Counter()
    kept: dict[bytes, tuple[int, bytes]] = {}
    for text, anchors in texts:
        for anchor, _, body, digest in _segments(text or b"", anchors, p):
            counts[digest] += 1
            if digest not in kept:
                kept[digest] = anchor, body
        if len(kept) >= p.held:
            yield [(d, anchor, counts[d], body) for d, (anchor, body) in kept.items()]
            counts.clear()
            kept.clear()
    yield [(d, anchor, counts[d], body) for d, (anchor, body) in kept.items()]


def counted_segments(chosen: DataFrame, p: SubstringParams) -> DataFrame:
    """Distinct segments of each task with their numbers, from rows (text, anchors)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((text, _uint64(anchors)) for batch in batches for text, anchors in zip(as_bytes(batch.column("text")), batch.column("anchors"), strict=True))
        for found in _distinct_segments(rows, p):
            a, b = _long_pairs([d for d, *_ in found])
            columns = [pa.array([x for _, x, _, _ in found], pa.int64()), a, b, pa.array([n for _, _, n, _ in found], pa.int64()), pa.array([x for *_, x in found], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["anchor", "seg_a", "seg_b", "n", "words"])

    return chosen.select(*SHUFFLED, "anchors").mapInArrow(run, "anchor long, seg_a long, seg_b long, n long, words binary")


def _rows_of_windows(found: list[tuple[bytes, int, int, bytes]], p: SubstringParams) -> pa.RecordBatch:
    """Of segments (digest, anchor, number, words): a row for each digest of their windows (win, n; with seg and low if it stands once in them),
    and the stretches (seg, low, high) that the others cover."""
    hashes = [hash_words(body.split(b" ")) for *_, body in found]
    sizes = np.array([len(h) - p.window + 1 for h in hashes])
    owner = np.repeat(np.arange(len(found)), sizes)
    place = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    win_a, win_b = (np.concatenate([rolling(f(h), p.window) for h in hashes]).view(np.int64) for f in (lambda h: h, mix))
    order = np.lexsort((win_b, win_a))
    first = np.flatnonzero(np.concatenate([[True], (win_a[order][1:] != win_a[order][:-1]) | (win_b[order][1:] != win_b[order][:-1])]))
    total = np.add.reduceat(np.array([n for _, _, n, _ in found])[owner][order], first)
    one, again = order[first], np.zeros(len(order), bool)
    again[order] = np.repeat(total > 1, np.diff([*first, len(order)]))
    at = np.flatnonzero(again)
    apart = (owner[at][1:] != owner[at][:-1]) | (np.diff(place[at]) > p.window)
    low, high = (at[np.concatenate(x)] if len(at) else at for x in (([True], apart), (apart, [True])))
    seg_a, seg_b = _long_pairs([d for d, *_ in found])
    known, none = pa.array(total > 1), pa.nulls(len(low), pa.int64())
    hide = lambda column: pc.if_else(known, pa.nulls(len(column), column.type), column)
    columns = [
        (pa.array(win_a[one], pa.int64()), none),
        (pa.array(win_b[one], pa.int64()), none),
        (pa.array(total, pa.int64()), none),
        (hide(seg_a.take(pa.array(owner[one]))), seg_a.take(pa.array(owner[low]))),
        (hide(seg_b.take(pa.array(owner[one]))), seg_b.take(pa.array(owner[low]))),
        (hide(pa.array(place[one], pa.int32())), pa.array(place[low], pa.int32())),
        (hide(pa.array(place[one] + p.window, pa.int32())), pa.array(place[high] + p.window, pa.int32())),
    ]
    return pa.RecordBatch.from_arrays([pa.concat_arrays(x) for x in columns], names=["win_a", "win_b", "n", "seg_a", "seg_b", "low", "high"])


def counted_windows(texts: DataFrame, hot: np.ndarray, p: SubstringParams) -> DataFrame:
    """The windows of the distinct segments of each task around hot anchors (sorted), as ``_rows_of_windows``: what recurs inside
    a task is known there, so a window of many segments goes out as one row a task and as stretches, not once for each segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((text, hot) for batch in batches for text in as_bytes(batch.column("text")))
        for found in _distinct_segments(rows, p):
            if found:
                made = _rows_of_windows(found, p)
                yield from (made.slice(at, 100_000) for at in range(0, made.num_rows, 100_000))

    return texts.select("text").mapInArrow(run, "win_a long, win_b long, n long, seg_a long, seg_b long, low int, high int")


def located_by_windows(windows: DataFrame, p: SubstringParams) -> DataFrame:
    """As ``located``, from the windows of segments: those whose digest recurs, joined where they overlap."""
    windows = cut(windows)
    digest, stretch = ["win_a", "win_b"], ["seg_a", "seg_b", "low", "high"]
    counted = windows.where("win_a is not null")
    open_ = counted.where("seg_a is not null").select(*digest, *stretch)  # those that stand once in a task
    recurring = cut(counted.groupBy(*digest).agg(F.sum("n").alias("n"), F.count("seg_a").alias("rows")).where("n > 1 and rows > 0").drop("n"))
    found = join_uneven(open_, recurring, digest, "rows", open_.count()).select(*stretch)
    found = found.unionByName(windows.where("win_a is null").select(*stretch)).distinct()
    order = W.partitionBy("seg_a", "seg_b").orderBy("low", "high")
    reach = F.max("high").over(order.rowsBetween(W.unboundedPreceding, -1))
    marked = found.withColumn("_new", F.coalesce(F.col("low") > reach, F.lit(True)).cast("int")).withColumn("_part", F.sum("_new").over(order))
    return marked.groupBy("seg_a", "seg_b", "_part").agg(F.min("low").alias("low"), F.max("high").alias("high")).drop("_part")


def _uint64(values: pa.ListScalar) -> np.ndarray:
    return np.sort(values.values.to_numpy(zero_copy_only=False).view(np.uint64))


def placed_segments(chosen: DataFrame, p: SubstringParams) -> DataFrame:
    """Every occurrence of a segment: its digest, the document (key and digest of the text) and its first word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, keys, own, starts = [], [], [], []
            for key, text, anchors in zip(batch.column("doc_key").to_pylist(), as_bytes(batch.column("text")), batch.column("anchors"), strict=True):
                text_digest = _text_digest(text or b"")
                for _, start, _, digest in _segments(text or b"", _uint64(anchors), p):
                    digests.append(digest)
                    keys.append(key)
                    own.append(text_digest)
                    starts.append(start)
            a, b = _long_pairs(digests)
            yield pa.RecordBatch.from_arrays([a, b, pa.array(keys, pa.int64()), pa.array(own, pa.int64()), pa.array(starts, pa.int32())], names=["seg_a", "seg_b", "doc_key", "own", "start"])

    return chosen.select(*SHUFFLED, "anchors").mapInArrow(run, "seg_a long, seg_b long, doc_key long, own long, start int")


def _text_digest(text: bytes) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(text)).view(np.int64))


class Alphabet:
    """Words as characters, two for each word if there are too many words for one."""

    def __init__(self, segments: list[list[bytes]]):
        ids: dict[bytes, int] = {}
        for words in segments:
            for w in words:
                ids.setdefault(w, len(ids))
        self.width = 1 if len(ids) < 1_000_000 else 2
        safe = lambda k: chr(k + 1 if k < 0xD000 else k + 0x2000)  # noqa: E731  leaves out the surrogates
        self.letters = {w: safe(k) if self.width == 1 else safe(k // 500_000) + safe(500_000 + k % 500_000) for w, k in ids.items()}

    def spell(self, words: list[bytes]) -> str:
        return "".join(map(self.letters.__getitem__, words))


def repeated_spans(segments: list[list[bytes]], counts: list[int], window: int) -> list[list[tuple[int, int]]]:
    """For each distinct segment the stretches of words that recurring windows cover."""
    alphabet = Alphabet(segments)
    step = alphabet.width
    size = window * step
    spelled = [alphabet.spell(words) for words in segments]
    seen: Counter[str] = Counter()
    for text, n in zip(spelled, counts, strict=True):
        for at in range(0, len(text) - size + 1, step):
            seen[text[at : at + size]] += n
    automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
    for text in spelled:
        start = None
        for at in range(0, len(text) - size + step + 1, step):
            if at <= len(text) - size and seen[text[at : at + size]] > 1:
                start = at if start is None else start
            elif start is not None:
                automaton.add_word(text[start : at - step + size])
                start = None
    if not len(automaton):
        return [[] for _ in segments]
    automaton.make_automaton()
    out = []
    for text in spelled:
        spans: list[tuple[int, int]] = []
        for end, length in automaton.iter(text):
            a, b = (end + 1 - length) // step, (end + 1) // step
            while spans and spans[-1][1] >= a:
                a = min(a, spans.pop()[0])
            spans.append((a, b))
        out.append(spans)
    return out


def located(segments: DataFrame, p: SubstringParams) -> DataFrame:
    """Digest of each segment with repeated words, and where they are in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in groups(batches, ["anchor"], p.shard):
            merged: dict[tuple[int, int], list] = {}
            for a, b, n, words in zip(*(part.column(c).to_pylist() for c in ("seg_a", "seg_b", "n", "words")), strict=True):
                merged.setdefault((a, b), [0, words])[0] += n
            spans = repeated_spans([x[1].split(b" ") for x in merged.values()], [x[0] for x in merged.values()], p.window)
            rows = [(a, b, s, e) for (a, b), found in zip(merged, spans, strict=True) for s, e in found]
            columns = list(zip(*rows, strict=True)) or [[], [], [], []]
            types = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, types, strict=True)], names=["seg_a", "seg_b", "low", "high"])

    dealt = segments.repartition("anchor").sortWithinPartitions("anchor")
    return dealt.mapInArrow(run, "seg_a long, seg_b long, low int, high int")


def remove_repeats(docs: DataFrame, p: SubstringParams = SubstringParams(), carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, the columns of ``carry``, n_words, n_removed, kept.

    kept holds the words that stay, joined by one space. Words are runs of characters other than
    space and U+0009 to U+000D, compared as they are. Null and empty texts have no words and an empty
    kept. Texts of fewer words than a window lose nothing, long ones are taken whole. Repeated rows repeat
    each other's windows. A null doc_id stays null, and any number of rows may have none. Other columns are
    not read. An empty table gives an empty result.
    """
    key = F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text")).alias("doc_key")  # rows that share one are told apart by their texts
    texts = docs.select(key, "text", F.struct("doc_id", *carry).alias("row"))
    anchors = cut(document_anchors(texts.where("text is not null"), p)).where("size(anchors) > 0")
    flat = anchors.select("doc_key", F.explode("anchors").alias("anchor"))
    total = anchors.agg(F.coalesce(F.sum(F.size("anchors")), F.lit(0))).first()[0]
    recurring = cut(flat.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").withColumn("many", F.col("n") > max(p.hot, total / p.most_hot)))
    own = join_uneven(flat, recurring, ["anchor"], "n", total)
    some, hot = (F.collect_set(F.when(which, F.col("anchor"))) for which in (~F.col("many"), F.col("many")))
    wanted = own.groupBy("doc_key").agg(some.alias("anchors"), hot.alias("hot"))
    chosen = texts.join(wanted, "doc_key")

    spans = located(counted_segments(chosen.where("size(anchors) > 0"), p), p)
    frequent = recurring.where("many").select("anchor").toArrow().column("anchor").to_numpy().view(np.uint64)  # at most most_hot
    if len(frequent):
        spans = spans.unionByName(located_by_windows(counted_windows(texts, np.sort(frequent), p), p))
    places = placed_segments(chosen.withColumn("anchors", F.concat("anchors", "hot")), p).join(spans, ["seg_a", "seg_b"])
    stretch = F.struct("own", (F.col("start") + F.col("low")).alias("low"), (F.col("start") + F.col("high")).alias("high"))
    removed = places.groupBy("doc_key").agg(F.collect_set(stretch).alias("spans"))
    joined = texts.join(removed, "doc_key", "left").select(*SHUFFLED, "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, lost, kept = [], [], []
            for text, found in zip(as_bytes(batch.column("text")), batch.column("spans").to_pylist(), strict=True):
                words = (text or b"").split()
                if found:
                    own = _text_digest(text or b"")
                    gone = np.zeros(len(words) + 1, np.int64)
                    for x in found:
                        if x["own"] == own:
                            gone[x["low"]] += 1
                            gone[x["high"]] -= 1
                    stays = np.cumsum(gone)[:-1] == 0
                    words, n = [w for w, keep in zip(words, stays.tolist(), strict=True) if keep], len(words)
                else:
                    n = len(words)
                sizes.append(n)
                lost.append(n - len(words))
                kept.append(text if p.untouched and len(words) == n else b" ".join(words))
            columns = [batch.column("row"), pa.array(sizes, pa.int64()), pa.array(lost, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "n_words", "n_removed", "kept"])

    schema = T.StructType([joined.schema["row"], *(T.StructField(n, t) for n, t in (("n_words", T.LongType()), ("n_removed", T.LongType()), ("kept", T.StringType())))])
    return joined.mapInArrow(run, schema).select("row.*", "n_words", "n_removed", "kept")
