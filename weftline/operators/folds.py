"""Operators whose next step depends on what they have put out so far.

Spark deals the rows out by key and sorts them; a small Python generator then reads each key's rows one after the
other and gives its results as it goes. It holds only its state (the open caption, the tracks, the sums), never a
recording, so a very long one costs time but no memory. Values are Python's: a null is None, a long stays a whole number.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from difflib import SequenceMatcher
from itertools import groupby
from operator import itemgetter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Result rows that a task gathers before it hands them on.
CHUNK = 10_000


def _row_type(names: list[str]) -> type:
    """A tuple whose values have the names of the columns."""
    return type("Row", (tuple,), {"__slots__": (), **{n: property(itemgetter(k)) for k, n in enumerate(names)}})


def per_key(df: DataFrame, keys: list[str], order: list[str | Column], fold: Callable[[Iterator], Iterator[tuple]], schema: str) -> DataFrame:
    """keys and the results of the fold over the rows of each key in order. Rows with a null in a key are a group like others."""
    types = dict(df.dtypes)
    result = ", ".join([*(f"`{k}` {types[k]}" for k in keys), schema])
    kinds = to_arrow_schema(StructType.fromDDL(result))
    places = [df.columns.index(k) for k in keys]

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator:
        for batch in batches:
            made = _row_type(batch.schema.names)
            yield from map(made, zip(*(c.to_pylist() for c in batch.columns), strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type, from_pandas=True) for c, f in zip(zip(*held, strict=True), kinds, strict=True)], names=kinds.names)

        for key, rows in groupby(rows_of(batches), key=lambda r: tuple(r[k] for k in places)):
            for made in fold(rows):
                held.append((*key, *made))
                if len(held) >= CHUNK:
                    yield out()
                    held = []
        if held:
            yield out()

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, result)


def ratio(a: str, b: str, least: float = 0.0) -> float:
    """Ratcliff-Obershelp ratio; a bound below it, if that already says that it is under ``least``."""
    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    match = SequenceMatcher(None, a, b)
    for bound in (match.real_quick_ratio, match.quick_ratio):
        if bound() < least:
            return 0.0
    return match.ratio()


def spaced(df: DataFrame, keys: list[str], t: str, least, more: list[str] = []) -> DataFrame:  # noqa: B006
    """keys, t and ``more``: the first row of each key and then every row at least ``least`` after the last one kept. Holds one time a key."""
    types = dict(df.dtypes)

    def fold(rows: Iterator) -> Iterator[tuple]:
        last = None
        for r in rows:
            now = getattr(r, t)
            if last is None or now - last >= least:
                last = now
                yield (now, *(getattr(r, c) for c in more))

    return per_key(df.select(*keys, t, *more), keys, [t], fold, ", ".join(f"{c} {types[c]}" for c in (t, *more)))


def disjoint(df: DataFrame, keys: list[str], pad, unique: str) -> DataFrame:
    """keys, start, end: intervals in order of (start, end, unique), each if it begins ``pad`` or more after the end of the last one kept."""
    types = dict(df.dtypes)

    def fold(rows: Iterator) -> Iterator[tuple]:
        reach = None
        for r in rows:
            if reach is None or r.start >= reach + pad:
                reach = r.end
                yield r.start, r.end

    return per_key(df.select(*keys, "start", "end", unique), keys, ["start", "end", unique], fold, f"start {types['start']}, end {types['end']}")


@dataclass(frozen=True)
class CaptionParams:
    gap: float = 0.55
    longest: float = 14.0
    least_chars: int = 24
    most_chars: int = 220


def captions(words: DataFrame, keys: list[str], p: CaptionParams = CaptionParams()) -> DataFrame:
    """keys, start, end, text from words (start, end, text, speaker, kind): a caption ends at a pause, another speaker, when it is long, or at a sound."""

    def fold(rows: Iterator) -> Iterator[tuple]:
        text, start, end, speaker = "", None, None, None
        caption = lambda: (max(0.0, start), max(start + 0.05, end), " ".join(text.split()))
        for r in rows:
            token = (r.text or "").strip()
            if not token:
                continue
            a = None if pd.isna(r.start) else float(r.start)
            b = None if pd.isna(r.end) else float(r.end)
            who = r.speaker if isinstance(r.speaker, str) and r.speaker else None
            if start is not None:
                long = b is not None and b - start > p.longest and len(text) >= p.least_chars
                apart = a is not None and a - end > p.gap
                if apart or (who and speaker and who != speaker) or long or len(text) >= p.most_chars or r.kind == "audio_event":
                    yield caption()
                    start = None
            if start is None:
                start = a if a is not None else 0.0
                end = b if b is not None else start
                speaker, text = who, token
                continue
            start = min(start, a) if a is not None else start
            end = max(end, b) if b is not None else end
            speaker = speaker or who
            text += token if token[0] in ",.;:!?)]}" or text[-1] in "([{" else f" {token}"
        if start is not None:
            yield caption()

    return per_key(words, keys, [F.col("start").asc_nulls_last(), F.col("end").asc_nulls_last()], fold, "start double, end double, text string")


@dataclass(frozen=True)
class MergeParams:
    gap: float = 6.0
    ratio: float = 0.88
    bits: int = 4


def merge_similar(events: DataFrame, keys: list[str], p: MergeParams = MergeParams()) -> DataFrame:
    """keys, number, start, end, text, hash, confidence, n: events in a row join if their text or hash is near that of the merged event so far.

    Events have start, end, text (normalised), hash, confidence. The merged event keeps its first hash
    and the text of the surest member.
    """

    def fold(rows: Iterator) -> Iterator[tuple]:
        now, number = None, 0  # [start, end, text, hash, confidence, n]
        for r in rows:
            if now is not None and r.start - now[1] <= p.gap:
                bits = bin((int(now[3]) ^ int(r.hash)) & (2**64 - 1)).count("1")
                if bits <= p.bits or ratio(now[2], r.text, p.ratio) >= p.ratio:
                    now[1] = max(now[1], r.end)
                    if r.confidence > now[4]:
                        now[2], now[4] = r.text, r.confidence
                    now[5] += 1
                    continue
            if now is not None:
                yield number, *now
            now, number = [r.start, r.end, r.text, r.hash, r.confidence, 1], number + 1
        if now is not None:
            yield number, *now

    return per_key(events, keys, ["start", "end"], fold, "number int, start double, end double, text string, hash long, confidence double, n int")


@dataclass(frozen=True)
class DuplicateParams:
    strict: int = 2
    near: int = 5
    ratio: float = 0.88


class _Blocks:
    """Finds the 64-bit hashes within ``near`` bits of one: cut into one block more than that, they agree in a block at least."""

    def __init__(self, near: int):
        edges = [64 * k // (near + 1) for k in range(near + 2)]
        self.blocks = [(a, (1 << (b - a)) - 1) for a, b in zip(edges, edges[1:])]
        self.found: dict[tuple[int, int], list[int]] = {}
        self.hashes: list[int] = []

    def add(self, hash_: int) -> int:
        """The number of a new hash."""
        n = len(self.hashes)
        self.hashes.append(hash_)
        for k, (a, mask) in enumerate(self.blocks):
            self.found.setdefault((k, hash_ >> a & mask), []).append(n)
        return n

    def sharing(self, hash_: int) -> list[int]:
        """Numbers of the hashes that share a block, in order."""
        return sorted({n for k, (a, mask) in enumerate(self.blocks) for n in self.found.get((k, hash_ >> a & mask), ())})


def duplicate_groups(events: DataFrame, keys: list[str], p: DuplicateParams = DuplicateParams()) -> DataFrame:
    """keys, id, leader, group, is_representative: each event joins the best earlier group of its type whose first member is near.

    Near: hash within ``strict`` bits, or within ``near`` bits with similar texts. Best: 64 - bits + 20 *
    ratio, first on ties. The representative is the surest, then longest, then earliest member. Only first members that share a
    block of the hash are looked at; the widest distance leaves no other near. An event without a hash has hash 0.
    """

    def fold(rows: Iterator) -> Iterator[tuple]:
        widest = max(p.near, p.strict)
        types: dict[str | None, tuple[_Blocks, list]] = {}  # of each type: the first members' hashes, and (group, text, id)
        made = 0
        for r in rows:
            best, score = None, -1.0
            if r.type not in types:
                types[r.type] = _Blocks(widest), []
            blocks, firsts = types[r.type]
            hash_ = int(r.hash or 0) & (2**64 - 1)
            for n in blocks.sharing(hash_):
                bits = (blocks.hashes[n] ^ hash_).bit_count()
                if bits > widest or 64 - bits + 20 <= score:
                    continue
                least = 0.0 if bits <= p.strict else p.ratio
                alike = ratio(firsts[n][1], r.text, max(least, (score - 64 + bits) / 20))
                if (bits <= p.strict or bits <= p.near and alike >= p.ratio) and 64 - bits + 20 * alike > score:
                    best, score = firsts[n], 64 - bits + 20 * alike
            if best is None:
                made += 1
                best = (made, r.text, r.id)
                firsts.append(best)
                blocks.add(hash_)
            yield r.id, best[2], best[0], r.confidence, len(r.text or ""), float(r.start)

    found = per_key(events, keys, ["start", "id"], fold, "id long, leader long, group int, _sure double, _size int, _start double")
    first = F.row_number().over(W.partitionBy(*keys, "group").orderBy(F.desc("_sure"), F.desc("_size"), "_start", "id")) == 1
    return found.withColumn("is_representative", first).drop("_sure", "_size", "_start")


def fuse(observations: DataFrame, keys: list[str], track: str, least: int = 2, alike: float = 0.84) -> DataFrame:
    """keys, track, text, confidence, n, start, end: the largest cluster of similar texts of each track, its surest text and average confidence."""

    def fold(rows: Iterator) -> Iterator[tuple]:
        clusters: list[list] = []  # first text, text, confidence and size of the surest, sum of confidences, n, start, end
        seen = 0
        for r in rows:
            seen += 1
            home = next((c for c in clusters if ratio(c[0], r.text, alike) >= alike), None)
            if home is None:
                home = [r.text, r.text, (r.confidence, len(r.text)), 0.0, 0, r.start, r.end]
                clusters.append(home)
            if (r.confidence, len(r.text)) > home[2]:
                home[1], home[2] = r.text, (r.confidence, len(r.text))
            home[3], home[4] = home[3] + r.confidence, home[4] + 1
            home[5], home[6] = min(home[5], r.start), max(home[6], r.end)
        if seen >= least:
            big = max(clusters, key=lambda c: c[4])
            yield big[1], big[3] / big[4], big[4], big[5], big[6]

    return per_key(observations, [*keys, track], ["start", "end"], fold, "text string, confidence double, n int, start double, end double")


def online_centroids(hits: DataFrame, keys: list[str], least: float = 0.48) -> DataFrame:
    """keys, id, cluster: each vector (id, t, vector) in order of time joins the nearest running mean by cosine, or starts one."""

    def fold(rows: Iterator) -> Iterator[tuple]:
        sums: list[np.ndarray] = []
        for r in rows:
            v = np.asarray(r.vector, float)
            best, score = None, -2.0
            for k, s in enumerate(sums):
                size = np.linalg.norm(s) * np.linalg.norm(v)
                c = float(s @ v / size) if size > 0 else -1.0
                if c > score:
                    best, score = k, c
            if best is None or score < least:
                sums.append(v.copy())
                best = len(sums) - 1
            else:
                sums[best] = sums[best] + v
            yield r.id, best

    return per_key(hits, keys, ["t", "id"], fold, "id long, cluster int")


def _iou(a, b) -> float:
    wide = max(0, min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0]))
    high = max(0, min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1]))
    union = a[2] * a[3] + b[2] * b[3] - wide * high
    return wide * high / union if union > 0 else 0.0


def suppress_boxes(boxes: DataFrame, keys: list[str], most: float = 0.25) -> DataFrame:
    """keys, id: boxes (id, t, x, y, w, h, score) kept from the best of their time down if they overlap none kept by ``most`` or more."""

    def fold(rows: Iterator) -> Iterator[tuple]:
        for _, boxes_ in groupby(rows, key=lambda r: r.t):
            kept: list = []
            for r in boxes_:
                if all(_iou((r.x, r.y, r.w, r.h), k) < most for k in kept):
                    kept.append((r.x, r.y, r.w, r.h))
                    yield (r.id,)

    return per_key(boxes, keys, ["t", F.desc("score"), "id"], fold, "id long")


class BoxTracks:
    """Open tracks of boxes, by number: [box, hits, misses]. Boxes of a time match them greedily by overlap."""

    def __init__(self, least: float = 0.35, misses: int = 3, old: float = 0.6):
        self.least, self.most, self.old = least, misses, old
        self.tracks: dict[int, list] = {}
        self.made = 0

    def step(self, found: list[tuple]) -> tuple[list[tuple], list[tuple]]:
        """id, track, hits of the boxes (id, box) of one time, in order; track, hits of the tracks that end with it."""
        pairs = sorted(((_iou(b, s[0]), -n, -k) for k, (_, b) in enumerate(found) for n, s in self.tracks.items()), reverse=True)
        used: dict[int, int] = {}
        for value, n, k in pairs:
            if value >= self.least and -k not in used and -n not in used.values():
                used[-k] = -n
        ended = []
        for n in [n for n in self.tracks if n not in used.values()]:
            self.tracks[n][2] += 1
            if self.tracks[n][2] > self.most:
                ended.append((n, self.tracks.pop(n)[1]))
        rows = []
        for k, (unique, box) in enumerate(found):
            if k in used:
                s = self.tracks[used[k]]
                s[0], s[1], s[2] = self.old * s[0] + (1 - self.old) * box, s[1] + 1, 0
            else:
                self.made += 1
                used[k] = self.made
                self.tracks[self.made] = [box, 1, 0]
            rows.append((unique, used[k], self.tracks[used[k]][1]))
        return rows, ended


def track_boxes(boxes: DataFrame, keys: list[str], least: float = 0.35, misses: int = 3, old: float = 0.6) -> DataFrame:
    """keys, id, track, hits: boxes of each time match open tracks greedily by overlap; a track ends after more than ``misses`` misses."""

    def fold(rows: Iterator) -> Iterator[tuple]:
        tracks = BoxTracks(least, misses, old)
        for _, frame in groupby(rows, key=lambda r: r.t):
            yield from tracks.step([(r.id, np.array([r.x, r.y, r.w, r.h], float)) for r in frame])[0]

    return per_key(boxes, keys, ["t", "id"], fold, "id long, track int, hits int")


def smooth(points: DataFrame, keys: list[str], alpha: float = 0.35, both_ways: bool = True) -> DataFrame:
    """keys, t, x: exponential average of points (t, x; one for each t) seeded with the first; both ways: averaged with the same from the end."""

    def fold(rows: Iterator) -> Iterator[tuple]:
        x = None
        for r in rows:
            x = float(r.x) if x is None else (1 - alpha) * x + alpha * float(r.x)
            yield r.t, x

    schema = f"t {dict(points.dtypes)['t']}, x double"
    ahead = per_key(points, keys, ["t"], fold, schema)
    if not both_ways:
        return ahead
    back = per_key(points, keys, [F.desc("t")], fold, schema).withColumnRenamed("x", "_back")
    return ahead.join(back, [*keys, "t"]).withColumn("x", (F.col("x") + F.col("_back")) / 2).drop("_back")


def simplify(points: DataFrame, keys: list[str], tolerance: float) -> DataFrame:
    """keys, t, x: the points of a line that it needs to stay within ``tolerance`` (Ramer-Douglas-Peucker)."""

    def fold(rows: Iterator) -> Iterator[tuple]:
        own = [(r.t, float(r.x)) for r in rows]  # the farthest point of a whole stretch decides, so this one needs the path
        t, x = np.array([a for a, _ in own], float), np.array([b for _, b in own])
        keep, spans = {0, len(t) - 1}, [(0, len(t) - 1)]
        while spans:
            a, b = spans.pop()
            if b - a < 2:
                continue
            line = x[a] + (x[b] - x[a]) * (t[a + 1 : b] - t[a]) / max(t[b] - t[a], 1e-12)
            off = np.abs(x[a + 1 : b] - line)
            k = int(off.argmax()) + a + 1
            if off[k - a - 1] > tolerance:
                keep.add(k)
                spans += [(a, k), (k, b)]
        for k in sorted(keep):
            yield own[k]

    return per_key(points, keys, ["t"], fold, f"t {dict(points.dtypes)['t']}, x double")


@dataclass(frozen=True)
class MotionParams:
    """step: largest move from one point to the next. dead: moves within this are none. hold: points for which a new direction has to last."""

    step: float = 40.0
    dead: float = 6.0
    hold: int = 2


def limit_motion(points: DataFrame, keys: list[str], p: MotionParams = MotionParams()) -> DataFrame:
    """keys, t, x: a follower of points (t, x) with a dead band, a direction that has to last, and a largest step."""

    def fold(rows: Iterator) -> Iterator[tuple]:
        at, direction, lasted = None, 0, 0
        for r in rows:
            if at is None:
                at = float(r.x)
            else:
                move = float(r.x) - at
                sign = 0 if abs(move) <= p.dead else (1 if move > 0 else -1)
                lasted = lasted + 1 if sign == direction else 1
                direction = sign
                at += max(-p.step, min(p.step, move)) if sign != 0 and lasted >= p.hold else 0.0
            yield r.t, at

    return per_key(points, keys, ["t"], fold, f"t {dict(points.dtypes)['t']}, x double")


@dataclass(frozen=True)
class GateParams:
    enter: float = 0.5
    stay: float = 0.35
    cut_boost: float = 0.1
    probe_every: int = 10


def hysteresis(samples: DataFrame, keys: list[str], p: GateParams = GateParams()) -> DataFrame:
    """keys, t, selected, forced: samples (t, score, cut) are taken above a threshold that is lower while the last one was taken; every n-th is forced."""

    def fold(rows: Iterator) -> Iterator[tuple]:
        on = False
        for k, r in enumerate(rows, 1):
            value = r.score + (p.cut_boost if r.cut else 0.0)
            forced = k % p.probe_every == 0
            on = value >= (p.stay if on else p.enter)
            yield r.t, bool(on or forced), forced

    return per_key(samples, keys, ["t"], fold, f"t {dict(samples.dtypes)['t']}, selected boolean, forced boolean")


@dataclass(frozen=True)
class RegionParams:
    """threshold: least score of a region, less ``cut_boost`` in a sample with a cut and times ``relax`` if it was taken in the sample before.
    probe_every: each n-th sample takes its best region if it would take none. most: regions of a sample."""

    threshold: float = 0.5
    cut_boost: float = 0.1
    relax: float = 0.7
    probe_every: int = 10
    most: int = 2


def region_gate(samples: DataFrame, keys: list[str], p: RegionParams = RegionParams()) -> DataFrame:
    """keys, t, region, forced of the regions taken from each sample (t, region, score, cut): the best ones above a threshold that is lower while
    a region is taken. Of equal scores the first region by name goes first."""

    def fold(rows: Iterator) -> Iterator[tuple]:
        before: set[str] = set()
        for k, (t, frame) in enumerate(groupby(rows, key=lambda r: r.t), 1):
            regions = list(frame)
            least = max(0.0, p.threshold - (p.cut_boost if any(r.cut for r in regions) else 0.0))
            taken = [r for r in regions if r.score >= (least * p.relax if r.region in before else least)]
            forced = not taken and k % p.probe_every == 0
            taken = sorted(regions if forced else taken, key=lambda r: (-r.score, r.region))[: 1 if forced else p.most]
            before = {r.region for r in taken}
            for r in sorted(taken, key=lambda r: r.region):
                yield t, r.region, forced

    return per_key(samples, keys, ["t", "region"], fold, f"t {dict(samples.dtypes)['t']}, region string, forced boolean")


@dataclass(frozen=True)
class RescueParams:
    bucket: float = 300.0
    window: float = 60.0
    per_anchor: int = 2
    most: int = 30
    score: float = 0.44
    text: float = 0.42


def rescue_neighbours(candidates: DataFrame, keys: list[str], p: RescueParams = RescueParams()) -> DataFrame:
    """keys, id: candidates not picked that follow a picked one of their bucket closely and are good, best by text first, anchors in order of time.

    Candidates have id, start, end, score, text_score, priority, picked.
    """

    def fold(rows: Iterator) -> Iterator[tuple]:
        taken = 0
        for _, bucket in groupby(rows, key=lambda r: int(max(r.start, 0.0) // p.bucket)):
            own = list(bucket)
            free = {r.id: r for r in own if not r.picked and r.score >= p.score and r.text_score >= p.text}
            for a in (r for r in own if r.picked):
                near = [r for r in free.values() if a.end <= r.start <= a.end + p.window]
                near.sort(key=lambda r: (-r.text_score, -r.score, -r.priority, r.start))
                for r in near[: p.per_anchor]:
                    del free[r.id]
                    taken += 1
                    if taken > p.most:
                        return
                    yield (r.id,)

    return per_key(candidates, keys, ["start", "id"], fold, "id long")


def relabel(sections: DataFrame, keys: list[str]) -> DataFrame:
    """keys, id, type: music sections that sound like speech become sermon next to a sermon (the one before as relabelled already), else other.

    Sections have id, start, type, music, speech, song_cue.
    """

    def fold(rows: Iterator) -> Iterator[tuple]:
        before, now = None, next(rows, None)
        while now is not None:
            after, kind = next(rows, None), now.type
            if kind == "congregational_music" and now.music < 0.12 and now.speech > 0.7 and not now.song_cue:
                kind = "sermon" if before == "sermon" or (after is not None and after.type == "sermon") else "other"
            yield now.id, kind
            before, now = kind, after

    return per_key(sections, keys, ["start", "id"], fold, "id long, type string")
