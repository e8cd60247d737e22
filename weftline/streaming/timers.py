"""Operators over streams that act without a new row: timers in event time end tracks and leases of silent keys.

They need the state store ``RocksDBStateStoreProvider`` (``spark.sql.streaming.stateStore.providerClass``). A key's rows of a
micro-batch are put in order of time, so bound a micro-batch by the source's options. A timer fires when the watermark, the
latest time of any key less ``late``, passes it. State ends with the timer, so silent keys cost nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from weftline.operators.folds import BoxTracks


def _type(df: DataFrame, column: str) -> str:
    return dict(df.dtypes)[column]


def _rows(schema: str) -> Row:
    """Makes rows with the names of a schema."""
    return Row(*(x.split()[0] for x in schema.split(", ")))


class _Timed(StatefulProcessor):
    """One timer a key, set to a time in milliseconds."""

    def init(self, handle) -> None:
        self.handle = handle

    def wake(self, at: int | None) -> None:
        for old in list(self.handle.listTimers()):
            if old != at:
                self.handle.deleteTimer(old)
        if at is not None:
            self.handle.registerTimer(at)

    def close(self) -> None:
        pass


def track_boxes(stream: DataFrame, keys: list[str], ts: str, late: str, idle_ms: int, least: float = 0.35, misses: int = 3, old: float = 0.6) -> DataFrame:
    """keys, id, track, hits, ended: the boxes (ts, id, x, y, w, h) of a stream with their tracks, and a row without id for each track that ends.

    A track ends after more than ``misses`` frames of its key without it, or when its key is silent for ``idle_ms``; then tracks
    are numbered anew. All boxes of a frame (a time of a key) have to come in one micro-batch. Frames come in order from
    micro-batch to micro-batch. The tracks are those of ``folds.track_boxes``.
    """

    schema = ", ".join([*(f"{k} {_type(stream, k)}" for k in keys), f"id {_type(stream, 'id')}", "track int, hits int, ended boolean"])
    made = _rows(schema)

    class Tracks(_Timed):
        def init(self, handle) -> None:
            super().init(handle)
            self.open = handle.getMapState("tracks", "track int", "x double, y double, w double, h double, hits int, misses int")
            self.made = handle.getValueState("made", "made int")

        def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
            tracks = BoxTracks(least, misses, old)
            for (n,), (x, y, w, h, hits, missed) in self.open.iterator():
                tracks.tracks[n] = [np.array([x, y, w, h]), hits, missed]
            tracks.tracks = dict(sorted(tracks.tracks.items()))
            tracks.made = self.made.get()[0] if self.made.exists() else 0
            known = set(tracks.tracks)
            ordered = sorted(rows, key=lambda r: (r[ts], r.id))
            for _, frame in groupby(ordered, key=lambda r: r[ts]):
                seen, ended = tracks.step([(r.id, np.array([r.x, r.y, r.w, r.h], float)) for r in frame])
                for unique, n, hits in seen:
                    yield made(*key, unique, n, hits, False)
                for n, hits in ended:
                    yield made(*key, None, n, hits, True)
            for n in known - set(tracks.tracks):
                self.open.removeKey((n,))
            for n, (box, hits, missed) in tracks.tracks.items():
                self.open.updateValue((n,), (*map(float, box), hits, missed))
            self.made.update((tracks.made,))
            self.wake(int(ordered[-1][ts].timestamp() * 1000) + idle_ms)

        def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
            for (n,), (*_, hits, _missed) in sorted(self.open.iterator()):
                yield made(*key, None, n, hits, True)
            self.open.clear()
            self.made.clear()

    return stream.withWatermark(ts, late).groupBy(*keys).transformWithState(Tracks(), schema, "append", "EventTime")


def leases(stream: DataFrame, key: str, ts: str, late: str, lease_ms: int, least_ms: int = 30_000) -> DataFrame:
    """key, t (milliseconds), action, token, accepted of claims, heartbeats and completions (ts, action, token) of jobs, and a row ``expired``
    for each lease that ends by itself.

    A lease lasts ``lease_ms``, at least ``least_ms``, from the claim or the last heartbeat. A claim is accepted if there is no lease or it
    is over; a heartbeat or completion only with the token of the last claim, even after its lease is over if nobody else
    has claimed. Nothing is accepted after completion. ``expired`` comes when the watermark passes the end, without any row of the job, or
    before the row that comes first.
    """
    length = max(lease_ms, least_ms)

    schema = f"{key} {_type(stream, key)}, t long, action string, token string, accepted boolean"
    made = _rows(schema)

    class Leases(_Timed):
        def init(self, handle) -> None:
            super().init(handle)
            self.state = handle.getValueState("lease", "token string, until long, done boolean, over boolean")

        def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
            token, until, done, over = self.state.get() if self.state.exists() else (None, -1, False, True)
            for r in sorted(rows, key=lambda r: r[ts]):
                t = int(r[ts].timestamp() * 1000)
                if not over and until <= t:
                    over = True
                    yield made(*key, until, "expired", token, True)
                ok = not done and (over if r.action == "claim" else token is not None and r.token == token)
                if ok:
                    done = r.action == "complete"
                    token, until, over = (None, -1, True) if done else (r.token, t + length, False)
                yield made(*key, t, r.action, r.token, ok)
            self.state.update((token, until, done, over))
            self.wake(None if over else until)

        def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
            token, until, done, over = self.state.get()
            if not over and until <= expiredTimerInfo.getExpiryTimeInMs():
                self.state.update((token, until, done, True))
                yield made(*key, until, "expired", token, True)

    return stream.withWatermark(ts, late).groupBy(key).transformWithState(Leases(), schema, "append", "EventTime")
