"""Operators with state over streams. The batch functions of ``operators`` say the same over finished tables.

The stateful ones keep a few numbers for each key. A key's rows of a micro-batch come in several Arrow frames; they are
gathered and put in order of time before they are folded, so bound a micro-batch by the source's
options. With ``idle_ms`` a key without rows for so long
is forgotten and begins anew: give it for streams that run on (a run over what is there now, ``availableNow``, would
wait for it without end).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

def sessions(stream: DataFrame, key: str, ts: str, gap: str, late: str) -> DataFrame:
    """key, start, end, n: sessions of events; events at exactly the gap still join, and end is the last event's time."""
    marked = stream.withWatermark(ts, late)
    found = marked.groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.min(ts).alias("start"), F.max(ts).alias("end"), F.count("*").alias("n"))
    return found.select(key, "start", "end", "n")


def tumbling(stream: DataFrame, keys: list[str], ts: str, width: str, late: str, value: str) -> DataFrame:
    """keys, start, n, total: fixed windows."""
    found = stream.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return found.select(*keys, F.col("w.start").alias("start"), "n", "total")


def _fold(stream: DataFrame, key: str, step: Callable, start: tuple, out: str, state: str, idle_ms: int | None) -> DataFrame:
    """Folds the rows of each key in order of t: step(state, row) gives the new state and a result row without its key, or None."""
    names = [x.split()[0] for x in out.split(", ")]

    def run(k: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            held.remove()
            return
        now, made = (held.get if held.exists else start), []
        for row in pd.concat(list(frames)).sort_values("t", kind="stable").itertuples():
            now, result = step(now, row)
            if result is not None:
                made.append((k[0], *result))
        held.update(now)
        if idle_ms is not None:
            held.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(made, columns=[key, *names])

    schema = f"{key} {dict(stream.dtypes)[key]}, {out}"
    return stream.groupBy(key).applyInPandasWithState(run, schema, state, "append", GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout)


def change_gate(stream: DataFrame, key: str, least_bits: int, idle_ms: int | None = None) -> DataFrame:
    """key, t, hash of events (t, hash, cut) that differ from the last one let through by at least ``least_bits`` bits, or cut the scene."""

    def step(state: tuple, row) -> tuple:
        seen, last = state
        bits = bin((last ^ int(row.hash)) & (2**64 - 1)).count("1") if seen else 64
        if bits >= least_bits or row.cut:
            return (True, int(row.hash)), (row.t, row.hash)
        return state, None

    return _fold(stream, key, step, (False, 0), f"t {dict(stream.dtypes)['t']}, hash long", "seen boolean, last long", idle_ms)


def rate_limit(stream: DataFrame, key: str, most: int, window: int, idle_ms: int | None = None) -> DataFrame:
    """key, t, allowed: at most ``most`` hits in a window that starts with its first hit; t and window in one unit."""

    def step(state: tuple, row) -> tuple:
        start, hits = state
        if hits == 0 or row.t - start >= window:
            start, hits = int(row.t), 0
        return (start, hits + 1), (row.t, hits + 1 <= most)

    return _fold(stream, key, step, (0, 0), f"t {dict(stream.dtypes)['t']}, allowed boolean", "start long, hits int", idle_ms)


def throttle(stream: DataFrame, key: str, least: int, rising: bool = True, idle_ms: int | None = None) -> DataFrame:
    """key, t, value: progress at least ``least`` after the last one let through and (``rising``) larger than it."""

    def step(state: tuple, row) -> tuple:
        seen, t, value = state
        if not seen or (row.t - t >= least and (not rising or row.value > value)):
            return (True, int(row.t), float(row.value)), (row.t, row.value)
        return state, None

    return _fold(stream, key, step, (False, 0, 0.0), f"t {dict(stream.dtypes)['t']}, value double", "seen boolean, last long, value double", idle_ms)


def spaced_cuts(stream: DataFrame, key: str, least: int, idle_ms: int | None = None) -> DataFrame:
    """key, t: times at least ``least`` after the last one kept."""
    counted = stream.withColumn("value", F.lit(0.0))
    return throttle(counted, key, least, rising=False, idle_ms=idle_ms).select(key, "t")


def leases(stream: DataFrame, key: str, lease: int, idle_ms: int | None = None) -> DataFrame:
    """key, t, action, accepted: claims, heartbeats and completions of jobs as a state machine.

    Events have t, action (claim, heartbeat, complete) and token. A claim is accepted if there is no
    lease or it is over; the other actions only with the token of the lease. A job that is complete
    accepts nothing.
    """

    def step(state: tuple, row) -> tuple:
        token, until, done = state
        if done:
            ok = False
        elif row.action == "claim":
            ok = token == "" or until < row.t
        else:
            ok = token != "" and row.token == token
        if ok:
            done = row.action == "complete"
            token, until = ("", -1) if done else (row.token, int(row.t) + lease)
        return (token, until, done), (row.t, row.action, ok)

    return _fold(stream, key, step, ("", -1, False), f"t {dict(stream.dtypes)['t']}, action string, accepted boolean", "token string, until long, done boolean", idle_ms)
