"""Paths of a camera: points (t in whole milliseconds, x from 0 to 1) of each key, made calm by folds that hold a few points.

All operators read ``points`` with the columns of ``keys``, t and x (one point for each t) and give keys, t, x.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.operators.folds import per_key

_POINT = "t long, x double"


def _within(x: float, low: float, high: float) -> float:
    return max(low, min(high, x))


Spot = tuple[int, float]


def _between(a: Spot, b: Spot, t: int) -> float:
    """The place at t on the line from a to b."""
    return b[1] if t >= b[0] else a[1] + (b[1] - a[1]) * ((t - a[0]) / (b[0] - a[0]))


def _spots(rows: Iterator) -> Iterator[Spot]:
    return ((int(r.t), float(r.x)) for r in rows)


def _sampled(spots: Iterator[Spot], step: int) -> Iterator[Spot]:
    """The path every ``step`` from its first point on, and its last point."""
    a = next(spots)
    yield a
    at = a[0] + step
    for b in spots:
        while at <= b[0]:
            yield at, _between(a, b, at)
            at += step
        a = b
    if at - step < a[0]:
        yield a


def limit_speed(points: DataFrame, keys: list[str], speed: float = 0.05, acceleration: float = 0.03) -> DataFrame:
    """Follows the points at a speed (a second) that changes by at most ``acceleration`` (a second) and stays within ``speed``."""

    def fold(rows: Iterator) -> Iterator[tuple]:
        t = x = None
        v = 0.0
        for r in rows:
            if t is None:
                x = float(r.x)
            else:
                dt = max(1e-4, (r.t - t) / 1000)
                want = (float(r.x) - x) / dt
                v = _within(_within(want, v - acceleration * dt, v + acceleration * dt), -speed, speed)
                x = _within(x + v * dt, 0.0, 1.0)
            t = r.t
            yield int(t), x

    return per_key(points, keys, ["t"], fold, _POINT)


@dataclass(frozen=True)
class FollowParams:
    """step: milliseconds between results. ahead: how far in front the target lies. pull, damp: of a spring. speed, acceleration: largest."""

    step: int = 100
    ahead: int = 1200
    pull: float = 7.0
    damp: float = 4.0
    speed: float = 0.05
    acceleration: float = 0.06


def follow(points: DataFrame, keys: list[str], p: FollowParams = FollowParams()) -> DataFrame:
    """A head that is drawn like a spring to where the path will be, from time 0 to the last point. It holds two points of the path."""

    def fold(rows: Iterator) -> Iterator[tuple]:
        a = b = next(rows)

        def reach(t: float) -> bool:
            """Reads on until a point lies at t or behind; whether there was one."""
            nonlocal a, b
            while b.t <= t:
                following = next(rows, None)
                if following is None:
                    return b.t >= t
                a, b = b, following
            return True

        def at(t: float) -> float:
            if t <= a.t or a is b:
                return float(a.x)
            if t >= b.t:
                return float(b.x)
            return float(a.x + (b.x - a.x) * ((t - a.t) / max(1e-6, b.t - a.t)))

        t, x, v, dt = 0, float(a.x), 0.0, p.step / 1000
        yield t, x
        while True:
            target = t + p.step + p.ahead
            if not reach(target):  # the path ends before the target
                if t >= b.t:
                    return
                target = min(int(b.t), min(int(b.t), t + p.step) + p.ahead)
            v = _within(v + _within(p.pull * (at(target) - x) - p.damp * v, -p.acceleration, p.acceleration) * dt, -p.speed, p.speed)
            x = _within(x + v * dt, 0.0, 1.0)
            t = min(t + p.step, int(b.t))
            yield t, x

    return per_key(points, keys, ["t"], fold, _POINT)


@dataclass(frozen=True)
class OptimizeParams:
    """step: milliseconds between points. velocity, acceleration, jerk: weights of the squares of first, second and third differences."""

    step: int = 80
    velocity: float = 0.2
    acceleration: float = 1.2
    jerk: float = 0.6


#: Signs and sizes of the first three differences.
_DIFFERENCES = ((-1.0, 1.0), (1.0, -2.0, 1.0), (-1.0, 3.0, -3.0, 1.0))
_BAND = 3


def optimize(points: DataFrame, keys: list[str], p: OptimizeParams = OptimizeParams()) -> DataFrame:
    """The path with the same ends that is least in the squares of its distances from the points and of its differences.

    A point on the grid meets only three on each side, so the linear system has seven diagonals. One fold factors it from the
    first point on and hands on three numbers a point, another one solves it from the last point back; each holds four
    points, so the path can have any length. The result is kept within 0 and 1.
    """
    weights = (p.velocity, p.acceleration, p.jerk)

    def entry(i: int, j: int, last: int | None) -> float:
        """What row i of the system has in column j >= i; last: number of the last point, if it is near."""
        total = float(i == j)
        for weight, signs in zip(weights, _DIFFERENCES):
            m = len(signs) - 1
            for s in range(max(0, j - m), i + 1):
                if last is None or s + m <= last:
                    total += weight * signs[i - s] * signs[j - s]
        return total

    def ahead(rows: Iterator) -> Iterator[tuple]:
        spots = _sampled(_spots(rows), p.step)
        near = deque(islice(spots, _BAND + 2))  # the point and what follows it: one more than its row of the system meets
        first = near[0][1]
        done: deque[tuple[float, list[float], float]] = deque(maxlen=_BAND)  # pivot, factors to the points before, right side
        i = 0
        while near:
            last = i + len(near) - 1 if len(near) < _BAND + 2 else None
            (t, value), fixed = near[0], i in (0, last)
            factors, pivot = [0.0] * _BAND, 1.0
            if not fixed:
                coupled = [entry(i - k, i, last) for k in range(1, min(i, _BAND) + 1)]
                if i <= _BAND:  # the ends stay, so what they couple to is known
                    value -= coupled.pop() * first
                if last is not None:
                    value -= entry(i, last, last) * near[-1][1]
                pivot = entry(i, i, last)
                for k in range(len(coupled), 0, -1):
                    d, own, _ = done[-k]
                    rest = coupled[k - 1] - sum(factors[m - 1] * done[-m][0] * own[m - k - 1] for m in range(k + 1, len(coupled) + 1))
                    factors[k - 1] = rest / d
                for k in range(1, len(coupled) + 1):
                    d, _, before = done[-k]
                    pivot -= factors[k - 1] ** 2 * d
                    value -= factors[k - 1] * before
            done.append((pivot, factors, value))
            yield t, value / pivot, *factors, fixed
            near.popleft()
            near.extend(islice(spots, 1))
            i += 1

    def back(rows: Iterator) -> Iterator[tuple]:
        behind: deque[tuple[float, list[float]]] = deque(maxlen=_BAND)  # nearest first
        for r in rows:
            x = float(r.x) if r.fixed else float(r.x) - sum(f[k] * y for k, (y, f) in enumerate(behind))
            behind.appendleft((0.0 if r.fixed else x, [r.f1, r.f2, r.f3]))
            yield int(r.t), _within(x, 0.0, 1.0)

    factored = per_key(points, keys, ["t"], ahead, "t long, x double, f1 double, f2 double, f3 double, fixed boolean")
    return per_key(factored, keys, [F.desc("t")], back, _POINT)


@dataclass(frozen=True)
class RampParams:
    """threshold: moves within it are none. confirm: milliseconds for which a move has to last. ramp: length of the way there. step: between its points."""

    threshold: float = 0.03
    confirm: int = 300
    ramp: int = 900
    step: int = 100


def hold_and_ramp(points: DataFrame, keys: list[str], p: RampParams = RampParams()) -> DataFrame:
    """keys, n, t, x: stands still until the points have left it for a while, then goes to where they first went along a smooth ramp.

    n numbers the results: points that come while a ramp is laid follow it although they are earlier, as they start from its end.
    """

    def fold(rows: Iterator) -> Iterator[tuple]:
        at = since = target = None
        n = 0
        for r in rows:
            t, x = int(r.t), float(r.x)
            at = x if at is None else at
            if abs(x - at) <= p.threshold:
                since = None
            elif since is None:
                since, target = t, x
            elif t - since >= p.confirm:
                for k in range(p.ramp // p.step + 1):
                    u = k * p.step / p.ramp
                    yield n, t + k * p.step, at + (target - at) * (u * u * (3 - 2 * u))
                    n += 1
                at, since = target, None
                continue
            yield n, t, at
            n += 1

    return per_key(points, keys, ["t"], fold, "n long, t long, x double")


def keyframes(points: DataFrame, keys: list[str], spacing: int = 1500, move: float = 0.012, longest: int = 4000) -> DataFrame:
    """The path every ``spacing`` milliseconds where it moved by ``move`` since the last key point or that is ``longest`` ago, and its ends."""

    def fold(rows: Iterator) -> Iterator[tuple]:
        spots = _sampled(_spots(rows), spacing)
        t, x = next(spots)
        yield t, x
        now = next(spots, None)
        while now is not None:
            following = next(spots, None)
            part = 1.0 if following is not None else 0.5
            moved = abs(now[1] - x) >= move * part or now[0] - t >= max(spacing, longest) * part
            if moved:
                t, x = now
            if moved or following is None:
                yield now[0], x
            now = following

    return per_key(points, keys, ["t"], fold, _POINT)


def _with_cuts(rows: Iterator, least: int) -> Iterator[tuple[int, float, bool]]:
    """t, x and whether to cut there, of rows (t, x, cut) in order, of which those without x are cuts between two points.

    A cut stays if it lies ``least`` or more behind the start (0) or the last one, and a point ``least`` or more behind it. So it waits for that
    point; only the rows since then are held.
    """
    before, held = 0, deque()
    for r in rows:
        cut = bool(r.cut) and r.t > 0 and r.t - before >= least
        before = int(r.t) if cut else before
        held.append((int(r.t), None if r.x is None else float(r.x), cut))
        while held and r.x is not None and not (held[0][2] and r.t - held[0][0] < least):
            yield held.popleft()
    yield from ((t, x, False) for t, x, _ in held)


def _filled(rows: Iterator[tuple[int, float | None, bool]]) -> Iterator[tuple[int, float, bool]]:
    """Rows without x get the place of the path there; those behind the last point are left out."""
    last, held = None, []
    for t, x, cut in rows:
        if x is None:
            held.append((t, cut))
            continue
        for at, c in held:
            yield at, x if last is None else _between(last, (t, x), at), c
        yield t, x, cut
        last, held = (t, x), []


def smooth_between_cuts(points: DataFrame, cuts: DataFrame, keys: list[str], least: int = 600, step: int = 50, alpha: float = 0.2) -> DataFrame:
    """The path on a grid of ``step``, averaged forward and back again, anew from each cut (t) on.

    The path is split at the cuts that are ``least`` apart, and from its start and end; both pieces get its place at the cut. Times lie on
    a grid from the start of each piece; where two pieces have one, the earlier piece counts.
    """
    spots = points.select(*keys, F.col("t").cast("long").alias("t"), F.col("x").cast("double").alias("x"), F.lit(False).alias("cut"))
    marks = cuts.select(*keys, F.col("t").cast("long").alias("t"), F.lit(None).cast("double").alias("x"), F.lit(True).alias("cut"))
    rows = spots.unionByName(marks).groupBy(*keys, "t").agg(F.max("x").alias("x"), F.max("cut").alias("cut"))

    def ahead(rows: Iterator) -> Iterator[tuple]:
        """Grid points of each piece, averaged forward; twice: the piece before has one at this time too."""
        piece, last, at, y = 0, None, 0, 0.0
        for t, x, cut in _filled(_with_cuts(rows, least)):
            if last is None:
                at, y = t, x
            while at <= t:
                place = x if at == t else _between(last, (t, x), at)
                y = alpha * place + (1 - alpha) * y
                yield piece, at, y, False
                at += step
            if cut and last is not None:
                twice = at - step == t
                piece, at, y = piece + 1, t + step, x
                yield piece, t, y, twice
            last = (t, x)

    def back(rows: Iterator) -> Iterator[tuple]:
        y = None
        for r in rows:
            y = float(r.y) if y is None else alpha * float(r.y) + (1 - alpha) * y
            if not r.twice:
                yield int(r.t), _within((y + float(r.y)) * 0.5, 0.0, 1.0)

    smoothed = per_key(rows, keys, ["t"], ahead, "piece long, t long, y double, twice boolean")
    return per_key(smoothed, [*keys, "piece"], [F.desc("t")], back, _POINT).select(*keys, "t", "x")


class _Median:
    """The middle (the upper one of two) of the last n values, in order of size and of arrival."""

    def __init__(self, n: int):
        self.n, self.order, self.arrived = n, [], deque()

    def add(self, x: float) -> float:
        self.arrived.append(x)
        insort(self.order, x)
        if len(self.arrived) > self.n:
            del self.order[bisect_left(self.order, self.arrived.popleft())]
        return self.order[len(self.order) // 2]


def scene_median(points: DataFrame, keys: list[str], n: int = 5) -> DataFrame:
    """The median (upper of two) of the last n points (t, x, cut) of a scene, which begins anew at each cut."""

    def fold(rows: Iterator) -> Iterator[tuple]:
        seen = _Median(n)
        for r in rows:
            if r.cut:
                seen = _Median(n)
            yield int(r.t), seen.add(float(r.x))

    return per_key(points, keys, ["t"], fold, _POINT)


@dataclass(frozen=True)
class SteadyParams:
    """target, weight: points are drawn to target by 1 - weight. window: seconds between points. rate, fast_rate: largest move a second,
    and after a cut for ``fast`` milliseconds. dead, hysteresis: moves within are none, and don't turn. hold: points for
    which a direction has to last. scene: points of the median that is held after a cut."""

    target: float = 0.5
    weight: float = 0.7
    window: float = 1.0
    rate: float = 0.08
    fast_rate: float = 0.12
    fast: int = 1500
    dead: float = 0.015
    hysteresis: float = 0.03
    hold: int = 2
    scene: int = 5


def steady(points: DataFrame, keys: list[str], p: SteadyParams = SteadyParams()) -> DataFrame:
    """Follows points (t, x, cut) with a largest step, a dead band and a direction that has to last; from a cut on it holds the median of its
    own last places."""
    first = round(1 - p.weight, 12)  # the decimal 0.3 for 0.7, where 1 - 0.7 is a bit more: moves on the border of the dead band tell them apart

    def fold(rows: Iterator) -> Iterator[tuple]:
        at = held = seen = fast_until = None
        turned, lasted = 0, 0
        for r in rows:
            if r.cut:
                held, seen, fast_until = (p.target if at is None else at), _Median(p.scene), r.t + p.fast
            x = p.weight * float(r.x) + (first if at is None else 1 - p.weight) * p.target if held is None else held
            if at is not None:
                most = max(0.01, (max(p.rate, p.fast_rate) if fast_until is not None and r.t < fast_until else p.rate) * max(0.2, p.window))
                x = _within(x, at - most, at + most)
                move = x - at
                if abs(move) < p.dead:
                    x, turned, lasted = at, 0, 0
                else:
                    sign = 1 if move > 0 else -1
                    if abs(move) < max(p.dead, p.hysteresis) and turned:
                        sign = turned
                    if sign != turned:
                        x, turned, lasted = at, sign, 1
                    else:
                        lasted += 1
                        x = x if lasted >= p.hold else at
            at = x
            if held is not None:
                held = seen.add(x)
            yield int(r.t), x

    return per_key(points, keys, ["t"], fold, _POINT)


def zoom(points: DataFrame, keys: list[str], speed: float = 0.012, widest: float = 1.3) -> DataFrame:
    """keys, t, z: the faster a path moves, the wider the view, up to ``widest`` at ``speed`` a second; 1 for a path of one point."""
    order = W.partitionBy(*keys).orderBy("t")
    dt = F.greatest(F.lit(1e-6), (F.col("t") - F.lag("t").over(order)) / 1000)
    part = F.least(F.lit(1.0), F.abs(F.col("x") - F.lag("x").over(order)) / dt / speed)
    wide = F.when(F.lag("t").over(order).isNotNull(), F.least(F.lit(widest), 1 + part * (widest - 1)))
    rows = points.withColumn("_z", wide).withColumn("_n", F.count("*").over(W.partitionBy(*keys)))
    return rows.where("_z is not null or _n = 1").select(*keys, "t", F.coalesce("_z", F.lit(1.0)).alias("z"))
