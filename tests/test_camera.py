"""Camera paths: the streamed solver against a dense one, the folds against plain loops, odd paths."""

import random
from statistics import median_high

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.operators import camera as C
from weftline.operators import folds

SCHEMA = "key int, t long, x double"


def paths(seed, lengths, most_step=900):
    rnd = random.Random(seed)
    rows = []
    for key, n in enumerate(lengths):
        t = 0
        for _ in range(n):
            rows.append((key, t, rnd.random()))
            t += rnd.randint(1, most_step)
    return rows


def by_key(df, *columns):
    out = {}
    for r in df.orderBy("key", *columns[:1]).collect():
        out.setdefault(r.key, []).append(tuple(r[c] for c in columns))
    return out


def dense(t, x, p):
    """The optimal path by one dense linear system."""
    grid = [*range(t[0], t[-1] + 1, p.step)]
    grid += [t[-1]] * (grid[-1] < t[-1])
    z = np.interp(grid, t, x)
    n = len(z)
    a = np.eye(n)
    for weight, order in ((p.velocity, 1), (p.acceleration, 2), (p.jerk, 3)):
        if n > order:
            d = np.diff(np.eye(n), order, axis=0)
            a += weight * d.T @ d
    inner = slice(1, n - 1)
    y = z.copy()
    if n > 2:
        y[inner] = np.linalg.solve(a[inner, inner], z[inner] - a[inner, 0] * z[0] - a[inner, -1] * z[-1])
    return grid, np.clip(y, 0, 1)


@pytest.mark.parametrize("p", [C.OptimizeParams(step=100), C.OptimizeParams(300, 0.0, 5.0, 50.0), C.OptimizeParams(250, 3.0, 0.0, 0.0)])
def test_optimizer_solves_the_whole_system(spark, p):
    rows = paths(p.step, [1, 2, 2, 3, 4, 5, 6, 7, 8, 9, 40], 500) + [(99, 0, 0.2), (99, 10, 0.4), (98, 0, 0.1), (98, 2 * p.step, 0.9), (97, 0, 0.1), (97, 3 * p.step, 0.9), (96, 0, 0.1), (96, 5 * p.step, 0.3)]
    got = by_key(C.optimize(spark.createDataFrame(rows, SCHEMA), ["key"], p), "t", "x")
    for key in {k for k, *_ in rows}:
        own = sorted((t, x) for k, t, x in rows if k == key)
        grid, want = dense([t for t, _ in own], [x for _, x in own], p)
        assert [t for t, _ in got[key]] == grid
        assert np.allclose([x for _, x in got[key]], want, atol=1e-9)


def test_follower_matches_a_loop(spark):
    rows, p = paths(1, [1, 2, 3, 30], 700), C.FollowParams(step=130, ahead=400)
    got = by_key(C.follow(spark.createDataFrame(rows, SCHEMA), ["key"], p), "t", "x")
    for key in range(4):
        own = [(t, x) for k, t, x in rows if k == key]
        ts, xs, end = [t for t, _ in own], [x for _, x in own], own[-1][0]
        t, x, v, want = 0, xs[0], 0.0, [(0, xs[0])]
        while t < end:
            now = min(end, t + p.step)
            a = max(-p.acceleration, min(p.acceleration, p.pull * (np.interp(min(end, now + p.ahead), ts, xs) - x) - p.damp * v))
            v = max(-p.speed, min(p.speed, v + a * p.step / 1000))
            x, t = max(0.0, min(1.0, x + v * p.step / 1000)), now
            want.append((t, x))
        assert [t for t, _ in got[key]] == [t for t, _ in want]
        assert np.allclose([x for _, x in got[key]], [x for _, x in want])


def test_smoothing_restarts_at_cuts(spark):
    rnd = random.Random(4)
    rows = paths(2, [1, 2, 5, 40, 40, 40], 300)
    marks = [(k, rnd.randint(-100, 13_000)) for k in range(7) for _ in range(12)] + [(3, t) for k, t, _ in rows if k == 3][:9]
    got = by_key(C.smooth_between_cuts(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(marks, "key int, t long"), ["key"], 600, 70, 0.3), "t", "x")
    for key in range(6):
        own = [(t, x) for k, t, x in rows if k == key]
        ts, xs, end = [t for t, _ in own], [x for _, x in own], own[-1][0]
        kept = []
        for c in sorted({t for k, t in marks if k == key and 0 < t < end}):
            if c - (kept[-1] if kept else 0) >= 600:
                kept.append(c)
        if kept and end - kept[-1] < 600:
            kept.pop()
        want = {}
        for a, b in zip([0, *kept], [*kept, end]):
            grid = list(range(a, b + 1, 70))
            z = np.interp(grid, ts, xs)
            f = [z[0]]
            for v in z[1:]:
                f.append(0.3 * v + 0.7 * f[-1])
            r = [f[-1]]
            for v in f[-2::-1]:
                r.append(0.3 * v + 0.7 * r[-1])
            for t, u, v in zip(grid, f, r[::-1]):
                want.setdefault(t, (u + v) / 2)
        assert [t for t, _ in got[key]] == sorted(want)
        assert np.allclose([x for _, x in got[key]], [want[t] for t in sorted(want)])


def test_medians_of_scenes(spark):
    rnd = random.Random(9)
    rows = [(1, t, rnd.choice([0.1, 0.2, 0.5, 0.7]), rnd.random() < 0.1) for t in range(200)]
    got = by_key(C.scene_median(spark.createDataFrame(rows, SCHEMA + ", cut boolean"), ["key"], 7), "t", "x")[1]
    scene, want = [], []
    for _, t, x, cut in rows:
        scene = [x] if cut else [*scene, x][-7:]
        want.append((t, median_high(scene)))
    assert got == want


def test_ramp_starts_after_confirmation(spark):
    rows = [(1, 0, 0.5), (1, 100, 0.51), (1, 200, 0.8), (1, 300, 0.7), (1, 500, 0.9), (1, 600, 0.8)]
    got = by_key(C.hold_and_ramp(spark.createDataFrame(rows, SCHEMA), ["key"]), "n", "t", "x")[1]
    assert [t for _, t, _ in got] == [0, 100, 200, 300, *range(500, 1401, 100), 600]
    assert got[3][2] == 0.5 and got[4][2] == 0.5 and abs(got[13][2] - 0.8) < 1e-12 and got[14][2] == 0.8


def test_paths_of_one_point(spark):
    one = spark.createDataFrame([(1, 7, 0.4)], SCHEMA)
    cut = one.withColumn("cut", F.lit(True))
    for made in (C.limit_speed(one, ["key"]), C.optimize(one, ["key"]), C.keyframes(one, ["key"]), C.smooth_between_cuts(one, cut.select("key", "t"), ["key"]), C.scene_median(cut, ["key"])):
        assert [(r.key, r.t, round(r.x, 12)) for r in made.collect()] == [(1, 7, 0.4)]
    assert C.steady(cut, ["key"]).first().x == 0.5
    assert C.zoom(one, ["key"]).first().z == 1.0
    empty = one.limit(0)
    assert C.optimize(empty, ["key"]).count() == C.zoom(empty, ["key"]).count() == 0


def test_greedy_folds(spark):
    rnd = random.Random(2)
    rows = [(k, rnd.randint(0, 300), rnd.randint(0, 30), i) for i, k in enumerate(rnd.choices(range(3), k=200))]
    df = spark.createDataFrame(rows, "key int, start long, n long, id long").withColumn("end", F.col("start") + F.col("n"))
    spaced = sorted(tuple(r) for r in folds.spaced(df, ["key"], "start", 20).collect())
    disjoint = sorted(tuple(r) for r in folds.disjoint(df, ["key"], 2, "id").collect())
    for key in range(3):
        last, want, kept = None, [], []
        for t in sorted(s for k, s, _, _ in rows if k == key):
            if last is None or t - last >= 20:
                want.append((key, t))
                last = t
        for a, b in sorted((s, s + n) for k, s, n, _ in rows if k == key):
            if all(not (c < b + 2 and a < d + 2) for _, c, d in kept):
                kept.append((key, a, b))
        assert [x for x in spaced if x[0] == key] == want
        assert [x for x in disjoint if x[0] == key] == sorted(kept)


def test_folds_keep_large_numbers_and_null_keys(spark):
    df = spark.createDataFrame([(None, 2**53 + 1, None), (None, 2**53 + 3, 2**60 + 1), (1, None, 5)], "key int, t long, x long")
    got = folds.per_key(df, ["key"], ["t"], lambda rows: iter([(sum(r.x or 0 for r in rows),)]), "total long")
    assert sorted((r.key or 0, r.total) for r in got.collect()) == [(0, 2**60 + 1), (1, 5)]
    kept = folds.per_key(df, ["key"], ["t"], lambda rows: ((r.t, r.x) for r in rows), "t long, x long")
    assert {tuple(r) for r in kept.collect()} == {(None, 2**53 + 1, None), (None, 2**53 + 3, 2**60 + 1), (1, None, 5)}


def test_steady_at_the_border_of_the_dead_band(spark):
    """0.7 and 0.3 of a first point are the decimals that the SQL has: the last move here is 0.015 but for the last bit."""
    rows = [(1, t * 1000, x, False) for t, x in enumerate([0.106, 0.692, 0.819, 0.69, 0.356])]
    got = C.steady(spark.createDataFrame(rows, "key int, t long, x double, cut boolean"), ["key"]).orderBy("t").collect()
    assert [round(r.x, 6) for r in got] == [0.2242, 0.2242, 0.3042, 0.3842, 0.3992]
