"""Queries over camera paths: the events of a user, six hours to a second, with their values as places from 0 to 1."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.operators import camera as C
from weftline.plans.registry import query
from weftline.plans.timeline import EV, events

#: Microseconds of events for a millisecond of a path.
SCALE = 21_600_000


def path(spark: SparkSession, d: str) -> DataFrame:
    """key, t (milliseconds from the user's first event), x, cut (whether a signup lies there)."""
    t = F.expr(f"(start - _first) div {SCALE}")
    rows = events(spark, d).withColumn("_first", F.min("start").over(W.partitionBy("key"))).withColumn("t", t)
    return rows.groupBy("key", "t").agg((F.max(F.col("cents") % 1001) / 1000).alias("x"), F.max(F.col("label") == "signup").alias("cut"))


def cuts(spark: SparkSession, d: str) -> DataFrame:
    return path(spark, d).where("cut").select("key", "t")


def shown(df: DataFrame, x: str = "x") -> DataFrame:
    """Rounded so that the last bits don't count."""
    return df.withColumn(x, F.round(F.col(x) + 3e-8, 6))


PATH = f"""{EV}, timed AS (
        SELECT *, (start - min(start) OVER (PARTITION BY key)) // {SCALE} AS t FROM ev
    ), path AS (
        SELECT key, t, max(cents % 1001) / 1000::DOUBLE AS x, bool_or(label = 'signup') AS cut FROM timed GROUP BY key, t
    ), r AS (
        SELECT *, row_number() OVER (PARTITION BY key ORDER BY t) AS n FROM path
    )"""


def _at(grid: str) -> str:
    """key, t, x of the path at the times (key, t) of a relation; behind its last point that one's place."""
    return f"""
        SELECT s.key, s.t, CASE WHEN b.t IS NULL OR b.t = a.t THEN a.x ELSE a.x + (b.x - a.x) * ((s.t - a.t) / (b.t - a.t)) END AS x
        FROM (SELECT g.key, g.t, max(CASE WHEN p.t <= g.t THEN p.t END) AS low, min(CASE WHEN p.t >= g.t THEN p.t END) AS high
              FROM {grid} g JOIN path p ON p.key = g.key GROUP BY ALL) s
        JOIN path a ON a.key = s.key AND a.t = low LEFT JOIN path b ON b.key = s.key AND b.t = high"""


@query(f"""
    WITH RECURSIVE {PATH}, w AS (
        SELECT key, n, t, x, 0::DOUBLE AS v FROM r WHERE n = 1
        UNION ALL
        SELECT key, n, t, greatest(0, least(1, o + v * dt)), v FROM (
            SELECT r.key, r.n, r.t, w.x AS o, greatest(0.0001::DOUBLE, (r.t - w.t) / 1000::DOUBLE) AS dt,
                   greatest(-0.05::DOUBLE, least(0.05::DOUBLE, greatest(w.v - 0.03::DOUBLE * dt, least(w.v + 0.03::DOUBLE * dt, (r.x - w.x) / dt)))) AS v
            FROM w JOIN r ON r.key = w.key AND r.n = w.n + 1)
    )
    SELECT key, t, round(x + 0.00000003::DOUBLE, 6) AS x FROM w""")
def speed_limited_path(spark: SparkSession, d: str) -> DataFrame:
    return shown(C.limit_speed(path(spark, d), ["key"]))


@query(f"""
    WITH RECURSIVE {PATH}, ends AS (
        SELECT key, max(t) AS e FROM path GROUP BY key
    ), steps AS (
        SELECT key, e, k, least(e, k * 1000) AS t, least(e, least(e, k * 1000) + 1200) AS ahead FROM ends, unnest(range(1, CAST(ceil(e / 1000) AS BIGINT) + 1)) u(k)
    ), asked AS (
        SELECT DISTINCT key, ahead AS t FROM steps
    ), targets AS ({_at("asked")}), s AS (
        SELECT steps.key, k, steps.t, targets.x AS target FROM steps JOIN targets ON targets.key = steps.key AND targets.t = ahead
    ), w AS (
        SELECT key, 0::BIGINT AS k, 0::BIGINT AS t, x, 0::DOUBLE AS v FROM r WHERE n = 1
        UNION ALL
        SELECT key, k, t, greatest(0, least(1, o + v * 1::DOUBLE)), v FROM (
            SELECT s.key, s.k, s.t, w.x AS o, greatest(-0.05::DOUBLE, least(0.05::DOUBLE,
                   w.v + greatest(-0.06::DOUBLE, least(0.06::DOUBLE, 7::DOUBLE * (s.target - w.x) - 4::DOUBLE * w.v)) * 1::DOUBLE)) AS v
            FROM w JOIN s ON s.key = w.key AND s.k = w.k + 1)
    )
    SELECT key, t, round(x + 0.00000003::DOUBLE, 6) AS x FROM w""")
def followed_path(spark: SparkSession, d: str) -> DataFrame:
    return shown(C.follow(path(spark, d), ["key"], C.FollowParams(step=1000)))


@query(None)
def optimized_path(spark: SparkSession, d: str) -> DataFrame:
    return shown(C.limit_speed(C.optimize(path(spark, d), ["key"], C.OptimizeParams(step=500)), ["key"], 0.5, 0.3))


@query(f"""
    WITH RECURSIVE {PATH}, w AS (
        SELECT key, n, t, x AS place, NULL::BIGINT AS since, NULL::DOUBLE AS target, NULL::DOUBLE AS ramp_to FROM r WHERE n = 1
        UNION ALL
        SELECT key, n, t, place, CASE WHEN still OR go THEN NULL WHEN since IS NULL THEN t ELSE since END,
               CASE WHEN NOT still AND since IS NULL THEN x ELSE target END, CASE WHEN go THEN target END
        FROM (SELECT *, NOT still AND since IS NOT NULL AND t - since >= 1500 AS go FROM (
            SELECT r.key, r.n, r.t, r.x, coalesce(w.ramp_to, w.place) AS place, w.since, w.target, abs(r.x - coalesce(w.ramp_to, w.place)) <= 0.03::DOUBLE AS still
            FROM w JOIN r ON r.key = w.key AND r.n = w.n + 1))
    ), laid AS (
        SELECT key, n, 0 AS k, t, place AS x FROM w WHERE ramp_to IS NULL
        UNION ALL
        SELECT key, n, k, t + k * 100, place + (ramp_to - place) * ((k * 100 / 900) * (k * 100 / 900) * (3 - 2 * (k * 100 / 900))) FROM w, unnest(range(10)) u(k) WHERE ramp_to IS NOT NULL
    )
    SELECT key, row_number() OVER (PARTITION BY key ORDER BY n, k) - 1 AS n, t, round(x + 0.00000003::DOUBLE, 6) AS x FROM laid""")
def held_and_ramped_path(spark: SparkSession, d: str) -> DataFrame:
    return shown(C.hold_and_ramp(path(spark, d), ["key"], C.RampParams(confirm=1500)))


@query(f"""
    WITH RECURSIVE {PATH}, ends AS (
        SELECT key, max(t) AS e FROM path GROUP BY key
    ), asked AS (
        SELECT DISTINCT key, least(e, k * 1500) AS t FROM ends, unnest(range(0, CAST(ceil(e / 1500) AS BIGINT) + 1)) u(k)
    ), grid AS ({_at("asked")}), g AS (
        SELECT *, row_number() OVER (PARTITION BY key ORDER BY t) AS n, CASE WHEN lead(t) OVER (PARTITION BY key ORDER BY t) IS NULL THEN 0.5::DOUBLE ELSE 1::DOUBLE END AS part FROM grid
    ), w AS (
        SELECT key, n, t, x, t AS key_t, x AS key_x, true AS taken FROM g WHERE n = 1
        UNION ALL
        SELECT key, n, t, CASE WHEN moved THEN x ELSE key_x END, CASE WHEN moved THEN t ELSE key_t END, CASE WHEN moved THEN x ELSE key_x END, moved OR part < 1
        FROM (SELECT g.key, g.n, g.t, g.x, g.part, w.key_t, w.key_x, abs(g.x - w.key_x) >= 0.2::DOUBLE * g.part OR g.t - w.key_t >= 4000 * g.part AS moved
              FROM w JOIN g ON g.key = w.key AND g.n = w.n + 1)
    )
    SELECT key, t, round(x + 0.00000003::DOUBLE, 6) AS x FROM w WHERE taken""")
def camera_keyframes(spark: SparkSession, d: str) -> DataFrame:
    return shown(C.keyframes(path(spark, d), ["key"], move=0.2))


@query(f"""
    WITH RECURSIVE {PATH}, ends AS (
        SELECT key, max(t) AS e FROM path GROUP BY key
    ), offered AS (
        SELECT path.key, t, e, row_number() OVER (PARTITION BY path.key ORDER BY t) AS m FROM path JOIN ends USING (key) WHERE cut AND t > 0 AND t < e
    ), chosen AS (
        SELECT key, 0::BIGINT AS m, 0::BIGINT AS t, false AS taken, 0::BIGINT AS before FROM ends
        UNION ALL
        SELECT o.key, o.m, o.t, o.t - c.before >= 600, CASE WHEN o.t - c.before >= 600 THEN o.t ELSE c.before END FROM chosen c JOIN offered o ON o.key = c.key AND o.m = c.m + 1
    ), cuts AS (
        SELECT key, t FROM (SELECT key, t, e, lead(t) OVER (PARTITION BY key ORDER BY t) IS NULL AS final FROM chosen JOIN ends USING (key) WHERE taken) WHERE NOT final OR e - t >= 600
    ), pieces AS (
        SELECT key, t AS a, coalesce(lead(t) OVER (PARTITION BY key ORDER BY t), e) AS b, row_number() OVER (PARTITION BY key ORDER BY t) AS piece
        FROM (SELECT key, 0 AS t FROM ends UNION ALL SELECT key, t FROM cuts) JOIN ends USING (key)
    ), asked AS (
        SELECT key, piece, a + k * 250 AS t FROM pieces, unnest(range(0, (b - a) // 250 + 1)) u(k)
    ), known AS (
        SELECT DISTINCT key, t FROM asked
    ), values_ AS ({_at("known")}), grid AS (
        SELECT key, piece, t, x, row_number() OVER (PARTITION BY key, piece ORDER BY t) AS n, row_number() OVER (PARTITION BY key, piece ORDER BY t DESC) AS m
        FROM asked JOIN values_ USING (key, t)
    ), f AS (
        SELECT key, piece, n, m, t, x AS y FROM grid WHERE n = 1
        UNION ALL
        SELECT g.key, g.piece, g.n, g.m, g.t, 0.8::DOUBLE * f.y + 0.2::DOUBLE * g.x FROM f JOIN grid g ON g.key = f.key AND g.piece = f.piece AND g.n = f.n + 1
    ), z AS (
        SELECT key, piece, m, t, y, y AS back FROM f WHERE m = 1
        UNION ALL
        SELECT f.key, f.piece, f.m, f.t, f.y, 0.2::DOUBLE * f.y + 0.8::DOUBLE * z.back FROM z JOIN f ON f.key = z.key AND f.piece = z.piece AND f.m = z.m + 1
    )
    SELECT key, t, round(greatest(0, least(1, (back + y) * 0.5::DOUBLE)) + 0.00000003::DOUBLE, 6) AS x
    FROM z QUALIFY row_number() OVER (PARTITION BY key, t ORDER BY piece) = 1""")
def smoothed_between_cuts(spark: SparkSession, d: str) -> DataFrame:
    return shown(C.smooth_between_cuts(path(spark, d), cuts(spark, d), ["key"], step=250))


@query(f"""
    WITH {PATH}, scenes AS (
        SELECT *, count(CASE WHEN cut THEN 1 END) OVER (PARTITION BY key ORDER BY t) AS scene FROM path
    ), lists AS (
        SELECT key, t, list_sort(list(x) OVER (PARTITION BY key, scene ORDER BY t ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)) AS v FROM scenes
    )
    SELECT key, t, v[len(v) // 2 + 1] AS x FROM lists""")
def scene_medians(spark: SparkSession, d: str) -> DataFrame:
    return C.scene_median(path(spark, d), ["key"])


@query(f"""
    WITH RECURSIVE {PATH}, s AS (
        SELECT key, n, t, x, cut AND n % 40 = 0 AS cut FROM r
    ), first AS (
        SELECT *, CASE WHEN cut THEN 0.5::DOUBLE ELSE 0.7::DOUBLE * x + 0.3::DOUBLE * 0.5::DOUBLE END AS y FROM s WHERE n = 1
    ), w AS (
        SELECT key, n, t, y AS place, CASE WHEN cut THEN [y] END AS seen, CASE WHEN cut THEN t + 1500 END AS fast, 0 AS turned, 0 AS lasted FROM first
        UNION ALL
        SELECT key, n, t, place, CASE WHEN seen IS NOT NULL THEN list_append(seen, place)[-5:] END, fast, turned, lasted FROM (
            SELECT key, n, t, seen, fast, CASE WHEN calm OR sign <> turned OR lasted + 1 < 2 THEN o ELSE y END AS place,
                   CASE WHEN calm THEN 0 ELSE sign END AS turned, CASE WHEN calm THEN 0 WHEN sign <> turned THEN 1 ELSE lasted + 1 END AS lasted
            FROM (SELECT *, abs(y - o) < 0.015::DOUBLE AS calm, CASE WHEN abs(y - o) < 0.03::DOUBLE AND turned <> 0 THEN turned WHEN y > o THEN 1 ELSE -1 END AS sign
                FROM (SELECT *, greatest(o - most, least(o + most, wish)) AS y
                    FROM (SELECT *, CASE WHEN t < fast THEN 0.12::DOUBLE ELSE 0.08::DOUBLE END AS most,
                                 CASE WHEN held IS NULL THEN 0.7::DOUBLE * x + (1 - 0.7::DOUBLE) * 0.5::DOUBLE ELSE held END AS wish
                        FROM (SELECT s.key, s.n, s.t, s.x, w.place AS o, w.turned, w.lasted, CASE WHEN s.cut THEN s.t + 1500 ELSE w.fast END AS fast,
                                     CASE WHEN s.cut THEN w.place ELSE list_sort(w.seen)[len(w.seen) // 2 + 1] END AS held, CASE WHEN s.cut THEN []::DOUBLE[] ELSE w.seen END AS seen
                            FROM w JOIN s ON s.key = w.key AND s.n = w.n + 1)))))
    )
    SELECT key, t, round(place + 0.00000003::DOUBLE, 6) AS x FROM w""")
def steady_path(spark: SparkSession, d: str) -> DataFrame:
    nth = F.row_number().over(W.partitionBy("key").orderBy("t"))
    return shown(C.steady(path(spark, d).withColumn("cut", F.col("cut") & (nth % 40 == 0)), ["key"]))


@query(f"""
    WITH {PATH}, s AS (
        SELECT *, greatest(0.000001::DOUBLE, (t - lag(t) OVER (PARTITION BY key ORDER BY t)) / 1000::DOUBLE) AS dt, abs(x - lag(x) OVER (PARTITION BY key ORDER BY t)) AS dx,
               count(*) OVER (PARTITION BY key) AS all_ FROM r
    )
    SELECT key, t, round(CASE WHEN n > 1 THEN least(1.3::DOUBLE, 1 + least(1, dx / dt / 0.5::DOUBLE) * (1.3::DOUBLE - 1)) ELSE 1 END + 0.00000003::DOUBLE, 6) AS z FROM s WHERE n > 1 OR all_ = 1""")
def zoomed_out(spark: SparkSession, d: str) -> DataFrame:
    return shown(C.zoom(path(spark, d), ["key"], speed=0.5), "z")
