"""As-of and nearest joins on a time, by one sort per key and no pairing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def as_of(left: DataFrame, right: DataFrame, keys: list[str], t: str, r_t: str, values: list[str], forward: bool = False, tolerance=0, prefix: str = "r_", unique: str | None = None) -> DataFrame:
    """Adds to every row of left the values of the last row of right with ``r_t <= t + tolerance``
    (``forward``: the first with ``r_t >= t - tolerance``); nulls where there is none.

    Of rows of right with one time that with the largest ``unique`` wins (forward: the smallest), if it is given.
    """
    shift = -tolerance if forward else tolerance
    pick = F.struct(F.col(r_t).alias("_at"), *[F.col(v).alias(v) for v in values])
    a = left.select(*keys, (F.col(t) + shift).alias("_time"), F.lit(1 if not forward else 0).alias("_side"), F.struct(*left.columns).alias("_left"), F.lit(None).cast(right.select(pick.alias("x")).schema[0].dataType).alias("_right"), F.lit(None).cast("long").alias("_nth"))
    nth = F.col(unique).cast("long") if unique else F.lit(0).cast("long")
    b = right.select(*keys, F.col(r_t).alias("_time"), F.lit(0 if not forward else 1).alias("_side"), F.lit(None).cast(left.select(F.struct(*left.columns).alias("x")).schema[0].dataType).alias("_left"), pick.alias("_right"), nth.alias("_nth"))
    order = W.partitionBy(*keys).orderBy("_time", "_side", "_nth")
    if forward:
        found = F.first("_right", ignorenulls=True).over(order.rowsBetween(0, W.unboundedFollowing))
    else:
        found = F.last("_right", ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, 0))
    out = a.unionByName(b).withColumn("_found", found).where("_left is not null")
    return out.select("_left.*", F.col("_found._at").alias(f"{prefix}{r_t}"), *[F.col(f"_found.{v}").alias(f"{prefix}{v}") for v in values if v != r_t])


def nearest(left: DataFrame, right: DataFrame, keys: list[str], t: str, r_t: str, name: str = "nearest") -> DataFrame:
    """Adds the time of right nearest to t; the earlier one on ties, null without any."""
    back = as_of(left, right, keys, t, r_t, [r_t], prefix="_b_")
    both = as_of(back, right, keys, t, r_t, [r_t], forward=True, prefix="_f_")
    b, f = F.col(f"_b_{r_t}"), F.col(f"_f_{r_t}")
    closer = F.when(b.isNull(), f).when(f.isNull(), b).when(F.col(t) - b <= f - F.col(t), b).otherwise(f)
    return both.withColumn(name, closer).drop(f"_b_{r_t}", f"_f_{r_t}")


def pad_to_neighbours(df: DataFrame, speech: DataFrame, keys: list[str], most) -> DataFrame:
    """Widens start and end of df by at most ``most``, never over the neighbouring rows of speech (keys, start, end).

    Adds prev_end, next_start, clip_start, clip_end.
    """
    before = as_of(df, speech.select(*keys, F.col("end").alias("prev_end")), keys, "start", "prev_end", ["prev_end"], prefix="")
    both = as_of(before, speech.select(*keys, F.col("start").alias("next_start")), keys, "end", "next_start", ["next_start"], forward=True, prefix="")
    room = F.greatest(F.lit(0), F.col("start") - F.coalesce("prev_end", F.lit(0)))
    after = F.when(F.col("next_start").isNull(), F.lit(most)).otherwise(F.greatest(F.lit(0), F.col("next_start") - F.col("end")))
    return both.withColumn("clip_start", F.greatest(F.lit(0), F.col("start") - F.least(F.lit(most), room))).withColumn("clip_end", F.col("end") + F.least(F.lit(most), after))


def near_any(df: DataFrame, cuts: DataFrame, keys: list[str], t: str, cut: str, within, name: str = "near") -> DataFrame:
    """Adds whether any cut lies within ``within`` of t."""
    found = nearest(df, cuts, keys, t, cut, "_nearest")
    return found.withColumn(name, F.coalesce(F.abs(F.col(t) - F.col("_nearest")) <= within, F.lit(False))).drop("_nearest")


def resample(points: DataFrame, keys: list[str], t: str, value: str, step) -> DataFrame:
    """keys, t, value on a grid of ``step`` from each timeline's first to its last point, by linear interpolation."""
    ends = points.groupBy(*keys).agg(F.min(t).alias("_a"), F.max(t).alias("_b"))
    grid = ends.select(*keys, F.explode(F.sequence("_a", "_b", F.lit(step))).alias("g"))
    known = points.select(*keys, F.col(t).alias("p"), F.col(value).alias("v"))
    low = as_of(grid, known, keys, "g", "p", ["p", "v"], prefix="low_")
    both = as_of(low, known, keys, "g", "p", ["p", "v"], forward=True, prefix="high_")
    part = (F.col("g") - F.col("low_p")) / (F.col("high_p") - F.col("low_p"))
    mid = F.when(F.col("high_p") == F.col("low_p"), F.col("low_v")).otherwise(F.col("low_v") + (F.col("high_v") - F.col("low_v")) * part)
    return both.select(*keys, F.col("g").alias(t), mid.alias(value))
