"""Interval predicates and joins.

Joins never compare everything with everything: both sides are cut into buckets of a width, meet by
key and bucket, and a pair counts only in the first bucket that both share, so it is found once.
Choose a width near the usual length of an interval.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def overlap_length(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    return F.greatest(F.lit(0), F.least(a_end, b_end) - F.greatest(a_start, b_start))


def touches(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Closed: borders that meet count."""
    return (a_end >= b_start) & (a_start <= b_end)


def overlaps(a_start: Column, a_end: Column, b_start: Column, b_end: Column, pad=0) -> Column:
    """Open; ``pad`` widens the first interval on both sides."""
    return (a_start < b_end + pad) & (b_start < a_end + pad)


def contains(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """b lies in a."""
    return (b_start >= a_start) & (b_end <= a_end)


def holds_point(start: Column, end: Column, t: Column, is_last: Column) -> Column:
    """Half-open, but closed for the last interval."""
    return (t >= start) & F.when(is_last, t <= end).otherwise(t < end)


def _bucketed(df: DataFrame, start: str, end: str, width, prefix: str) -> DataFrame:
    first = F.floor(F.col(start) / width).cast("long")
    last = F.floor(F.col(end) / width).cast("long")
    return df.withColumn(f"{prefix}_first", first).withColumn("_bucket", F.explode(F.sequence(first, F.greatest(first, last))))


def interval_join(left: DataFrame, right: DataFrame, keys: list[str], width, predicate=overlaps, l=("start", "end"), r=("r_start", "r_end")) -> DataFrame:  # noqa: E741
    """All columns of both sides for pairs that meet the predicate (one under which intervals touch or overlap)."""
    a = _bucketed(left, l[0], l[1], width, "_l")
    b = _bucketed(right, r[0], r[1], width, "_r")
    pairs = a.join(b, [*keys, "_bucket"]).where(F.col("_bucket") == F.greatest("_l_first", "_r_first"))
    found = pairs.where(predicate(F.col(l[0]), F.col(l[1]), F.col(r[0]), F.col(r[1])))
    return found.drop("_bucket", "_l_first", "_r_first")


def label_seconds(windows: DataFrame, events: DataFrame, keys: list[str], width, label: str = "label") -> DataFrame:
    """keys, window, label, length: how much of each window its labels cover. Windows have window, start, end; events label, r_start, r_end."""
    pairs = interval_join(windows, events, keys, width)
    length = overlap_length(F.col("start"), F.col("end"), F.col("r_start"), F.col("r_end"))
    return pairs.withColumn("_len", length).where("_len > 0").groupBy(*keys, "window", F.lower(label).alias(label)).agg(F.sum("_len").alias("length"))


def around(points: DataFrame, reach, t: str = "t") -> DataFrame:
    """Two windows for each point: before (not below 0) and after; adds side, start, end."""
    before = F.struct(F.lit("before").alias("side"), F.greatest(F.col(t) - reach, F.lit(0)).alias("start"), F.col(t).alias("end"))
    after = F.struct(F.lit("after").alias("side"), F.col(t).alias("start"), (F.col(t) + reach).alias("end"))
    return points.withColumn("_w", F.explode(F.array(before, after))).select(*points.columns, "_w.side", "_w.start", "_w.end")


def bins(df: DataFrame, keys: list[str], step) -> DataFrame:
    """keys, bin, start, end: the bins of ``step`` from 0 that cover each timeline (rows have keys, end)."""
    last = df.groupBy(*keys).agg(F.max("end").alias("_last"))
    count = F.greatest(F.lit(1), F.ceil(F.col("_last") / step)).cast("long")
    out = last.withColumn("bin", F.explode(F.sequence(F.lit(0).cast("long"), count - 1)))
    return out.select(*keys, "bin", (F.col("bin") * step).alias("start"), ((F.col("bin") + 1) * step).alias("end"))


def semi(left: DataFrame, right: DataFrame, keys: list[str], width, unique: str, predicate=overlaps) -> DataFrame:
    """Rows of left with any match; ``unique`` names their id."""
    hits = interval_join(left, right, keys, width, predicate).select(*keys, unique).distinct()
    return left.join(hits, [*keys, unique], "left_semi")


def locate(points: DataFrame, intervals: DataFrame, keys: list[str]) -> DataFrame:
    """Adds ``index`` to points (keys, id, t): the interval (keys, index, start, end) that holds t, else the nearest; null without any.

    The intervals of a key don't overlap, start at different times and are numbered in order, so only the last one that starts at or before t
    and the first one after it can be meant: two as-of joins, no pairs. Distance is to the nearer border; ties go to
    the smaller index. The last interval is closed, the others are half-open.
    """
    from weftline.operators.nearest import as_of

    order = W.partitionBy(*keys).orderBy("index")
    # An empty interval at the end of the one before is as near as that one, which has the smaller index.
    meets = (F.lag("end").over(order) == F.col("start")) & (F.col("start") == F.col("end"))
    first = F.when(meets, F.lag("index").over(order)).otherwise(F.col("index")).alias("first")
    numbered = intervals.select(*keys, "index", "start", "end", first, F.lead("index").over(order).isNull().alias("is_last"))
    before = as_of(points, numbered, keys, "t", "start", ["index", "start", "end", "first", "is_last"], prefix="_b_", unique="index")
    both = as_of(before, numbered.select(*keys, "index", "start"), keys, "t", "start", ["index", "start"], forward=True, prefix="_a_", unique="index")
    t, a, b = F.col("t"), F.col("_b_start"), F.col("_b_end")
    inside = holds_point(a, b, t, F.col("_b_is_last"))
    nearer = F.least(t - a, F.abs(t - b)) <= F.coalesce(F.col("_a_start") - t, F.least(t - a, F.abs(t - b)))
    found = F.when(F.col("_b_index").isNull(), F.col("_a_index")).when(inside, F.col("_b_index")).when(nearer, F.col("_b_first")).otherwise(F.col("_a_index"))
    return both.select(*points.columns, found.alias("index"))
