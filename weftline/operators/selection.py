"""Choosing rows: top-k, budgets, spacing, samples, pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def top(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each key in an order that should end with a unique column."""
    return df.withColumn(rank, F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= k)


def head_and_tail(df: DataFrame, keys: list[str], order: list[str], head: int, tail: int) -> DataFrame:
    """The first ``head`` and the last ``tail`` rows of each key in the order (which ends with a unique column), each once; adds ``place``, from 1."""
    first = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    last = F.row_number().over(W.partitionBy(*keys).orderBy(*[F.desc(c) for c in order]))
    return df.withColumn("place", first).withColumn("_last", last).where((F.col("place") <= head) | (F.col("_last") <= tail)).drop("_last")


def budget(df: DataFrame, keys: list[str], bucket: str, priority: str, unique: str, per_bucket: int, most: int) -> DataFrame:
    """At most ``most`` rows per key: the best ``per_bucket`` of each bucket first, strongest buckets first, then the best of the rest.

    Adds ``pick``, the place in which a row is chosen.
    """
    inside = W.partitionBy(*keys, bucket).orderBy(F.desc(priority), unique)
    ranked = df.withColumn("_in", F.row_number().over(inside)).withColumn("_strength", F.max(priority).over(W.partitionBy(*keys, bucket)))
    quota = F.col("_in") <= per_bucket
    order = W.partitionBy(*keys).orderBy(
        F.when(quota, 0).otherwise(1),
        F.when(quota, F.col("_strength")).desc_nulls_last(),
        F.when(quota, F.col(bucket)).asc_nulls_last(),
        F.desc(priority),
        unique,
    )
    return ranked.withColumn("pick", F.row_number().over(order)).where(F.col("pick") <= most).drop("_in", "_strength")


def spaced(df: DataFrame, keys: list[str], t: str, order: list[str], least, most: int) -> DataFrame:
    """keys, kept: times taken greedily in the order (structs of ``order`` columns, ascending), each at least ``least`` from all taken before; at most ``most``."""
    rows = F.array_sort(F.collect_list(F.struct(*order, F.col(t).alias("_t"))))
    kind = df.schema[t].dataType
    empty = F.array().cast(f"array<{kind.simpleString()}>")
    step = lambda acc, x: F.when((F.size(acc) < most) & ~F.exists(acc, lambda y: F.abs(y - x) < least), F.array_append(acc, x)).otherwise(acc)
    return df.groupBy(*keys).agg(rows.alias("_rows")).select(*keys, F.aggregate(F.transform("_rows", lambda x: x["_t"]), empty, step).alias("kept"))


def disjoint(df: DataFrame, keys: list[str], order: list[str], pad, most: int) -> DataFrame:
    """keys, kept: intervals (start, end) taken greedily in the order if they overlap none taken before, widened by ``pad``; at most ``most``."""
    start_type = df.schema["start"].dataType.simpleString()
    empty = F.array().cast(f"array<struct<start:{start_type},end:{start_type}>>")
    rows = F.array_sort(F.collect_list(F.struct(*order, F.struct("start", "end").alias("_i"))))

    def step(acc: Column, x: Column) -> Column:
        hit = F.exists(acc, lambda y: (y["start"] < x["_i"]["end"] + pad) & (x["_i"]["start"] < y["end"] + pad))
        return F.when((F.size(acc) < most) & ~hit, F.array_append(acc, x["_i"])).otherwise(acc)

    return df.groupBy(*keys).agg(rows.alias("_rows")).select(*keys, F.aggregate("_rows", empty, step).alias("kept"))


def systematic(df: DataFrame, keys: list[str], order: list[str], most: int) -> DataFrame:
    """Every floor(n / most)-th row of each key, at most ``most``."""
    w = W.partitionBy(*keys)
    rows = df.withColumn("_nth", F.row_number().over(w.orderBy(*order)) - 1).withColumn("_n", F.count("*").over(w))
    step = F.greatest(F.lit(1), F.floor(F.col("_n") / most))
    return rows.where((F.col("_nth") % step == 0) & (F.floor(F.col("_nth") / step) < most)).drop("_nth", "_n")


def prefix_by_size(df: DataFrame, keys: list[str], order: list[str], size: Column, most: int) -> DataFrame:
    """The rows of each key from the first on while their running size stays within ``most``; adds ``used``."""
    w = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumn("used", F.sum(size).over(w)).where(F.col("used") <= most)


def page(df: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    """One page of rows, each with ``total``, the number of all rows. limit is held within 1 and 100, offset at 0 or more."""
    rows = df.orderBy(*order).offset(max(0, offset)).limit(max(1, min(100, limit)))
    return rows.crossJoin(F.broadcast(df.agg(F.count("*").alias("total"))))  # one row


def every_nth(df: DataFrame, keys: list[str], order: list[str], stride: int) -> DataFrame:
    """Every ``stride``-th row and the last one."""
    w = W.partitionBy(*keys)
    rows = df.withColumn("_nth", F.row_number().over(w.orderBy(*order)) - 1).withColumn("_n", F.count("*").over(w))
    return rows.where((F.col("_nth") % stride == 0) | (F.col("_nth") == F.col("_n") - 1)).drop("_nth", "_n")


def arg_max(df: DataFrame, keys: list[str], value: Column, rank: list[Column], name: str = "best") -> DataFrame:
    """The value of the row of each key whose rank is largest."""
    return df.groupBy(*keys).agg(F.max_by(value, F.struct(*rank)).alias(name))


def chunks(df: DataFrame, keys: list[str], order: list[str], size: int) -> DataFrame:
    """Adds ``chunk``: rows of each key in batches of ``size``."""
    nth = F.row_number().over(W.partitionBy(*keys).orderBy(*order)) - 1
    return df.withColumn("chunk", F.floor(nth / size))


def sample_candidates(primary: DataFrame, others: DataFrame, keys: list[str], t: str, low: str, high: str, reach) -> DataFrame:
    """keys, t: the primary time (columns low, high give its bounds) and others within bounds and ``reach`` of it, one for each hundredth."""
    base = primary.select(*keys, F.col(t).alias("_p"), low, high)
    first = base.select(*keys, F.col("_p").alias(t), F.lit(0).alias("_o"))
    rest = others.select(*keys, t).join(base, keys).where(F.col(t).between(F.col(low), F.col(high)) & (F.abs(F.col(t) - F.col("_p")) <= reach))
    both = first.unionByName(rest.select(*keys, t, F.lit(1).alias("_o")))
    order = W.partitionBy(*keys, F.round(F.col(t) * 100)).orderBy("_o", t)
    return both.withColumn("_nth", F.row_number().over(order)).where("_nth = 1").select(*keys, t)
