"""Merging of ordered rows: sessions, runs, gaps, paragraphs.

All functions take ``keys`` (what a timeline is), columns ``start`` and ``end`` in comparable units
and order rows by ``start``, ``end`` and a unique ``id``, so results don't depend on the order of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _order(keys: list[str], *more: str):
    return W.partitionBy(*keys).orderBy("start", "end", *more)


def mark_gaps(df: DataFrame, keys: list[str], gap, unique: str = "id", strict: bool = False) -> DataFrame:
    """Adds ``island``: a new one where start is more than ``gap`` after all ends before (``strict``: at least gap)."""
    order = _order(keys, unique)
    reach = F.max("end").over(order.rowsBetween(W.unboundedPreceding, -1))
    away = (F.col("start") - reach >= gap) if strict else (F.col("start") - reach > gap)
    return df.withColumn("_new", F.coalesce(away, F.lit(True)).cast("int")).withColumn("island", F.sum("_new").over(order.rowsBetween(W.unboundedPreceding, 0))).drop("_new")


def mark_runs(df: DataFrame, keys: list[str], label: str, unique: str = "id") -> DataFrame:
    """Adds ``run``: a new one where the label differs from the row before."""
    order = _order(keys, unique)
    change = ~F.col(label).eqNullSafe(F.lag(label).over(order)) | F.lag(F.lit(1)).over(order).isNull()
    return df.withColumn("_new", change.cast("int")).withColumn("run", F.sum("_new").over(order.rowsBetween(W.unboundedPreceding, 0))).drop("_new")


def merge(df: DataFrame, keys: list[str], gap, label: str | None = None, more: list[Column] | None = None, unique: str = "id", strict: bool = False) -> DataFrame:
    """One row per island: keys, (label,) start, end (the largest), n and the aggregates of ``more``.

    With a label there are two levels: runs of one label first, then gaps inside a run.
    """
    inner = keys
    if label:
        df = mark_runs(df, keys, label, unique)
        inner = [*keys, "run", label]
    found = mark_gaps(df, inner, gap, unique, strict).groupBy(*inner, "island")
    out = found.agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n"), *(more or []))
    return out.drop("run", "island")


def run_length(df: DataFrame, keys: list[str], label: str, tolerance, unique: str = "id") -> DataFrame:
    """Rows with one label whose borders meet within ``tolerance`` become one; its end is that of its last row."""
    order = _order(keys, unique)
    broken = ~F.col(label).eqNullSafe(F.lag(label).over(order)) | (F.abs(F.col("start") - F.lag("end").over(order)) > tolerance)
    marked = df.withColumn("_new", F.coalesce(broken, F.lit(True)).cast("int")).withColumn("run", F.sum("_new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    last = F.max_by("end", F.struct("start", "end", unique))
    return marked.groupBy(*keys, label, "run").agg(F.min("start").alias("start"), last.alias("end"), F.count("*").alias("n")).drop("run")


def chain_last_end(df: DataFrame, keys: list[str], gap, unique: str = "id") -> DataFrame:
    """Rows less than ``gap`` after the end of the row before become one; its end is that of its last row."""
    order = _order(keys, unique)
    broken = F.coalesce(F.col("start") - F.lag("end").over(order) >= gap, F.lit(True))
    marked = df.withColumn("_new", broken.cast("int")).withColumn("island", F.sum("_new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    return marked.groupBy(*keys, "island").agg(F.min("start").alias("start"), F.max_by("end", F.struct("start", "end", unique)).alias("end"), F.count("*").alias("n")).drop("island")


def fill_gaps(df: DataFrame, keys: list[str], label: str, least, filler: str, until: Column | None = None, unique: str = "id") -> DataFrame:
    """keys, label, start, end: the rows, and a ``filler`` row in every gap of at least ``least`` (from 0, and up to ``until``)."""
    order = _order(keys, unique)
    cursor = F.greatest(F.coalesce(F.max("end").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)), F.lit(0))
    here = df.withColumn("_cursor", cursor)
    own = F.struct(F.col(label).alias("label"), F.col("start").alias("start"), F.col("end").alias("end"))
    gap = F.struct(F.lit(filler).alias("label"), F.col("_cursor").alias("start"), F.col("start").alias("end"))
    rows = here.select(*keys, F.explode(F.when(F.col("start") - F.col("_cursor") >= least, F.array(gap, own)).otherwise(F.array(own))).alias("_row"))
    out = rows.select(*keys, F.col("_row.label").alias(label), "_row.start", "_row.end")
    if until is None:
        return out
    last = df.groupBy(*keys).agg(F.max("end").alias("start"), F.first(until).alias("end")).where(F.col("end") - F.col("start") >= least)
    return out.unionByName(last.select(*keys, F.lit(filler).alias(label), "start", "end"))


def end_from_next(df: DataFrame, keys: list[str], last, unique: str = "id") -> DataFrame:
    """``end`` is the start of the next row; the last row gets ``start + last``."""
    order = W.partitionBy(*keys).orderBy("start", unique)
    return df.withColumn("end", F.coalesce(F.lead("start").over(order), F.col("start") + last))


def paragraphs(df: DataFrame, keys: list[str], gap, stop: str, unique: str = "id") -> DataFrame:
    """keys, start, end, text, n: rows joined until a pause longer than ``gap`` or a text that matches ``stop``.

    Rows with an empty text are left out first.
    """
    rows = df.where(F.col("text") != "")
    order = _order(keys, unique)
    broken = (F.col("start") - F.lag("end").over(order) > gap) | F.lag("text").over(order).rlike(stop)
    marked = rows.withColumn("_new", F.coalesce(broken, F.lit(True)).cast("int")).withColumn("island", F.sum("_new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    last = F.max_by("end", F.struct("start", "end", unique)).alias("end")
    return marked.groupBy(*keys, "island").agg(F.min("start").alias("start"), last, ordered_text("text", unique).alias("text"), F.count("*").alias("n"))


def ordered_text(column: str, unique: str = "id", separator: str = " ") -> Column:
    """Aggregate: texts in order of start, end and id."""
    rows = F.array_sort(F.collect_list(F.struct("start", "end", unique, F.col(column).alias("_text"))))
    return F.array_join(F.transform(rows, lambda x: x["_text"]), separator)


def split_words(df: DataFrame, keys: list[str], gap, speaker: str | None = None, unique: str = "id") -> DataFrame:
    """Words to turns: a new one after a pause longer than ``gap`` or at another speaker; turns without length are dropped."""
    rows = merge(df, keys, gap, speaker, [ordered_text("text", unique).alias("text")], unique)
    return rows.where("end > start")


def presence(df: DataFrame, keys: list[str], gap, least, score: str, unique: str = "id") -> DataFrame:
    """Samples (start = end = time) to stretches with average and peak score; short ones are dropped."""
    more = [F.avg(score).alias("avg_score"), F.max(score).alias("peak_score")]
    return merge(df, keys, gap, None, more, unique).where(F.col("end") - F.col("start") >= least)


def keyed_order_merge(df: DataFrame, keys: list[str], identity: list[str], gap, confidence: str, unique: str = "id") -> DataFrame:
    """Rows in one global order; a new stretch where the identity changes or after a pause. Average confidence."""
    order = _order(keys, unique)
    same = F.lit(True)
    for c in identity:
        same = same & F.col(c).eqNullSafe(F.lag(c).over(order))
    broken = ~same | (F.col("start") - F.lag("end").over(order) > gap)
    marked = df.withColumn("_new", F.coalesce(broken | F.lag(F.lit(1)).over(order).isNull(), F.lit(True)).cast("int"))
    marked = marked.withColumn("island", F.sum("_new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    return marked.groupBy(*keys, *identity, "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.avg(confidence).alias("confidence"), F.count("*").alias("n")).drop("island")


def repeats(df: DataFrame, keys: list[str], text: str, within, confidence: str, unique: str = "id") -> DataFrame:
    """One row per text and stretch of repeats that start within ``within`` of the last start; largest confidence and end."""
    order = W.partitionBy(*keys, text).orderBy("start", unique)
    broken = F.coalesce(F.col("start") - F.lag("start").over(order) > within, F.lit(True))
    marked = df.withColumn("island", F.sum(broken.cast("int")).over(order.rowsBetween(W.unboundedPreceding, 0)))
    return marked.groupBy(*keys, text, "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.max(confidence).alias("confidence"), F.count("*").alias("n")).drop("island")


def chain_prefix(df: DataFrame, keys: list[str], eligible: str, gap, unique: str = "id") -> DataFrame:
    """The rows of each timeline from its first on, as long as they are eligible and follow within ``gap``."""
    order = _order(keys, unique)
    broken = ~F.col(eligible) | F.coalesce(F.col("start") - F.lag("end").over(order) > gap, F.lit(False))
    return df.withColumn("_broken", F.sum(broken.cast("int")).over(order.rowsBetween(W.unboundedPreceding, 0))).where("_broken = 0").drop("_broken")


def split_at(df: DataFrame, cut: str, least_lead, least_tail) -> DataFrame:
    """Rows with a time ``cut`` inside become two if both parts are long enough; adds ``part`` (0 or 1)."""
    inside = F.col(cut).isNotNull() & (F.col(cut) - F.col("start") >= least_lead) & (F.col("end") - F.col(cut) >= least_tail)
    whole = F.array(F.struct(F.col("start").alias("s"), F.col("end").alias("e"), F.lit(0).alias("part")))
    two = F.array(F.struct(F.col("start").alias("s"), F.col(cut).alias("e"), F.lit(0).alias("part")), F.struct(F.col(cut).alias("s"), F.col("end").alias("e"), F.lit(1).alias("part")))
    rest = [c for c in df.columns if c not in ("start", "end", cut)]
    return df.select(*rest, F.explode(F.when(inside, two).otherwise(whole)).alias("_part")).select(*rest, F.col("_part.s").alias("start"), F.col("_part.e").alias("end"), "_part.part")


def pairs_of_bounds(df: DataFrame, keys: list[str], bound: str, least) -> DataFrame:
    """Consecutive distinct bounds of a timeline as start, end, number; bounds closer than ``least`` are one."""
    order = W.partitionBy(*keys).orderBy(bound)
    apart = F.coalesce(F.col(bound) - F.lag(bound).over(order) >= least, F.lit(True))
    kept = df.select(*keys, bound).distinct().withColumn("_keep", apart).where("_keep")
    pairs = kept.select(*keys, F.col(bound).alias("start"), F.lead(bound).over(order).alias("end"), F.row_number().over(order).alias("number"))
    return pairs.where("end is not null")


def transitions(df: DataFrame, keys: list[str], label: str, target: str, unique: str = "id") -> DataFrame:
    """Per timeline the latest start of a change to ``target`` and the earliest end of a change from it."""
    order = _order(keys, unique)
    rows = df.withColumn("_was", F.lag(label).over(order)).withColumn("_was_end", F.lag("end").over(order)).where("_was is not null")
    into = F.max(F.when((F.col("_was") != target) & (F.col(label) == target), F.col("start"))).alias("latest_into")
    out_of = F.min(F.when((F.col("_was") == target) & (F.col(label) != target), F.col("_was_end"))).alias("earliest_out")
    return rows.groupBy(*keys).agg(into, out_of)
