"""Writers: JSON artifacts, JSON lines, subtitles, Markdown reports, event rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.functions.values import clock, finite, srt_clock


def write_json(df: DataFrame, path: str) -> None:
    """Replaces the artifact."""
    df.write.mode("overwrite").json(path)


def append_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def to_srt(segments: DataFrame, keys: list[str], unique: str = "id") -> DataFrame:
    """keys, content: subtitles of each timeline, blocks numbered from 1 and separated by an empty line."""
    order = W.partitionBy(*keys).orderBy("start", unique)
    block = F.concat_ws("\n", F.row_number().over(order).cast("string"), F.concat(srt_clock(F.col("start")), F.lit(" --> "), srt_clock(F.col("end"))), F.col("text"))
    rows = segments.withColumn("_block", block).withColumn("_nth", F.row_number().over(order))
    packed = F.array_sort(F.collect_list(F.struct("_nth", "_block")))
    return rows.groupBy(*keys).agg(F.array_join(F.transform(packed, lambda x: x["_block"]), "\n\n").alias("content"))


def to_markdown(sections: DataFrame, keys: list[str], unique: str = "id") -> DataFrame:
    """keys, content: a heading with times for each section (start, end, title), its text below."""
    head = F.concat(F.lit("## "), F.col("title"), F.lit(" ("), clock(F.col("start")), F.lit(" - "), clock(F.col("end")), F.lit(")"))
    packed = F.array_sort(F.collect_list(F.struct("start", unique, F.concat_ws("\n\n", head, F.col("text")).alias("_part"))))
    return sections.groupBy(*keys).agg(F.array_join(F.transform(packed, lambda x: x["_part"]), "\n\n").alias("content"))


def event_rows(df: DataFrame, defaults: dict[str, Column], numbers: list[str]) -> DataFrame:
    """Rows ready to append: nulls of the named columns become defaults, numbers that aren't finite become null."""
    out = df.withColumns({name: F.coalesce(F.col(name), value) for name, value in defaults.items()})
    return out.withColumns({n: F.when(finite(F.col(n)), F.col(n)) for n in numbers})


def package(events: DataFrame, keys: list[str], flag: str) -> DataFrame:
    """keys, total, flagged, events (JSON of the flagged ones, of all if none is): what a presentation needs."""
    some = F.max(F.col(flag).cast("int")).over(W.partitionBy(*keys)) == 1
    rows = events.withColumn("_keep", F.when(some, F.col(flag)).otherwise(F.lit(True)))
    body = F.to_json(F.array_sort(F.collect_list(F.when(F.col("_keep"), F.struct("start", "end", "text")))))
    return rows.groupBy(*keys).agg(F.count("*").alias("total"), F.sum(F.col(flag).cast("int")).alias("flagged"), body.alias("events"))
