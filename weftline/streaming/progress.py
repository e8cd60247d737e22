"""The state of running jobs from a stream of progress events, kept as a table that survives replayed batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from weftline.operators.entity import latest, upsert

_STATE = "elapsed double, sampled double, total double, percent double, rate double, remaining double, events long"


def rates(events: DataFrame, before: DataFrame, key: str) -> DataFrame:
    """The last event of each key of ``events`` (elapsed_sec, sampled, total_samples) as a row of the table ``before``, which has the state so far.

    rate: samples a second since the event before, which may be the one in the table; null without one or without time between.
    remaining: seconds at this rate. events: how many there were. Events without elapsed_sec only count.
    """
    known = before.select(key, F.col("elapsed").alias("elapsed_sec"), "sampled", F.col("total").alias("total_samples"), F.lit(0).alias("_n"), F.col("events").alias("_known"))
    rows = events.select(key, "elapsed_sec", "sampled", "total_samples", F.lit(1).alias("_n"), F.lit(0).cast("long").alias("_known"))
    both = rows.unionByName(known.join(rows.select(key).distinct(), key, "left_semi"))
    order = W.partitionBy(key).orderBy(F.col("elapsed_sec").asc_nulls_first(), "sampled", "_n")
    gap = F.col("elapsed_sec") - F.lag("elapsed_sec").over(order)
    rate = F.when(gap > 0, (F.col("sampled") - F.lag("sampled").over(order)) / gap)
    timed = both.withColumn("rate", rate).withColumn("events", F.sum(F.col("_n") + F.col("_known")).over(W.partitionBy(key)).cast("long"))
    last = latest(timed, [key], [F.desc_nulls_last("elapsed_sec"), F.desc("sampled"), F.desc("_n")])
    remaining = F.when(F.col("rate") > 0, F.greatest(F.lit(0.0), F.col("total_samples") - F.col("sampled")) / F.col("rate"))
    percent = F.when(F.col("total_samples") > 0, 100 * F.col("sampled") / F.col("total_samples"))
    return last.select(key, F.col("elapsed_sec").alias("elapsed"), "sampled", F.col("total_samples").alias("total"), percent.alias("percent"), "rate", remaining.alias("remaining"), "events")


def snapshots(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the micro-batches whose tables lie in the folder."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(path):
        return []
    found = [f.getPath() for f in files.listStatus(path)]
    done = [p for p in found if p.getName().startswith("batch=") and files.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return sorted(int(p.getName().split("=")[1]) for p in done)


def current(spark: SparkSession, folder: str, key_type: str = "long", key: str = "job", before: int | None = None) -> DataFrame:
    """The table after the last micro-batch, or the last one before a number; empty if there is none."""
    numbers = [n for n in snapshots(spark, folder) if before is None or n < before]
    if not numbers:
        return spark.createDataFrame([], f"{key} {key_type}, {_STATE}")
    return spark.read.parquet(f"{folder}/batch={numbers[-1]}")


def apply_batch(events: DataFrame, number: int, folder: str, key: str = "job") -> None:
    """Puts the events of a micro-batch into the table of the one before and writes the table of this one.

    The same number gives the same table however often it is run, as it always starts from the one before.
    """
    table = current(events.sparkSession, folder, dict(events.dtypes)[key], key, number)
    upsert(table, rates(events, table, key), [key]).write.mode("overwrite").parquet(f"{folder}/batch={number}")


def write_progress(events: DataFrame, folder: str, checkpoint: str, key: str = "job", **trigger) -> StreamingQuery:
    """Keeps the table of a stream of progress events (``readers.parse_progress`` with the key) in a shared folder."""
    writer = events.writeStream.foreachBatch(lambda batch, number: apply_batch(batch, number, folder, key))
    return writer.option("checkpointLocation", checkpoint).trigger(**trigger).start()
