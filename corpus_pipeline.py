"""The corpus pipeline: stages over the documents table, each written as Parquet before the next one reads it.

Every stage reads and returns the columns of COLUMNS; others are not kept, whatever their names. Null, empty and
blank texts pass all stages (the classifier scores them like any text); texts of any length are taken whole; rows that
repeat an id, or have none, are rows of their own; empty tables give empty results.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.llm.common import cut
from weftline.llm.decontaminate import contaminated
from weftline.llm.mixing import mix
from weftline.llm.near_dup import NearDupParams, near_duplicates
from weftline.llm.quality import keep_good
from weftline.llm.substring import SubstringParams, remove_repeats

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

#: Ids up to this number are broadcast to drop their documents; more are joined by a shuffle.
BROADCAST_IDS = 200_000


def _few(df: DataFrame) -> DataFrame:
    """df, written down, and marked for broadcast if it has few rows."""
    df = cut(df)
    return F.broadcast(df) if df.count() <= BROADCAST_IDS else df


def _keyed(docs: DataFrame) -> DataFrame:
    """docs with row_key: a number for each pair of doc_id and text, and never null.

    A doc_id that stands once is its own key. Rows that repeat one, and rows without one, get numbers
    above all ids, ordered by id (null last) and digest of the text; the first text of an id keeps the id.
    """
    ids = docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null").select("doc_id")
    ids = _few(ids.withColumnRenamed("doc_id", "odd_id"))
    if ids.isEmpty():
        return docs.withColumn("row_key", F.col("doc_id").cast("long"))
    odd = docs.join(ids, docs["doc_id"].eqNullSafe(ids["odd_id"]), "left_semi").select("doc_id", F.md5("text").alias("digest")).distinct()
    first = F.row_number().over(W.partitionBy("doc_id").orderBy(F.col("digest").asc_nulls_last())) == 1
    odd = cut(odd.withColumn("own", first & F.col("doc_id").isNotNull()).sort(F.col("doc_id").asc_nulls_last(), F.col("digest").asc_nulls_last()).withColumn("part", F.spark_partition_id()))
    sizes = sorted((r["part"], r["count"]) for r in odd.groupBy("part").count().collect())
    top = docs.agg(F.max("doc_id")).first()[0]
    starts, at = [], 0 if top is None else max(0, top) + 1
    for part, n in sizes:
        starts.append((part, at))
        at += n
    starts = F.broadcast(docs.sparkSession.createDataFrame(starts, "part int, begin long"))
    place = F.row_number().over(W.partitionBy("part").orderBy(F.col("doc_id").asc_nulls_last(), F.col("digest").asc_nulls_last())) - 1
    numbered = odd.withColumn("place", place).join(starts, "part")
    keys = _few(numbered.select(F.col("doc_id").alias("odd_id"), F.col("digest").alias("odd_digest"), F.when(F.col("own"), F.col("doc_id")).otherwise(F.col("begin") + F.col("place")).cast("long").alias("odd_key")))
    same = docs["doc_id"].eqNullSafe(keys["odd_id"]) & F.md5(docs["text"]).eqNullSafe(keys["odd_digest"])
    return docs.join(keys, same, "left").select(*(docs[c] for c in docs.columns), F.coalesce("odd_key", docs["doc_id"].cast("long")).alias("row_key"))


def _without(keyed: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of keyed whose row_key isn't among the doc_ids of ids."""
    ids = _few(ids.select(F.col("doc_id").alias("gone_id")).distinct())
    return keyed.join(ids, keyed["row_key"] == ids["gone_id"], "left_anti")


def _once(keyed: DataFrame) -> DataFrame:
    """The rows of keyed, of those with one row_key and the same words only the least; rows without words all stay."""
    worded = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    again = _few(keyed.where(worded).groupBy("row_key").agg(F.count("*").alias("n")).where("n > 1").select(F.col("row_key").alias("again_key")))
    if again.isEmpty():
        return keyed
    repeated = keyed["row_key"] == again["again_key"]
    least = keyed.join(again, repeated, "left_semi").groupBy("row_key").agg(F.min(F.struct(*keyed.columns)).alias("row")).select("row.*")
    return keyed.join(again, repeated, "left_anti").unionByName(least)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    return keep_good(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates (five-word shingles, similarity 0.8): the one with the smallest id.

    Rows that repeat an id and rows without one take part as rows of their own; a row with an id goes before one without.
    """
    keyed = _keyed(docs.select(*COLUMNS))
    again = near_duplicates(keyed.select(F.col("row_key").alias("doc_id"), "text"), NearDupParams(shingle=5)).where("not kept")
    return _once(_without(keyed, again)).drop("row_key")


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the words that repeated passages cover; other texts stay as they are."""
    rest = remove_repeats(docs.select(*COLUMNS), SubstringParams(untouched=True), carry=("lang", "source"))
    return rest.select("doc_id", F.col("kept").alias("text"), "lang", "source", F.length("kept").cast("long").alias("n_chars"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no benchmark item, whether or not they have an id."""
    keyed = _keyed(docs.select(*COLUMNS))
    found = contaminated(keyed.select(F.col("row_key").alias("doc_id"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _without(keyed, found.where("contaminated")).drop("row_key")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time that a document is taken into the mixture, with its text."""
    return mix(docs.select(*COLUMNS), carry=("text", "lang", "n_chars"))


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", quality),
    ("minhash near-dedup", near_dedup),
    ("substring dedup", substring_dedup),
    ("benchmark decontamination", decontamination),
    ("mixing sources", mixing),
]

#: No SQL: the classifier is fitted and the components are iterated; the tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the documents table of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    cut(spark.range(0))  # makes sure of a shared folder
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
    return docs
