"""Documents that hold items of a benchmark, by DataFrame functions alone.

A window is a run of as many words as an item has, or a whole text that has fewer. Window and item
are multisets of word shingles. Their similarity is the larger of the plain Jaccard similarity and a
weighted one, in which a shingle weighs more the fewer item texts it is in, and a shingle of no
item as much as a shingle of one.

1. Shingles of all documents meet the shingles of the items.
2. A window at similarity t shares at least t of the item, by count or by weight. So only those pairs
   of a text and an item go on whose whole text holds that much, and of these only the windows
   that have places enough with shingles of the item. Neither step loses a window.
3. The exact similarity decides.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import cut


@dataclass(frozen=True)
class DecontaminationParams:
    """shingle: words in a shingle. similarity: least similarity of a window. broadcast_rows: rows of a
    side up to which it is broadcast."""

    shingle: int = 5
    similarity: float = 0.8
    broadcast_rows: int = 200_000


def words_of(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def shingle_hashes(words: str, width: int) -> Column:
    """The hash of each run of ``width`` words, in order; empty if there are fewer words."""
    picked = ", ".join(f"{words}[i + {k}]" for k in range(width))
    inside = f"transform(sequence(0, size({words}) - {width}), i -> xxhash64({picked}))"
    return F.expr(f"if(size({words}) >= {width}, {inside}, cast(array() as array<bigint>))")


def _small(df: DataFrame, p: DecontaminationParams) -> DataFrame:
    """df, written down, and marked for broadcast if it is small."""
    df = cut(df)
    return F.broadcast(df) if df.count() <= p.broadcast_rows else df


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def contaminated(docs: DataFrame, benchmark: DataFrame, p: DecontaminationParams = DecontaminationParams()) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, contaminated, items (item_ids in order), similarity (the best).

    An item of fewer words than a shingle has one shingle, all its words, and is found where they
    stand in a row. Null or empty items and texts, and items without an id, match nothing; similarity
    is then null and items empty. Rows with a null doc_id are never contaminated. Rows that repeat a
    doc_id are judged one by one and share the result. Repeated items give one entry. Other columns
    are not read.
    """
    owned = benchmark.where("item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), words_of(F.col("text")).alias("words"))
    items = owned.where("size(words) > 0").groupBy("words").agg(F.collect_set("item_id").alias("item_ids"))
    items = items.select(F.monotonically_increasing_id().alias("item"), "item_ids", "words", F.size("words").alias("size"), F.least(F.size("words"), F.lit(p.shingle)).alias("width"))
    items = _small(items, p)
    widths = [r["width"] for r in items.select("width").distinct().collect()]
    texts = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.md5("text").alias("digest"), words_of(F.col("text")).alias("words"))
    row = ["doc_id", "digest"]
    nothing = docs.select("doc_id", F.lit(False).alias("contaminated"), F.expr("cast(array() as array<bigint>)").alias("items"), F.lit(None).cast("double").alias("similarity"))
    if not widths:
        return nothing
    shingled = [items.where(F.col("width") == w).select("item", "size", "width", F.explode(shingle_hashes("words", w)).alias("hash")) for w in widths]
    parts = cut(_union(shingled).groupBy("item", "size", "width", "hash").agg(F.count("*").alias("item_times")))
    known = _small(parts.groupBy("hash").agg(F.count("*").alias("n")), p)
    rarity = f"1 + ln({items.count() + 1}D / (1 + coalesce(n, 1)))"
    parts = _small(parts.join(known, "hash").withColumn("rarity", F.expr(rarity)).drop("n"), p)
    totals = _small(parts.groupBy("item", "size", "width").agg(F.sum("item_times").alias("item_count"), F.sum(F.expr("item_times * rarity")).alias("item_weight")), p)

    # Places of documents with a shingle of any item.
    found = []
    for w in widths:
        flat = texts.select(*row, F.size("words").alias("n_words"), F.posexplode(shingle_hashes("words", w)).alias("place", "hash"))
        own = parts.where(F.col("width") == w).select("hash").distinct()
        found.append(flat.join(F.broadcast(own) if known.count() <= p.broadcast_rows else own, "hash", "left_semi").withColumn("width", F.lit(w)))
    places = cut(_union(found).distinct())

    # Pairs of a row and an item that share enough in all.
    enough = f"weight >= {p.similarity} * item_weight - 1e-6 or count >= {p.similarity} * item_count - 1e-6"
    held = places.groupBy(*row, "n_words", "width", "hash").agg(F.count("*").alias("times")).join(parts, ["width", "hash"])
    held = held.withColumn("times", F.least("times", "item_times")).groupBy(*row, "n_words", "item").agg(F.sum("times").alias("count"), F.sum(F.expr("times * rarity")).alias("weight"))
    pairs = _small(held.join(totals, "item").where(enough).select(*row, "n_words", "item"), p)

    # Windows that hold enough of the places that an item shares.
    met = places.join(parts.select("item", "size", "width", "hash", "rarity"), ["width", "hash"]).join(pairs, [*row, "n_words", "item"])
    met = met.withColumn("length", F.least("size", "n_words"))
    reach = "explode(sequence(greatest(0, place - length + width), least(place, n_words - length))) as start"
    met = met.selectExpr(*row, "item", "length", "rarity", reach).groupBy(*row, "item", "length", "start").agg(F.count("*").alias("count"), F.sum("rarity").alias("weight"))
    windows = cut(met.join(totals, "item").where(enough).select(*row, "item", "width", "length", "start"))

    # Exact similarity: what both share over what both have less the shared.
    spans = windows.drop("item").distinct()
    some = texts.join(_small(spans.select(*row).distinct(), p), row, "left_semi").dropDuplicates(row)
    spans = spans.join(some, row).withColumn("words", F.expr("slice(words, start + 1, length)"))
    window = [*row, "width", "length", "start"]
    counted = _union([spans.where(F.col("width") == w).select(*window, F.explode(shingle_hashes("words", w)).alias("hash")) for w in widths])
    counted = counted.groupBy(*window, "hash").agg(F.count("*").alias("times"))
    counted = cut(counted.join(known, "hash", "left").withColumn("rarity", F.expr(rarity)).drop("n"))
    whole = counted.groupBy(*window).agg(F.sum("times").alias("count"), F.sum(F.expr("times * rarity")).alias("weight"))
    meet = windows.join(counted.drop("rarity"), window).join(parts.select("item", "hash", "item_times", "rarity"), ["item", "hash"])
    meet = meet.withColumn("times", F.least("times", "item_times")).groupBy(*window, "item").agg(F.sum("times").alias("both_count"), F.sum(F.expr("times * rarity")).alias("both_weight"))
    judged = meet.join(whole, window).join(totals.drop("size", "width"), "item")
    plain, weighted = (f"both_{x} / (cast({x} as double) + item_{x} - both_{x})" for x in ("count", "weight"))
    judged = judged.withColumn("similarity", F.expr(f"greatest({plain}, {weighted})")).where(F.col("similarity") >= p.similarity - 1e-9)
    best = judged.groupBy("doc_id", "item").agg(F.max("similarity").alias("similarity")).join(items.select("item", F.explode("item_ids").alias("item_id")), "item")
    best = best.groupBy("doc_id").agg(F.array_sort(F.collect_set("item_id")).alias("items"), F.max("similarity").alias("similarity"))
    best = _small(best, p)
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id")).join(best, "doc_id", "left")
    return out.select("doc_id", F.col("similarity").isNotNull().alias("contaminated"), F.coalesce("items", F.expr("cast(array() as array<bigint>)")).alias("items"), "similarity")
