"""Mixing of sources: tempered shares, turned into a budget of tokens from permuted blocks of documents.

A source with the share q of all tokens gets a weight in proportion to q^a. The exponent a is found by
bisection: weights are even at 0 and the shares themselves at 1, and entropy falls in between. It is
the largest a in [0, 1] whose weights have the entropy asked for, or the smallest one that repeats no source more
often than allowed if that is larger (no a above 1 is tried: then the shares themselves are used).

The budget is realised source by source. Documents are hashed into blocks; each pass over a source
takes its blocks in an order of its own, whole passes first and then blocks, and at the end documents of one block,
as long as they fit the source's tokens.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.llm.common import cut


@dataclass(frozen=True)
class MixParams:
    """entropy: wanted entropy of the weights as a part of the largest one (None: not asked for).
    repeats: most passes over a source (None: any number). budget: tokens to give out (None: as many
    as there are). block_docs: a source of n documents has the root of n / block_docs blocks, so neither the
    blocks of a source nor the documents of a block grow with n itself. broadcast_rows: rows of a side up
    to which it is broadcast."""

    entropy: float | None = 0.97
    repeats: float | None = 4.0
    budget: int | None = None
    block_docs: int = 64
    seed: int = 3
    broadcast_rows: int = 200_000


def n_tokens(text: Column) -> Column:
    """Words of a text: runs of characters other than space and U+0009 to U+000D."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def tempered(shares: list[float], exponent: float) -> list[float]:
    powers = [q**exponent for q in shares]
    return [x / sum(powers) for x in powers]


def entropy(weights: list[float]) -> float:
    return -sum(w * math.log(w) for w in weights if w > 0)


#: For each exponent a the sums over sources of q^a and of q^a ln q.
Sums = Callable[[list[float]], list[tuple[float, float]]]


def sums_of(shares: list[float]) -> Sums:
    return lambda exponents: [(math.fsum(q**a for q in shares), math.fsum(q**a * math.log(q) for q in shares)) for a in exponents]


def find_exponent(sums: Sums, sources: int, smallest: float, turnover: float, p: MixParams) -> float:
    """The exponent for sources with these sums of shares; smallest: their smallest share, turnover: budget over all tokens.

    With Z and S for the two sums the weights q^a / Z have the entropy ln Z - a S / Z, and the source that is
    repeated most is the smallest one, turnover * q^(a - 1) / Z times.
    """
    wide = lambda a, z, s: p.entropy is None or math.log(z) - a * s / z >= p.entropy * math.log(sources) - 1e-12
    few = lambda a, z, s: p.repeats is None or turnover * smallest ** (a - 1) / z <= p.repeats * (1 + 1e-12)
    found = _bisect(sums, wide, last=True)
    return found if few(found, *sums([found])[0]) else max(found, _bisect(sums, few, last=False))


def _bisect(sums: Sums, holds: Callable[[float, float, float], bool], last: bool) -> float:
    """The last a in [0, 1] where a falling condition holds, or the first where a rising one does; 64 parts at a time."""
    at = lambda points: [holds(a, *zs) for a, zs in zip(points, sums(points), strict=True)]
    first_holds, last_holds = at([0.0, 1.0])
    if last_holds if last else not last_holds:
        return 1.0
    if not first_holds if last else first_holds:
        return 0.0
    low, high = 0.0, 1.0
    for _ in range(8):
        points = [low + (high - low) * k / 64 for k in range(1, 64)]
        same = sum(1 for x in at(points) if x == last)  # a run of points like low, then those like high
        ends = [low, *points, high]
        low, high = ends[same], ends[same + 1]
    return low if last else high


def mix(docs: DataFrame, p: MixParams = MixParams(), carry: tuple[str, ...] = ()) -> DataFrame:
    """A row for each time that a document is taken: doc_id, source, the columns of ``carry``, n_tokens, weight, epoch, block_rank.

    weight is the source's weight, epoch the number of the pass (from 0), block_rank the place of the
    document's block in that pass. A null source is a source of its own. Documents without tokens
    belong to every pass of their block and cost nothing; a source of only such documents has weight 0
    and is passed once. Rows with a null doc_id are all in one block of their source
    and never taken by a partial pass; repeated rows are taken
    together, and texts of any length count whole. Blocks and documents whose hashes tie are in order of their number
    or doc_id. An empty table gives an empty result. Other columns are not read.
    """
    own = docs.select("doc_id", "source", *carry).columns
    key = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")).alias("_key")  # never null
    rows = docs.select(*own, n_tokens(F.col("text")).alias("n_tokens"), key)
    slim = cut(docs.select("doc_id", key, n_tokens(F.col("text")).alias("n_tokens")))
    totals = cut(slim.groupBy("_key").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs")))
    full = totals.where("tokens > 0")
    total, least, n, n_sources = totals.select(F.coalesce(F.sum("tokens"), F.lit(0)), F.min(F.when(F.col("tokens") > 0, F.col("tokens"))), F.count_if(F.col("tokens") > 0), F.count("*")).first()
    budget = total if p.budget is None else p.budget

    def sums(exponents: list[float]) -> list[tuple[float, float]]:
        share = F.col("tokens") / float(total)
        tried = full.select(share.alias("q"), F.posexplode(F.array(*map(F.lit, exponents))).alias("k", "a"))
        found = {r["k"]: (r["z"], r["s"]) for r in tried.groupBy("k").agg(F.sum(F.expr("pow(q, a)")).alias("z"), F.sum(F.expr("pow(q, a) * ln(q)")).alias("s")).collect()}
        return [found[k] for k in range(len(exponents))]

    exponent = find_exponent(sums, n, least / total, budget / total, p) if n else 1.0
    whole = sums([exponent])[0][0] if n else 1.0
    weight = F.when(F.col("tokens") > 0, F.pow(F.col("tokens") / float(total or 1), F.lit(exponent)) / whole).otherwise(0.0)
    plan = totals.withColumn("weight", weight).withColumn("quota", F.floor(F.col("weight") * budget + 1e-6))
    passes, rest = F.expr("if(tokens > 0, quota div tokens, 1L)"), F.expr("if(tokens > 0, quota % tokens, 0L)")
    blocks = F.greatest(F.lit(1), F.ceil(F.sqrt(F.col("docs") / p.block_docs))).cast("long")
    sources = cut(plan.select("_key", "weight", passes.alias("passes"), rest.alias("rest"), blocks.alias("blocks")))
    sources = F.broadcast(sources) if n_sources <= p.broadcast_rows else sources
    block = F.expr(f"pmod(xxhash64(doc_id, {p.seed}L), blocks)")
    order = lambda epoch: F.expr(f"xxhash64({p.seed}L, {epoch}, _key, block)")
    blocked = lambda df: df.join(sources, "_key").withColumn("block", block)

    # The order of blocks in each pass, and how far the last, partial pass reaches.
    blocks = cut(blocked(slim).groupBy("_key", "block", "passes", "rest").agg(F.sum("n_tokens").alias("tokens")))
    last = W.partitionBy("_key").orderBy(order("passes"), "block")
    reach = blocks.withColumn("before", F.sum("tokens").over(last) - F.col("tokens")).withColumn("last_rank", F.row_number().over(last))
    reach = reach.selectExpr("_key", "block", "last_rank", "rest - before as room", "rest > 0 and rest - before >= tokens as whole")
    ranks = blocks.where("passes > 0").withColumn("epoch", F.explode(F.expr("sequence(0L, passes - 1)")))
    ranks = ranks.withColumn("block_rank", F.row_number().over(W.partitionBy("_key", "epoch").orderBy(order("epoch"), "block")))
    ranks = ranks.groupBy("_key", "block").agg(F.collect_list(F.struct("epoch", "block_rank")).alias("full"))
    places = cut(reach.join(ranks, ["_key", "block"], "left"))
    small = F.broadcast if places.count() <= p.broadcast_rows else (lambda df: df)

    # Documents of the one block of a source that is taken in part: as many as fit, in an order of their own.
    cutting = blocked(slim).join(small(places.where("not whole and room > 0").select("_key", "block", "room")), ["_key", "block"])
    inside = W.partitionBy("_key").orderBy(F.expr(f"xxhash64({p.seed + 1}L, doc_id)"), "doc_id", "n_tokens").rowsBetween(W.unboundedPreceding, 0)
    fitting = cutting.withColumn("used", F.sum("n_tokens").over(inside)).groupBy("_key", "doc_id").agg(F.max("used").alias("used"), F.max("room").alias("room"))
    fitting = cut(fitting.where("used <= room and doc_id is not null").select("_key", "doc_id"))
    fitting = F.broadcast(fitting) if fitting.count() <= p.broadcast_rows else fitting

    # Every document once for each pass that takes it.
    tagged = blocked(rows).join(small(places), ["_key", "block"]).join(fitting.withColumn("fits", F.lit(True)), ["_key", "doc_id"], "left")
    partly = "if(whole or coalesce(fits, false), array(struct(passes as epoch, last_rank as block_rank)), array())"
    taken = tagged.withColumn("place", F.explode(F.expr(f"concat(coalesce(full, array()), {partly})")))
    return taken.select(*own, "n_tokens", "weight", "place.epoch", "place.block_rank")
