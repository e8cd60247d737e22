"""Nearest neighbours by inner product from balanced posting lists.

Vectors are lifted by one coordinate so that the largest inner product is the smallest distance.
Centroids are fitted on a sample in two levels: k-means of a small sample into groups, then k-means of
each group in a task of its own, with large clusters split. Sample and number of lists grow with the
table, up to ``most_lists``. Every vector is then indexed: it goes to the list of its nearest centroid and, near
a border, to a few more. A query finds centroids by a best-first search on a graph that links each
centroid with its nearest ones; lists much farther than the nearest one are pruned by their distance ratio.

Lists and the queries that read them meet in cells. A list of many vectors or many readers has as many
cells as its counts ask for, so no list, however hot, is one task's work; a cell holds a bounded block
of vectors and streams its queries past it, and a task merges the results of all its cells
before it hands them on.

Equal vectors are searched once. Of the copies of one vector only the ``top + 1`` smallest ids can
be in any result (ties go to smaller ids), so only they are carried; this loses nothing.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.llm.common import cut, groups


@dataclass(frozen=True)
class AnnParams:
    """top: results for each query. list_size: vectors for each centroid aimed at. most_lists: most centroids;
    they are held by every worker. per_list: sampled vectors for each centroid, those with the
    smallest hashes. coarse: sampled vectors that the groups are fitted on. copies and border: a vector
    goes to at most so many lists, those within so many times the distance of the nearest centroid. ratio:
    lists within so many times the nearest distance are read. least: times the root of the number of
    lists that are read at least. degree: neighbours in the graph. cell: vectors of a cell, and queries."""

    top: int = 20
    list_size: int = 256
    most_lists: int = 65_536
    per_list: int = 48
    coarse: int = 8_192
    copies: int = 4
    border: float = 1.25
    ratio: float = 1.1
    least: float = 2.5
    degree: int = 24
    cell: int = 8_192
    rounds: int = 12
    seed: int = 11


def _nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances of each row of x from each centroid."""
    d = (x * x).sum(axis=1)[:, None] - 2 * x @ centroids.T + (centroids * centroids).sum(axis=1)
    return np.maximum(d, 0)


def fit_centroids(x: np.ndarray, n_lists: int, p: AnnParams) -> np.ndarray:
    """k-means from a random start; after each round the largest clusters take over the places of the smallest."""
    random = np.random.default_rng(p.seed)
    centroids = x[random.choice(len(x), min(n_lists, len(x)), replace=False)].copy()
    for k in range(p.rounds):
        own = np.concatenate([_nearest(x[at : at + 4096], centroids).argmin(axis=1) for at in range(0, len(x), 4096)])
        size = np.bincount(own, minlength=len(centroids))
        total = np.zeros_like(centroids)
        np.add.at(total, own, x)
        centroids = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], centroids)
        if k < p.rounds - 3:
            order = np.argsort(size)
            for small, large in zip(order, order[::-1], strict=True):
                if size[large] <= 2 * len(x) / len(centroids) or size[small] >= size[large] / 4:
                    break
                members = x[own == large]
                centroids[small] = members[random.integers(len(members))]
    return centroids


class CentroidGraph:
    """Each centroid is linked with its nearest ones, in both directions.

    A far group of centroids may have no link with the others, so a search starts from about as many
    centroids as the root of their number, each the farthest one from those chosen before.
    """

    def __init__(self, centroids: np.ndarray, degree: int):
        self.centroids = centroids
        near = np.concatenate([np.argsort(_nearest(centroids[at : at + 512], centroids), axis=1)[:, 1 : degree + 1] for at in range(0, len(centroids), 512)])
        links: list[set[int]] = [set(row.tolist()) for row in near]
        for a, row in enumerate(near.tolist()):
            for b in row:
                links[b].add(a)
        self.links = [np.array(sorted(x), np.int64) for x in links]
        starts = [int(_nearest(centroids.mean(axis=0)[None], centroids).argmin())]
        away = _nearest(centroids[starts], centroids)[0]
        while len(starts) < int(np.ceil(np.sqrt(len(centroids)))):
            starts.append(int(away.argmax()))
            away = np.minimum(away, _nearest(centroids[starts[-1:]], centroids)[0])
        self.starts = np.unique(starts)

    def search(self, query: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Centroids near the query and their squared distances, nearest first."""
        seen = np.zeros(len(self.centroids), bool)
        seen[self.starts] = True
        first = sorted(zip(_nearest(query[None], self.centroids[self.starts])[0].tolist(), self.starts.tolist(), strict=True))
        ahead, best = first[:width], [(-d, k) for d, k in first[:width]]
        heapq.heapify(best)
        while ahead:
            distance, node = heapq.heappop(ahead)
            if len(best) >= width and distance > -best[0][0]:
                break
            new = self.links[node][~seen[self.links[node]]]
            seen[new] = True
            for d, k in zip(_nearest(query[None], self.centroids[new])[0].tolist(), new.tolist(), strict=True):
                if len(best) < width or d < -best[0][0]:
                    heapq.heappush(ahead, (d, k))
                    heapq.heappush(best, (-d, k))
                    if len(best) > width:
                        heapq.heappop(best)
        found = sorted((-d, k) for d, k in best)
        return np.array([k for _, k in found], np.int64), np.array([d for d, _ in found])


def usable(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """id and vector of the rows that take part: id and vector not null, components finite, not all zero, of the usual length.

    A vector keeps its type if that is float or double; other numbers become doubles.
    """
    kind = "float" if dict(vectors.dtypes)[vector_column] == "array<float>" else "double"
    real = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).cast(f"array<{kind}>").alias("vector"))
    good = f"id is not null and vector is not null and not exists(vector, x -> x is null or isnan(x) or abs(x) = {kind}('infinity')) and exists(vector, x -> x <> 0)"
    real = real.where(good)
    lengths = real.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).collect()
    return real.where(F.size("vector") == (lengths[0]["n"] if lengths else 0))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1).astype(np.float64)


def nearest(vectors: DataFrame, queries: str, p: AnnParams = AnnParams(), id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each row that the SQL condition ``queries`` (on id) picks, its nearest other rows.

    score is the inner product of the vectors as they are, float or double, in double precision; ties go to the
    smaller vec_id. Null vectors, zero
    vectors and those with null or non-finite components, or without an id, take no part; nor do
    vectors whose length isn't the most frequent one. Rows repeated with their id are one. With fewer
    candidates than asked for all that were found are returned. An empty table gives an empty result. Other
    columns are not read.
    """
    rows = usable(vectors, id_column, vector_column)
    keyed = rows.select("id", "vector", F.xxhash64("vector").alias("key"), F.expr("xxhash64(reverse(vector))").alias("key2"))
    order = W.partitionBy("key", "key2").orderBy("id")
    some = keyed.withColumn("nth", F.dense_rank().over(order)).where(F.col("nth") <= p.top + 1)  # cut down before the shuffle, too
    first = cut(some.dropDuplicates(["key", "key2", "id"]))
    reps = first.where("nth = 1").select("key", "key2", "vector", F.col("id").alias("rep"))
    members = first.join(reps.select("key", "key2", "rep"), ["key", "key2"]).select("rep", "id")
    asked = keyed.where(queries).select(F.col("id").alias("query_id"), "key", "key2").distinct()
    query_of = asked.join(reps.select("key", "key2", "rep"), ["key", "key2"]).select("query_id", F.col("rep").alias("query"))
    query_reps = reps.join(query_of.select(F.col("query").alias("rep")).distinct(), "rep", "left_semi").select("rep", "vector")
    found = _search(reps.select("rep", "vector"), query_reps, p)

    score_first = W.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    wide = found.join(members, "rep").select("query", F.col("id").alias("vec_id"), "score")
    wide = wide.withColumn("nth", F.row_number().over(score_first)).where(F.col("nth") <= p.top + 1)
    last = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    out = query_of.join(wide, "query").where("vec_id <> query_id").withColumn("rank", F.row_number().over(last).cast("int"))
    return out.where(F.col("rank") <= p.top).select("query_id", "rank", "vec_id", "score")


@dataclass(frozen=True)
class Lift:
    """Divides by the largest component, so that squares stay finite, and adds the coordinate that gives all vectors one length."""

    largest: float
    longest: float

    def vectors(self, x: np.ndarray) -> np.ndarray:
        x = x / self.largest
        return np.column_stack([x, np.sqrt(np.maximum(self.longest - (x * x).sum(axis=1), 0))])

    def queries(self, x: np.ndarray) -> np.ndarray:
        x = x / self.largest
        return np.column_stack([x / np.maximum(np.linalg.norm(x, axis=1), 1e-300)[:, None] * np.sqrt(self.longest), np.zeros(len(x))])


def fit_lists(reps: DataFrame, n: int, lift: Lift, p: AnnParams) -> np.ndarray:
    """The centroids, from the vectors with the smallest hashes: groups on the driver, each group's own in a task."""
    n_lists = int(min(p.most_lists, max(1, -(-n // p.list_size))))
    nth = F.expr("pmod(xxhash64(rep), 2147483648L)")
    part = lambda k: int(min(1.0, k / n) * 2147483648)
    sample = reps.where(nth <= part(min(p.coarse, p.per_list * n_lists))).select("vector").toArrow()  # about p.coarse rows
    if not sample.num_rows:
        sample = reps.limit(1).select("vector").toArrow()
    x = lift.vectors(_matrix(sample.column("vector")))
    n_groups = int(np.ceil(np.sqrt(n_lists))) if p.per_list * n_lists > p.coarse else n_lists
    coarse = fit_centroids(x, min(n_groups, max(1, len(x) // 8)), p)
    if n_groups >= n_lists:
        return coarse
    inner = -(-n_lists // len(coarse))

    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = _nearest(lift.vectors(_matrix(batch.column("vector"))), coarse).argmin(axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), batch.column("vector")], names=["group", "vector"])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in groups(batches, ["group"]):
            found = fit_centroids(lift.vectors(_matrix(own.column("vector"))), min(inner, max(1, own.num_rows // 8)), p)
            yield pa.RecordBatch.from_arrays([own.column("group")[:1].combine_chunks(), pa.array([found.tobytes()], pa.binary())], names=["group", "found"])

    kind = dict(reps.dtypes)["vector"]
    dealt = reps.where(nth <= part(p.per_list * n_lists)).select("vector").mapInArrow(group, f"group int, vector {kind}").repartition("group").sortWithinPartitions("group")
    rows = dealt.mapInArrow(split, "group int, found binary").orderBy("group").collect()  # at most most_lists centroids
    return np.concatenate([np.frombuffer(r["found"], float).reshape(-1, x.shape[1]) for r in rows])


def _best(query: np.ndarray, rep: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each query its k largest scores, each rep once; ties go to the smaller rep."""
    order = np.lexsort((-score, rep, query))
    query, rep, score = query[order], rep[order], score[order]
    new = np.ones(len(query), bool)
    new[1:] = (query[1:] != query[:-1]) | (rep[1:] != rep[:-1])
    query, rep, score = query[new], rep[new], score[new]
    order = np.lexsort((rep, -score, query))
    query, rep, score = query[order], rep[order], score[order]
    starts = np.flatnonzero(np.concatenate([[True], query[1:] != query[:-1]])) if len(query) else np.empty(0, int)
    place = np.arange(len(query)) - np.repeat(starts, np.diff(np.append(starts, len(query))))
    keep = place < k
    return query[keep], rep[keep], score[keep]


def _search(reps: DataFrame, queries: DataFrame, p: AnnParams) -> DataFrame:
    """query, rep, score: for each query its best top + 1 distinct vectors, itself included."""
    schema = "query long, rep long, score double"
    n, largest = reps.selectExpr("count(*) as n", "max(array_max(transform(vector, x -> abs(cast(x as double)))))").collect()[0]
    if not n:
        return reps.sparkSession.createDataFrame([], schema)
    longest = reps.selectExpr(f"max(aggregate(vector, 0D, (s, x) -> s + (x / {largest!r}D) * (x / {largest!r}D)))").collect()[0][0]
    lift = Lift(largest, longest)
    centroids = fit_lists(reps, n, lift, p)
    graph = CentroidGraph(centroids, p.degree)
    kind = dict(reps.dtypes)["vector"]

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                some = batch.slice(at, 1024)
                d = _nearest(lift.vectors(_matrix(some.column("vector"))), centroids)
                copies = min(p.copies, d.shape[1])
                near = np.argpartition(d, copies - 1, axis=1)[:, :copies]
                close = np.take_along_axis(d, near, axis=1)
                row, col = np.nonzero(close <= p.border**2 * close.min(axis=1, keepdims=True) + 1e-12)
                yield pa.RecordBatch.from_arrays([pa.array(near[row, col].astype(np.int32)), *(some.column(c).take(pa.array(row)) for c in ("rep", "vector"))], names=["list", "rep", "vector"])

    def probes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = int(np.ceil(p.least * np.sqrt(len(centroids))))
        for batch in batches:
            if not batch.num_rows:
                continue
            row, chosen = [], []
            for k, query in enumerate(lift.queries(_matrix(batch.column("vector")))):
                node, d = graph.search(query, 2 * least)
                node = node[(np.arange(len(node)) < least) | (d <= p.ratio**2 * d[0])]
                row += [k] * len(node)
                chosen.append(node)
            picked = pa.array(np.concatenate(chosen).astype(np.int32))
            yield pa.RecordBatch.from_arrays([picked, *(batch.column(c).take(pa.array(row)) for c in ("rep", "vector"))], names=["list", "rep", "vector"])

    posted = cut(reps.mapInArrow(lists, f"list int, rep long, vector {kind}"))
    asking = cut(queries.mapInArrow(probes, f"list int, rep long, vector {kind}"))
    counts = [dict(df.groupBy("list").count().collect()) for df in (posted, asking)]  # a number for each list

    def dealt(df: DataFrame, side: int) -> DataFrame:
        """The rows once for each cell of their list: a vector for all parts of the queries, a query for all parts of the vectors."""
        parts = [np.array([-(-c.get(k, 0) // p.cell) or 1 for k in range(len(centroids))], np.int32) for c in counts]

        def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                own = batch.column("list").to_numpy()
                part = (batch.column("rep").to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % parts[side][own]
                times = parts[1 - side][own]
                row = np.repeat(np.arange(len(own)), times)
                other = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
                cell = (part[row] * times[row] + other) if side == 0 else (other * parts[side][own][row] + part[row])
                columns = [batch.column("list").take(pa.array(row)), pa.array(cell.astype(np.int32)), pa.array(np.full(len(row), side, np.int32)), *(batch.column(c).take(pa.array(row)) for c in ("rep", "vector"))]
                yield pa.RecordBatch.from_arrays(columns, names=["list", "cell", "side", "rep", "vector"])

        return df.mapInArrow(cells, f"list int, cell int, side int, rep long, vector {kind}")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, matrix = None, [], []
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        waiting = 0
        for part in groups(batches, ["list", "cell", "side"]):
            place, side = (part.column("list")[0].as_py(), part.column("cell")[0].as_py()), part.column("side")[0].as_py()
            if side == 0:
                now, ids, matrix = place, part.column("rep").to_numpy(), _matrix(part.column("vector"))
            elif place == now:
                asked = part.column("rep").to_numpy()
                k = min(p.top + 1, len(ids))
                for at in range(0, len(asked), 256):
                    score = _matrix(part.column("vector").slice(at, 256)) @ matrix.T
                    least = -np.partition(-score, k - 1, axis=1)[:, k - 1 : k]
                    i, j = np.nonzero(score >= least)
                    held.append((asked[at + i], ids[j], score[i, j]))
                    waiting += len(i)
                if waiting > 1 << 20:
                    held = [_best(*map(np.concatenate, zip(*held, strict=True)), p.top + 1)]
                    waiting = len(held[0][0])
                    if waiting > 1 << 19:  # too many queries to hold
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in held[0]], names=["query", "rep", "score"])
                        held, waiting = [], 0
        if held:
            found = _best(*map(np.concatenate, zip(*held, strict=True)), p.top + 1)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=["query", "rep", "score"])

    both = dealt(posted, 0).unionByName(dealt(asking, 1)).repartition("list", "cell").sortWithinPartitions("list", "cell", "side")
    scored = both.mapInArrow(meet, schema)
    once = scored.groupBy("query", "rep").agg(F.max("score").alias("score"))
    ranked = once.withColumn("nth", F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "rep")))
    return ranked.where(F.col("nth") <= p.top + 1).select("query", "rep", "score")
