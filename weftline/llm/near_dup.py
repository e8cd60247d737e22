"""Near-duplicate documents: MinHash bands propose, sequential Bayesian tests prune, full sets decide.

A document is the set of its distinct word shingles. Two documents are linked if the Jaccard
similarity of their sets is at least a threshold; a component is a set of documents that links
connect. The work runs in rounds, so that large groups never cost all their pairs:

1. Documents with equal sets form one class, which its smallest id represents from here on.
2. Each representative falls into one bucket per band of its signature. Each bucket proposes the
   pairs of its smallest id with the others (a star), of which each document tests first the one
   that most buckets propose, and later those that still join two components.
3. Buckets whose members are in several components still compare all pairs across components,
   block by block inside tasks, which return only links that join components. A pair is compared in
   the first band whose bucket it shares.

Every proposed pair has to pass the Bayesian test on signatures (BayesLSH-Lite) and is then decided on
its full sets, so no link is wrong; a link at the threshold is missed with about the probability
that no band proposes it, (1 - 0.8^5)^32 = 3e-6, plus ``miss``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import LOWER, as_bytes, cut, fewer, groups, hash_words, join_uneven, mix, rolling


@dataclass(frozen=True)
class NearDupParams:
    """shingle: words in a shingle. percent: least similarity, in hundredths. bands x rows: hashes
    of a signature. batch: hashes compared before each test. miss: the largest posterior
    probability of a link that a test may throw away. stars: star rounds before the last one."""

    shingle: int = 5
    percent: int = 80
    bands: int = 32
    rows: int = 5
    batch: int = 32
    miss: float = 1e-6
    seed: int = 7


def shingle_set(text: bytes | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles; all words as one if there are fewer than width."""
    words = (text or b"").translate(LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    return np.unique(rolling(hash_words(words), min(width, len(words))))


def signature(shingles: np.ndarray, xor: np.ndarray, factor: np.ndarray) -> np.ndarray:
    """The least value of each hash function over the set, 32 bits each."""
    low = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.full(len(xor), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), 512):
        part = np.bitwise_xor(xor[:, None], low[None, at : at + 512])
        part *= factor[:, None]
        np.minimum(out, part.min(axis=1), out=out)
    return out


def _functions(p: NearDupParams) -> tuple[np.ndarray, np.ndarray]:
    random = np.random.default_rng(p.seed)
    k = p.bands * p.rows
    return random.integers(0, 1 << 32, k, np.uint32), random.integers(0, 1 << 32, k, np.uint32) | np.uint32(1)


#: Ids up to this number (16 bytes each) are broadcast to find their texts; more are joined by a shuffle.
BROADCAST_IDS = 200_000

#: Rows of a block of a bucket.
BLOCK = 4096

SKETCH = "doc_id long, n_shingles long, set_a long, set_b long, sig binary, keys array<long>"


def sketch(docs: DataFrame, p: NearDupParams) -> DataFrame:
    """One row per document: set size, 128-bit digest of the set, signature (16 bits a hash), band keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        xor, factor = _functions(p)
        powers = mix(np.arange(1, p.rows + 1, dtype=np.uint64)) | np.uint64(1)
        salt = mix(np.arange(100, 100 + p.bands, dtype=np.uint64))
        for batch in batches:
            sizes, digests, sigs, keys = [], [], [], []
            for text in as_bytes(batch.column("text")):
                found = shingle_set(text, p.shingle)
                sig = signature(found, xor, factor)
                key = mix((sig.astype(np.uint64).reshape(p.bands, p.rows) * powers).sum(axis=1, dtype=np.uint64) + salt)
                sizes.append(len(found))
                digests.append(xxhash.xxh3_128_digest(found.tobytes()))
                sigs.append(sig.astype(np.uint16).tobytes())
                keys.append(key.view(np.int64))
            halves = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            flat = np.concatenate(keys) if keys else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").cast(pa.int64()),
                    pa.array(sizes, pa.int64()),
                    pa.array(halves[:, 0]),
                    pa.array(halves[:, 1]),
                    pa.array(sigs, pa.binary()),
                    pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1, dtype=np.int32) * p.bands), pa.array(flat)),
                ],
                names=["doc_id", "n_shingles", "set_a", "set_b", "sig", "keys"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, SKETCH)


def least_matches(total: int, p: NearDupParams) -> int:
    """The fewest agreeing hashes of ``total`` with which a link is still likelier than ``miss``.

    With a uniform prior the similarity has the posterior Beta(m + 1, total - m + 1); it reaches t
    with the probability that a binomial of total + 1 trials with chance t has at most m successes.
    """
    t, below = p.percent / 100, 0.0
    for m in range(total + 1):
        below += comb(total + 1, m) * t**m * (1 - t) ** (total + 1 - m)
        if below >= p.miss:
            return m
    return total


def _tests(p: NearDupParams) -> list[tuple[int, int]]:
    k = p.bands * p.rows
    return [(n, least_matches(n, p)) for n in range(p.batch, k + 1, p.batch)]


def _alive(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray, tests: list[tuple[int, int]]) -> np.ndarray:
    """Places in i and j where the signatures x[i] and y[j] pass all tests, batch after batch."""
    alive, matches, start = np.arange(len(i)), np.zeros(len(i), np.int64), 0
    for n, least in tests:
        matches = matches + (x[i[alive], start:n] == y[j[alive], start:n]).sum(axis=1)
        going = matches >= least
        alive, matches, start = alive[going], matches[going], n
    return alive


def likely(pairs: DataFrame, sigs: DataFrame, total: int, p: NearDupParams) -> DataFrame:
    """Pairs (a, b) that no batch of hashes makes unlikely enough to throw away."""
    sides = fewer(pairs.join(sigs.select(F.col("doc_id").alias("a"), F.col("sig").alias("sig_a")), "a"), total)
    sides = sides.join(sigs.select(F.col("doc_id").alias("b"), F.col("sig").alias("sig_b")), "b")
    k, tests = p.bands * p.rows, _tests(p)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, k) for c in ("sig_a", "sig_b"))
            alive = _alive(x, y, np.arange(len(x)), np.arange(len(x)), tests)
            yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(alive)) for c in "ab"], names=["a", "b"])

    return sides.select("a", "b", "sig_a", "sig_b").mapInArrow(run, "a long, b long")


def left_over(buckets: DataFrame, labels: DataFrame, docs: DataFrame, reps: DataFrame, total: int, p: NearDupParams) -> DataFrame:
    """Links (a, b) between documents of one bucket and different components, enough to join them.

    In a bucket one component has most rows, the big one. Its rows are dealt out to blocks of about BLOCK rows
    and move once for each block of the others; the others are compared with it and with each
    other, block by block. A bucket with a few strays so moves few rows more than it has, and no task's
    memory grows with a bucket. A first pass over signatures finds the documents in any likely pair, a
    second one compares their sets. Documents that are close to one another share many buckets: a pair counts
    in that of its first band only (31 bits of its keys tell), so few sets move to several buckets.
    """
    placed = buckets.join(labels, buckets.doc_id == labels.id, "left").select("key", "band", "doc_id", F.coalesce("component", "doc_id").alias("component"))
    counts = fewer(placed, total).groupBy("key", "component").agg(F.count("*").alias("n"))
    mixed = counts.groupBy("key").agg(F.max(F.struct("n", "component")).alias("top"), F.sum("n").alias("n"), F.count("*").alias("kinds")).where("kinds > 1")
    mixed = cut(fewer(mixed.selectExpr("key", "top.component as big", f"cast(ceil(top.n / {BLOCK}) as int) as bigs", f"cast(ceil((n - top.n) / {BLOCK}) as int) as others", "n"), total))
    dealt = join_uneven(placed, mixed, ["key"], "n", total * p.bands, 1000 * p.bands)
    part = lambda blocks: F.expr(f"cast(pmod(xxhash64(doc_id), {blocks}) as int)")
    cell = "struct(cast({0} as int) as kind, cast({1} as int) as i, cast({2} as int) as j, cast({3} as int) as own)"
    with_all = "transform(sequence(0, others - 1), x -> {})".format(cell.format(0, "x", "block", 1))
    with_big = "transform(sequence(0, bigs - 1), x -> {})".format(cell.format(0, "block", "x", 0))
    with_each = "transform(sequence(0, others - 1), x -> {})".format(cell.format(1, "least(x, block)", "greatest(x, block)", "block"))
    dealt = dealt.withColumn("is_big", F.col("component") == F.col("big")).withColumn("block", F.when(F.col("is_big"), part("bigs")).otherwise(part("others")))
    dealt = dealt.select("key", "band", "doc_id", "component", F.explode(F.expr(f"if(is_big, {with_all}, concat({with_big}, {with_each}))")).alias("_cell"))
    dealt = cut(fewer(dealt.select("key", "band", "_cell.kind", "_cell.i", "_cell.j", "_cell.own", "doc_id", "component"), total))
    place = ["key", "kind", "i", "j"]
    order = [*place, "own"]
    k, tests = p.bands * p.rows, _tests(p)

    def likely_pairs(part: pa.Table) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """A row, the rows after it that may link with it, and the present group of each row."""
        group, own = (part.column(c).to_numpy() for c in ("component", "own"))
        group = group.copy()
        sig = np.frombuffer(b"".join(part.column("sig").to_pylist()), np.uint16).reshape(-1, k)
        bits = part.column("bits").combine_chunks().flatten().to_numpy().reshape(-1, p.bands)[:, : part.column("band")[0].as_py()]
        two_blocks = part.column("kind")[0].as_py() == 0 or part.column("i")[0].as_py() != part.column("j")[0].as_py()
        for r in range(int((own == own[0]).sum()) if two_blocks else len(group)):  # the first block comes first
            others = np.flatnonzero(group[r + 1 :] != group[r]) + r + 1
            if two_blocks:
                others = others[own[others] != own[r]]
            others = others[~(bits[others] == bits[r]).any(axis=1)]
            if len(others):
                yield r, others[_alive(sig, sig, np.full(len(others), r), others, tests)], group

    def in_any(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in groups(batches, place):
            hit = np.zeros(part.num_rows, bool)
            for r, others, _ in likely_pairs(part):
                hit[others] = True
                hit[r] |= bool(len(others))
            yield from part.drop_columns(["sig", "bits"]).filter(pa.array(hit)).to_batches()

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in groups(batches, place):
            ids = part.column("doc_id").to_numpy()
            sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in part.column("shingles")]
            sizes = np.array([len(x) for x in sets])
            a, b = [], []
            for r, others, group in likely_pairs(part):
                for at in range(0, len(others), 512):
                    some = others[at : at + 512]
                    some = some[group[some] != group[r]]
                    if not len(some):
                        continue
                    place_in = np.minimum(np.searchsorted(sets[r], flat := np.concatenate([sets[x] for x in some])), sizes[r] - 1)
                    ends = np.cumsum(sizes[some])
                    shared = np.diff(np.concatenate([[0], np.cumsum(sets[r][place_in] == flat)[ends - 1]]))
                    for other in some[100 * shared >= p.percent * (sizes[r] + sizes[some] - shared)]:
                        if group[other] != group[r]:
                            a.append(min(ids[r], ids[other]))
                            b.append(max(ids[r], ids[other]))
                            group[group == group[other]] = group[r]
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    sigs = reps.select("doc_id", "sig", F.expr("transform(keys, x -> cast(x & 2147483647 as int))").alias("bits"))
    sigs = cut(fewer(sigs.join(_few(dealt.select("doc_id").distinct(), total), "doc_id", "left_semi"), total))
    schema = "key long, band int, kind int, i int, j int, own int, doc_id long, component long"
    rows = ["key", "band", "kind", "i", "j", "own", "doc_id", "component", "sig", "bits"]
    near = cut(fewer(dealt.join(sigs, "doc_id"), total).select(*rows).repartition(*place).sortWithinPartitions(*order).mapInArrow(in_any, schema))
    near = fewer(near, total)
    sets = sets_of(docs, _few(near.select("doc_id").distinct(), total), p)
    both = fewer(near.join(sigs, "doc_id").join(sets, "doc_id"), total).repartition(*place).sortWithinPartitions(*order)
    return both.mapInArrow(linked, "a long, b long")


def sets_of(docs: DataFrame, ids: DataFrame, p: NearDupParams) -> DataFrame:
    """Full shingle sets (sorted 64-bit hashes) of the documents with these ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingle_set(text, p.shingle).tobytes() for text in as_bytes(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(found, pa.binary())], names=["doc_id", "shingles"])

    return docs.select("doc_id", "text").join(ids, "doc_id", "left_semi").mapInArrow(run, "doc_id long, shingles binary")


def confirmed(pairs: DataFrame, sets: DataFrame, total: int, p: NearDupParams) -> DataFrame:
    """Pairs whose full sets have at least the similarity asked for."""
    small = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("set_b"))
    large = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("set_a"))
    sides = fewer(pairs.join(small, "b"), total).join(large, "a").select("a", "b", "set_a", "set_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("set_a"), batch.column("set_b"), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = np.concatenate([x, y])
                both.sort()
                shared = int((both[1:] == both[:-1]).sum())
                keep.append(100 * shared >= p.percent * (len(both) - shared))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(mask) for c in "ab"], names=["a", "b"])

    return fewer(sides, total).mapInArrow(run, "a long, b long")


def components(links: DataFrame, total: int) -> DataFrame:
    """(id, component): the smallest id that links reach, for every id in a link.

    Labels move along links and then jump to the label of their label, so long chains take a
    logarithmic number of rounds; each round is written to the shared folder.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = cut(fewer(fewer(both, total).distinct(), total))
    labels = _few(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("component")), total)
    while True:
        near = both.join(labels, both.b == labels.id).groupBy("a").agg(F.min("component").alias("least"))
        moved = fewer(near, total).join(labels, F.col("a") == labels.id).select("id", F.col("component").alias("was"), F.least("component", "least").alias("now"))
        jump = labels.select(F.col("id").alias("now"), F.col("component").alias("next"))
        labels = _few(moved.join(jump, "now").select("id", "was", F.col("next").alias("component")), total)
        if labels.where("was <> component").isEmpty():
            return labels.select("id", "component")
        labels = labels.select("id", "component")


def joined(labels: DataFrame, links: DataFrame, total: int) -> DataFrame:
    """The labels after further links: these join whole components, so only those are labelled anew."""
    ends = _few(components(_across(links, labels).selectExpr("ca as a", "cb as b"), total).select(F.col("id").alias("end"), F.col("component").alias("now")), total)
    moved = labels.join(ends, labels.component == ends.end, "left").select("id", F.coalesce("now", "component").alias("component"))
    single = ends.join(labels, ends.end == labels.id, "left_anti").select(F.col("end").alias("id"), F.col("now").alias("component"))
    return _few(moved.unionByName(single), total)


def near_duplicates(docs: DataFrame, p: NearDupParams = NearDupParams()) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_shingles, component_id, kept.

    Words are runs of characters other than space and U+0009 to U+000D, with A-Z in lower case.
    Texts of any length are taken whole. Null or empty texts have no shingles and link with nothing. A row whose doc_id is null links
    with nothing either: its component_id is null and kept is true. Repeated rows of one doc_id
    give as many result rows, all in one component if their texts are alike. Other columns are
    not read. An empty table gives an empty result.
    """
    base = cut(sketch(docs, p))
    slim = cut(base.select("doc_id", "n_shingles", "set_a", "set_b"))
    total = slim.count()
    some = slim.where("n_shingles > 0 and doc_id is not null")
    digest = ["set_a", "set_b"]
    shared = cut(fewer(some.groupBy(*digest).agg(F.min("doc_id").alias("class_id"), F.count("*").alias("n")).where("n > 1"), total))
    member = join_uneven(some.select("doc_id", *digest), shared, digest, "n", total, how="left").withColumn("class_id", F.coalesce("class_id", "doc_id"))
    member = cut(fewer(member, total))
    first = _few(member.where("doc_id = class_id").select("doc_id").distinct(), total)
    reps = cut(fewer(base.where("n_shingles > 0").join(first, "doc_id", "left_semi").select("doc_id", "sig", "keys"), total))

    # The buckets with at least two representatives, a row for each member.
    flat = reps.select("doc_id", F.posexplode("keys").alias("band", "key"))
    centers = flat.groupBy("key").agg(F.min("doc_id").alias("center"), F.max("doc_id").alias("last"), F.count("*").alias("n")).where("center < last").select("key", "center", "n")
    buckets = cut(fewer(join_uneven(flat, cut(fewer(centers, total)), ["key"], "n", total * p.bands, 1000 * p.bands), total))
    stars = buckets.where("doc_id <> center").groupBy(F.col("center").alias("a"), F.col("doc_id").alias("b")).agg(F.count("*").alias("shared"))
    stars = cut(fewer(stars, total))

    alive = fewer(likely(stars, reps, total, p), total)
    stars = cut(fewer(alive.join(stars, ["a", "b"]), total))
    ends = stars.select(F.col("a").alias("doc_id")).unionByName(stars.select(F.col("b").alias("doc_id")))
    sets = cut(fewer(sets_of(docs, _few(fewer(ends, total).distinct(), total), p), total))

    best = stars.groupBy("b").agg(F.max(F.struct("shared", -F.col("a"))).alias("best")).select((-F.col("best.col2")).alias("a"), "b")
    best = cut(fewer(best, total))
    labels = components(cut(confirmed(best, sets, total, p)), total)
    rest = fewer(_across(stars.join(best, ["a", "b"], "left_anti").select("a", "b"), labels).select("a", "b"), total)
    labels = joined(labels, cut(confirmed(rest, sets, total, p)), total)
    labels = joined(labels, fewer(cut(left_over(buckets, labels, docs, reps, total, p)), total), total)

    sizes = member.groupBy("class_id").agg(F.count("*").alias("n")).join(labels, F.col("class_id") == labels.id).select("class_id", "component", "n")
    done = join_uneven(member, cut(fewer(sizes, total)), ["class_id"], "n", total, how="left")
    done = fewer(done, total).select("doc_id", *digest, F.coalesce("component", "class_id").alias("component_id")).distinct()
    rows = fewer(slim.join(done, ["doc_id", *digest], "left"), total)
    component = F.coalesce("component_id", "doc_id")
    return rows.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def _few(ids: DataFrame, total: int) -> DataFrame:
    """The ids, written down, and marked for broadcast if they are few."""
    ids = cut(fewer(ids, total))
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def _across(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs of documents that aren't in one component, and the components (ca, cb)."""
    a = labels.select(F.col("id").alias("a"), F.col("component").alias("ca"))
    b = labels.select(F.col("id").alias("b"), F.col("component").alias("cb"))
    tagged = pairs.join(a, "a", "left").join(b, "b", "left")
    return tagged.select("a", "b", F.coalesce("ca", "a").alias("ca"), F.coalesce("cb", "b").alias("cb")).where("ca <> cb")
