"""URL allow and block lists as sorted arrays of 64-bit digests.

A rule is a host and the beginning of a path (``example.net/en/``). It fits its host and all
subdomains if the path of the url starts with the rule's. Of all rules that fit the longest wins, in
bytes of UTF-8; of equally long ones the one with the longest host, so the one most about the site.

The index is a number of shards. A shard holds the sorted xxhash digests of a range and, in the same
order, the rules' strings. Spark sorts the rules into ranges and its tasks write a shard each to the shared
folder; executors fetch the files once and their workers memory-map them, so a worker's memory
holds only the pages that it touches. A url is probed with every suffix of its host joined with every
prefix of its path that is as long as some rule's path: all candidates of a batch go through one
vectorised binary search in the shards of their ranges, and a hit counts only if the stored string is the candidate itself.
The way is the same for a list of four rules and one of many millions.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import shared_folder

#: Rules of a shard. With strings of 50 bytes a shard has about 60 MB.
SHARD_RULES = 1_000_000

#: Number of rules and bytes of strings.
_HEADER = "<QQ"
_RULES = "host string, path string, verdict string"


@dataclass(frozen=True)
class Rule:
    """host: without port, any case. path: '/' or the beginning of a path. verdict: allow or block."""

    host: str
    path: str
    verdict: str


def digests_of(texts: list[bytes]) -> np.ndarray:
    """The 64-bit xxhash of each text as a signed number: the same as Spark's ``xxhash64``, so its ranges are ranges here."""
    return np.fromiter((xxhash.xxh64_intdigest(t, 42) for t in texts), np.uint64, len(texts)).view(np.int64)


def build(rules: list[tuple[bytes, bool]]) -> bytes:
    """A shard from distinct (string, whether it blocks): header (number of rules, bytes of strings), digests, ends, strings, verdicts."""
    ordered = sorted((d, text, blocks) for d, (text, blocks) in zip(digests_of([t for t, _ in rules]).tolist(), rules, strict=True))
    digests = np.array([d for d, _, _ in ordered], "<i8")
    ends = np.cumsum([0, *(len(t) for _, t, _ in ordered)]).astype("<u8")
    blob = b"".join(t for _, t, _ in ordered)
    blocks = np.array([b for _, _, b in ordered], "u1")
    return struct.pack(_HEADER, len(ordered), len(blob)) + digests.tobytes() + ends.tobytes() + blob + blocks.tobytes()


class Shard:
    """A memory-mapped shard."""

    def __init__(self, path: str):
        self.map = np.memmap(path, np.uint8, "r")
        at = struct.calcsize(_HEADER)
        n, size = struct.unpack(_HEADER, bytes(self.map[:at]))
        self.digests = self.map[at : (at := at + 8 * n)].view("<i8")
        self.ends = self.map[at : (at := at + 8 * (n + 1))].view("<u8")
        self.blob = self.map[at : (at := at + size)]
        self.blocks = self.map[at : at + n]

    def text(self, i: int) -> bytes:
        return bytes(self.blob[int(self.ends[i]) : int(self.ends[i + 1])])

    def find(self, keys: list[bytes], wanted: np.ndarray) -> np.ndarray:
        """The place of each key in the shard, -1 if it isn't there; wanted: their digests."""
        places = np.searchsorted(self.digests, wanted)
        found = np.full(len(keys), -1)
        inside = np.flatnonzero(places < len(self.digests))
        for k in inside[self.digests[places[inside]] == wanted[inside]]:
            at = int(places[k])
            while at < len(self.digests) and self.digests[at] == wanted[k]:  # other strings may share the digest
                if self.text(at) == keys[k]:
                    found[k] = at
                    break
                at += 1
        return found


def url_parts(url: F.Column) -> tuple[F.Column, F.Column]:
    """Host (after the first ``://`` up to /, ?, # or end, A-Z in lower case) and path (then up to ?, # or end).

    Both are empty for a null url or one without ``://``.
    """
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.coalesce(_lower(host), F.lit("")), F.coalesce(path, F.lit(""))


def _lower(host: F.Column) -> F.Column:
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _candidates(host: bytes, path: bytes, lengths: list[int]) -> list[bytes]:
    """Keys of all rules that could fit, the one that would win first."""
    if not host:
        return []
    labels = host.split(b".")
    suffixes = [b".".join(labels[k:]) for k in range(len(labels))]
    prefixes = [path[:n] for n in lengths if n <= len(path)]
    found = sorted(((len(s) + len(p), len(s), s + p) for s in suffixes for p in prefixes), reverse=True)
    return [key for _, _, key in found]


def write_shards(rules: DataFrame, folder: str, shard_rules: int) -> list[int]:
    """Writes the shards of rules (text, blocks) to the folder; the path lengths that occur, in bytes."""

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(t.encode(), b) for batch in batches for t, b in zip(batch.column("text").to_pylist(), batch.column("blocks").to_pylist(), strict=True)]
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([build(held)], pa.binary())], names=["shard"])

    n = max(1, -(-rules.count() // shard_rules))
    ranged = rules.repartitionByRange(n, "digest") if n > 1 else rules.coalesce(1)
    ranged.select("text", "blocks").mapInArrow(shard, "shard binary").select(F.col("shard").cast("string")).write.text(folder)  # raw bytes and a line end
    return sorted(r["n"] for r in rules.select("n").distinct().collect())  # at most as many as a path has bytes


def judge(pages: DataFrame, rules: DataFrame | list[Rule], default: str = "allow", shard_rules: int = SHARD_RULES) -> DataFrame:
    """One row per row of pages (page_id, url): page_id, host, path, rule, verdict.

    rules: a table (host, path, verdict), or a short list. Rules with a null are left out; hosts are compared with
    A-Z in lower case; of several rules for one host and path that with the smallest verdict counts (allow before
    block). rule is null where no rule fits; the verdict is then ``default``. A null or odd url has an
    empty host and fits no rule. No rules: every verdict is the default. Urls of any length are judged
    whole. Repeated rows give repeated results; other columns are not read.
    """
    spark = pages.sparkSession
    listed = rules if isinstance(rules, DataFrame) else spark.createDataFrame([(r.host, r.path, r.verdict) for r in rules], _RULES)
    listed = listed.where("host is not null and path is not null and verdict is not null")
    listed = listed.select(F.concat(_lower(F.col("host")), F.col("path")).alias("text"), F.octet_length("path").alias("n"), F.col("verdict"))
    listed = listed.groupBy("text").agg(F.min("verdict").alias("verdict"), F.min("n").alias("n"))
    listed = listed.select("text", "n", (F.col("verdict") == "block").alias("blocks"), F.xxhash64("text").alias("digest"))
    folder = f"{shared_folder(spark)}/url-index-{uuid.uuid4().hex}"
    lengths = write_shards(listed, folder, shard_rules)
    names = _share(spark, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards = [Shard(SparkFiles.get(name)) for name in names]
        firsts = np.array([shard.digests[0] for shard in shards], np.int64)
        for batch in batches:
            rule: list[str | None] = [None] * batch.num_rows
            verdict = [default] * batch.num_rows
            keys, rows = [], []
            for row, (h, t) in enumerate(zip(batch.column("host").to_pylist(), batch.column("path").to_pylist(), strict=True)):
                found = _candidates(h.encode(), t.encode(), lengths)
                keys += found
                rows += [row] * len(found)
            wanted = digests_of(keys)
            owner = np.searchsorted(firsts, wanted, "right") - 1  # the only shard that can hold the key
            blocks = np.full(len(keys), -1)
            for k in np.unique(owner[owner >= 0]):
                own = np.flatnonzero(owner == k)
                places = shards[k].find([keys[i] for i in own], wanted[own])
                hit = places >= 0
                blocks[own[hit]] = shards[k].blocks[places[hit]]
            for k in np.flatnonzero(blocks >= 0)[::-1]:  # the first of a row comes last and stays
                rule[rows[k]] = keys[k].decode()
                verdict[rows[k]] = "block" if blocks[k] else "allow"
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("page_id", "host", "path")), pa.array(rule, pa.string()), pa.array(verdict, pa.string())],
                names=["page_id", "host", "path", "rule", "verdict"],
            )

    host, path = url_parts(F.col("url"))
    parsed = pages.select("page_id", host.alias("host"), path.alias("path"))
    return parsed.mapInArrow(run, "page_id long, host string, path string, rule string, verdict string")


def _share(spark: SparkSession, folder: str) -> list[str]:
    """Has the executors fetch the shards of the folder; their file names. Only names come to the driver."""
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(folder)
    found = path.getFileSystem(context._jsc.hadoopConfiguration()).listStatus(path)
    files = sorted(str(f.getPath().toString()) for f in found if f.getPath().getName().startswith("part-") and f.getLen() > 0)
    for file in files:
        context.addFile(file)
    return [file.rsplit("/", 1)[1] for file in files]
