"""What the operators of this subpackage share: cutting lineage, words, and batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A-Z to a-z; bytes above 127 stay, so UTF-8 stays valid.
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")

#: Odd multiplier of the polynomial hash over words.
MULTIPLIER = 0x9E3779B97F4A7C15


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which driver and executors share.

    A session that sets none (tests) uses a folder in its warehouse, never a temporary folder of one machine.
    """
    context = spark.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_checkpoints")
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """The rows of df, written to the shared folder.

    Every executor can read them there, so a lost executor costs only its running tasks.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


#: Rows of the input that a task of a small table takes at least, and the tasks that any table may have.
TASK_ROWS, LEAST_TASKS = 4096, 12


def fewer(df: DataFrame, rows: int) -> DataFrame:
    """df in no more partitions than a table of so many rows needs.

    A task leaves files and a place in each log however few rows it has; a chain of many shuffles over a small table
    would leave more of those than of data. Nothing changes once there are rows for all partitions.
    """
    return df.coalesce(max(LEAST_TASKS, -(-rows // TASK_ROWS)))


def join_uneven(left: DataFrame, right: DataFrame, keys: list[str], n: str, total: int, parts: int = 1000, how: str = "inner") -> DataFrame:
    """left joined with right, whose keys are unique and whose column n says how many rows of left have its key.

    Keys with more than a part of all ``total`` rows of left are fewer than ``parts``, so they are broadcast and
    their rows stay where they are; no other key can fill a task of the shuffle. n is dropped.
    """
    hot = F.col(n) * parts > total
    few, rest = F.broadcast(right.where(hot).drop(n)), right.where(~hot).drop(n)
    direct = left.join(few, keys)
    others = left.join(few.select(*keys), keys, "left_anti").join(rest, keys, how)
    return direct.unionByName(others)


def tables(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    return [spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in names]


def as_bytes(column: pa.Array) -> Iterator[bytes | None]:
    """UTF-8 of each string, None for null, without building Python strings."""
    for value in column.cast(pa.binary()):
        yield value.as_py()


def hash_words(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash for each word."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit integers whose output bits depend on all input bits."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def rolling(hashes: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash for each run of ``width`` consecutive words; empty if there are fewer."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total, power = np.zeros(n, np.uint64), 1
    for offset in range(width - 1, -1, -1):
        total += hashes[offset : offset + n] * np.uint64(power)
        power = power * MULTIPLIER % (1 << 64)
    return mix(total)


def groups(batches: Iterator[pa.RecordBatch], keys: list[str], least_rows: int = 0) -> Iterator[pa.Table]:
    """Consecutive rows with equal keys (whole groups, joined until they have least_rows).

    The rows come sorted by the keys; a group may reach over several batches.
    """
    held: list[pa.RecordBatch] = []
    rows, last = 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for values in columns:
            change[1:] |= values[1:] != values[:-1]
        now = tuple(values[0] for values in columns)
        change[0] = last is not None and now != last
        last = tuple(values[-1] for values in columns)
        start = 0
        for at in np.flatnonzero(change):
            if rows + at - start >= max(least_rows, 1):
                held.append(batch.slice(start, at - start))
                yield pa.Table.from_batches(held)
                held, rows, start = [], 0, at
        held.append(batch.slice(start))
        rows += batch.num_rows - start
    if rows:
        yield pa.Table.from_batches(held)
