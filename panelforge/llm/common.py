"""Shared pieces of the corpus operators: tables, shared storage, Arrow batches and word hashes."""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHINGLE = 5
SIMILARITY = 0.8


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def small_batches(spark: SparkSession, rows: int = 500, size: int = 32 << 20) -> None:
    """Bound the rows and the bytes of an Arrow batch of the session, so that a batch of long texts stays small in a
    Python worker; smaller bounds that are set stay."""
    for key, most in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", size)):
        key = f"spark.sql.execution.arrow.{key}"
        held = spark.conf.get(key).rstrip("bB")  # plain bytes; a value in larger units is replaced
        if not held.isdigit() or not 0 < int(held) <= most:
            spark.conf.set(key, most)


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder. Where none is set, a folder of this machine for a session that has no
    other machine (tests); on a cluster that is an error, as executors would not see each other's files."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return spark.sparkContext.getCheckpointDir()


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, scratch: list[str] | None = None) -> DataFrame:
    """Cut the lineage by a table in the shared folder: survives the loss of executors, computed once. Its path is
    added to scratch, for a table that is only needed until a later one is written."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    if scratch is not None:
        scratch.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    at, fs = _file_system(spark, path)
    return fs.exists(at)


def drop(spark: SparkSession, scratch: list[str]) -> None:
    """Delete tables that written() made and nothing reads any more."""
    while scratch:
        at, fs = _file_system(spark, scratch.pop())
        fs.delete(at, True)


def text_of(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def let(value: Column, body) -> Column:
    """body(value) with the value computed once a row, even where body uses it inside a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def text_key(col: str = "text") -> Column:
    """64-bit key of a whole text: equal texts share it (two different ones do with odds of n*n/2**65)."""
    return F.xxhash64(text_of(col))


_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_S30, _S27, _S31 = np.uint64(30), np.uint64(27), np.uint64(31)


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values (the finaliser of splitmix64)."""
    x = (x ^ (x >> _S30)) * _MIX[0]
    x = (x ^ (x >> _S27)) * _MIX[1]
    return x ^ (x >> _S31)


_BASE = np.uint64(0x9E3779B97F4A7C15)
_powers = np.ones(1, dtype=np.uint64)


def powers(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        x = np.full(max(n, 2 * len(_powers)), _BASE, dtype=np.uint64)
        x[0] = 1
        _powers = np.multiply.accumulate(x)
    return _powers


def word_hashes(text: str | None) -> np.ndarray:
    """A 64-bit hash of each lower-case word of the whole text; words are cut at bytes up to 0x20."""
    b = np.frombuffer((text or "").lower().encode("utf-8", "surrogatepass"), dtype=np.uint8)
    space = b <= 32
    word = ~space
    before = np.empty_like(space)
    before[:1], before[1:] = True, space[:-1]
    start = np.flatnonzero(word & before)
    if not len(start):
        return np.empty(0, dtype=np.uint64)
    b, space, start = b[start[0] :], space[start[0] :], start - start[0]
    length = np.diff(start, append=len(b))
    at = np.arange(len(b)) - np.repeat(start, length)
    value = (b.astype(np.uint64) + np.uint64(1)) * powers(int(length.max()) + 1)[at]
    value[space] = 0
    return mix(np.add.reduceat(value, start))


def shingle_hashes(words: np.ndarray, k: int = SHINGLE) -> np.ndarray:
    """Hashes of all runs of k words; a text of fewer words is one run, no words give none."""
    if not len(words):
        return words
    k = min(k, len(words))
    out = np.zeros(len(words) - k + 1, dtype=np.uint64)
    for i in range(k):
        out = out * _BASE + words[i : len(words) - k + 1 + i]
    return mix(out + np.uint64(k))


def ranked(df: DataFrame, *order: Column, name: str, rank: str, scratch: list[str]) -> DataFrame:
    """df with the place of each row (from 0) in an order of all rows, from a table in the shared folder: sorted by
    ranges, and counted on from one range to the next; the driver sees one number a range. Ties take any order."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id())
    # the id has the partition in its high bits and the place within in the low 33
    rows = rows.withColumns({"__part": F.shiftright("__id", 33), "__at": F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))}).drop("__id")
    rows, base, seen = written(rows, name, scratch), [], 0
    for part, n in sorted(map(tuple, rows.groupBy("__part").count().collect())):
        base.append((part, seen))
        seen += n
    base = df.sparkSession.createDataFrame(base, "__part long, __base long")
    return rows.join(F.broadcast(base), "__part").withColumn(rank, F.col("__base") + F.col("__at")).drop("__part", "__at", "__base")
