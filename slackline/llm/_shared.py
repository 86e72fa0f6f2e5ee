"""Shared tables, blocks of large groups, and streams of key runs."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Ids broadcast at most; larger sets are joined by a shuffle.
BROADCAST_IDS = 1_000_000
_OWN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only if none is set, and only on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        if not _OWN:
            _OWN.append("file://" + tempfile.mkdtemp(prefix="slackline-"))
        found = _OWN[0]
    return found.rstrip("/")


def write_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def persisted(df: DataFrame, name: str) -> DataFrame:
    """The rows as a written table in the shared folder: lineage ends there, lost executors cost nothing.

    The schema is given again at reading, so no file is opened for it.
    """
    spark = df.sparkSession
    path = write_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._slackline_path = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete tables of persisted() that no later plan reads."""
    for t in tables:
        path = getattr(t, "_slackline_path", None)
        if path:
            jvm = t.sparkSession._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(t.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


def broadcast_if_small(df: DataFrame, rows: int, limit: int = BROADCAST_IDS) -> DataFrame:
    """A broadcast hint only for a counted and small side; Spark shuffles the rest."""
    return F.broadcast(df) if rows <= limit else df


def hash_sample(df: DataFrame, limit: int, *key: str) -> DataFrame:
    """limit rows (all, if fewer): those with the smallest hashes of the key columns, the same at every partitioning.

    A first count gives a bound on the hash that about one and a half times limit rows pass, so what the tasks
    hand on doesn't grow with their number. Where too few pass, as many rows share a key, the bound is widened.
    """
    n = df.count()
    h = F.xxhash64(*[F.coalesce(F.col(k).cast("string"), F.lit("\0")) for k in key], F.lit("sample"))
    share = (1.5 * limit + 100) / max(n, 1)
    rows = df
    while n > limit and share < 1:
        rows = df.where(h <= F.lit(-(1 << 63) + int(share * (1 << 64))))
        if rows.count() >= limit:
            break
        share, rows = 4 * share, df
    return rows.orderBy(h, *key).limit(limit)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def block_pairs(df: DataFrame, rows_in_group: Column, block_rows: int, member: Column) -> DataFrame:
    """Deal every group into blocks and each row to the tasks of its block pairs.

    Adds blk_i <= blk_j and side (0: the row is of block i, 1: of block j). A group of up to
    block_rows rows is one task; a larger one is spread over the pairs of its blocks, so no task
    ever holds more than about two blocks whatever the size of the group.
    """
    n = F.greatest(F.lit(1), F.ceil(rows_in_group / F.lit(block_rows))).cast("int")
    df = df.withColumn("_nb", n).withColumn("_blk", F.pmod(F.xxhash64(member, F.lit(17)), F.col("_nb").cast("long")).cast("int"))
    df = df.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_nb") - 1)))
    return df.select(
        *[c for c in df.columns if c not in ("_nb", "_blk", "_other")],
        F.least("_blk", "_other").alias("blk_i"),
        F.greatest("_blk", "_other").alias("blk_j"),
        (F.col("_blk") > F.col("_other")).cast("int").alias("side"),
    )


def aligned(batches: Iterable[pa.RecordBatch], keys: list[str], least_rows: int = 16384) -> Iterator[pa.Table]:
    """Tables of whole key runs from batches that are sorted by keys."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        rows += b.num_rows
        if rows < least_rows:
            continue
        t = pa.Table.from_batches(held)
        cut = last_run_start(t, keys)
        if cut:
            yield t.slice(0, cut).combine_chunks()
            rest = t.slice(cut).combine_chunks()
            held, rows = rest.to_batches(), rest.num_rows
    if rows:
        yield pa.Table.from_batches(held).combine_chunks()


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """At most so many rows of an Arrow batch in this session from now on: rows hold whole texts, and a batch is
    held several times over by executor and worker. (A lazy result needs the setting when it runs.)"""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, rows)


def sliced(batches: Iterable[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Batches of few rows, so that what a kernel makes of whole texts stays small beside them."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def last_run_start(t: pa.Table, keys: list[str]) -> int:
    same = np.ones(t.num_rows, bool)
    for k in keys:
        col = numpy_of(t[k])
        same &= col == col[-1]
    differs = np.flatnonzero(~same)
    return int(differs[-1]) + 1 if len(differs) else 0


def numpy_of(col) -> np.ndarray:
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks() if col.num_chunks != 1 else col.chunk(0)
    return col.to_numpy(zero_copy_only=False)


def run_bounds(*cols: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal rows, and the number of rows at the end."""
    n = len(cols[0])
    new = np.zeros(n, bool)
    new[:1] = True
    for c in cols:
        new[1:] |= c[1:] != c[:-1]
    return np.append(np.flatnonzero(new), n)


def binaries(col) -> list[bytes]:
    """Values of a text or binary column as bytes; null as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks() if col.num_chunks != 1 else col.chunk(0)
    return [b or b"" for b in col.cast(pa.large_binary() if pa.types.is_large_string(col.type) else pa.binary()).to_pylist()]
