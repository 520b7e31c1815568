"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of whole texts that a function is given at a time; Spark bounds the bytes of a batch (spark.sql.execution.arrow.maxBytesPerBatch).
BATCH_ROWS = 1000
#: Bytes of the Arrow batches of whole texts: Spark's default of 64 MB is as much again in Python, and more in the JVM's buffers.
BATCH_BYTES, BATCH_CONF = 4_000_000, "spark.sql.execution.arrow.maxBytesPerBatch"
#: Removes the shuffle files of a query when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def crc_mod(key: Column, n: int) -> Column:
    """crc32 of the key as text, modulo n; a null key counts as the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % F.lit(n)


def shared_dir(spark: SparkSession) -> str:
    """A new folder under the cluster's shared spark.checkpoint.dir, which must be set."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"{base.rstrip('/')}/tidewell-{uuid.uuid4().hex}"


def written(df: DataFrame, *, texts: bool = False) -> DataFrame:
    """The rows as a Parquet table in the shared folder: cuts the lineage and is read as often as needed.

    The files of its shuffles go when it is written. texts: Python functions in it are given whole texts, in batches of BATCH_BYTES.
    """
    spark, path = df.sparkSession, shared_dir(df.sparkSession)
    own = {CLEANUP: "true"} | ({BATCH_CONF: str(BATCH_BYTES)} if texts else {})
    before = {k: spark.conf.get(k) for k in own}
    try:
        for k, v in own.items():
            spark.conf.set(k, v)
        df.write.option("compression", "zstd").parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    out = spark.read.schema(df.schema).parquet(path)
    out.folder = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Deletes tables of written() that nothing reads any more."""
    for df in tables:
        context = df.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(df.folder)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def text_batches(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """mapInArrow with batches small enough for whole texts."""
    rows = BATCH_ROWS

    def run(batches):
        # Copies, not slices: Arrow's casts read a slice of texts from the wrong place.
        return function(b.take(pa.array(range(at, min(at + rows, b.num_rows)))) for b in batches for at in range(0, b.num_rows, rows))

    return df.mapInArrow(run, schema)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small(df: DataFrame, max_rows: int) -> DataFrame:
    """Marks a written table for broadcast if it has at most max_rows rows; otherwise Spark shuffles it."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def prefix(df: DataFrame) -> str:
    """The start of names that no column of df has."""
    p = "_tw_"
    while any(c.lower().startswith(p) for c in df.columns):
        p += "_"
    return p
