"""Whole-number ids for keys, handed out once and kept in a stored table.

A feed's keys that are known keep their ids. New ones are sorted into partitions; the numbers of rows in the partitions,
which are all that the driver sees, give each partition its first id, so ids are dense above the greatest one stored.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def stored_ids(spark: SparkSession, folder: str) -> DataFrame | None:
    """(key, id) of all feeds that were stored wholly; None where there is none."""
    pattern = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/*/_SUCCESS")
    done = pattern.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(pattern)
    feeds = [d.getPath().getParent().toString() for d in done or []]
    return spark.read.schema("key string, id long").parquet(*feeds) if feeds else None


def numbered(keys: DataFrame, first: int) -> DataFrame:
    """(key, id): distinct keys with dense ids from first on, in the order of the keys."""
    spread = keys.select("key").repartitionByRange("key").sortWithinPartitions("key").withColumn("_part", F.spark_partition_id()).checkpoint()
    counts = {r["_part"]: r["n"] for r in spread.groupBy("_part").agg(F.count("*").alias("n")).collect()}  # a row a partition
    begins, at = [], first
    for part in sorted(counts):
        begins.append((part, at))
        at += counts[part]
    starts = keys.sparkSession.createDataFrame(begins, "_part int, _first long")
    # Each window is one partition of the range, which a task held already.
    rank = F.row_number().over(Window.partitionBy("_part").orderBy("key"))
    return spread.join(F.broadcast(starts), "_part").select("key", (F.col("_first") + rank - 1).cast("long").alias("id"))


def allocate(feed: DataFrame, folder: str) -> DataFrame:
    """(key, id) of each distinct key of feed(key); new keys get ids, which are stored in the shared folder.

    Null keys have no id. One feed is taken at a time; a feed that is sent again, or that broke off, gives no key a second id,
    as tables of feeds that broke off are not read.
    """
    spark = feed.sparkSession
    keys = feed.select(F.col("key").cast("string").alias("key")).filter("key is not null").distinct()
    known = stored_ids(spark, folder)
    last = known.agg(F.max("id")).first()[0] if known is not None else None
    fresh = keys.join(known, "key", "left_anti") if known is not None else keys
    numbered(fresh, 0 if last is None else last + 1).write.parquet(f"{folder}/feed-{uuid.uuid4().hex}")
    return keys.join(stored_ids(spark, folder), "key")


def collisions(ids: DataFrame) -> DataFrame:
    """(id, paths): ids(id, path) under which there is more than one path, with the least and the greatest of them and their number."""
    found = ids.filter("id is not null and path is not null").groupBy("id").agg(F.min("path").alias("least"), F.max("path").alias("greatest"), F.count_distinct("path").alias("paths"))
    return found.filter("least <> greatest")
