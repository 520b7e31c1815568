"""Exact dedup: a streaming aggregation whose state, kept on disk without expiry, is the index of digests.

Each feed row is (id, row, digest, locator). The state of a digest is its stable identifier (the largest id
so far), the locator of that content and the number of copies. Hits, digests with more than one copy, are then
checked on their full bytes; different texts under one digest are told apart.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.common import ascii_lower, prefix, same, shared_dir, small, table, written

#: State on disk, uploaded as a log of changes; without preallocated files, as each of many partitions has a store.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}
#: Rows up to which a list of ids may be broadcast (about 32 MB); beyond it, Spark shuffles both sides.
BROADCAST_ROWS = 1_000_000


def located(docs: DataFrame) -> DataFrame:
    """docs with locator: file and number of the row in it; null where docs isn't read from Parquet files as it is."""
    try:
        return docs.select("*", F.concat_ws("#", "_metadata.file_path", "_metadata.row_index").alias("locator"))
    except AnalysisException:
        return docs.withColumn("locator", F.lit(None).cast("string"))


def content_at(docs: DataFrame, locators: DataFrame) -> DataFrame:
    """The rows of the table docs at locators(locator), with their locator."""
    return located(docs).join(locators.select("locator").distinct(), "locator", "left_semi")


def _feed(docs: DataFrame, id_col: str, text_col: str, digest_hex: int, tag: str) -> DataFrame:
    """(id, row, text_sha256, digest, locator); a row's name begins with the tag of its feed."""
    rows = located(docs.select(id_col, text_col) if "locator" in docs.columns else docs)
    row = F.concat(F.lit(tag), F.lpad(F.hex(F.monotonically_increasing_id()), 16, "0"))
    rows = rows.select(F.col(id_col).alias("id"), row.alias("row"), F.sha2(ascii_lower(F.col(text_col).cast("string")), 256).alias("text_sha256"), "locator")
    return rows.select("id", "row", "text_sha256", F.unhex(F.substring("text_sha256", 1, digest_hex)).alias("digest"), "locator")


def dedup_index(feed: DataFrame, state: str, files_per_trigger: int | None = None) -> DataFrame:
    """Runs the stream over the feed table in state, on what it holds from former feeds; returns (digest, copies, keeper struct<id, row, locator>)."""
    spark, states = feed.sparkSession, state
    reader = spark.readStream.schema(feed.schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    state = reader.parquet(f"{states}/feed").groupBy("digest").agg(F.count("*").alias("copies"), F.max(F.struct("id", "row", "locator")).alias("keeper"))

    def emit(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{states}/changed/batch={batch}")  # a replayed batch writes the same again

    before = {k: spark.conf.get(k, None) for k in STATE}
    for k, v in STATE.items():
        spark.conf.set(k, v)
    try:
        query = state.writeStream.outputMode("update").foreachBatch(emit).option("checkpointLocation", f"{states}/stream").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    shape = state.schema
    if not spark._jvm.org.apache.hadoop.fs.Path(f"{states}/changed").getFileSystem(spark._jsc.hadoopConfiguration()).exists(spark._jvm.org.apache.hadoop.fs.Path(f"{states}/changed")):
        return spark.createDataFrame([], shape)
    # Copies of a digest only grow, so its last state is the one with most copies.
    last = spark.read.schema(shape).parquet(f"{states}/changed").groupBy("digest").agg(F.max(F.struct("copies", "keeper")).alias("s"))
    return last.select("digest", "s.copies", "s.keeper")


def exact_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, digest_hex: int = 64, files_per_trigger: int | None = None, state: str | None = None, earlier: DataFrame | None = None
) -> DataFrame:
    """One row per row of docs: id, keep_id, group_size, kept, text_sha256, locator (of the kept content).

    Texts are equal when identical after lower-casing A-Z; null counts as empty. Of equal texts the row with the
    largest id stays; a null id is smaller than any. Of repeated rows with one id exactly one stays. An empty table
    gives no rows. Extra columns of docs are ignored. digest_hex shortens the digest, for tests of the byte check.

    state is a shared folder that keeps the index: a later call with it goes on from there, and its rows are compared
    with all that were fed before, whose ids the rows that stay may have. earlier has those rows for the check of bytes.
    """
    spark = docs.sparkSession
    folder, tag = state or shared_dir(spark), uuid.uuid4().hex
    _feed(docs, id_col, text_col, digest_hex, tag).write.mode("append").parquet(f"{folder}/feed")
    feed = spark.read.parquet(f"{folder}/feed")
    index = written(dedup_index(feed, folder, files_per_trigger))
    feed = feed.filter(F.startswith("row", F.lit(tag)))
    hits = index.filter("copies > 1").withColumnRenamed("digest", "hit")
    groups = feed.join(hits, feed.digest == hits.hit, "left")
    verdict = groups.select(
        F.col("id").alias("doc_id"),
        F.when(F.col("hit").isNull(), F.col("id")).otherwise(F.col("keeper.id")).alias("keep_id"),
        F.coalesce("copies", F.lit(1)).cast("long").alias("group_size"),
        (F.col("hit").isNull() | (F.col("row") == F.col("keeper.row"))).alias("kept"),
        "text_sha256",
        F.coalesce("keeper.locator", "locator").alias("locator"),
        "digest", "hit", "row",
    )
    verdict = written(verdict)
    plain = ["doc_id", "keep_id", "group_size", "kept", "text_sha256", "locator"]
    bodies = docs.select(F.col(id_col).alias("doc_id"), ascii_lower(F.col(text_col)).alias("norm"), F.lit(True).alias("own"))
    if earlier is not None:
        bodies = bodies.unionByName(earlier.select(F.col(id_col).alias("doc_id"), ascii_lower(F.col(text_col)).alias("norm"), F.lit(False).alias("own")))
    clashes = written(_clashes(bodies, verdict, digest_hex))
    if clashes.isEmpty():
        return verdict.select(*plain)
    # Different texts share a digest: their rows are grouped by the bytes themselves.
    apart = verdict.join(clashes, "digest", "left_anti").select(*plain)
    again = bodies.withColumn("text_sha256", F.sha2("norm", 256)).withColumn("digest", F.unhex(F.substring("text_sha256", 1, digest_hex)))
    again = written(again.join(clashes, "digest", "left_semi").withColumn("row", F.monotonically_increasing_id()))
    groups = again.groupBy("digest", "norm").agg(F.count("*").alias("group_size"), F.max(F.struct("doc_id", "row")).alias("keeper"))
    told = again.filter("own").join(groups, ["digest", "norm"]).select(
        "doc_id", F.col("keeper.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("keeper.row")).alias("kept"), "text_sha256", F.lit(None).cast("string").alias("locator")
    )
    return apart.unionByName(told)


def _clashes(bodies: DataFrame, verdict: DataFrame, digest_hex: int) -> DataFrame:
    """Digests of hits under which more than one text stands; grouping by the text compares all bytes."""
    hits = verdict.filter("hit is not null")
    ids = small(written(hits.select(F.col("doc_id").alias("hit_id")).distinct()), BROADCAST_ROWS)
    texts = bodies.filter("own").join(ids, same(bodies.doc_id, ids.hit_id), "left_semi").select("norm")
    shortened = F.unhex(F.substring(F.sha2("norm", 256), 1, digest_hex)).alias("digest")
    old = bodies.filter("not own").select(shortened, "norm").join(hits.select("digest").distinct(), "digest", "left_semi")
    groups = texts.select(shortened, "norm").unionByName(old).groupBy("digest", "norm").agg(F.count("*").alias("n"))
    return groups.groupBy("digest").agg(F.count("*").alias("bodies")).filter("bodies > 1").select("digest")


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that exact_dedup keeps, with all their columns."""
    p = prefix(docs)
    verdict = written(exact_dedup(docs, id_col, text_col).select("doc_id", "text_sha256", "kept"))
    # A repeated row shares id and text with the one that stays; such pairs are told apart below.
    by = verdict.groupBy("doc_id", "text_sha256").agg(F.count("*").alias(f"{p}rows"), F.max("kept").alias(f"{p}stays")).filter(f"{p}rows > 1 or not {p}stays")
    out = written(by.select(F.col("doc_id").alias(f"{p}id"), F.col("text_sha256").alias(f"{p}sha"), f"{p}stays"))
    gone, columns = small(out, BROADCAST_ROWS), [F.col(f"`{c}`") for c in docs.columns]
    untouched = docs.join(gone, same(docs[id_col], gone[f"{p}id"]), "left_anti")
    rest = docs.join(gone, same(docs[id_col], gone[f"{p}id"]), "left_semi").withColumn(f"{p}s", F.sha2(ascii_lower(F.col(text_col)), 256))
    rest = rest.join(out, same(rest[id_col], out[f"{p}id"]) & (rest[f"{p}s"] == out[f"{p}sha"]), "left").filter(f"{p}sha is null or {p}stays")
    repeated = rest.filter(f"{p}stays").dropDuplicates([id_col, f"{p}s"]).select(*columns)
    return untouched.unionByName(rest.filter(f"{p}sha is null").select(*columns)).unionByName(repeated)


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents")).drop("locator")


OP1_SQL = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents),
k AS (SELECT doc_id, sha256(norm) AS text_sha256, max(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM k
"""
