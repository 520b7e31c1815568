"""A stored graph that plans are merged into: files by buckets of ids, of which a merge rewrites only those that it touches.

A folder holds plans (what was asked for, stored first), nodes and edges of each version, and versions: small tables that
tell which version's files each bucket is to be read from. A version counts once its table is whole, so readers see nodes
and edges of one merge together or not at all, and earlier versions stay readable. One writer at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Of several values that one merge gives a node, the least one holds: a fact ends when the first other fact ends it.
LEAST = ("superseded_at", "valid_to")
NODE, EDGE = ["id"], ["id", "kind", "source_id", "source_label", "destination_id", "destination_label"]
#: Columns that the latest row of a node decides.
LAST = {"nodes": ["label", "context", "key"], "edges": []}
KEYS = {"nodes": NODE, "edges": EDGE}
_MAP = "map<string,string>"


def _schema(side: str) -> str:
    return ", ".join([*(f"`{name}` string" for name in (*KEYS[side], *LAST[side])), f"properties {_MAP}"])


def _found(spark: SparkSession, pattern: str) -> list[str]:
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    return sorted(f.getPath().toString() for f in path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path) or [])


def versions(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the versions that are whole."""
    return [int(p.split("/")[-2]) for p in _found(spark, f"{folder}/versions/*/_SUCCESS")]


def layout(spark: SparkSession, folder: str, version: int | None = None) -> tuple[int | None, dict[tuple[str, int], int]]:
    """(number of buckets, {(side, bucket): version}) of a version, the latest unless one is named: a row a bucket and side."""
    known = versions(spark, folder)
    if version is not None and version not in known:
        raise ValueError(f"there is no version {version}")
    if not known:
        return None, {}
    rows = spark.read.parquet(f"{folder}/versions/{known[-1] if version is None else version:08d}").collect()
    return rows[0]["buckets"], {(r["side"], r["bucket"]): r["version"] for r in rows if r["bucket"] >= 0}


def _bucket(id_: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(id_), F.lit(buckets)).cast("int")


def _read(spark: SparkSession, folder: str, side: str, places: dict[tuple[str, int], int], only: set[int] | None = None) -> DataFrame:
    paths = [f"{folder}/{side}/{v:08d}/bucket={b}" for (s, b), v in sorted(places.items()) if s == side and (only is None or b in only)]
    return spark.read.schema(_schema(side)).parquet(*paths) if paths else spark.createDataFrame([], _schema(side))


def stored(spark: SparkSession, folder: str, side: str, version: int | None = None) -> DataFrame:
    """nodes(id, label, context, key, properties) or edges(id, kind, source_id, source_label, destination_id, destination_label, properties)."""
    return _read(spark, folder, side, layout(spark, folder, version)[1])


def _touched(rows: DataFrame, *ids: str, buckets: int) -> set[int]:
    """At most as many numbers as there are buckets."""
    found = rows.select(F.explode(F.array(*(_bucket(F.col(i), buckets) for i in ids))).alias("b")).distinct()
    return {r["b"] for r in found.collect()}


def _once(rows: DataFrame, side: str) -> DataFrame:
    """Rows of a plan, repeats gone: a node that every chunk tells of is one row a task before anything is shuffled."""
    entries = F.array_sort(F.map_entries(F.map_filter("properties", lambda _, v: v.isNotNull())))
    return rows.groupBy(*KEYS[side], *LAST[side], entries.alias("entries")).agg(F.max("seq").alias("seq"))


def _settled(old: DataFrame, new: DataFrame, side: str, buckets: int) -> DataFrame:
    """One row a key: stored properties, over them those of the plan, of which the latest holds, or the least of LEAST.

    Both sides are dealt by bucket once; grouping by (bucket, key, property) and by key needs no other shuffle, and no group is collected but
    the properties of one key.
    """
    keys, last = ["bucket", *KEYS[side]], LAST[side]
    before = old.select(*KEYS[side], *last, F.map_entries("properties").alias("entries"), F.lit(None).cast("long").alias("seq"))
    rows = before.unionByName(new).withColumn("bucket", _bucket(F.col("id"), buckets)).repartition("bucket")
    each = rows.select(*keys, *last, "seq", F.explode_outer("entries").alias("p")).select(*keys, *last, "seq", F.col("p.key").alias("name"), F.col("p.value").alias("value"))
    fresh, whole = F.col("seq").isNotNull(), F.col("value").try_cast("long")
    order = F.coalesce("seq", F.lit(-(1 << 63)))
    values = each.groupBy(*keys, "name").agg(
        F.max_by("value", F.struct(order, F.col("value"))).alias("latest"), F.min(F.when(fresh, whole)).alias("least"),
        F.bool_and(F.when(fresh, whole.isNotNull())).alias("whole"), F.max(F.struct(order.alias("order"), *last)).alias("last"),
    )
    value = F.when(F.col("name").isin(*LEAST) & F.col("whole"), F.col("least").cast("string")).otherwise(F.col("latest"))
    pairs = F.collect_list(F.when(F.col("name").isNotNull(), F.struct(F.col("name").alias("k"), value.alias("v"))))
    found = values.groupBy(*keys).agg(F.max("last").alias("last"), F.map_from_entries(F.array_sort(pairs)).alias("properties"))
    return found.select(*keys, *(F.col(f"last.{name}").alias(name) for name in last), "properties")


def merge(nodes: DataFrame, edges: DataFrame, folder: str, buckets: int = 64) -> int:
    """Merges a plan's nodes, then its edges, into the graph of a shared folder; returns the new version's number.

    nodes(id, label, context, key, properties, seq) and edges(.., properties, seq) are what graph_plan gives; ids and properties
    are text. A known node keeps the properties that the plan doesn't name; values that tie in seq hold by their
    order. An edge between nodes that neither the plan nor the store has, under the labels that it names, isn't made.
    Rows without an id, and null properties, go. The number of buckets is that of the folder's first merge.
    Merging a plan again, in whole, changes nothing that a later plan hasn't changed meanwhile. A merge that breaks off leaves no version.
    """
    spark = nodes.sparkSession
    had, places = layout(spark, folder)
    buckets, known = had or buckets, versions(spark, folder)
    # A number that a broken merge took isn't taken again, so that its files are never read.
    number = max([-1, *known, *(int(p.rpartition("/")[2]) for p in _found(spark, f"{folder}/plans/*"))]) + 1
    plan: dict[str, DataFrame] = {}
    for side, rows in (("nodes", nodes), ("edges", edges)):
        path = f"{folder}/plans/{number:08d}/{side}"
        _once(rows.filter("id is not null"), side).write.parquet(path)
        plan[side] = spark.read.parquet(path)
    for side in ("nodes", "edges"):
        rows = plan[side] if side == "nodes" else _between(spark, folder, f"{folder}/plans/{number:08d}/missing", plan[side], places, buckets)
        old = _read(spark, folder, side, places, _touched(rows, "id", buckets=buckets))
        target = f"{folder}/{side}/{number:08d}"
        _settled(old, rows, side, buckets).write.partitionBy("bucket").parquet(target)
        places |= {(side, int(p.rpartition("=")[2])): number for p in _found(spark, f"{target}/bucket=*")}
    table = [(side, b, v, buckets) for (side, b), v in places.items()] or [("nodes", -1, number, buckets)]
    spark.createDataFrame(table, "side string, bucket int, version int, buckets int").coalesce(1).write.parquet(f"{folder}/versions/{number:08d}")
    return number


def _between(spark: SparkSession, folder: str, path: str, edges: DataFrame, places: dict[tuple[str, int], int], buckets: int) -> DataFrame:
    """Edges whose ends are stored. Each end is looked up once, however many edges it has; what is missing is written to path.

    Nearly always that is nothing, and then edges are neither joined nor moved.
    """
    end = lambda side: edges.select(F.col(f"{side}_id").alias("id"), F.col(f"{side}_label").alias("label"))
    ends = end("source").unionByName(end("destination")).distinct()
    nodes = _read(spark, folder, "nodes", places, _touched(edges, "source_id", "destination_id", buckets=buckets))
    ends.join(nodes.select("id", "label"), ["id", "label"], "left_anti").write.parquet(path)
    missing = spark.read.parquet(path)
    if missing.isEmpty():
        return edges
    for side in ("source", "destination"):
        gone = missing.select(F.col("id").alias("_id"), F.col("label").alias("_label"))
        edges = edges.join(gone, (F.col(f"{side}_id") == F.col("_id")) & (F.col(f"{side}_label") == F.col("_label")), "left_anti")
    return edges


def absent(nodes: DataFrame, folder: str) -> DataFrame:
    """(id, label) of a plan that can't be read back from the store."""
    spark = nodes.sparkSession
    had, places = layout(spark, folder)
    asked = nodes.filter("id is not null").select("id", "label").distinct()
    if had is None:
        return asked
    known = _read(spark, folder, "nodes", places, _touched(asked, "id", buckets=had))
    return asked.join(known.select("id", "label"), ["id", "label"], "left_anti")
