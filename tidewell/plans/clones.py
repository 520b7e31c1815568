"""Copies: a region with all below it, a chain of superseding facts, a context of the graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewell.operators import clones as C
from tidewell.plans.registry import query, read

c = F.col


@query("""WITH r AS (SELECT * FROM region WHERE r_regionkey = 1), n AS (SELECT * FROM nation SEMI JOIN r ON n_regionkey = r_regionkey), s AS (SELECT * FROM supplier SEMI JOIN n ON s_nationkey = n_nationkey),
cu AS (SELECT * FROM customer SEMI JOIN n ON c_nationkey = n_nationkey), o AS (SELECT * FROM orders SEMI JOIN cu ON o_custkey = c_custkey), l AS (SELECT * FROM lineitem SEMI JOIN o ON l_orderkey = o_orderkey)
SELECT 'region' AS kind, 'x:region:' || r_regionkey AS new_key, NULL AS new_parent, r_name AS content FROM r UNION ALL SELECT 'nation', 'x:nation:' || n_nationkey, 'x:region:' || n_regionkey, n_name FROM n
UNION ALL SELECT 'supplier', 'x:supplier:' || s_suppkey, 'x:nation:' || s_nationkey, s_name FROM s UNION ALL SELECT 'customer', 'x:customer:' || c_custkey, 'x:nation:' || c_nationkey, c_name FROM cu
UNION ALL SELECT 'orders', 'x:orders:' || o_orderkey, 'x:customer:' || o_custkey, o_orderstatus FROM o UNION ALL SELECT 'lineitem', NULL, 'x:orders:' || l_orderkey, l_linenumber || l_returnflag FROM l""")
def deep_copy(spark: SparkSession, d: str) -> DataFrame:
    """A region, its nations, their suppliers and customers, their orders, the lines of those."""
    t = lambda name: read(spark, d, name)
    children = [
        C.Child("nation", t("nation"), "n_nationkey", "region", "n_regionkey"), C.Child("supplier", t("supplier"), "s_suppkey", "nation", "s_nationkey"),
        C.Child("customer", t("customer"), "c_custkey", "nation", "c_nationkey"), C.Child("orders", t("orders"), "o_orderkey", "customer", "o_custkey"), C.Child("lineitem", t("lineitem"), None, "orders", "l_orderkey"),
    ]
    content = {"region": c("r_name"), "nation": c("n_name"), "supplier": c("s_name"), "customer": c("c_name"), "orders": c("o_orderstatus"), "lineitem": F.concat("l_linenumber", "l_returnflag")}
    copies = C.deep_copy("x", "region", t("region").filter("r_regionkey = 1"), "r_regionkey", children)
    parts = [df.select(F.lit(name).alias("kind"), "new_key", "new_parent", content[name].alias("content")) for name, df in copies.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("""WITH e AS (SELECT event_id, user_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS prior, value FROM events), k AS (SELECT * FROM e WHERE value > 10)
SELECT 'x:fact:' || k.event_id AS new_key, 'x:fact:' || p.event_id AS new_link FROM k LEFT JOIN k p ON p.event_id = k.prior""")
def clone_relink(spark: SparkSession, d: str) -> DataFrame:
    """Copies of facts point to the copies of what they supersede, where that was copied."""
    prior = F.lag("event_id").over(Window.partitionBy("user_id").orderBy("event_id"))
    kept = read(spark, d, "events").select("event_id", prior.alias("prior"), "value").filter("value > 10")
    return C.relinked(kept.withColumn("new_key", C.new_key("x", "fact", c("event_id"))), "event_id", "prior").select("new_key", "new_link")


GRAPH = """nodes AS (SELECT 'fact:' || event_id AS id, 'Fact' AS label, event_id % 17 = 0 AS archived, CASE WHEN event_id % 4 = 0 THEN ts END AS superseded_at FROM events
UNION ALL SELECT DISTINCT 'user:' || user_id, 'User', user_id % 9 = 0, NULL FROM events), edges AS (SELECT 'fact:' || event_id AS source, 'ABOUT' AS kind, 'user:' || user_id AS target FROM events),
now_ AS (SELECT * FROM nodes WHERE NOT archived AND superseded_at IS NULL), e AS (SELECT * FROM edges WHERE source IN (SELECT id FROM now_) AND target IN (SELECT id FROM now_))"""


def graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = read(spark, d, "events")
    fact, user = F.concat(F.lit("fact:"), "event_id"), F.concat(F.lit("user:"), "user_id")
    facts = e.select(fact.alias("id"), F.lit("Fact").alias("label"), (c("event_id") % 17 == 0).alias("archived"), F.when(c("event_id") % 4 == 0, c("ts")).alias("superseded_at"))
    users = e.select("user_id").distinct().select(user.alias("id"), F.lit("User").alias("label"), (c("user_id") % 9 == 0).alias("archived"), F.lit(None).cast("timestamp_ntz").alias("superseded_at"))
    return facts.unionByName(users), e.select(fact.alias("source"), F.lit("ABOUT").alias("kind"), user.alias("target"))


@query(f"WITH {GRAPH} SELECT id, label FROM now_ WHERE label = 'User'")
def scan_nodes_current(spark: SparkSession, d: str) -> DataFrame:
    nodes, _ = graph(spark, d)
    return nodes.filter("label = 'User' and not archived and superseded_at is null").select("id", "label")


@query(f"WITH {GRAPH} SELECT 'node' AS kind, 'x:' || id AS a, label AS b FROM now_ UNION ALL SELECT kind, 'x:' || source, 'x:' || target FROM e")
def clone_context(spark: SparkSession, d: str) -> DataFrame:
    """The current nodes and the edges between them, under new ids."""
    nodes, edges = C.clone_context(*graph(spark, d), "x")
    return nodes.select(F.lit("node").alias("kind"), c("id").alias("a"), c("label").alias("b")).unionByName(edges.select("kind", c("source").alias("a"), c("target").alias("b")))


@query(f"WITH {GRAPH} SELECT label AS kind, count(*) AS n FROM now_ GROUP BY 1 UNION ALL SELECT 'edges', count(*) FROM e")
def clone_counts(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = C.clone_context(*graph(spark, d), "x")
    return nodes.groupBy(c("label").alias("kind")).agg(F.count("*").alias("n")).unionByName(edges.agg(F.lit("edges").alias("kind"), F.count("*").alias("n")))


@query("""SELECT u.user_id, e.event_type AS content, 'template' AS origin FROM (SELECT DISTINCT user_id FROM events) u, (SELECT event_type FROM events WHERE event_id < 3) e
UNION ALL SELECT user_id, event_type, 'player' FROM (SELECT DISTINCT ON (user_id) user_id, event_type FROM events ORDER BY user_id, event_id)""")
def clone_union(spark: SparkSession, d: str) -> DataFrame:
    """A new space has the template's three facts and the player's own first one."""
    e = read(spark, d, "events")
    template = [r["event_type"] for r in e.filter("event_id < 3").select("event_type").collect()]  # three rows
    facts = e.select("user_id").distinct().select("user_id", F.explode(F.array(*map(F.lit, template))).alias("content"), F.lit("template").alias("origin"))
    return facts.unionByName(e.groupBy("user_id").agg(F.min_by("event_type", "event_id").alias("content"), F.lit("player").alias("origin")))


@query("SELECT doc_id, source = 'src1' AND doc_id % 6 <> 0 OR doc_id % 6 = 0 AS archived, source = 'src1' AND doc_id % 6 <> 0 AS archived_now FROM documents")
def republish_archive(spark: SparkSession, d: str) -> DataFrame:
    """Publishing a template again archives all that is current of it."""
    rows = read(spark, d, "documents").select("doc_id", "source", (c("doc_id") % 6 == 0).alias("was"))
    now = F.coalesce(c("source") == "src1", F.lit(False)) & ~c("was")
    return rows.select("doc_id", (c("was") | now).alias("archived"), now.alias("archived_now"))
