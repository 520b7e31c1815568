"""Platform queries: feeds, pages, statistics, quotas, upserts over orders, customers and parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewell.operators import lifecycle as L
from tidewell.plans.registry import query, read

c = F.col


def conjunction(df: DataFrame, **given) -> DataFrame:
    """Filters column = value for each that is given, or membership where the value is a list."""
    for name, value in given.items():
        if value is not None:
            df = df.filter(c(name).isin(value) if isinstance(value, (list, tuple)) else c(name) == value)
    return df


@query("""SELECT p_partkey, p_name, p_brand, p_type, p_size FROM part WHERE p_type = 'ECONOMY' AND p_size IN (5, 10, 15, 20) AND p_name IS NOT NULL""")
def feed_filters(spark: SparkSession, d: str) -> DataFrame:
    rows = conjunction(read(spark, d, "part"), p_type="ECONOMY", p_size=[5, 10, 15, 20], p_brand=None).filter(c("p_name").isNotNull())
    return rows.select("p_partkey", "p_name", "p_brand", "p_type", "p_size")


@query("SELECT p_partkey, p_name FROM part WHERE list_has_any(string_split(p_name, ' '), ['red', 'ring'])")
def filter_array_overlap(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "part").filter(F.arrays_overlap(F.split("p_name", " "), F.array(F.lit("red"), F.lit("ring")))).select("p_partkey", "p_name")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 40")
def feed_page(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").offset(40).limit(20)


@query("SELECT count(*) AS total, CASE WHEN 60 < count(*) THEN 60 END::BIGINT AS next_offset FROM orders WHERE o_orderstatus = 'F'")
def feed_total(spark: SparkSession, d: str) -> DataFrame:
    n = F.count("*")
    return read(spark, d, "orders").filter("o_orderstatus = 'F'").agg(n.alias("total"), F.when(n > 60, F.lit(60).cast("long")).alias("next_offset"))


@query("SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 50")
def feed_sorted(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "part").select("p_partkey", "p_retailprice").orderBy(F.desc("p_retailprice"), "p_partkey").limit(50)


@query("SELECT p_partkey, p_name FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_custkey = 7)")
def feed_played(spark: SparkSession, d: str) -> DataFrame:
    mine = read(spark, d, "lineitem").join(read(spark, d, "orders").filter("o_custkey = 7"), c("l_orderkey") == c("o_orderkey"), "left_semi")
    return read(spark, d, "part").join(mine, c("p_partkey") == c("l_partkey"), "left_semi").select("p_partkey", "p_name")


@query("SELECT DISTINCT c_custkey, c_name FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_orderpriority = '1-URGENT'")
def feed_saved(spark: SparkSession, d: str) -> DataFrame:
    urgent = read(spark, d, "orders").filter("o_orderpriority = '1-URGENT'")
    return read(spark, d, "customer").join(urgent, c("o_custkey") == c("c_custkey"), "left_semi").select("c_custkey", "c_name")


@query("SELECT o_orderkey, c_name, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey")
def reviews_with_names(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "orders").join(read(spark, d, "customer"), c("o_custkey") == c("c_custkey")).select("o_orderkey", "c_name", "o_totalprice")


@query("SELECT o_orderkey, c_name, o_orderdate FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'O' ORDER BY o_orderdate DESC, o_orderkey LIMIT 10")
def recent_public(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "orders").filter("o_orderstatus = 'O'").join(read(spark, d, "customer"), c("o_custkey") == c("c_custkey"))
    return rows.select("o_orderkey", "c_name", "o_orderdate").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(10)


@query("""SELECT o_custkey AS user_id, count(*) AS played, count(*) FILTER (o_orderstatus = 'F') AS won, coalesce(sum(n), 0)::BIGINT AS turns
FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey WHERE o_orderpriority <> '5-LOW' GROUP BY 1""")
def player_stats(spark: SparkSession, d: str) -> DataFrame:
    """Per player, without playtests: games, wins and turns in one pass over orders."""
    turns = read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    games = read(spark, d, "orders").filter("o_orderpriority <> '5-LOW'").join(turns, c("l_orderkey") == c("o_orderkey"), "left")
    return games.groupBy(c("o_custkey").alias("user_id")).agg(F.count("*").alias("played"), F.count_if(c("o_orderstatus") == "F").alias("won"), F.coalesce(F.sum("n"), F.lit(0)).alias("turns"))


@query("SELECT s_suppkey, count(l_orderkey) AS published, coalesce(sum(l_linenumber), 0)::BIGINT AS plays FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey AND l_returnflag = 'R' GROUP BY 1")
def creator_stats(spark: SparkSession, d: str) -> DataFrame:
    own = read(spark, d, "lineitem").filter("l_returnflag = 'R'").groupBy("l_suppkey").agg(F.count("*").alias("n"), F.sum("l_linenumber").alias("s"))
    rows = read(spark, d, "supplier").join(own, c("l_suppkey") == c("s_suppkey"), "left")
    return rows.select("s_suppkey", F.coalesce("n", F.lit(0)).alias("published"), F.coalesce("s", F.lit(0)).alias("plays"))


@query("SELECT l_partkey, round_even(avg(l_quantity::DECIMAL(12,2))::DECIMAL(18,6), 2)::DOUBLE AS rating FROM lineitem GROUP BY 1")
def rating_avg_bround(spark: SparkSession, d: str) -> DataFrame:
    mean = F.sum(c("l_quantity").cast("decimal(12,2)")).cast("double") / F.count("*")
    return read(spark, d, "lineitem").groupBy("l_partkey").agg(F.bround(mean.cast("decimal(18,6)"), 2).cast("double").alias("rating"))


@query("SELECT s_suppkey, round(coalesce(avg(l_discount), 0.0), 6) AS rating FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey AND l_tax > 0.07 GROUP BY 1")
def avg_rating(spark: SparkSession, d: str) -> DataFrame:
    mean = read(spark, d, "lineitem").filter("l_tax > 0.07").groupBy("l_suppkey").agg(F.avg("l_discount").alias("m"))
    return read(spark, d, "supplier").join(mean, c("l_suppkey") == c("s_suppkey"), "left").select("s_suppkey", F.round(F.coalesce("m", F.lit(0.0)), 6).alias("rating"))


@query("SELECT e, count(*) AS n FROM (SELECT unnest([l_partkey, l_suppkey]) AS e FROM lineitem) WHERE e IS NOT NULL GROUP BY 1")
def count_by_endpoint(spark: SparkSession, d: str) -> DataFrame:
    ends = read(spark, d, "lineitem").select(F.explode(F.array("l_partkey", "l_suppkey")).alias("e")).filter("e is not null")
    return ends.groupBy("e").agg(F.count("*").alias("n"))


@query("SELECT event_type, count(*) FILTER (value > 50) AS big, count(*) FILTER (value <= 50) AS small_ FROM events GROUP BY 1")
def filtered_counts(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").groupBy("event_type").agg(F.count_if(c("value") > 50).alias("big"), F.count_if(c("value") <= 50).alias("small_"))


@query("SELECT conv_id, (coalesce(max(turn), -1) + 1)::BIGINT AS next_turn FROM conversations GROUP BY 1")
def next_sequence(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "conversations").groupBy("conv_id").agg((F.coalesce(F.max("turn"), F.lit(-1)) + 1).alias("next_turn"))


@query("SELECT user_id, count(*) AS lifetime, count(*) FILTER (ts >= TIMESTAMP '2024-01-29 00:00:00') AS last_day FROM events GROUP BY 1")
def quota_usage(spark: SparkSession, d: str) -> DataFrame:
    recent = c("ts") >= F.expr("timestamp_ntz'2024-01-29 00:00:00'")
    return read(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("lifetime"), F.count_if(recent).alias("last_day"))


@query("""SELECT l_orderkey AS batch, CASE WHEN bool_or(l_linestatus = 'O' AND l_returnflag = 'N') THEN 'pending' WHEN bool_and(l_returnflag = 'A') THEN 'succeeded'
WHEN bool_or(l_returnflag = 'A') THEN 'partial' ELSE 'failed' END AS batch_status, count(*) AS chunks FROM lineitem GROUP BY 1""")
def batch_status(spark: SparkSession, d: str) -> DataFrame:
    state = F.when((c("l_linestatus") == "O") & (c("l_returnflag") == "N"), "pending").when(c("l_returnflag") == "A", "succeeded").otherwise("failed")
    return L.batch_state(read(spark, d, "lineitem").select(c("l_orderkey").alias("batch"), state.alias("state")), "batch", "state")


@query("""SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, list_sort(list(value))[(count(*) // 2) + 1] AS p50,
list_sort(list(value))[CAST(floor(0.95 * count(*)) AS BIGINT) + 1] AS p95, round(sum(value) / sum(sum(value)) OVER (), 6) AS share FROM events GROUP BY 1""")
def latency_attribution(spark: SparkSession, d: str) -> DataFrame:
    """Index-based percentiles from the counts of distinct values: rows are counted before anything is put in order."""
    counts = read(spark, d, "events").groupBy("event_type", "value").agg(F.count("*").alias("m"))
    w = Window.partitionBy("event_type")
    ranked = counts.withColumn("upto", F.sum("m").over(w.orderBy("value"))).withColumn("n", F.sum("m").over(w))
    at = lambda i: F.min(F.when(c("upto") > i, c("value")))
    steps = ranked.groupBy("event_type").agg(
        F.sum("m").alias("n"), F.round(F.sum(c("value") * c("m")) / F.sum("m"), 6).alias("mean"), at(F.floor(c("n") / 2)).alias("p50"), at(F.floor(0.95 * c("n"))).alias("p95"), F.sum(c("value") * c("m")).alias("s")
    )
    return steps.withColumn("share", F.round(c("s") / F.sum("s").over(Window.partitionBy()), 6)).drop("s")


@query("SELECT user_id, round(sum(value), 6) AS total, count(*) AS n, round(sum(value) FILTER (event_type IN ('click', 'view')), 6) AS model_s, round(sum(value) FILTER (event_type NOT IN ('click', 'view')), 6) AS other_s FROM events GROUP BY 1")
def stage_profile(spark: SparkSession, d: str) -> DataFrame:
    model = c("event_type").isin("click", "view")
    return read(spark, d, "events").groupBy("user_id").agg(
        F.round(F.sum("value"), 6).alias("total"), F.count("*").alias("n"), F.round(F.sum(F.when(model, c("value"))), 6).alias("model_s"), F.round(F.sum(F.when(~model, c("value"))), 6).alias("other_s")
    )


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_custkey = c_custkey GROUP BY o_orderkey HAVING count(*) >= 7)")
def elig_min_activity(spark: SparkSession, d: str) -> DataFrame:
    """At least seven turns in one game, not in all of them."""
    long = read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n")).filter("n >= 7")
    games = read(spark, d, "orders").join(long, c("o_orderkey") == c("l_orderkey"), "left_semi")
    return read(spark, d, "customer").join(games, c("c_custkey") == c("o_custkey"), "left_semi").select("c_custkey")


@query("SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'widg') OR contains(lower(p_type), 'econ')")
def filter_text_contains(spark: SparkSession, d: str) -> DataFrame:
    found = F.lower("p_name").contains("widg") | F.lower("p_type").contains("econ")
    return read(spark, d, "part").filter(found).select("p_partkey", "p_name")


@query("SELECT least(l_partkey, l_suppkey) AS a, greatest(l_partkey, l_suppkey) AS b, count(*) AS n FROM lineitem WHERE l_partkey <> l_suppkey GROUP BY 1, 2")
def canonical_pairs(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "lineitem").filter("l_partkey <> l_suppkey")
    return rows.groupBy(F.least("l_partkey", "l_suppkey").alias("a"), F.greatest("l_partkey", "l_suppkey").alias("b")).agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, to_json(list({'line': l_linenumber, 'part': l_partkey} ORDER BY l_linenumber, l_partkey))::VARCHAR AS lines, count(l_orderkey) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def snapshot_nest(spark: SparkSession, d: str) -> DataFrame:
    lines = read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(c("l_linenumber").alias("line"), c("l_partkey").alias("part")))).alias("a"))
    rows = read(spark, d, "orders").join(lines, c("l_orderkey") == c("o_orderkey"))
    return rows.select("o_orderkey", F.to_json("a").alias("lines"), F.size("a").cast("long").alias("n"))


@query("SELECT n.n_nationkey, o.n_nationkey AS neighbour FROM nation n JOIN nation o ON o.n_nationkey IN (n.n_nationkey - 1, n.n_nationkey + 1)")
def neighbors_undirected(spark: SparkSession, d: str) -> DataFrame:
    """Connections stored once, read from both ends."""
    n = read(spark, d, "nation").select("n_nationkey")
    links = n.select(c("n_nationkey").alias("a"), (c("n_nationkey") + 1).alias("b")).join(n, c("b") == c("n_nationkey"), "left_semi")
    return links.select(c("a").alias("n_nationkey"), c("b").alias("neighbour")).unionByName(links.select(c("b").alias("n_nationkey"), c("a").alias("neighbour")))


@query("""SELECT n_nationkey, turn_order, turn_order = 3 AS is_turn FROM (SELECT n_nationkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name) - 1 AS turn_order,
count(*) OVER (PARTITION BY n_regionkey) AS n FROM nation)""")
def turn_rotation(spark: SparkSession, d: str) -> DataFrame:
    """Whose turn it is after 13 turns among the members of each region, five each: index 13 mod n."""
    w = Window.partitionBy("n_regionkey")
    rows = read(spark, d, "nation").withColumn("turn_order", F.row_number().over(w.orderBy("n_name")).cast("long") - 1).withColumn("n", F.count("*").over(w))
    return rows.select("n_nationkey", "turn_order", (c("turn_order") == F.lit(13) % c("n")).alias("is_turn"))


@query("SELECT p_brand, p_partkey, (row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) - 1)::BIGINT AS priority FROM part")
def reorder_priority(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("p_brand").orderBy(F.desc("p_size"), "p_partkey")
    return read(spark, d, "part").select("p_brand", "p_partkey", (F.row_number().over(w) - 1).cast("long").alias("priority"))


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def verify_missing(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "orders").join(read(spark, d, "lineitem"), c("o_orderkey") == c("l_orderkey"), "left_anti").select("o_orderkey")


@query("SELECT c_custkey, n_name, r_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def lookup_enrich(spark: SparkSession, d: str) -> DataFrame:
    """Dimension lookups; Spark broadcasts them by their size."""
    rows = read(spark, d, "customer").join(read(spark, d, "nation"), c("c_nationkey") == c("n_nationkey"), "left")
    return rows.join(read(spark, d, "region"), c("n_regionkey") == c("r_regionkey"), "left").select("c_custkey", "n_name", "r_name")


@query("""SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 3 = 0 THEN 'conflict' WHEN o_orderkey % 3 = 1 THEN 'updated' ELSE 'missing' END AS outcome FROM orders WHERE o_orderkey < 3000""")
def optimistic_update(spark: SparkSession, d: str) -> DataFrame:
    """Updates expecting version 1 of rows whose stored version is 1, 2 or none."""
    return _update(read(spark, d, "orders").filter("o_orderkey < 3000"))


@query("""SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 3 = 0 THEN 'conflict' WHEN o_orderkey % 3 = 1 THEN 'updated' ELSE 'missing' END AS outcome FROM orders""")
def optimistic_update_all(spark: SparkSession, d: str) -> DataFrame:
    return _update(read(spark, d, "orders"))


def _update(orders: DataFrame) -> DataFrame:
    k = c("o_orderkey")
    updates = orders.select("o_orderkey", "o_custkey", F.lit(1).alias("expected"))
    stored = orders.filter(k % 3 != 2).select(k.alias("id"), F.when(k % 3 == 0, 2).otherwise(1).alias("version"))
    rows = updates.join(stored, k == c("id"), "left")
    outcome = F.when(c("id").isNull(), "missing").when(c("version") == c("expected"), "updated").otherwise("conflict")
    return rows.select("o_orderkey", "o_custkey", outcome.alias("outcome"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') OR o_orderpriority = '2-HIGH'")
def access_semi(spark: SparkSession, d: str) -> DataFrame:
    """Owners of a segment or holders of a share: one semi join against the union of both."""
    o = read(spark, d, "orders")
    members = read(spark, d, "customer").filter("c_mktsegment = 'BUILDING'").select(c("c_custkey").alias("k"))
    allowed = o.join(members, c("o_custkey") == c("k"), "left_semi").select("o_orderkey").unionByName(o.filter("o_orderpriority = '2-HIGH'").select("o_orderkey"))
    return o.join(allowed, "o_orderkey", "left_semi").select("o_orderkey", "o_custkey")


@query("SELECT * FROM (SELECT o_custkey, o_orderkey, o_orderdate, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1 AS is_player FROM orders)")
def single_flag(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))
    return read(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate", (F.row_number().over(w) == 1).alias("is_player"))


SLOTS = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")


@query("SELECT p_brand, p_type, count(p_partkey) AS n FROM (SELECT DISTINCT p_brand FROM part) CROSS JOIN (SELECT DISTINCT p_type FROM part) LEFT JOIN part USING (p_brand, p_type) GROUP BY ALL")
def slot_default_fill(spark: SparkSession, d: str) -> DataFrame:
    """Every brand has all slots; the slots are a fixed short list."""
    p = read(spark, d, "part")
    slots = F.array(*map(F.lit, SLOTS))
    every = p.select("p_brand").distinct().select("p_brand", F.explode(slots).alias("p_type"))
    have = p.groupBy("p_brand", "p_type").agg(F.count("*").alias("n"))
    return every.join(have, ["p_brand", "p_type"], "left").select("p_brand", "p_type", F.coalesce("n", F.lit(0)).alias("n"))


@query("SELECT l_orderkey, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) - 1)::BIGINT AS pos, p_name FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_orderkey < 2000")
def inventory_explode(spark: SparkSession, d: str) -> DataFrame:
    return _explode(read(spark, d, "lineitem").filter("l_orderkey < 2000"), read(spark, d, "part"))


@query("SELECT l_orderkey, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) - 1)::BIGINT AS pos, p_name FROM lineitem JOIN part ON l_partkey = p_partkey")
def inventory_explode_all(spark: SparkSession, d: str) -> DataFrame:
    return _explode(read(spark, d, "lineitem"), read(spark, d, "part"))


def _explode(lineitem: DataFrame, part: DataFrame) -> DataFrame:
    lists = lineitem.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("items"))
    items = lists.select("l_orderkey", F.posexplode("items").alias("pos", "item"))
    return items.join(part, c("item.l_partkey") == c("p_partkey")).select("l_orderkey", c("pos").cast("long").alias("pos"), "p_name")


@query("""SELECT l_orderkey + 1000000 AS new_order, l_partkey + 2000000 AS new_part FROM lineitem WHERE l_orderkey % 2 = 0 AND l_partkey % 3 <> 0""")
def clone_remap_edges(spark: SparkSession, d: str) -> DataFrame:
    edges = read(spark, d, "lineitem").select(c("l_orderkey").alias("order"), c("l_partkey").alias("part"))
    orders = edges.select(c("order").alias("old_id")).distinct().filter("old_id % 2 = 0").withColumn("new_id", c("old_id") + 1000000)
    parts = edges.select(c("part").alias("old_id")).distinct().filter("old_id % 3 <> 0").withColumn("new_id", c("old_id") + 2000000)
    rows = edges.join(orders.withColumnsRenamed({"old_id": "order", "new_id": "new_order"}), "order")
    return rows.join(parts.withColumnsRenamed({"old_id": "part", "new_id": "new_part"}), "part").select("new_order", "new_part")


@query("SELECT p_brand, count(*) AS n, count(*) FILTER (p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 50)) AS in_use FROM part GROUP BY 1")
def guard_in_use(spark: SparkSession, d: str) -> DataFrame:
    used = read(spark, d, "lineitem").filter("l_quantity >= 50").select(c("l_partkey").alias("k")).distinct()
    rows = read(spark, d, "part").join(used, c("p_partkey") == c("k"), "left")
    return rows.groupBy("p_brand").agg(F.count("*").alias("n"), F.count("k").alias("in_use"))


@query("SELECT p_partkey, p_name, list_sort(list(DISTINCT s_name)) AS aliases FROM part JOIN lineitem ON l_partkey = p_partkey JOIN supplier ON s_suppkey = l_suppkey WHERE p_partkey < 200 GROUP BY ALL")
def entity_alias_hydrate(spark: SparkSession, d: str) -> DataFrame:
    return _hydrate(read(spark, d, "lineitem").filter("l_partkey < 200"), read(spark, d, "supplier"), read(spark, d, "part"))


@query("SELECT p_partkey, p_name, list_sort(list(DISTINCT s_name)) AS aliases FROM part JOIN lineitem ON l_partkey = p_partkey JOIN supplier ON s_suppkey = l_suppkey GROUP BY ALL")
def entity_alias_hydrate_all(spark: SparkSession, d: str) -> DataFrame:
    return _hydrate(read(spark, d, "lineitem"), read(spark, d, "supplier"), read(spark, d, "part"))


def _hydrate(lineitem: DataFrame, supplier: DataFrame, part: DataFrame) -> DataFrame:
    links = lineitem.join(supplier, c("s_suppkey") == c("l_suppkey"))
    names = links.groupBy("l_partkey").agg(F.sort_array(F.collect_set("s_name")).alias("aliases"))
    return part.join(names, c("p_partkey") == c("l_partkey")).select("p_partkey", "p_name", "aliases")


@query("SELECT doc_id, label FROM documents JOIN embeddings ON vec_id::VARCHAR = doc_id::VARCHAR")
def join_cast_key(spark: SparkSession, d: str) -> DataFrame:
    """The text key is cast back to the id's type once, so that the join stays on a number."""
    e = read(spark, d, "embeddings").select(c("vec_id").cast("string").alias("k"), "label")
    return read(spark, d, "documents").join(e, c("doc_id") == c("k").try_cast("long")).select("doc_id", "label")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey = 4242")
def scan_point_lookup(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "orders").filter("o_orderkey = 4242").select("o_orderkey", "o_totalprice")


@query("SELECT p_partkey, p_name FROM part WHERE starts_with(p_name, 'red') AND p_retailprice > 950")
def scan_prefix(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "part").filter(c("p_name").startswith("red") & (c("p_retailprice") > 950)).select("p_partkey", "p_name")


@query("SELECT l_orderkey, l_partkey, p_type, o_orderstatus FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey WHERE l_returnflag = 'R'")
def scan_edges(spark: SparkSession, d: str) -> DataFrame:
    edges = read(spark, d, "lineitem").filter("l_returnflag = 'R'").select("l_orderkey", "l_partkey")
    rows = edges.join(read(spark, d, "orders"), c("o_orderkey") == c("l_orderkey")).join(read(spark, d, "part"), c("p_partkey") == c("l_partkey"))
    return rows.select("l_orderkey", "l_partkey", "p_type", "o_orderstatus")


@query("SELECT o_orderkey, l_partkey, p_name FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_returnflag = 'A' LEFT JOIN part ON p_partkey = l_partkey AND p_type = 'ECONOMY'")
def graph_optional_expand(spark: SparkSession, d: str) -> DataFrame:
    about = read(spark, d, "lineitem").filter("l_returnflag = 'A'")
    objects = read(spark, d, "part").filter("p_type = 'ECONOMY'")
    rows = read(spark, d, "orders").join(about, c("l_orderkey") == c("o_orderkey"), "left").join(objects, c("p_partkey") == c("l_partkey"), "left")
    return rows.select("o_orderkey", "l_partkey", "p_name")


@query("SELECT o_orderkey, o_orderstatus, c_mktsegment FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_custkey = 12 AND o_orderstatus = 'F'")
def user_history(spark: SparkSession, d: str) -> DataFrame:
    games = conjunction(read(spark, d, "orders"), o_custkey=12, o_orderstatus="F")
    return games.join(read(spark, d, "customer"), c("c_custkey") == c("o_custkey")).select("o_orderkey", "o_orderstatus", "c_mktsegment")


@query("SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_orderkey < 5000) + row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS position FROM customer")
def next_position(spark: SparkSession, d: str) -> DataFrame:
    """Those there already, and the place among those who join now."""
    there = read(spark, d, "orders").filter("o_orderkey < 5000").groupBy("o_custkey").agg(F.count("*").alias("n"))
    rows = read(spark, d, "customer").join(there, c("c_custkey") == c("o_custkey"), "left")
    place = F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_custkey"))
    return rows.select("c_custkey", (F.coalesce("n", F.lit(0)) + place).alias("position"))


@query("SELECT quality, count(*) FILTER (toxic = 0) AS won, count(*) FILTER (toxic = 1) AS lost FROM labels GROUP BY 1")
def objectives_split(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "labels").groupBy("quality").agg(F.count_if(c("toxic") == 0).alias("won"), F.count_if(c("toxic") == 1).alias("lost"))


@query("SELECT a.n_nationkey AS pin, b.n_nationkey AS linked FROM nation a JOIN nation b ON b.n_nationkey = a.n_nationkey + 1 WHERE a.n_regionkey IN (0, 1, 2) AND b.n_regionkey IN (0, 1, 2)")
def map_visible_subgraph(spark: SparkSession, d: str) -> DataFrame:
    """Connections with both ends in the discovered regions."""
    pins = read(spark, d, "nation").filter(c("n_regionkey").isin(0, 1, 2)).select(c("n_nationkey").alias("pin"))
    links = pins.withColumn("linked", c("pin") + 1)
    return links.join(pins.select(c("pin").alias("p")), c("linked") == c("p"), "left_semi")


@query("SELECT p_partkey, p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49) AS active FROM part")
def soft_delete(spark: SparkSession, d: str) -> DataFrame:
    gone = read(spark, d, "lineitem").filter("l_quantity > 49").select(c("l_partkey").alias("g")).distinct()
    return read(spark, d, "part").join(gone, c("p_partkey") == c("g"), "left").select("p_partkey", c("g").isNull().alias("active"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_linestatus = 'O' AND (l_orderkey, l_linenumber) NOT IN (SELECT (l_orderkey, l_linenumber) FROM lineitem WHERE l_linestatus = 'F')")
def retry_pending(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_linestatus")
    return rows.filter("l_linestatus = 'O'").join(rows.filter("l_linestatus = 'F'"), ["l_orderkey", "l_linenumber"], "left_anti").drop("l_linestatus")


@query("SELECT o_custkey, o_orderstatus, min(o_orderkey) AS share FROM orders GROUP BY 1, 2")
def get_or_create(spark: SparkSession, d: str) -> DataFrame:
    """Shares that exist (of early orders), and new ones for the keys that have none."""
    o = read(spark, d, "orders")
    have = o.filter("o_orderkey < 4000").groupBy("o_custkey", "o_orderstatus").agg(F.min("o_orderkey").alias("share"))
    new = o.join(have, ["o_custkey", "o_orderstatus"], "left_anti").groupBy("o_custkey", "o_orderstatus").agg(F.min("o_orderkey").alias("share"))
    return have.unionByName(new)


@query("SELECT o_custkey, count(*) FILTER (l_linenumber = 5 AND o_orderpriority <> '5-LOW') AS plays FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def play_count(spark: SparkSession, d: str) -> DataFrame:
    """A game counts once, when its fifth turn comes, and not as a playtest."""
    rows = read(spark, d, "orders").join(read(spark, d, "lineitem"), c("l_orderkey") == c("o_orderkey"))
    return rows.groupBy("o_custkey").agg(F.count_if((c("l_linenumber") == 5) & (c("o_orderpriority") != "5-LOW")).alias("plays"))


@query("SELECT event_type, len(json_keys(props))::BIGINT AS names, count(*) AS rows_ FROM events GROUP BY 1, 2")
def write_buckets(spark: SparkSession, d: str) -> DataFrame:
    """Nodes by label and number of property names, as a sink writes them together."""
    return read(spark, d, "events").groupBy("event_type", F.size(F.json_object_keys("props")).cast("long").alias("names")).agg(F.count("*").alias("rows_"))


@query("SELECT event_id, CASE WHEN event_type IN ('view', 'click') THEN ['view', 'view', 'click'] ELSE ['view', 'view', 'click', event_type] END AS found FROM events")
def append_distinct(spark: SparkSession, d: str) -> DataFrame:
    """Appended where it isn't there yet; what the list repeats stays."""
    have = F.array(F.lit("view"), F.lit("view"), F.lit("click"))
    return read(spark, d, "events").select("event_id", F.when(F.array_contains(have, c("event_type")), have).otherwise(F.concat(have, F.array("event_type"))).alias("found"))


@query("SELECT 'lore:' || source || ':' || substr(sha256(coalesce(text, '')), 1, 16) AS record_id, count(*) AS n FROM documents GROUP BY 1")
def src_content_key(spark: SparkSession, d: str) -> DataFrame:
    """Records named by their content: an edited text is a new one."""
    key = F.concat(F.lit("lore:"), "source", F.lit(":"), F.substring(F.sha2(F.coalesce("text", F.lit("")), 256), 1, 16))
    return read(spark, d, "documents").groupBy(key.alias("record_id")).agg(F.count("*").alias("n"))
