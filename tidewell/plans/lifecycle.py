"""Lifecycle queries: registries, manifests, direct facts, embeddings, compensation, platform lists and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewell.functions import rules as R
from tidewell.functions import vectors as V
from tidewell.operators import lifecycle as L
from tidewell.operators.similar import near_pairs
from tidewell.plans.registry import query, read

c = F.col
MUTABLE = ("superseded_at", "valid_to", "archived", "aliases")


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'old-' || doc_id ELSE substr(sha256('doc:' || doc_id), 1, 16) END AS id FROM documents")
def id_registry(spark: SparkSession, d: str) -> DataFrame:
    """Registered ids stay; new keys get one that is computed, so that tasks need no counter."""
    docs = read(spark, d, "documents").select("doc_id")
    known = docs.filter("doc_id % 2 = 0").select(c("doc_id").alias("k"), F.concat(F.lit("old-"), "doc_id").alias("id"))
    fresh = F.substring(F.sha2(F.concat(F.lit("doc:"), "doc_id"), 256), 1, 16)
    return docs.join(known, c("doc_id") == c("k"), "left").select("doc_id", F.coalesce("id", fresh).alias("id"))


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'insert' WHEN 1 THEN 'same' WHEN 2 THEN 'merge' ELSE 'conflict' END AS verdict, CASE event_id % 4 WHEN 0 THEN 2 WHEN 1 THEN 2 WHEN 2 THEN 4 END::INT AS properties FROM events""")
def manifest_merge(spark: SparkSession, d: str) -> DataFrame:
    """A second plan of the same node: new keys and the mutable ones merge, another change is a conflict."""
    e, k = read(spark, d, "events"), c("event_id")
    text = F.lit("text"), c("event_type")
    stored = e.filter("event_id % 4 <> 0").select(k.alias("key"), F.create_map(*text, F.lit("valid_to"), F.lit("9")).alias("stored"))
    same = F.create_map(*text, F.lit("valid_to"), F.lit("9"))
    more = F.create_map(F.lit("valid_to"), F.lit("5"), F.lit("archived"), F.lit("true"), F.lit("score"), c("props"))
    other = F.create_map(F.lit("text"), F.concat("event_type", F.lit("!")))
    incoming = e.select(k.alias("key"), F.when(k % 4 == 2, more).when(k % 4 == 3, other).otherwise(same).alias("incoming"))
    return L.manifest_merge(incoming, stored, "key", MUTABLE).select(c("key").alias("event_id"), "verdict", F.size("merged").alias("properties")).withColumn("properties", F.when(c("properties") >= 0, c("properties")))


@query("""WITH f AS (SELECT event_id, user_id, event_type, value, row_number() OVER w AS n, lead(ts) OVER w AS valid_to FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id))
SELECT 'fact:direct:' || substr(sha256(concat_ws(chr(31), user_id, event_type, value) || CASE WHEN n > 1 THEN chr(31) || event_id ELSE '' END), 1, 24) AS key, event_id, valid_to, CASE WHEN n > 1 THEN 'superseding' ELSE 'first' END AS kind FROM f""")
def direct_facts(spark: SparkSession, d: str) -> DataFrame:
    """Authored facts: the key is a hash of the content, with salt where it supersedes; the prior one closes when it begins."""
    rows = read(spark, d, "events").select("event_id", "user_id", "event_type", "value", c("ts").alias("valid_from"))
    return L.direct_facts(rows, ["user_id", "event_type"], "value", "valid_from", "event_id").select("key", "event_id", "valid_to", "kind")


@query("SELECT 'entity:user:' || user_id AS id, count(*) AS facts FROM events GROUP BY user_id UNION ALL SELECT 'entity:type:' || event_type, count(*) FROM events GROUP BY event_type")
def direct_fact_stubs(spark: SparkSession, d: str) -> DataFrame:
    """Entities that authored facts name, each once, with the number of facts."""
    e = read(spark, d, "events")
    ends = e.select(F.explode(F.array(F.concat(F.lit("entity:user:"), "user_id"), F.concat(F.lit("entity:type:"), "event_type"))).alias("id"))
    return ends.groupBy("id").agg(F.count("*").alias("facts"))


@query("SELECT event_id, user_id || ' ' || replace(event_type, '_', ' ') || ' ' || value::VARCHAR AS text, 'chunk:direct:' || event_id AS chunk_id FROM (SELECT event_id, user_id, event_type, (value * 100)::BIGINT AS value FROM events)")
def fact_projection(spark: SparkSession, d: str) -> DataFrame:
    """Authored facts as rows of the search index, each with a chunk of its own to stand for its source."""
    text = F.concat_ws(" ", "user_id", F.replace("event_type", F.lit("_"), F.lit(" ")), F.round(c("value") * 100).cast("long"))
    return read(spark, d, "events").select("event_id", text.alias("text"), F.concat(F.lit("chunk:direct:"), "event_id").alias("chunk_id"))


@query("SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN 'insert' WHEN label = 4 THEN 'conflict' ELSE 'kept' END AS verdict FROM embeddings")
def embed_upsert(spark: SparkSession, d: str) -> DataFrame:
    """A vector is stored once for each item and model; another text under the same key is a conflict."""
    e = read(spark, d, "embeddings")
    digest = F.sha2(F.concat_ws("|", "vec_id", "label"), 256)
    stored = e.filter("vec_id % 3 <> 0").select("vec_id", F.when(c("label") == 4, "other").otherwise(digest).alias("digest"))
    found = L.classify_upsert(e.select("vec_id", digest.alias("digest")), stored, "vec_id", "digest")
    return found.select("vec_id", F.when(c("status") == "new", "insert").when(c("status") == "replay", "kept").otherwise("conflict").alias("verdict"))


@query("""WITH e AS (SELECT *, lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS prior FROM events), g AS (SELECT user_id, bool_and(value > 1) AS fine FROM events GROUP BY 1)
SELECT event_id, NOT fine AS archived, CASE WHEN fine THEN lead_id END AS superseded_by FROM (SELECT *, lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS lead_id FROM e) JOIN g USING (user_id)""")
def compensate(spark: SparkSession, d: str) -> DataFrame:
    """Groups whose writes don't verify: what they wrote is archived, what it superseded is open again."""
    e = read(spark, d, "events")
    later = F.lead("event_id").over(Window.partitionBy("user_id").orderBy("event_id"))
    groups = e.groupBy("user_id").agg(F.bool_and(c("value") > 1).alias("fine"))
    rows = e.select("event_id", "user_id", later.alias("later")).join(groups, "user_id")
    return rows.select("event_id", (~c("fine")).alias("archived"), F.when(c("fine"), c("later")).alias("superseded_by"))


@query("""WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings)
SELECT a.vec_id AS fresh, b.vec_id AS prior FROM v a JOIN v b USING (label) WHERE a.vec_id % 20 = 0 AND b.vec_id < a.vec_id AND round(list_inner_product(a.e, b.e), 6) >= 0.15""")
def supersession_prefilter(spark: SparkSession, d: str) -> DataFrame:
    """Prior facts of the same subject that are near enough to a fresh one to be asked about: a dot product of 0.15."""
    v = read(spark, d, "embeddings").select(c("vec_id").alias("id"), c("label").alias("context"), V.doubles(c("embedding")).alias("v"))
    near = near_pairs(v.filter("id % 20 = 0"), v, 0.15, 64, plain=True).filter("id < question")
    return near.select(c("question").alias("fresh"), c("id").alias("prior"))


@query("""WITH f AS (SELECT event_id, user_id, event_type, ts, value, event_id % 4 = 0 AS gone FROM events), n AS (SELECT * FROM f WHERE event_id % 10 = 0)
SELECT n.event_id AS fresh, count(p.event_id) AS existing FROM n LEFT JOIN f p ON p.user_id = n.user_id AND p.event_type = n.event_type AND NOT p.gone AND p.event_id <> n.event_id AND p.ts < n.ts GROUP BY 1""")
def existing_facts(spark: SparkSession, d: str) -> DataFrame:
    """Current facts of the same subject and predicate that were there before: what a fresh fact may supersede."""
    f = read(spark, d, "events").select("event_id", "user_id", "event_type", "ts")
    old = f.filter("event_id % 4 <> 0").select(c("event_id").alias("prior"), "user_id", "event_type", c("ts").alias("at"))
    rows = f.filter("event_id % 10 = 0").join(old, ["user_id", "event_type"], "left")
    before = (c("prior") != c("event_id")) & (c("at") < c("ts"))
    return rows.groupBy(c("event_id").alias("fresh")).agg(F.count_if(before).alias("existing"))


@query("""SELECT c_custkey, 'has_segment' AS predicate, c_mktsegment AS object FROM customer WHERE c_mktsegment <> 'MACHINERY' UNION ALL SELECT c_custkey, 'comes_from', c_nationkey::VARCHAR || ', old' FROM customer WHERE c_custkey % 3 = 0""")
def setup_facts(spark: SparkSession, d: str) -> DataFrame:
    """Filled choices become facts, but for the field of the name; lists are written with commas."""
    schema = [("name", None), ("segment", None), ("nation", "comes_from"), ("pet", None)]
    values = F.create_map(
        F.lit("name"), F.array("c_name"), F.lit("segment"), F.array(F.when(c("c_mktsegment") != "MACHINERY", c("c_mktsegment")).otherwise("")),
        F.lit("nation"), F.when(c("c_custkey") % 3 == 0, F.array(c("c_nationkey").cast("string"), F.lit("old"))).otherwise(F.array().cast("array<string>")),
    )
    table = F.array(*(F.struct(F.lit(k).alias("key"), F.lit(p or f"has_{k}").alias("predicate")) for k, p in schema))
    rows = read(spark, d, "customer").select("c_custkey", values.alias("v"), F.explode(table).alias("f")).filter("f.key <> 'name'")
    object_ = F.array_join(F.try_element_at("v", c("f.key")), ", ")
    return rows.select("c_custkey", "f.predicate", object_.alias("object")).filter("object <> ''")


@query("""SELECT p_partkey, CASE WHEN p_type NOT IN ('ECONOMY', 'STANDARD', 'PROMO') THEN 'content tag' WHEN n > 0 AND NOT pinned THEN 'no start' END AS error
FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n, bool_or(l_linenumber = 1) AS pinned FROM lineitem GROUP BY 1) ON l_partkey = p_partkey""")
def dq_publish_gate(spark: SparkSession, d: str) -> DataFrame:
    """A scenario goes out with an allowed tag, and with a start if it has maps."""
    pins = read(spark, d, "lineitem").groupBy("l_partkey").agg(F.bool_or(c("l_linenumber") == 1).alias("pinned"))
    rows = read(spark, d, "part").join(pins, c("l_partkey") == c("p_partkey"), "left")
    return rows.select("p_partkey", R.first_error((c("p_type").isin("ECONOMY", "STANDARD", "PROMO"), "content tag"), (F.coalesce("pinned", F.lit(True)), "no start")).alias("error"))


@query("SELECT conv_id, turn FROM conversations WHERE turn <= 3")
def rollback_buffer(spark: SparkSession, d: str) -> DataFrame:
    """Turns after the save point leave the buffer."""
    return read(spark, d, "conversations").filter("turn <= 3").select("conv_id", "turn")


@query("SELECT l_orderkey, l_linenumber, o_custkey, c_name FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey WHERE l_returnflag = 'R'")
def lineage_join(spark: SparkSession, d: str) -> DataFrame:
    """Candidate to attempt to chunk."""
    rows = read(spark, d, "lineitem").filter("l_returnflag = 'R'").join(read(spark, d, "orders"), c("o_orderkey") == c("l_orderkey"))
    return rows.join(read(spark, d, "customer"), c("c_custkey") == c("o_custkey")).select("l_orderkey", "l_linenumber", "o_custkey", "c_name")


@query("""WITH k AS (SELECT DISTINCT json_extract_string(props, '$.k')::BIGINT AS k FROM events WHERE event_id % 50 = 0 UNION SELECT 7 UNION SELECT 9)
SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey IN (SELECT k FROM k) OR l_suppkey IN (SELECT k FROM k)""")
def on_scene_semi(spark: SparkSession, d: str) -> DataFrame:
    """Facts whose subject or object is a known entity, or one that the state names anywhere."""
    state = F.concat(F.lit('{"deep": [{"ref": '), F.get_json_object("props", "$.k"), F.lit("}]}"))
    refs = F.explode(F.regexp_extract_all(state, F.lit(r'"ref": ?(\d+)'), F.lit(1))).alias("ref")
    refs = read(spark, d, "events").filter("event_id % 50 = 0").select(refs).select(c("ref").cast("long").alias("k"))
    known = refs.unionByName(spark.createDataFrame([(7,), (9,)], "k long")).distinct()
    subject, object_ = known.withColumnRenamed("k", "s"), known.withColumnRenamed("k", "o")
    rows = read(spark, d, "lineitem").join(subject, c("s") == c("l_partkey"), "left").join(object_, c("o") == c("l_suppkey"), "left")
    return rows.filter("s is not null or o is not null").select("l_orderkey", "l_linenumber")


@query("""SELECT user_id, event_id, CASE WHEN event_type IN ('view', 'click') THEN event_type ELSE 'view' END AS map FROM events""")
def active_map(spark: SparkSession, d: str) -> DataFrame:
    """The first map with a pin for the current place, else the first map."""
    maps = spark.createDataFrame([(1, "view", "view"), (2, "click", "click"), (3, "other", "click")], "at int, map string, place string")
    pins = maps.groupBy("place").agg(F.min_by("map", "at").alias("found"))
    first = maps.agg(F.min_by("map", "at")).first()[0]  # one row
    return read(spark, d, "events").join(F.broadcast(pins), c("place") == c("event_type"), "left").select("user_id", "event_id", F.coalesce("found", F.lit(first)).alias("map"))


@query("SELECT p_partkey, coalesce(n, 0) AS attributes FROM part LEFT JOIN (SELECT l_partkey, count(DISTINCT l_returnflag) AS n FROM lineitem WHERE l_quantity > 40 GROUP BY 1) ON l_partkey = p_partkey")
def entity_live_state(spark: SparkSession, d: str) -> DataFrame:
    """Entities with the attributes they have now, none where there are none."""
    live = read(spark, d, "lineitem").filter("l_quantity > 40").groupBy("l_partkey").agg(F.map_from_entries(F.transform(F.collect_set("l_returnflag"), lambda x: F.struct(x, F.lit(True)))).alias("a"))
    rows = read(spark, d, "part").join(live, c("l_partkey") == c("p_partkey"), "left")
    return rows.select("p_partkey", F.size(F.coalesce("a", F.create_map().cast("map<string,boolean>"))).cast("long").alias("attributes"))


@query("SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'Now' WHEN '5-LOW' THEN 'Later' ELSE o_orderpriority END AS label FROM orders")
def lookup_labels(spark: SparkSession, d: str) -> DataFrame:
    labels = spark.createDataFrame([("1-URGENT", "Now"), ("5-LOW", "Later")], "key string, label string")
    return read(spark, d, "orders").join(F.broadcast(labels), c("key") == c("o_orderpriority"), "left").select("o_orderkey", F.coalesce("label", "o_orderpriority").alias("label"))


@query("""SELECT c_custkey, coalesce(n, 0) AS played, coalesce(won, 0) AS won, coalesce(made, 0) AS made FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS won FROM orders GROUP BY 1) a ON o_custkey = c_custkey
LEFT JOIN (SELECT s_nationkey, count(*) AS made FROM supplier GROUP BY 1) b ON s_nationkey = c_nationkey""")
def user_stats(spark: SparkSession, d: str) -> DataFrame:
    played = read(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.count_if(c("o_orderstatus") == "F").alias("won"))
    made = read(spark, d, "supplier").groupBy("s_nationkey").agg(F.count("*").alias("made"))
    rows = read(spark, d, "customer").join(played, c("o_custkey") == c("c_custkey"), "left").join(made, c("s_nationkey") == c("c_nationkey"), "left")
    zero = lambda x: F.coalesce(x, F.lit(0))
    return rows.select("c_custkey", zero("n").alias("played"), zero("won").alias("won"), zero("made").alias("made"))


@query("""WITH g AS (SELECT event_type, count(*) FILTER (event_id % 3 <> 1) AS old, count(*) FILTER (event_id % 3 <> 2) AS fresh FROM events GROUP BY 1) SELECT bool_and(old = fresh) FILTER (old > 0) AS all_match, count(*) FILTER (old = fresh) AS matching FROM g""")
def reconcile_all_match(spark: SparkSession, d: str) -> DataFrame:
    """Whether every group has as many new rows as old ones, where it has old ones."""
    k = c("event_id") % 3
    groups = read(spark, d, "events").groupBy("event_type").agg(F.count_if(k != 1).alias("old"), F.count_if(k != 2).alias("fresh"))
    same = c("old") == c("fresh")
    return groups.agg(F.bool_and(F.when(c("old") > 0, same)).alias("all_match"), F.count_if(same).alias("matching"))


@query("WITH l AS (SELECT DISTINCT ON (user_id, event_type) user_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events ORDER BY user_id, event_type, ts DESC, event_id DESC) SELECT user_id, sum(k)::BIGINT AS accepted FROM l GROUP BY 1")
def facts_created(spark: SparkSession, d: str) -> DataFrame:
    """Accepted candidates of the latest attempt of each chunk."""
    last = read(spark, d, "events").groupBy("user_id", "event_type").agg(F.max_by(F.get_json_object("props", "$.k").cast("long"), F.struct("ts", "event_id")).alias("k"))
    return last.groupBy("user_id").agg(F.sum("k").alias("accepted"))


@query("SELECT coalesce(o_orderpriority, 'all') AS kind, round(avg(o_totalprice), 4) AS mean, count(*) AS n FROM orders GROUP BY GROUPING SETS ((), (o_orderpriority))")
def eval_by_type(spark: SparkSession, d: str) -> DataFrame:
    """Means of a metric, overall and by type."""
    found = read(spark, d, "orders").rollup("o_orderpriority").agg(F.round(F.avg("o_totalprice"), 4).alias("mean"), F.count("*").alias("n"))
    return found.select(F.coalesce("o_orderpriority", F.lit("all")).alias("kind"), "mean", "n")


@query("SELECT user_id, count(*) AS turns, count(*) FILTER (event_type <> 'error') AS completed, sum(json_extract_string(props, '$.k')::BIGINT)::BIGINT AS accepted, round(sum(value) FILTER (event_type = 'view'), 4) AS stage_seconds, round(sum(value), 4) AS seconds FROM events GROUP BY 1")
def instance_summary(spark: SparkSession, d: str) -> DataFrame:
    kind = c("event_type")
    return read(spark, d, "events").groupBy("user_id").agg(
        F.count("*").alias("turns"), F.count_if(kind != "error").alias("completed"), F.sum(F.get_json_object("props", "$.k").cast("long")).alias("accepted"),
        F.round(F.sum(F.when(kind == "view", c("value"))), 4).alias("stage_seconds"), F.round(F.sum("value"), 4).alias("seconds"),
    )


@query("SELECT user_id, max_by(event_id, (ts, event_id)) AS image FROM events WHERE event_type = 'view' AND value > 5 GROUP BY 1")
def latest_by_location(spark: SparkSession, d: str) -> DataFrame:
    """The latest picture of each place."""
    return read(spark, d, "events").filter("event_type = 'view' and value > 5").groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("image"))


@query("""WITH r AS (SELECT vec_id, label, row_number() OVER (ORDER BY vec_id % 7, vec_id) AS place FROM embeddings), s AS (SELECT label, min(place) AS first_place FROM r GROUP BY 1)
SELECT label, row_number() OVER (ORDER BY first_place) AS rank FROM s""")
def session_order(spark: SparkSession, d: str) -> DataFrame:
    """Sessions in the order in which the ranking first meets them."""
    first = read(spark, d, "embeddings").groupBy("label").agg(F.min(F.struct(c("vec_id") % 7, c("vec_id"))).alias("at"))
    return first.select("label", F.row_number().over(Window.orderBy("at")).cast("long").alias("rank"))  # one row a session


@query("SELECT conv_id, turn FROM conversations WHERE turn >= 2 ORDER BY conv_id, turn LIMIT 50")
def turns_page(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "conversations").filter("turn >= 2").orderBy("conv_id", "turn").limit(50).select("conv_id", "turn")


@query("(SELECT 'display' AS list, p_partkey AS id FROM part ORDER BY p_size, p_partkey LIMIT 10) UNION ALL (SELECT 'recent', o_orderkey FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 10)")
def list_ordered(spark: SparkSession, d: str) -> DataFrame:
    """The first of two lists: by place on display, by date from the latest."""
    a = read(spark, d, "part").orderBy("p_size", "p_partkey").limit(10).select(F.lit("display").alias("list"), c("p_partkey").alias("id"))
    return a.unionByName(read(spark, d, "orders").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(10).select(F.lit("recent").alias("list"), c("o_orderkey").alias("id")))


@query("SELECT user_id, list_sort(list(DISTINCT p)) AS paths FROM (SELECT user_id, unnest(['k', event_type || '.n', CASE WHEN value > 50 THEN 'stats.hp' END]) AS p FROM events) WHERE p IS NOT NULL GROUP BY 1")
def changed_paths(spark: SparkSession, d: str) -> DataFrame:
    """All paths that effects and calls of a user changed."""
    effects = F.filter(F.array(F.lit("k"), F.when(c("value") > 50, "stats.hp")), lambda p: p.isNotNull())
    both = F.array_union(effects, F.array(F.concat("event_type", F.lit(".n"))))
    return read(spark, d, "events").select("user_id", F.explode(both).alias("p")).groupBy("user_id").agg(F.sort_array(F.collect_set("p")).alias("paths"))


@query("SELECT o_orderkey FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_custkey % 5 <> 0 WHERE c_custkey IS NULL OR c_acctbal > 0")
def fail_open_prune(spark: SparkSession, d: str) -> DataFrame:
    """Candidates whose metadata holds, and those whose metadata can't be read."""
    meta = read(spark, d, "customer").filter("c_custkey % 5 <> 0").select("c_custkey", "c_acctbal")
    return read(spark, d, "orders").join(meta, c("c_custkey") == c("o_custkey"), "left").filter("c_custkey is null or c_acctbal > 0").select("o_orderkey")


@query("SELECT conv_id, turn, CASE WHEN turn % 2 = 0 AND conv_id % 3 = 0 THEN 'override ' || conv_id ELSE role END AS line FROM conversations")
def checkpoint_override(spark: SparkSession, d: str) -> DataFrame:
    """A checkpoint's text takes the place of a field, unless it is empty."""
    rows = read(spark, d, "conversations").select("conv_id", "turn", "role")
    texts = rows.select(c("conv_id").alias("k")).distinct().withColumn("text", F.when(c("k") % 3 == 0, F.concat(F.lit("override "), "k")).when(c("k") % 3 == 1, ""))
    found = rows.join(texts, (c("k") == c("conv_id")) & (c("turn") % 2 == 0), "left")
    return found.select("conv_id", "turn", F.coalesce(F.nullif("text", F.lit("")), "role").alias("line"))


@query("SELECT id, max(v) AS version, count(*) > 1 AND NOT (count(*) FILTER (v = 1) = 0) AS merged FROM (SELECT 'n' || event_id AS id, 1 AS v FROM events WHERE event_id % 3 <> 0 UNION ALL SELECT 'n' || event_id, 2 FROM events WHERE event_id % 2 = 0) GROUP BY 1")
def sink_graph_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Nodes merged by id into those that are stored: new ones come in, known ones take the new properties."""
    e = read(spark, d, "events").select(F.concat(F.lit("n"), "event_id").alias("id"), "event_id")
    old, new = e.filter("event_id % 3 <> 0").select("id", F.lit(1).alias("a")), e.filter("event_id % 2 = 0").select("id", F.lit(2).alias("b"))
    return old.join(new, "id", "full_outer").select("id", F.coalesce("b", "a").alias("version"), (c("a").isNotNull() & c("b").isNotNull()).alias("merged"))


@query("SELECT user_id, list(event_id ORDER BY ts, event_id) AS steps FROM events GROUP BY 1")
def src_replay_fixture(spark: SparkSession, d: str) -> DataFrame:
    """The steps of each correlation in the order of time."""
    steps = F.sort_array(F.collect_list(F.struct("ts", "event_id")))
    return read(spark, d, "events").groupBy("user_id").agg(F.transform(steps, lambda s: s["event_id"]).alias("steps"))


@query("SELECT event_id, list_sort(['k', CASE WHEN event_id % 2 = 0 THEN 'extra' ELSE 'more' END]) AS fields FROM events")
def src_log_fields(spark: SparkSession, d: str) -> DataFrame:
    """Fields of client logs without the reserved ones."""
    reserved = F.array(*map(F.lit, ("level", "event", "timestamp")))
    own = F.when(c("event_id") % 2 == 0, "extra").otherwise("more")
    fields = F.create_map(F.lit("k"), c("props"), F.lit("level"), F.lit("info"), own, F.lit("1"), F.lit("event"), c("event_type"))
    return read(spark, d, "events").select("event_id", F.sort_array(F.map_keys(F.map_filter(fields, lambda k, _: ~F.array_contains(reserved, k)))).alias("fields"))
