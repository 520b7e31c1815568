"""Queries of sources, outcomes, invariants, versions, rollbacks and nested snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewell.functions import rules as R
from tidewell.functions import text as T
from tidewell.operators import lifecycle as L
from tidewell.functions import variants as V
from tidewell.plans.registry import query, read
from tidewell.sources import chat

c = F.col


@query("""SELECT 'q' || conv_id % 10 AS question_id, 's' || conv_id AS session_id, make_timestamp(2023, 1 + (conv_id % 12)::INT, 1 + (conv_id % 28)::INT, 10, 30, 0) AS occurred_at, turn::INT AS turn, role, length(text) AS n
FROM conversations WHERE text <> ''""")
def src_benchmark_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Benchmark instances, with sessions out of the order of their dates, as one row a turn."""
    turns = read(spark, d, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", c("text").alias("content")))).alias("t"))
    session = F.struct(
        F.concat(F.lit("s"), "conv_id").alias("id"), F.date_format(F.make_timestamp(F.lit(2023), c("conv_id") % 12 + 1, c("conv_id") % 28 + 1, F.lit(10), F.lit(30), F.lit(0)), "yyyy/MM/dd (EEE) HH:mm").alias("date"),
        F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("turns"),
    )
    rows = turns.select(F.concat(F.lit("q"), c("conv_id") % 10).alias("question_id"), session.alias("s")).groupBy("question_id").agg(F.reverse(F.sort_array(F.collect_list("s"))).alias("s"))
    part = lambda name: F.transform("s", lambda x: x[name])
    payloads = rows.select("question_id", part("id").alias("haystack_session_ids"), part("date").alias("haystack_dates"), part("turns").alias("haystack_sessions"))
    found = chat.benchmark_sessions(payloads)
    return found.select("question_id", F.regexp_replace("session_id", "#.*", "").alias("session_id"), c("occurred_at").cast("timestamp_ntz").alias("occurred_at"), c("turn").cast("int").alias("turn"), "role", F.length("content").cast("long").alias("n"))


@query("""SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'no_record_id' WHEN event_id % 7 = 1 THEN 'no_content' WHEN event_id % 7 = 2 THEN 'content_type' WHEN event_id % 7 = 3 THEN 'occurred_at' WHEN event_id % 7 = 4 THEN 'unknown_key' WHEN event_id % 7 = 5 THEN 'repeated_id' END AS reason FROM events""")
def src_contract_batches(spark: SparkSession, d: str) -> DataFrame:
    """JSON records against the contract: required text, type, time with an offset, allowed keys, ids that occur once."""
    k = c("event_id") % 7
    record = F.struct(
        F.when(k != 0, F.concat(F.lit("r"), F.when(k == 5, c("event_id") % 2).otherwise(c("event_id")), F.when(k == 5, "x").otherwise(""))).alias("record_id"), F.when(k == 1, "").otherwise(c("event_type")).alias("content"),
        F.when(k == 2, "text/html").otherwise("text/plain").alias("content_type"), F.when(k == 3, "2024-01-01 10:00").otherwise("2024-01-01T10:00:00Z").alias("occurred_at"), F.when(k == 4, 1).alias("extra"), c("event_id").cast("string").alias("session_id"),
    )
    good, bad = chat.parsed_batches(read(spark, d, "events").select(F.to_json(record).alias("value")))
    good = good.select(c("session_id").cast("long").alias("event_id"), F.lit(None).cast("string").alias("reason"))
    return good.unionByName(bad.select(F.get_json_object("raw", "$.session_id").cast("long").alias("event_id"), "reason"))


@query("SELECT conv_id, turn FROM conversations WHERE role IN ('user', 'assistant') AND trim(text) <> ''")
def src_turn_roles(spark: SparkSession, d: str) -> DataFrame:
    """One record a turn, of users and assistants only."""
    return chat.turn_batches(read(spark, d, "conversations")).select("conv_id", "turn")


@query("SELECT p_partkey, concat_ws(' ', 'Max', upper(p_type[1]) || lower(p_type[2:])) AS label FROM part")
def fn_label(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "part").select("p_partkey", T.label(F.concat(F.lit("max_"), F.lower("p_type"))).alias("label"))


@query("SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS hp, 'BIGINT' AS kind FROM events")
def fn_state_entity(spark: SparkSession, d: str) -> DataFrame:
    """A path whose root is an entity's id lies under entities; the value keeps its type."""
    entity = "123e4567-e89b-12d3-a456-426614174000"
    state = F.concat(F.lit('{"entities": {"' + entity + '": {"hp": '), F.get_json_object("props", "$.k"), F.lit("}}}"))
    x = R.Value.at(state, f"{entity}.hp")
    return read(spark, d, "events").select("event_id", x.number.cast("long").alias("hp"), x.kind.alias("kind"))


@query("""WITH e AS (SELECT *, json_extract_string(props, '$.k')::BIGINT AS k FROM events)
SELECT event_id, CASE WHEN event_type = 'error' THEN 'timeout' WHEN event_type = 'signup' THEN CASE WHEN value > 50 THEN 'win' ELSE 'lose' END WHEN k <= 30 THEN 'poor' WHEN k <= 70 THEN 'fair' ELSE 'great' END AS outcome, true AS pending_cleared FROM e""")
def outcome_resolve(spark: SparkSession, d: str) -> DataFrame:
    """A game's outcome: timed out, won or lost, or by tiers of its score; whatever it is, the state has no pending game afterwards."""
    k = F.get_json_object("props", "$.k").cast("long")
    tiers = [(None, 30, "poor"), (30, 70, "fair"), (70, None, "great")]
    found = R.outcome(timed_out=c("event_type") == "error", binary=c("event_type") == "signup", won=c("value") > 50, score=k, tiers=tiers)
    state = F.to_json(F.struct(F.struct(c("event_id").alias("id")).alias("_pending_minigame"), k.alias("k")))
    after = V.members(R.without_pending(F.parse_json(state)))
    cleared = ~F.map_contains_key(after, F.lit("_pending_minigame")) & F.map_contains_key(after, F.lit("k"))
    return read(spark, d, "events").select("event_id", found.alias("outcome"), cleared.alias("pending_cleared"))


@query("""WITH s AS (SELECT event_id, user_id, event_type, value, json_extract_string(props, '$.k')::BIGINT AS k FROM events)
SELECT event_id, CASE WHEN NOT (k <= 90) THEN 'Too much.' WHEN NOT (event_type <> 'error' OR (user_id % 4 <> 0 AND value > 5)) THEN 'A faulty state needs life.' END AS violated FROM s""")
def invariant_rules(spark: SparkSession, d: str) -> DataFrame:
    """The text of the first rule that the state breaks."""
    from tidewell.plans.rules import states

    rules = [({"field": "k", "op": "<=", "value": 90}, "Too much."), ({"field": "kind", "op": "!=", "value": "error", "OR": {"field": "stats.hp", "op": ">", "value": 5}}, "A faulty state needs life.")]
    return states(spark, d).select("event_id", R.first_error(*((R.compile_rule(t, c("state")), text) for t, text in rules)).alias("violated"))


@query("""SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'no path' WHEN 1 THEN 'system-managed' WHEN 2 THEN 'unknown' WHEN 3 THEN 'derived' ELSE CASE WHEN json_extract_string(props, '$.k')::BIGINT + 5 > 90 THEN 'schema' END END AS error FROM events""")
def mutation_paths(spark: SparkSession, d: str) -> DataFrame:
    """What speaks against a proposed change: no path, a reserved, an unknown or a derived one, a value that doesn't fit."""
    from tidewell.plans.rules import states

    schema = {"k": {"type": "number", "max": 90}, "total": {"type": "number", "derived": True}}
    paths = ["", "discovered_location_ids", "mana", "total", "k"]
    error = F.lit(None).cast("string")
    for i, path in enumerate(paths):
        error = F.when(c("event_id") % 5 == i, R.mutation_error(c("state"), {"path": path, "op": "increment", "value": 5}, schema)).otherwise(error)
    return states(spark, d).select("event_id", error.alias("error"))


@query("SELECT user_id, list(event_type ORDER BY first_id) AS found FROM (SELECT user_id, event_type, min(event_id) AS first_id FROM events WHERE event_type <> 'error' GROUP BY ALL) GROUP BY 1")
def discovery_fold(spark: SparkSession, d: str) -> DataFrame:
    """Places in the order in which each user first came to them."""
    first = read(spark, d, "events").filter("event_type <> 'error'").groupBy("user_id", "event_type").agg(F.min("event_id").alias("at"))
    found = first.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("at", "event_type"))).alias("f"))
    return found.select("user_id", F.transform("f", lambda x: x["event_type"]).alias("found"))


@query("""SELECT doc_id, CASE WHEN quality IS NULL THEN 'new' WHEN coalesce(text, '') = trim(coalesce(text, '')) THEN 'replay' ELSE 'conflict' END AS status FROM documents LEFT JOIN labels USING (doc_id)""")
def upsert_versions(spark: SparkSession, d: str) -> DataFrame:
    """Second versions of the labelled records, without white space at the ends: a conflict where that changes the text."""
    docs = read(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    stored = docs.join(read(spark, d, "labels").select("doc_id"), "doc_id", "left_semi").select("doc_id", F.sha2("text", 256).alias("digest"))
    return L.classify_upsert(docs.select("doc_id", F.sha2(F.trim("text"), 256).alias("digest")), stored, "doc_id", "digest").select("doc_id", "status")


@query("""WITH f AS (SELECT event_id, user_id, event_type, ts, value, lag(event_id) OVER w AS prior, lag(user_id) OVER w AS u, lag(event_type) OVER w AS t, lag(ts) OVER w AS at0, lag(value) OVER w AS v FROM events WINDOW w AS (ORDER BY user_id, event_id))
SELECT event_id, prior, CASE WHEN u <> user_id THEN 'other subject' WHEN t <> event_type THEN 'other predicate' WHEN ts <= at0 THEN 'not later' WHEN v = value THEN 'same' ELSE 'asks' END AS gate FROM f WHERE prior IS NOT NULL AND u = user_id""")
def supersession_gate(spark: SparkSession, d: str) -> DataFrame:
    """Whether a fact may supersede the one before: same subject and predicate, later, and not the same again."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    before = lambda x: F.lag(x).over(w)
    rows = read(spark, d, "events").select("event_id", "event_type", "ts", "value", before("event_id").alias("prior"), before("event_type").alias("t"), before("ts").alias("at"), before("value").alias("v")).filter("prior is not null")
    gate = R.first_error((c("t") == c("event_type"), "other predicate"), (c("ts") > c("at"), "not later"), (c("v") != c("value"), "same"))
    return rows.select("event_id", "prior", F.coalesce(gate, F.lit("asks")).alias("gate"))


@query("""SELECT 'fact' AS kind, 'fact:' || event_id AS id, NULL AS other FROM events UNION ALL SELECT DISTINCT 'entity', 'entity:' || user_id, NULL FROM events UNION ALL SELECT DISTINCT 'alias', 'alias:' || user_id || ':' || event_type, NULL FROM events
UNION ALL SELECT 'ABOUT', 'fact:' || event_id, 'entity:' || user_id FROM events UNION ALL SELECT DISTINCT 'HAS_ALIAS', 'entity:' || user_id, 'alias:' || user_id || ':' || event_type FROM events""")
def graph_plan(spark: SparkSession, d: str) -> DataFrame:
    """Nodes and edges of facts, their entities and the names that these went by, each once."""
    e = read(spark, d, "events")
    of = lambda kind, *parts: F.concat_ws(":", F.lit(kind), *parts)
    fact, entity, alias = of("fact", "event_id"), of("entity", "user_id"), of("alias", "user_id", "event_type")
    row = lambda kind, a, b=None: e.select(F.lit(kind).alias("kind"), a.alias("id"), (F.lit(None).cast("string") if b is None else b).alias("other"))
    return row("fact", fact).unionByName(row("entity", entity).distinct()).unionByName(row("alias", alias).distinct()).unionByName(row("ABOUT", fact, entity)).unionByName(row("HAS_ALIAS", entity, alias).distinct())


@query("""WITH f AS (SELECT event_id, event_id % 3 = 0 AS authored, ts AS observed, ts + INTERVAL 1 HOUR AS created, CASE WHEN event_id % 4 = 0 THEN ts + INTERVAL 5 HOUR END AS superseded, ts + INTERVAL 7 DAY AS planned FROM events)
SELECT event_id, CASE WHEN authored THEN created ELSE observed END > TIMESTAMP '2024-01-10' AS archived, CASE WHEN superseded <= TIMESTAMP '2024-01-10' THEN superseded END AS superseded, CASE WHEN superseded <= TIMESTAMP '2024-01-10' THEN superseded WHEN NOT authored THEN planned END AS valid_to FROM f""")
def rollback_values(spark: SparkSession, d: str) -> DataFrame:
    """After a rollback: extracted facts go by when they were observed, authored ones by when they were made; what the gone
    ones had closed is open again, extracted facts up to their own end."""
    k, at = c("event_id"), c("ts").cast("timestamp")
    rows = read(spark, d, "events").select("event_id", (k % 3 == 0).alias("authored"), at.alias("observed"), (at + F.expr("interval 1 hour")).alias("created"), F.when(k % 4 == 0, at + F.expr("interval 5 hour")).alias("superseded"), (at + F.expr("interval 7 day")).alias("planned"))
    cutoff = F.lit("2024-01-10").cast("timestamp")
    gone = F.when(c("authored"), c("created")).otherwise(c("observed")) > cutoff
    closed = F.when(c("superseded") <= cutoff, c("superseded"))
    ntz = lambda x: x.cast("timestamp_ntz")
    return rows.select("event_id", gone.alias("archived"), ntz(closed).alias("superseded"), ntz(F.coalesce(closed, F.when(~c("authored"), c("planned")))).alias("valid_to"))


@query("""SELECT c_custkey, n_name, count(o_orderkey) AS orders, coalesce(sum(n), 0)::BIGINT AS lines, coalesce(max(last), 0)::INT AS last_line FROM customer JOIN nation ON n_nationkey = c_nationkey LEFT JOIN orders ON o_custkey = c_custkey
LEFT JOIN (SELECT l_orderkey, count(*) AS n, max(l_linenumber) AS last FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey GROUP BY 1, 2""")
def snapshot_full(spark: SparkSession, d: str) -> DataFrame:
    """One document a customer: its nation, and its orders with their lines inside; then read back from it."""
    lines = read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("lines"))
    orders = read(spark, d, "orders").join(lines, c("l_orderkey") == c("o_orderkey"), "left")
    orders = orders.groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "lines"))).alias("orders"))
    whole = read(spark, d, "customer").join(F.broadcast(read(spark, d, "nation")), c("n_nationkey") == c("c_nationkey")).join(orders, c("o_custkey") == c("c_custkey"), "left")
    documents = whole.select(F.to_json(F.struct("c_custkey", F.struct("n_name").alias("nation"), F.coalesce("orders", F.array()).alias("orders"))).alias("j"))
    shape = "c_custkey bigint, nation struct<n_name: string>, orders array<struct<o_orderkey: bigint, lines: array<struct<l_linenumber: int, l_partkey: bigint>>>>"
    s = documents.select(F.from_json("j", shape).alias("s")).select("s.*")
    each = F.transform("orders", lambda o: F.coalesce(o["lines"], F.array()))
    return s.select("c_custkey", "nation.n_name", F.size("orders").cast("long").alias("orders"), F.size(F.flatten(each)).cast("long").alias("lines"), F.coalesce(F.array_max(F.transform(F.flatten(each), lambda x: x["l_linenumber"])), F.lit(0)).alias("last_line"))


@query("SELECT vec_id AS id, round(list_cosine_distance(list_transform(embedding, lambda x: x::DOUBLE), (SELECT list_transform(embedding, lambda x: x::DOUBLE) FROM embeddings WHERE vec_id = 0)), 6) AS distance FROM embeddings WHERE vec_id % 3 <> 1 ORDER BY 2, 1 LIMIT 7")
def semantic_of_model(spark: SparkSession, d: str) -> DataFrame:
    """The nearest of the vectors that the question's model made."""
    from tidewell.functions import vectors as V

    e = read(spark, d, "embeddings").withColumn("model", F.when(c("vec_id") % 3 == 1, "v1").otherwise("v2"))
    q = F.array(*(F.lit(float(x)) for x in e.filter("vec_id = 0").first()["embedding"]))
    near = e.filter("model = 'v2'").select(c("vec_id").alias("id"), F.round(1 - V.cosine(V.doubles(c("embedding")), q), 6).alias("distance"))
    return near.orderBy("distance", "id").limit(7)


@query("SELECT event_id, event_type AS prediction, round(value, 3) AS metric FROM events")
def sink_jsonl(spark: SparkSession, d: str) -> DataFrame:
    """Predictions written as JSON Lines in two parts, the second appended, and read again."""
    import uuid

    path = f"{spark.conf.get('spark.checkpoint.dir').rstrip('/')}/jsonl-{uuid.uuid4().hex}"
    rows = read(spark, d, "events").select("event_id", c("event_type").alias("prediction"), F.round("value", 3).alias("metric"))
    chat.write_jsonl(rows.filter("event_id % 2 = 0"), path)
    chat.write_jsonl(rows.filter("event_id % 2 = 1"), path, append=True)
    return chat.read_jsonl(spark, path, rows.schema)
