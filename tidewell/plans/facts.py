"""Fact queries over events read as facts: subject user_id, predicate event_type, observed at ts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewell.operators import lifecycle as L
from tidewell.operators import temporal as T
from tidewell.plans.registry import query, read

c = F.col
NOW = 1_705_312_800  # 2024-01-15 10:00 UTC, the time of the questions below


def facts(spark: SparkSession, d: str) -> DataFrame:
    """Events as bitemporal facts in seconds; bounds are null for some, as open ends are."""
    rows = read(spark, d, "events").withColumn("observed_at", F.floor(F.unix_micros(c("ts").cast("timestamp")) / 1_000_000))
    k, at = c("event_id"), c("observed_at")
    return rows.select(
        k.alias("fact_id"), "user_id", "event_type", "value", "observed_at", (k % 17 == 0).alias("archived"),
        F.when(k % 11 != 0, at - (k % 5) * T.DAY).alias("valid_from"), F.when(k % 3 != 0, at + (k % 7) * T.DAY).alias("valid_to"),
        F.when(k % 4 == 0, at + (k % 13) * 3600).alias("superseded_at"),
    )


FACTS = """facts AS (SELECT event_id AS fact_id, user_id, event_type, value, floor(epoch_us(ts) / 1000000)::BIGINT AS observed_at, event_id % 17 = 0 AS archived,
CASE WHEN event_id % 11 <> 0 THEN floor(epoch_us(ts) / 1000000)::BIGINT - (event_id % 5) * 86400 END AS valid_from,
CASE WHEN event_id % 3 <> 0 THEN floor(epoch_us(ts) / 1000000)::BIGINT + (event_id % 7) * 86400 END AS valid_to,
CASE WHEN event_id % 4 = 0 THEN floor(epoch_us(ts) / 1000000)::BIGINT + (event_id % 13) * 3600 END AS superseded_at FROM events)"""


@query(f"""WITH {FACTS} SELECT fact_id, user_id FROM facts WHERE NOT archived AND coalesce(valid_from <= {NOW}, true) AND coalesce(valid_to >= {NOW}, true)
AND observed_at < (floor({NOW} / 86400) + 1) * 86400 AND coalesce(superseded_at >= {NOW}, true)""")
def bitemporal_asof(spark: SparkSession, d: str) -> DataFrame:
    now = F.lit(NOW)
    return facts(spark, d).filter(T.visible(now, now, now)).select("fact_id", "user_id")


@query(f"""WITH {FACTS} SELECT fact_id, CASE WHEN valid_from IS NULL AND valid_to IS NULL THEN {NOW} ELSE valid_from END AS start_, coalesce(valid_to, {NOW})::BIGINT AS end_ FROM facts""")
def temporal_window_resolve(spark: SparkSession, d: str) -> DataFrame:
    start, end = T.window(c("valid_from"), c("valid_to"), F.lit(NOW).cast("long"))
    return facts(spark, d).select("fact_id", start.alias("start_"), end.alias("end_"))


@query(f"WITH {FACTS} SELECT fact_id FROM facts WHERE NOT (event_type = 'click' AND observed_at < {NOW} - 86400)")
def filter_chat_ttl(spark: SparkSession, d: str) -> DataFrame:
    return facts(spark, d).filter(~((c("event_type") == "click") & (c("observed_at") < NOW - T.DAY))).select("fact_id")


@query("SELECT o_orderkey FROM orders WHERE coalesce(list_position(['1-URGENT', '2-HIGH', '3-MEDIUM'], o_orderpriority) <= 2, true)")
def filter_checkpoint_gate(spark: SparkSession, d: str) -> DataFrame:
    """Checkpoints in their order; the question is asked at the second. Unknown ones of a fact leave it open."""
    at = F.nullif(F.array_position(F.array(*map(F.lit, ("1-URGENT", "2-HIGH", "3-MEDIUM"))), c("o_orderpriority")), F.lit(0))
    return read(spark, d, "orders").filter(T.holds(at <= 2)).select("o_orderkey")


@query("SELECT event_id FROM events WHERE coalesce(nullif(user_id % 5, 0) = 3, true)")
def filter_participant(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").filter(T.holds(F.nullif(c("user_id") % 5, F.lit(0)) == 3)).select("event_id")


@query("SELECT conv_id, turn FROM conversations WHERE coalesce(nullif(turn, 0) <= 3, true)")
def filter_as_of_turn(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "conversations").filter(T.holds(F.nullif(c("turn"), F.lit(0)) <= 3)).select("conv_id", "turn")


@query("SELECT doc_id FROM labels WHERE toxic = 0 OR doc_id IN (SELECT item_id FROM benchmark)")
def filter_hidden_revealed(spark: SparkSession, d: str) -> DataFrame:
    revealed = read(spark, d, "benchmark").select(c("item_id").alias("r")).distinct()
    return read(spark, d, "labels").join(revealed, c("doc_id") == c("r"), "left").filter((c("toxic") == 0) | c("r").isNotNull()).select("doc_id")


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_partkey = 77 OR l_suppkey = 77")
def filter_either_endpoint(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "lineitem").filter((c("l_partkey") == 77) | (c("l_suppkey") == 77)).select("l_orderkey", "l_linenumber", "l_partkey")


@query("SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AND doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def filter_key_set(spark: SparkSession, d: str) -> DataFrame:
    labels = read(spark, d, "labels")
    rows = read(spark, d, "documents").select("doc_id", "source").join(labels.filter("quality = 1"), "doc_id", "left_semi")
    return rows.join(labels.filter("toxic = 1"), "doc_id", "left_anti")


@query(f"""WITH {FACTS} SELECT fact_id, coalesce(nullif(CASE WHEN fact_id % 5 = 0 THEN '' ELSE user_id::VARCHAR END, ''), 'unknown') AS subject,
coalesce(CASE WHEN fact_id % 3 = 0 THEN event_type END, 'related_to') AS predicate, CASE WHEN valid_to IS NULL THEN NULL ELSE valid_to END AS valid_to FROM facts""")
def project_fact_triple(spark: SparkSession, d: str) -> DataFrame:
    k = c("fact_id")
    subject = F.coalesce(F.nullif(F.when(k % 5 == 0, "").otherwise(c("user_id").cast("string")), F.lit("")), F.lit("unknown"))
    return facts(spark, d).select("fact_id", subject.alias("subject"), F.coalesce(F.when(k % 3 == 0, c("event_type")), F.lit("related_to")).alias("predicate"), "valid_to")


@query(f"""WITH {FACTS} SELECT fact_id, CASE WHEN fact_id % 4 = 0 THEN NULL ELSE strftime(make_timestamp(observed_at * 1000000), '%Y-%m-%dT%H:%M:%S') END AS iso FROM facts""")
def project_sentinel(spark: SparkSession, d: str) -> DataFrame:
    """Epoch 0 and the open end are written as null, other times in ISO form."""
    at = F.when(c("fact_id") % 4 == 0, F.when(c("fact_id") % 8 == 0, 0).otherwise(T.OPEN)).otherwise(c("observed_at"))
    iso = F.when(~at.isin(0, T.OPEN), F.date_format(F.timestamp_seconds(at), "yyyy-MM-dd'T'HH:mm:ss"))
    return facts(spark, d).select("fact_id", iso.alias("iso"))


@query(f"""WITH {FACTS} SELECT fact_id, (SELECT min(b.observed_at) FROM facts b WHERE b.user_id = a.user_id AND b.event_type = a.event_type AND b.observed_at > a.observed_at) AS superseded_at FROM facts a""")
def supersession_lead(spark: SparkSession, d: str) -> DataFrame:
    rows = facts(spark, d).drop("superseded_at")
    return T.superseded(rows, ["user_id", "event_type"], "observed_at", "fact_id").select("fact_id", "superseded_at")


@query("""WITH f AS (SELECT event_id, user_id, event_type, ts, value, lag(ts) OVER w AS prior_ts, lag(event_id) OVER w AS prior_id FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id))
SELECT event_id, prior_id, CASE WHEN value > 60 THEN 'state_change' WHEN value > 20 THEN 'correction' ELSE 'none' END AS relation, CASE WHEN value > 20 THEN ts END AS prior_superseded_at,
CASE WHEN value > 60 THEN ts END AS prior_valid_to FROM f WHERE prior_id IS NOT NULL AND ts > prior_ts""")
def supersession_apply(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    rows = read(spark, d, "events").withColumn("prior_id", F.lag("event_id").over(w)).withColumn("prior_ts", F.lag("ts").over(w)).filter("prior_id is not null and ts > prior_ts")
    relation = F.when(c("value") > 60, "state_change").when(c("value") > 20, "correction").otherwise("none")
    return rows.select("event_id", "prior_id", relation.alias("relation"), F.when(c("value") > 20, c("ts")).alias("prior_superseded_at"), F.when(c("value") > 60, c("ts")).alias("prior_valid_to"))


@query(f"WITH {FACTS} SELECT fact_id, observed_at > {NOW} AS archived_now, CASE WHEN superseded_at <= {NOW} THEN superseded_at END AS superseded_after FROM facts")
def rollback_apply(spark: SparkSession, d: str) -> DataFrame:
    return T.rolled_back(facts(spark, d), F.lit(NOW)).select("fact_id", "archived_now", "superseded_after")


@query("""WITH RECURSIVE chain(node, prior) AS (SELECT event_id, event_id - 7 FROM events WHERE event_id >= 7 AND event_id % 5 <> 0
UNION ALL SELECT node, prior - 7 FROM chain WHERE prior >= 7 AND prior % 5 <> 0) SELECT node, max(prior) AS ancestor FROM chain WHERE prior % 5 = 0 GROUP BY 1""")
def rollback_restore(spark: SparkSession, d: str) -> DataFrame:
    """Each fact supersedes the one seven before; those not divisible by five are archived."""
    e = read(spark, d, "events").select("event_id")
    links = e.filter("event_id >= 7").select(c("event_id").alias("node"), (c("event_id") - 7).alias("prior"))
    _checkpoints(spark)
    return L.live_ancestors(links, e.filter("event_id % 5 <> 0").select(c("event_id").alias("node")))


def _checkpoints(spark: SparkSession) -> None:
    if spark.sparkContext.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(folder)


@query("""WITH a AS (SELECT event_id, user_id, (epoch_us(ts) // 1000000)::BIGINT AS lo, (epoch_us(ts) // 1000000)::BIGINT + 3600 AS hi, event_type FROM events)
SELECT x.event_id AS a_id, y.event_id AS b_id FROM a x JOIN a y USING (user_id) WHERE x.event_type = 'error' AND y.event_type = 'click' AND x.lo <= y.hi AND x.hi >= y.lo""")
def interval_overlap_join(spark: SparkSession, d: str) -> DataFrame:
    low = F.floor(F.unix_micros(c("ts").cast("timestamp")) / 1_000_000)
    side = lambda kind, p: read(spark, d, "events").filter(c("event_type") == kind).select("user_id", c("event_id").alias(f"{p}_id"), low.alias(f"{p}_low"), (low + 3600).alias(f"{p}_high"))
    return T.interval_join(side("error", "a"), side("click", "b"), "user_id", 7200).select("a_id", "b_id")


@query("""SELECT user_id, min(ts) AS superseded_at, min(value) AS valid_to, max_by(event_type, (event_id)) AS last_type FROM events GROUP BY 1""")
def merge_min_temporal(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "events").select("user_id", "event_id", c("ts").alias("superseded_at"), c("value").alias("valid_to"), c("event_type").alias("last_type"))
    return L.merge_conservative(rows, "user_id", ["superseded_at", "valid_to"], ["last_type"], "event_id")


@query("SELECT DISTINCT ON (user_id, event_type) user_id, event_type, event_id, value FROM events ORDER BY user_id, event_type, ts DESC, event_id DESC")
def latest_per_key(spark: SparkSession, d: str) -> DataFrame:
    return L.latest(read(spark, d, "events"), ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_type", "event_id", "value")


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'new' WHEN doc_id % 3 = 1 THEN 'replay' ELSE 'conflict' END AS status FROM documents""")
def upsert_classify(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"))
    stored = docs.filter("doc_id % 3 <> 0").select("doc_id", F.when(c("doc_id") % 3 == 1, c("digest")).otherwise("other").alias("digest"))
    return L.classify_upsert(docs, stored, "doc_id", "digest").select("doc_id", "status")


@query("""SELECT DISTINCT ON (user_id, event_type) user_id, event_type, value FROM (SELECT *, 1 AS v FROM events WHERE event_id % 2 = 0 UNION ALL SELECT *, 2 FROM events WHERE event_id % 2 = 1)
ORDER BY user_id, event_type, v DESC, event_id DESC""")
def upsert_latest(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events")
    part = lambda v: e.filter(c("event_id") % 2 == v - 1).withColumn("v", F.lit(v))
    return L.upsert(part(1), part(2), ["user_id", "event_type"], [F.desc("v"), F.desc("event_id")]).select("user_id", "event_type", "value")


@query("""SELECT doc_id, CASE WHEN n_chars = 0 THEN 'empty_text' WHEN doc_id % 10 = 0 THEN 'unknown_record' WHEN NOT coalesce(doc_id % 7 / 6.0 BETWEEN 0.2 AND 1, false) THEN 'low_confidence' END AS reason,
CASE WHEN doc_id % 2 = 0 THEN 'session' ELSE 'chat' END AS scope FROM documents""")
def validate_candidates(spark: SparkSession, d: str) -> DataFrame:
    from tidewell.functions.rules import first_error

    k = c("doc_id")
    reason = first_error((c("n_chars") > 0, "empty_text"), (k % 10 != 0, "unknown_record"), ((k % 7 / 6.0).between(0.2, 1), "low_confidence"))
    return read(spark, d, "documents").select("doc_id", reason.alias("reason"), F.when(k % 2 == 0, "session").otherwise("chat").alias("scope"))


@query("""SELECT user_id, event_id, event_type, prior, coalesce((prior, event_type) IN (('signup', 'view'), ('view', 'click'), ('click', 'purchase'), ('error', 'view')), false) AS legal
FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prior FROM events)""")
def job_transitions(spark: SparkSession, d: str) -> DataFrame:
    """Each change of a job's state against the table of legal ones."""
    legal = spark.createDataFrame([("signup", "view"), ("view", "click"), ("click", "purchase"), ("error", "view")], "a string, b string")
    rows = read(spark, d, "events").withColumn("prior", F.lag("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    rows = rows.join(F.broadcast(legal), (c("prior") == c("a")) & (c("event_type") == c("b")), "left")
    return rows.select("user_id", "event_id", "event_type", "prior", c("a").isNotNull().alias("legal"))


@query("""SELECT user_id, event_id, value - coalesce(lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id), 0) AS delta FROM events""")
def stat_delta_lag(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return read(spark, d, "events").select("user_id", "event_id", (c("value") - F.coalesce(F.lag("value").over(w), F.lit(0.0))).alias("delta"))


@query("""SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n <= 6""")
def last_n_turns(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return read(spark, d, "conversations").withColumn("n", F.row_number().over(w)).filter("n <= 6").select("conv_id", "turn", "role")


@query("SELECT turn, min(conv_id) AS conv_id FROM conversations GROUP BY 1")
def dedupe_turns(spark: SparkSession, d: str) -> DataFrame:
    """Groups in order, and of each turn number the first group's row."""
    return read(spark, d, "conversations").groupBy("turn").agg(F.min("conv_id").alias("conv_id"))


@query("SELECT 'conv:' || conv_id || ':turn:' || turn AS record_id, conv_id, turn, role, make_timestamp(turn * 1000000) AS occurred_at FROM conversations")
def src_turn_batch(spark: SparkSession, d: str) -> DataFrame:
    from tidewell.sources.chat import turn_records

    return turn_records(read(spark, d, "conversations")).drop("content")


@query("SELECT conv_id, turn, role, length(text) AS n FROM conversations WHERE text <> ''")
def src_explode_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Conversations nested into one row a session and taken apart again; empty turns go."""
    from tidewell.sources.chat import exploded_sessions

    nested = read(spark, d, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    return exploded_sessions(nested).select("conv_id", "turn", "role", F.length("text").cast("long").alias("n"))


@query("""SELECT 'session' AS kind, 'session:' || conv_id AS id FROM conversations GROUP BY ALL UNION ALL SELECT 'turn', 'turn:' || conv_id || ':' || turn FROM conversations
UNION ALL SELECT 'speaker', 'speaker:' || role FROM conversations GROUP BY ALL""")
def graph_build(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "conversations")
    node = lambda kind, *parts: rows.select(F.lit(kind).alias("kind"), F.concat_ws(":", F.lit(kind), *parts).alias("id")).distinct()
    return node("session", "conv_id").unionByName(node("turn", "conv_id", "turn")).unionByName(node("speaker", "role"))
