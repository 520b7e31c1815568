"""Writes that are undone, and ids that are handed out once."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.operators import id_registry as I
from tidewell.operators import undo as U
from tidewell.plans.facts import _checkpoints
from tidewell.plans.registry import query, read

c = F.col
#: Events are writes of a user's value of their type, twenty to a group; a group with a value above 150 fails. Views are stored as 0 before.
WRITES = """e AS (SELECT event_id AS seq, event_id // 20 AS g, user_id || ':' || event_type AS key, value AS v FROM events), bad AS (SELECT DISTINCT g FROM e WHERE v > 150), s AS (SELECT DISTINCT user_id || ':view' AS key, 0.0::DOUBLE AS old FROM events),
w AS (SELECT seq, e.g, key, v, old, bad.g IS NULL AS fine FROM e LEFT JOIN bad USING (g) LEFT JOIN s USING (key)),
log AS (SELECT seq, g, key, fine, v AS after, coalesce(lag(v) OVER (PARTITION BY key, g ORDER BY seq), last_value(CASE WHEN fine THEN v END IGNORE NULLS) OVER (PARTITION BY key ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), old) AS before FROM w)"""


def sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    e = read(spark, d, "events")
    key = lambda kind: F.concat_ws(":", "user_id", kind)
    writes = e.select(c("event_id").alias("seq"), F.floor(c("event_id") / 20).alias("group"), key("event_type").alias("key"), "value")
    stored = e.select(key(F.lit("view")).alias("key")).distinct().withColumn("value", F.lit(0.0))
    return writes, stored, writes.filter("value > 150").select("group")


@query(f'WITH {WRITES} SELECT seq, g AS "group", key, before, after, before IS NOT NULL AS was_there, fine FROM log')
def undo_log(spark: SparkSession, d: str) -> DataFrame:
    """Each write with the value that it replaced, in groups of which many fail."""
    return U.undo_log(*sides(spark, d))


@query(f"""WITH {WRITES} SELECT g AS "group", row_number() OVER (PARTITION BY g ORDER BY seq DESC) AS step, key, CASE WHEN before IS NULL THEN 'remove' ELSE 'restore' END AS action, before AS value FROM log WHERE NOT fine""")
def undo_steps(spark: SparkSession, d: str) -> DataFrame:
    """What undoes the failed groups, the last write first."""
    return U.undo_steps(U.undo_log(*sides(spark, d)))


@query(f"WITH {WRITES}, k AS (SELECT key, arg_max(after, seq) AS v FROM log WHERE fine GROUP BY 1) SELECT key, coalesce(v, old) AS value FROM s FULL JOIN k USING (key)")
def undo_state(spark: SparkSession, d: str) -> DataFrame:
    """What the keys hold after all groups ran and the failed ones were undone."""
    writes, stored, failed = sides(spark, d)
    return U.state_after(U.undo_log(writes, stored, failed), stored)


def _words(df: DataFrame) -> DataFrame:
    return df.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{4,}"), F.lit(0))).alias("key")).distinct()


@query("""WITH w AS (SELECT DISTINCT role, unnest(regexp_extract_all(lower(text), '[a-z]{4,}')) AS key FROM conversations), a AS (SELECT key, row_number() OVER (ORDER BY key) - 1 AS id FROM w WHERE role = 'user'),
b AS (SELECT key, (SELECT count(*) FROM a) + row_number() OVER (ORDER BY key) - 1 AS id FROM w WHERE role = 'assistant' AND key NOT IN (SELECT key FROM a)) SELECT * FROM a UNION ALL SELECT * FROM b""")
def ids_over_feeds(spark: SparkSession, d: str) -> DataFrame:
    """Dense ids of words: users' turns are one feed, the assistant's the next, and the first is sent again at the end."""
    _checkpoints(spark)
    folder = f"{spark.conf.get('spark.checkpoint.dir').rstrip('/')}/ids-{uuid.uuid4().hex}"
    turns = read(spark, d, "conversations")
    for role in ("user", "assistant", "user"):
        I.allocate(_words(turns.filter(c("role") == role)), folder)
    return I.stored_ids(spark, folder)


@query("""WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{4,}')) AS path FROM conversations)
SELECT substr(sha256(path), 1, 4) AS id, min(path) AS least, max(path) AS greatest, count(*) AS paths FROM w GROUP BY 1 HAVING count(*) > 1""")
def id_collisions(spark: SparkSession, d: str) -> DataFrame:
    """Words that share an id of four hexadecimal digits."""
    words = _words(read(spark, d, "conversations")).select(F.substring(F.sha2("key", 256), 1, 4).alias("id"), c("key").alias("path"))
    return I.collisions(words)
