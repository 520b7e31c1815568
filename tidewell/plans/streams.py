"""Queries of the ordered folds, over events and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.plans.registry import query, read
from tidewell.streaming import folds

c = F.col
DAY_US, MINUTE_US = 86_400_000_000, 60_000_000


def _partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _calls(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").select("user_id", "event_id", F.unix_micros(c("ts").cast("timestamp")).alias("at"), (c("event_type") == "error").alias("forced"))


@query(f"""WITH RECURSIVE o AS (SELECT user_id, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
f(user_id, event_id, n, start_, used) AS (SELECT user_id, event_id, n, t, 1 FROM o WHERE n = 1 UNION ALL
SELECT o.user_id, o.event_id, o.n, CASE WHEN t >= start_ + {DAY_US} THEN t ELSE start_ END, CASE WHEN t >= start_ + {DAY_US} THEN 1 ELSE used + 1 END FROM f JOIN o ON o.user_id = f.user_id AND o.n = f.n + 1)
SELECT user_id, event_id, used <= 3 AS allowed FROM f""")
def rate_limit_fold(spark: SparkSession, d: str) -> DataFrame:
    return folds.rate_limited(_calls(spark, d), "user_id", "event_id", "at", 3, DAY_US, _partitions(spark))


@query(f"""WITH RECURSIVE o AS (SELECT user_id, event_id, epoch_us(ts) AS t, event_type = 'error' AS forced, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
f(user_id, event_id, n, last_, passed) AS (SELECT user_id, event_id, n, t, true FROM o WHERE n = 1 UNION ALL
SELECT o.user_id, o.event_id, o.n, CASE WHEN forced OR t - last_ >= {360 * MINUTE_US} THEN t ELSE last_ END, forced OR t - last_ >= {360 * MINUTE_US} FROM f JOIN o ON o.user_id = f.user_id AND o.n = f.n + 1)
SELECT user_id, event_id, passed FROM f""")
def debounce_fold(spark: SparkSession, d: str) -> DataFrame:
    return folds.debounce(_calls(spark, d), "user_id", "event_id", "at", "forced", 360 * MINUTE_US, _partitions(spark))


@query('SELECT conv_id, (turn // 5)::BIGINT AS "window", min(turn) AS first, max(turn) AS last, count(*) AS n FROM conversations GROUP BY 1, 2 HAVING count(*) = 5')
def count_window_5(spark: SparkSession, d: str) -> DataFrame:
    return folds.count_windows(read(spark, d, "conversations"), "conv_id", "turn", 5)


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Idempotent replay: of records with one deterministic key, one stays."""
    return read(spark, d, "events").select("user_id", "event_type").dropDuplicates(["user_id", "event_type"])


@query("SELECT event_id, ts <= coalesce(max(ts) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), ts - INTERVAL 1 SECOND) AS late FROM events")
def late_guard(spark: SparkSession, d: str) -> DataFrame:
    """In order of arrival: not later than the latest time seen for its key."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, -1)
    return read(spark, d, "events").select("event_id", F.coalesce(c("ts") <= F.max("ts").over(w), F.lit(False)).alias("late"))
