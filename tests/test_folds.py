from pyspark.sql import functions as F

from tidewell.operators.lifecycle import live_ancestors
from tidewell.sources.chat import benchmark_sessions, parsed_batches
from tidewell.streaming import folds

CALLS = [(u, i, t) for u in (1, 2) for i, t in enumerate((0, 1, 2, 3, 10, 11, 25, 25, 26))]


def test_anchored_limit_counts_denied_calls():
    assert folds.anchored_limit([0, 1, 2, 3, 10, 11], 2, 10)[0] == [True, True, False, False, True, True]
    assert folds.debounced([0, 5, 10, 11], [False, False, False, True], 10)[0] == [True, False, True, True]


def test_stream_equals_batch(spark, tmp_path):
    calls = spark.createDataFrame(CALLS, "user_id long, event_id long, at long")
    batch = sorted(map(tuple, folds.rate_limited(calls, "user_id", "event_id", "at", 2, 10, 3).collect()))
    for n, cut in enumerate((F.col("at") < 5, F.col("at") >= 5)):
        calls.filter(cut).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        source = spark.readStream.schema(calls.schema).parquet(str(tmp_path / "in"))
        out = folds.stream_rate_limited(source, "user_id", "event_id", "at", 2, 10)
        query = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        query.awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == batch


def test_live_ancestors(spark):
    links = spark.createDataFrame([(4, 3), (3, 2), (2, 1), (9, 8)], "node long, prior long")
    spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
    gone = lambda *x: spark.createDataFrame([(i,) for i in x], "node long")
    assert sorted(map(tuple, live_ancestors(links, gone(4, 3, 9, 8)).collect())) == [(3, 2), (4, 2)]
    assert live_ancestors(links, gone(7)).collect() == []


def test_benchmark_sessions(spark):
    turn = "array<struct<role: string, content: string>>"
    rows = [("q1", ["b", "a"], ["2024/01/02 (Tue) 10:00", "2024/01/01 (Mon) 09:30"], [[("user", "x"), ("user", "")], [("user", "y")]]), ("q2", ["a"], [], [])]
    found = benchmark_sessions(spark.createDataFrame(rows, f"question_id string, haystack_session_ids array<string>, haystack_dates array<string>, haystack_sessions array<{turn}>"))
    assert [(r.session_id, str(r.occurred_at), r.content) for r in found.orderBy("occurred_at").collect()] == [("a#1", "2024-01-01 09:30:00", "y"), ("b#0", "2024-01-02 10:00:00", "x")]


def test_contract(spark):
    good = '{"record_id": "r", "content": "c", "content_type": "text/plain", "occurred_at": "2024-01-01T00:00:00Z"}'
    bad = [good.replace('"r"', '""'), good.replace("plain", "html"), good.replace("Z", ""), "not json", good.replace('"c"', '" "')]
    records, rejected = parsed_batches(spark.createDataFrame([(x,) for x in [good, *bad]], "value string"))
    assert records.count() == 1
    assert sorted(r.reason for r in rejected.collect()) == ["content_type", "no_content", "no_record_id", "no_record_id", "occurred_at"]


def test_stream_drops_replays_across_batches(spark, tmp_path):
    records = [("a", 1), ("b", 2), ("a", 3), ("c", 4), ("b", 70), ("z", 100_000), ("a", 100_050)]
    for part in (records[:3], records[2:5], records[5:6], records[6:]):
        rows = spark.createDataFrame(part, "id string, at long").select("id", F.timestamp_seconds("at").alias("ts")).coalesce(1)
        rows.write.mode("append").parquet(str(tmp_path / "in"))
        source = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
        out = folds.stream_deduplicated(source, ["id"], "ts", "1 hour")
        query = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        query.awaitTermination()
    found = sorted((r.id, int(r.at)) for r in spark.read.parquet(str(tmp_path / "out")).select("id", F.unix_timestamp("ts").alias("at")).collect())
    assert found == [("a", 1), ("a", 100_050), ("b", 2), ("c", 4), ("z", 100_000)]
