"""Sources of conversational records: turns, nested sessions, JSON batches; JSON Lines sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The shape of a context batch: allowed keys only, times with an offset.
RECORD = T.StructType(
    [
        T.StructField("record_id", T.StringType()), T.StructField("session_id", T.StringType()), T.StructField("actor_id", T.StringType()),
        T.StructField("actor_role", T.StringType()), T.StructField("occurred_at", T.StringType()), T.StructField("content_type", T.StringType()),
        T.StructField("content", T.StringType()), T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
    ]
)
OFFSET_TIME = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})$"


def turn_records(turns: DataFrame) -> DataFrame:
    """turns(conv_id, turn, role, text) as records with ids that a replay gives again; times are the turn in seconds."""
    return turns.select(
        F.concat(F.lit("conv:"), "conv_id", F.lit(":turn:"), "turn").alias("record_id"), "conv_id", "turn", "role",
        F.timestamp_seconds("turn").cast("timestamp_ntz").alias("occurred_at"), F.col("text").alias("content"),
    )


def turn_batches(turns: DataFrame) -> DataFrame:
    """One batch of one record for each turn of a user or an assistant that says something."""
    records = turn_records(turns.filter(F.col("role").isin("user", "assistant") & (F.trim("text") != "")))
    return records.select("conv_id", "turn", F.col("record_id").alias("ingestion_id"), F.array(F.struct("record_id", "role", "occurred_at", "content")).alias("records"))


def exploded_sessions(sessions: DataFrame) -> DataFrame:
    """sessions(conv_id, turns array<struct<turn, role, text>>) -> one row a turn with text."""
    return sessions.select("conv_id", F.explode("turns").alias("t")).select("conv_id", "t.turn", "t.role", "t.text").filter("text <> ''")


def benchmark_sessions(payloads: DataFrame) -> DataFrame:
    """Benchmark instances with parallel arrays of session ids, dates and sessions -> turns in the order of dates.

    Dates are `yyyy/MM/dd (EEE) HH:mm`. Empty turns go; instances whose arrays differ in length give no rows.
    """
    arrays = ("haystack_session_ids", "haystack_dates", "haystack_sessions")
    same = (F.size(arrays[0]) == F.size(arrays[1])) & (F.size(arrays[1]) == F.size(arrays[2]))
    rows = payloads.filter(same).select("question_id", F.posexplode(F.arrays_zip(*arrays)).alias("at", "s"))
    time = F.to_timestamp(F.regexp_replace("s.haystack_dates", r" \([A-Za-z]{3}\)", ""), "yyyy/MM/dd HH:mm")
    rows = rows.select("question_id", "at", F.col("s.haystack_session_ids").alias("session_id"), time.alias("occurred_at"), F.posexplode("s.haystack_sessions").alias("turn", "t"))
    return rows.filter("t.content <> ''").select("question_id", F.concat("session_id", F.lit("#"), "at").alias("session_id"), "occurred_at", "turn", "t.role", "t.content")


def benchmark_records(payloads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records, rejected with reason) of benchmark instances, one a row; see benchmark_sessions for their columns.

    Sessions go by their date, then by their place in the instance, inside the row. A record has record_id, session_id (with
    the place), place (from 0 over the instance's turns that say something), occurred_at (UTC), source_index, turn_index, role, content
    and skipped: how many empty turns the instance has. One fault rejects the whole instance: no id, lists of other lengths
    or none, a blank session id, a date that isn't `yyyy/MM/dd (EEE) HH:mm`, a turn without content or of another role than user
    and assistant, or no turn that says anything. Extra columns go; repeated instances give repeated records.
    """
    ids, dates, turns = (F.col(f"haystack_{name}") for name in ("session_ids", "dates", "sessions"))
    time = lambda d: F.try_to_timestamp(F.regexp_replace(d, r" \([A-Za-z]{3}\) ", " "), F.lit("yyyy/MM/dd HH:mm"))
    session = lambda s, i: F.struct(
        time(s["haystack_dates"]).alias("at"), i.alias("index"), F.concat(s["haystack_session_ids"], F.lit(":source-"), F.format_string("%04d", i)).alias("id"),
        F.transform(s["haystack_sessions"], lambda t, n: F.struct(n.alias("n"), t["role"].alias("role"), t["content"].alias("content"))).alias("turns"),
    )
    blank = lambda x: F.coalesce(F.trim(x) == "", F.lit(True))
    said = F.flatten(turns)
    sound_turn = lambda t: F.coalesce(t["role"].isin("user", "assistant"), F.lit(False)) & ((t["content"] == "") | ~blank(t["content"]))
    shape = r"^\d{4}/\d{2}/\d{2} \([A-Za-z]{3}\) \d{2}:\d{2}$"
    reason = (
        F.when(blank(F.col("question_id")), "no_question_id")
        .when(ids.isNull() | dates.isNull() | turns.isNull() | (F.size(ids) != F.size(dates)) | (F.size(dates) != F.size(turns)), "lengths")
        .when(F.exists(ids, blank), "no_session_id")
        .when(F.exists(dates, lambda d: ~F.coalesce(d.rlike(shape), F.lit(False)) | time(d).isNull()), "date")
        .when(said.isNull() | F.exists(said, lambda t: ~F.coalesce(sound_turn(t), F.lit(False))), "turn")
        .when(~F.exists(said, lambda t: t["content"] != ""), "no_turns")
    )
    rows = payloads.withColumn("reason", reason)
    sessions = F.array_sort(F.transform(F.arrays_zip("haystack_session_ids", "haystack_dates", "haystack_sessions"), session))
    each = F.flatten(F.transform(sessions, lambda s: F.transform(s["turns"], lambda t: F.struct(s["id"].alias("session_id"), s["at"].alias("occurred_at"), s["index"].alias("source_index"), t.alias("t")))))
    good = rows.filter("reason is null").select("question_id", each.alias("all"))
    kept = F.filter("all", lambda r: r["t"]["content"] != "")
    good = good.select("question_id", (F.size("all") - F.size(kept)).alias("skipped"), F.posexplode(kept).alias("place", "r"))
    record_id = F.concat("r.session_id", F.lit(":turn-"), F.format_string("%04d", F.col("r.t.n")))
    good = good.select("question_id", record_id.alias("record_id"), "r.session_id", "place", "r.occurred_at", "r.source_index", F.col("r.t.n").alias("turn_index"), "r.t.role", "r.t.content", "skipped")
    return good, rows.filter("reason is not null").select("question_id", "reason")


def benchmark_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records, rejected with reason) as benchmark_records gives them, of instances that come as a row a turn and may be of any size.

    turns(question_id, source_index, session_id, date, turn_index, role, content); source_index tells an instance's sessions
    apart. No row holds an instance: what is ordered as a whole is a row a session, and within a session its turns.
    """
    time = F.try_to_timestamp(F.regexp_replace("date", r" \([A-Za-z]{3}\) ", " "), F.lit("yyyy/MM/dd HH:mm"))
    blank = lambda x: F.coalesce(F.trim(x) == "", F.lit(True))
    said = F.coalesce(F.col("content") != "", F.lit(False))
    rows = turns.select("question_id", "source_index", "session_id", time.alias("occurred_at"), "date", "turn_index", "role", "content")
    dated = F.coalesce(F.col("date").rlike(r"^\d{4}/\d{2}/\d{2} \([A-Za-z]{3}\) \d{2}:\d{2}$"), F.lit(False)) & F.col("occurred_at").isNotNull()
    sound = F.coalesce(F.col("role").isin("user", "assistant"), F.lit(False)) & F.coalesce((F.col("content") == "") | ~blank(F.col("content")), F.lit(False))
    reasons = ["no_question_id", "no_session_id", "date", "turn"]
    fault = F.when(blank(F.col("question_id")), 0).when(blank(F.col("session_id")), 1).when(~dated, 2).when(~sound, 3)
    instances = rows.groupBy("question_id").agg(F.min(fault).alias("fault"), F.count_if(said).alias("n"), F.count_if(F.col("content") == "").alias("skipped"))
    named = F.coalesce(*(F.when(F.col("fault") == i, name) for i, name in enumerate(reasons)), F.when(F.col("n") == 0, "no_turns"))
    instances = instances.withColumn("reason", named)

    session = ["question_id", "source_index"]
    good = instances.filter("reason is null").select("question_id", F.col("skipped").cast("int").alias("skipped"))
    sessions = rows.groupBy(*session).agg(F.min("occurred_at").alias("at"), F.count_if(said).alias("n")).join(good, "question_id")
    earlier = Window.partitionBy("question_id").orderBy("at", "source_index").rowsBetween(Window.unboundedPreceding, -1)
    sessions = sessions.select(*session, "skipped", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    placed = F.row_number().over(Window.partitionBy(*session).orderBy("turn_index")) - 1
    kept = rows.filter(said).join(sessions, session).withColumn("place", (F.col("before") + placed).cast("int"))
    kept = kept.withColumn("session_id", F.concat("session_id", F.lit(":source-"), F.format_string("%04d", "source_index")))
    record_id = F.concat("session_id", F.lit(":turn-"), F.format_string("%04d", "turn_index"))
    kept = kept.select("question_id", record_id.alias("record_id"), "session_id", "place", "occurred_at", "source_index", "turn_index", "role", "content", "skipped")
    return kept, instances.filter("reason is not null").select("question_id", "reason")


def parsed_batches(lines: DataFrame, column: str = "value") -> tuple[DataFrame, DataFrame]:
    """(records, rejected with reason) of JSON records, one a line; an id that several sound records have rejects them all."""
    rows = lines.select(F.col(column).alias("raw"), F.from_json(column, RECORD).alias("r"), F.json_object_keys(column).alias("keys"))
    blank = lambda x: F.coalesce(F.trim(x) == "", F.lit(True))
    known = F.array(*map(F.lit, RECORD.names))
    reason = (
        F.when(F.col("r").isNull() | blank(F.col("r.record_id")), "no_record_id")
        .when(blank(F.col("r.content")), "no_content")
        .when(F.col("r.content_type") != "text/plain", "content_type")
        .when(~F.coalesce(F.col("r.occurred_at").rlike(OFFSET_TIME), F.lit(False)), "occurred_at")
        .when(F.size(F.array_except("keys", known)) > 0, "unknown_key")
    )
    rows = rows.withColumn("reason", reason)
    repeated = rows.filter("reason is null").groupBy(F.col("r.record_id").alias("_id")).agg(F.count("*").alias("_n")).filter("_n > 1")
    rows = rows.join(repeated, (F.col("r.record_id") == F.col("_id")) & F.col("reason").isNull(), "left")
    rows = rows.withColumn("reason", F.coalesce("reason", F.when(F.col("_id").isNotNull(), "repeated_id"))).drop("_id", "_n")
    return rows.filter("reason is null").select("r.*"), rows.filter("reason is not null").select("raw", "reason")


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).json(path)


def write_jsonl(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").json(path)
