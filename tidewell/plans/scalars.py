"""Scalar functions over the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.functions import text as T
from tidewell.functions import vectors as V
from tidewell.plans.registry import query, read

c = F.col


@query("SELECT p_partkey, lower(regexp_replace(regexp_replace('  ' || p_name || ' ', '^\\s+|\\s+$', '', 'g'), '\\s+', ' ', 'g')) AS canonical FROM part")
def fn_canonicalize(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "part").select("p_partkey", T.canonical(F.concat(F.lit("  "), "p_name", F.lit(" "))).alias("canonical"))


@query("SELECT p_partkey, 'file ' || lower(p_name) || ' 2 strasse' AS canonical FROM part")
def fn_canonicalize_any(spark: SparkSession, d: str) -> DataFrame:
    """A ligature, a wide digit and a sharp s become what they stand for."""
    surface = F.concat(F.lit(" \ufb01le\t"), F.upper("p_name"), F.lit("\u3000\uff12 Stra\u00dfe "))
    return read(spark, d, "part").select("p_partkey", T.folded(surface).alias("canonical"))


GRAMS = "list_distinct([substr('  ' || {0} || '  ', i::BIGINT, 3) for i in range(1, length({0}) + 3)])"


@query(f"""WITH g AS (SELECT p_partkey, {GRAMS.format("p_name")} AS a, {GRAMS.format("p_type")} AS b FROM part)
SELECT p_partkey, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6) AS similarity FROM g""")
def fn_trigram_jaccard(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "part").select("p_partkey", F.round(T.jaccard(T.trigrams(c("p_name")), T.trigrams(c("p_type"))), 6).alias("similarity"))


@query("""WITH ch AS (SELECT c_custkey, c_name, unnest(string_split(c_name, '')) AS x FROM customer), n AS (SELECT c_custkey, c_name, x, count(*) AS n FROM ch WHERE x <> '' GROUP BY ALL)
SELECT c_custkey, round(-sum(n / length(c_name) * log2(n / length(c_name))), 6) AS entropy, round(-sum(n / length(c_name) * log2(n / length(c_name))), 6) >= 1.0 AND max(length(c_name)) >= 2 AS stable FROM n GROUP BY 1""")
def surface_entropy(spark: SparkSession, d: str) -> DataFrame:
    h = F.round(T.entropy(c("c_name")), 6)
    return read(spark, d, "customer").select("c_custkey", h.alias("entropy"), ((h >= 1.0) & (F.length("c_name") >= 2)).alias("stable"))


@query("SELECT doc_id, 'sha256:' || sha256(coalesce(text, '')) AS digest FROM documents")
def fn_content_hash(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", T.content_hash(F.coalesce("text", F.lit(""))).alias("digest"))


@query("SELECT doc_id, sha256(source || chr(0) || doc_id) AS chunk_id, sha256(source || chr(31) || lang) AS fingerprint FROM documents")
def fn_chunk_id(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", T.chunk_id(c("source"), c("doc_id").cast("string")).alias("chunk_id"), T.fingerprint(c("source"), c("lang")).alias("fingerprint"))


@query("""WITH h AS (SELECT doc_id, sha256('fact:' || doc_id) AS h FROM documents)
SELECT doc_id, concat_ws('-', h[1:8], h[9:12], h[13:16], h[17:20], h[21:32]) AS id FROM h""")
def fn_det_uuid(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", T.uuid_of("fact", c("doc_id").cast("string")).alias("id"))


@query("""WITH p AS (SELECT o_orderkey, o_orderdate::DATE AS a, DATE '1999-03-15' AS b FROM orders), q AS (SELECT *, least(a, b) AS lo, greatest(a, b) AS hi FROM p),
m AS (SELECT *, (year(hi) - year(lo)) * 12 + month(hi) - month(lo) - CASE WHEN day(hi) < day(lo) THEN 1 ELSE 0 END AS m FROM q)
SELECT o_orderkey, (hi - lo)::DOUBLE AS days, round((hi - lo) / 7.0, 6)::DOUBLE AS weeks, m::DOUBLE AS months, floor(m / 12)::DOUBLE AS years FROM m""")
def fn_date_diff_unit(spark: SparkSession, d: str) -> DataFrame:
    a, b = F.to_date("o_orderdate"), F.to_date(F.lit("1999-03-15"))
    return read(spark, d, "orders").select("o_orderkey", *(F.round(T.date_difference(a, b, u), 6).alias(u) for u in ("days", "weeks", "months", "years")))


@query("SELECT doc_id, len(list_filter(list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')), lambda x: length(x) >= 3)) AS n_terms FROM documents")
def fn_query_terms(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", F.size(T.query_terms(F.coalesce("text", F.lit("")))).cast("long").alias("n_terms"))


QUESTIONS = [
    "How many books do I own?", "How often do I run?", "How long did the trip take?", "How many days passed since May?", "Which cat is mine?", "List all my plants",
    "What is the average of it?", "Every Monday then?", "How much time did I spend?", "How many trips ago was it?", "Between May and June, how many weeks were dry until it rained for days?", "The sum, please", "Was it two weeks ago?",
]
ASKED = "SELECT item_id, (" + repr(QUESTIONS) + ")[item_id % " + str(len(QUESTIONS)) + " + 1] AS q FROM benchmark"


@query(f"""WITH q AS ({ASKED}) SELECT item_id, regexp_matches(q, '{T.COUNT_QUESTION}') AS counts, regexp_matches(q, '{T.DURATION_QUESTION}') AS lasts,
CASE WHEN item_id % 5 = 0 THEN 7 WHEN regexp_matches(q, '{T.COUNT_QUESTION}') THEN 40 ELSE 20 END AS k FROM q""")
def fn_detect_count(spark: SparkSession, d: str) -> DataFrame:
    """Questions for a count or a duration; k is 40 for the former and 20 for others, unless the caller gives it."""
    q = F.element_at(F.array(*map(F.lit, QUESTIONS)), (c("item_id") % len(QUESTIONS) + 1).cast("int"))
    rows = read(spark, d, "benchmark").select("item_id", q.alias("q"), F.when(c("item_id") % 5 == 0, 7).alias("given"))
    counts = c("q").rlike(T.COUNT_QUESTION)
    return rows.select("item_id", counts.alias("counts"), c("q").rlike(T.DURATION_QUESTION).alias("lasts"), F.coalesce("given", F.when(counts, 40).otherwise(20)).alias("k"))


@query("SELECT p_partkey, replace(lower(p_name), ' ', '_') AS slug FROM part")
def fn_slug(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "part").select("p_partkey", T.slug(c("p_name")).alias("slug"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity = floor(l_quantity) THEN l_quantity::BIGINT::VARCHAR ELSE l_quantity::VARCHAR END AS plain, greatest(0.0, least(1.0, l_tax * 20 - 0.5)) AS clamped FROM lineitem")
def fn_format_number(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", T.plain_number(c("l_quantity")).alias("plain"), T.clamp(c("l_tax") * 20 - 0.5).alias("clamped"))


@query("""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\r\\f\\v]+'), lambda x: x <> '') AS w FROM documents)
SELECT doc_id, ceil(len(w) / 6.0)::BIGINT AS n_groups, array_to_string(w[1:6], ' ') AS first_group FROM w WHERE len(w) > 0""")
def fn_word_chunks(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "documents").select("doc_id", T.word_groups(F.coalesce("text", F.lit("")), 6).alias("g"))
    return rows.filter("size(g) > 0").select("doc_id", F.size("g").cast("long").alias("n_groups"), F.element_at("g", 1).alias("first_group"))


@query("SELECT doc_id, CASE WHEN n_chars < 500 THEN 'short' WHEN n_chars < 2000 THEN 'medium' WHEN n_chars < 8000 THEN 'long' ELSE 'very_long' END AS tier FROM documents")
def fn_length_tier(spark: SparkSession, d: str) -> DataFrame:
    n = c("n_chars")
    return read(spark, d, "documents").select("doc_id", F.when(n < 500, "short").when(n < 2000, "medium").when(n < 8000, "long").otherwise("very_long").alias("tier"))


@query("SELECT doc_id, instr(text, ' the ')::BIGINT AS start_, CASE WHEN instr(text, ' the ') > 0 THEN 5 ELSE length(text) END::BIGINT AS length_ FROM documents")
def fn_source_span(spark: SparkSession, d: str) -> DataFrame:
    """The first place of a quote; the whole text where it isn't there."""
    at = F.instr("text", " the ")
    return read(spark, d, "documents").select("doc_id", at.cast("long").alias("start_"), F.when(at > 0, 5).otherwise(F.length("text")).cast("long").alias("length_"))


@query("SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events")
def fn_state_get(spark: SparkSession, d: str) -> DataFrame:
    from tidewell.functions.rules import get

    return read(spark, d, "events").select("event_id", get(c("props"), "k").cast("long").alias("k"))


@query("SELECT vec_id, round(list_cosine_distance(list_transform(embedding, lambda x: x::DOUBLE), (SELECT list_transform(embedding, lambda x: x::DOUBLE) FROM embeddings WHERE vec_id = 1)), 6) AS distance FROM embeddings")
def vector_distance(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "embeddings")
    one = e.filter("vec_id = 1").select(V.doubles(c("embedding")).alias("q"))
    return e.join(F.broadcast(one)).select("vec_id", F.round(1 - V.cosine(V.doubles(c("embedding")), c("q")), 6).alias("distance"))


@query("SELECT c_custkey, split_part(c_name, '#', 1) AS head, 'Hello ' || c_name || ', you scored ' || c_nationkey AS line, CASE WHEN c_nationkey > 10 THEN 'd20+' || (c_nationkey - 10) ELSE 'd20' END AS dice FROM customer")
def fn_template(spark: SparkSession, d: str) -> DataFrame:
    line = F.replace(F.replace(F.lit("Hello {name}, you scored {score}"), F.lit("{name}"), c("c_name")), F.lit("{score}"), c("c_nationkey").cast("string"))
    dice = F.when(c("c_nationkey") > 10, F.concat(F.lit("d20+"), c("c_nationkey") - 10)).otherwise("d20")
    return read(spark, d, "customer").select("c_custkey", F.split_part("c_name", F.lit("#"), F.lit(1)).alias("head"), line.alias("line"), dice.alias("dice"))


@query("SELECT strftime(ts, '%Y/%m/%d (%a) %H:%M') AS written, date_trunc('minute', ts) AS parsed, event_id FROM events")
def fn_parse_benchmark_ts(spark: SparkSession, d: str) -> DataFrame:
    written = F.date_format("ts", "yyyy/MM/dd (EEE) HH:mm")
    parsed = F.to_timestamp_ntz(F.regexp_replace(written, r" \([A-Za-z]{3}\)", ""), F.lit("yyyy/MM/dd HH:mm"))
    return read(spark, d, "events").select(written.alias("written"), parsed.alias("parsed"), "event_id")


@query("SELECT conv_id, turn, list_sort(list_distinct(regexp_extract_all(lower(text), '\\b(the|that|with|from)\\b'))) AS names FROM conversations WHERE regexp_matches(lower(text), '\\b(the|that|with|from)\\b')")
def entity_mentions(spark: SparkSession, d: str) -> DataFrame:
    """Names found as whole words, the longest first in the pattern."""
    pattern = r"\b(" + "|".join(sorted(("the", "that", "with", "from"), key=lambda n: (-len(n), n))) + r")\b"
    names = F.sort_array(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(pattern), F.lit(1))))
    return read(spark, d, "conversations").select("conv_id", "turn", names.alias("names")).filter("size(names) > 0")
