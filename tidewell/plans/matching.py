"""Similarity joins and mention scans over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.functions import vectors as V
from tidewell.operators.mentions import found_names
from tidewell.operators.similar import near_pairs, similar_names
from tidewell.plans.registry import query, read

c = F.col
WORD = "[a-z]{4,}"
OPENING = r"^[\p{L}\p{M}\p{N}_]+( [\p{L}\p{M}\p{N}_]+)?"
#: Letters with marks, each of which stands as a capital in the lower-cased texts of the SQL below, so that \b knows them as letters.
MARKED = "àâäçèéêëîïíìñòóôöùúûüßœæá"
PLAIN = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"[: len(MARKED)]


@query("""WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), q AS (SELECT vec_id AS mention, label, list_concat(e[:36], list_transform(range(28), lambda i: 0.0::DOUBLE)) AS q FROM v WHERE vec_id % 20 = 0)
SELECT mention, vec_id AS entity, round(list_cosine_similarity(q, e), 6) AS similarity FROM q JOIN v USING (label) WHERE round(list_cosine_similarity(q, e), 6) >= 0.75""")
def near_names(spark: SparkSession, d: str) -> DataFrame:
    """Entities of a label with a cosine of 0.75 to a mention; every twentieth vector is one, of which 36 components are known."""
    v = read(spark, d, "embeddings").select(c("vec_id").alias("id"), c("label").alias("context"), V.doubles(c("embedding")).alias("v"))
    some = F.concat(F.slice("v", 1, 36), F.array_repeat(F.lit(0.0), 28))
    return near_pairs(v.filter("id % 20 = 0").withColumn("v", some), v, 0.75, 64).select(c("question").alias("mention"), c("id").alias("entity"), "similarity")


_GRAMS = "SELECT DISTINCT w, list_distinct(list_transform(range(1, length(w) + 3), lambda i: substr('  ' || w || '  ', i, 3))) AS g FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]{{4,}}')) AS w FROM {0})"


@query(f"""WITH a AS ({_GRAMS.format("conversations WHERE role = 'user'")}), b AS ({_GRAMS.format("benchmark")}), n AS (SELECT a.w AS mention, b.w AS name, len(list_intersect(a.g, b.g)) AS shared, len(a.g) + len(b.g) AS total FROM a, b)
SELECT mention, name, round(shared / (total - shared), 9) AS similarity FROM n WHERE shared / (total - shared) >= 0.25""")
def similar_words(spark: SparkSession, d: str) -> DataFrame:
    """Words of users' turns and the words of benchmark passages that are like them: a Jaccard of trigrams of 0.25."""
    words = lambda df: df.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(WORD), F.lit(0))).alias("name"))
    found = similar_names(words(read(spark, d, "conversations").filter("role = 'user'")), words(read(spark, d, "benchmark")))
    return found.select(c("left").alias("mention"), c("right").alias("name"), F.round("similarity", 9).alias("similarity"))


@query(rf"""WITH t AS (SELECT conv_id, turn, role, translate(lower(text), '{MARKED}', '{PLAIN}') AS text FROM conversations),
n AS (SELECT DISTINCT regexp_extract(text, '^\w+( \w+)?') AS name FROM t WHERE role = 'user' AND regexp_matches(text, '^\w')), p AS (SELECT '\b(' || string_agg(name, '|' ORDER BY length(name) DESC, name) || ')\b' AS pattern FROM n)
SELECT conv_id, turn, translate(name, '{PLAIN}', '{MARKED}') AS name, count(*) AS mentions FROM (SELECT conv_id, turn, unnest(regexp_extract_all(text, pattern)) AS name FROM t, p) GROUP BY ALL""")
def mentions_of_names(spark: SparkSession, d: str) -> DataFrame:
    """Names in all turns, the longest at each place; the names are what users' turns open with, one or two words."""
    turns = read(spark, d, "conversations")
    names = turns.filter("role = 'user'").select(F.regexp_extract("text", OPENING, 0).alias("name"))
    return found_names(turns, names, ["conv_id", "turn"]).groupBy("conv_id", "turn", "name").agg(F.count("*").alias("mentions"))
