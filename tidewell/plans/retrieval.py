"""Retrieval queries: vectors are facts, documents their texts, lineitem the graph of facts (orders) and entities (parts)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.functions import text as T
from tidewell.functions import vectors as V
from tidewell.operators import nearest as N
from tidewell.operators import retrieval as R
from tidewell.operators import text_index as IX
from tidewell.plans.facts import FACTS
from tidewell.plans.registry import query, read

c = F.col
TERMS = ["the", "ing", "error"]
K = 60
SEM = f"""q AS (SELECT list_transform(embedding, lambda x: x::DOUBLE) AS q FROM embeddings WHERE vec_id = 0),
dist AS (SELECT vec_id AS id, round(list_cosine_distance(list_transform(embedding, lambda x: x::DOUBLE), q), 6) AS distance FROM embeddings, q),
sem AS (SELECT id, round(1 / (1 + distance), 6) AS semantic_score, row_number() OVER (ORDER BY distance, id) AS semantic_rank FROM dist QUALIFY semantic_rank <= {K})"""
TF = " + ".join(f"(len(list_filter(w, lambda x: x = '{t}')) / (len(list_filter(w, lambda x: x = '{t}')) + 1))" for t in TERMS)
KEY = f"""toks AS (SELECT doc_id AS id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS w FROM documents),
kr AS (SELECT id, round(0.0 + {TF}, 6) AS r FROM toks),
key AS (SELECT id, round(r / (1 + r), 6) AS keyword_score, row_number() OVER (ORDER BY r DESC, id) AS keyword_rank FROM kr WHERE r > 0 QUALIFY keyword_rank <= {K})"""
SEED = """seed AS (SELECT id, coalesce(semantic_score, 0.0) AS semantic_score, semantic_rank, coalesce(keyword_score, 0.0) AS keyword_score, keyword_rank FROM sem FULL JOIN key USING (id))"""


def _query_vector(spark: SparkSession, d: str) -> list[float]:
    return [float(x) for x in read(spark, d, "embeddings").filter("vec_id = 0").first()["embedding"]]


def _seeds(spark: SparkSession, d: str) -> DataFrame:
    semantic = R.semantic_top_k(read(spark, d, "embeddings"), _query_vector(spark, d), K)
    return R.seeds(semantic, R.keyword_top_k(read(spark, d, "documents"), TERMS, K))


def _once(seeds: DataFrame) -> tuple[DataFrame, list]:
    """The seeds, 2 K rows at most, as rows that are there, and their ids: both channels run once."""
    rows = seeds.collect()
    return seeds.sparkSession.createDataFrame(rows, seeds.schema), [r["id"] for r in rows]


@query(f"WITH {SEM} SELECT * FROM sem")
def semantic_topk(spark: SparkSession, d: str) -> DataFrame:
    return R.semantic_top_k(read(spark, d, "embeddings"), _query_vector(spark, d), K)


@query(f"WITH {KEY} SELECT * FROM key")
def keyword_topk(spark: SparkSession, d: str) -> DataFrame:
    return R.keyword_top_k(read(spark, d, "documents"), TERMS, K)


@query(f"WITH {SEM}, {KEY}, {SEED} SELECT * FROM seed")
def seed_union(spark: SparkSession, d: str) -> DataFrame:
    return _seeds(spark, d)


@query(f"""WITH {SEM}, {KEY}, {SEED}, f AS (SELECT seed.*, coalesce(text, '') AS text, round(coalesce(1 / (60 + semantic_rank), 0) + coalesce(1 / (60 + keyword_rank), 0), 9) AS score FROM seed LEFT JOIN documents ON doc_id = id),
u AS (SELECT *, row_number() OVER (PARTITION BY CASE WHEN trim(text) = '' THEN id::VARCHAR ELSE lower(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) END ORDER BY score DESC, id) AS n FROM f)
SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM u WHERE n = 1 QUALIFY rank <= 20""")
def hybrid_retrieve(spark: SparkSession, d: str) -> DataFrame:
    """Both channels fused by reciprocal ranks, texts once each, the best twenty."""
    seeds, ids = _once(_seeds(spark, d))  # the scan of texts then skips what has none of them
    texts = read(spark, d, "documents").filter(c("doc_id").isin(ids)).select(c("doc_id").alias("k"), F.coalesce("text", F.lit("")).alias("text"))
    rows = seeds.join(F.broadcast(texts), c("k") == c("id"), "left").withColumn("text", F.coalesce("text", F.lit("")))
    rows = rows.withColumn("score", R.rrf(c("semantic_rank"), c("keyword_rank")))
    best = R.best_per_text(rows, "text", [F.desc("score"), c("id")])
    return R.top_k(best, [F.desc("score"), c("id")], 20, "rank").select("id", "score", "rank")


GRAPH = """edge AS (SELECT DISTINCT l_orderkey AS f, l_partkey AS e FROM lineitem), live AS (SELECT * FROM edge WHERE f % 17 <> 0), cand AS (SELECT f, e FROM edge WHERE f IN (SELECT f FROM live WHERE e < 5)),
p3 AS (SELECT a.e AS s, a.f, b.e AS t FROM live a JOIN live b USING (f) WHERE a.e < 5 AND b.e <> a.e), p4 AS (SELECT p3.s FROM p3 JOIN live x ON x.e = p3.t AND x.f <> p3.f),
ends AS (SELECT s AS e, 1 AS hops FROM p3 UNION ALL SELECT t, 1 FROM p3 UNION ALL SELECT s, 2 FROM p4), paths AS (SELECT f, min(hops) AS hops, count(*) AS paths FROM cand JOIN ends USING (e) GROUP BY 1)"""


def _paths(spark: SparkSession, d: str) -> DataFrame:
    edges = read(spark, d, "lineitem").select("l_orderkey", "l_partkey").distinct()
    return R.entity_paths(edges, "l_orderkey", "l_partkey", edges.filter("l_partkey < 5"), c("l_orderkey") % 17 == 0)


@query(f"WITH {GRAPH} SELECT f AS l_orderkey, hops, paths FROM paths")
def graph_paths(spark: SparkSession, d: str) -> DataFrame:
    return _paths(spark, d)


@query(f"""WITH {GRAPH}, n AS (SELECT l_orderkey AS f, count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY 1)
SELECT f AS l_orderkey, round(1 / hops * least(paths, 3) / 3, 6) AS structural, CASE WHEN f % 2 = 0 THEN least(0.5 / greatest(n, 1), 0.5) ELSE 0.0 END::DOUBLE AS boost FROM paths JOIN n USING (f)""")
def structural_score(spark: SparkSession, d: str) -> DataFrame:
    """Structural score of paths, and the boost of facts of mentioned entities (even ones here), by their number of facts."""
    n = read(spark, d, "lineitem").select("l_orderkey", "l_partkey").distinct().groupBy("l_orderkey").agg(F.count("*").alias("n"))
    rows = _paths(spark, d).join(n, "l_orderkey")
    return rows.select("l_orderkey", F.round(R.structural(c("hops"), c("paths")), 6).alias("structural"), R.entity_boost(c("n"), c("l_orderkey") % 2 == 0).alias("boost"))


FUSED = f"""WITH {SEM}, {KEY}, {SEED}, {GRAPH}, st AS (SELECT f AS id, 1 / hops * least(paths, 3) / 3 AS structural FROM paths),
ch AS (SELECT seed.*, coalesce(round(structural, 6), 0.0) AS structural, source, coalesce(text, '') AS text, count(*) OVER (PARTITION BY source) AS n FROM seed LEFT JOIN st USING (id) LEFT JOIN documents ON doc_id = id),
bo AS (SELECT *, CASE WHEN source IN ('src1', 'src2') THEN least(0.5 / greatest(n, 1), 0.5) ELSE 0.0 END::DOUBLE AS boost FROM ch),
r AS (SELECT *, CASE WHEN structural > 0 THEN row_number() OVER (ORDER BY structural DESC, id) END AS structural_rank, CASE WHEN boost > 0 THEN row_number() OVER (ORDER BY boost DESC, id) END AS boost_rank FROM bo),
every AS (SELECT *, round(coalesce(1 / (60 + semantic_rank), 0) + coalesce(1 / (60 + keyword_rank), 0) + coalesce(1 / (60 + structural_rank), 0) + coalesce(1 / (60 + boost_rank), 0), 9) AS score FROM r),
fused AS (SELECT * FROM every QUALIFY row_number() OVER (PARTITION BY CASE WHEN trim(text) = '' THEN id::VARCHAR ELSE lower(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) END ORDER BY score DESC, id) = 1)"""
QUESTION = ["the", "src1", "src2"]


def _ranked(rows: DataFrame, channel: str) -> DataFrame:
    """The candidates, at most 2 K, with their rank in a channel where they score above zero."""
    some = R.top_k(rows.filter(c(channel) > 0), [F.desc(channel), c("id")], 2 * K, f"{channel}_rank").select(c("id").alias("rid"), f"{channel}_rank")
    return rows.join(some, c("rid") == c("id"), "left").drop("rid")


def _fused(spark: SparkSession, d: str, seeds: DataFrame | None = None) -> DataFrame:
    """The candidates of both seeds, fused over four channels, each text once; an entity's boost falls with its candidates."""
    from pyspark.sql import Window

    seeds, ids = _once(_seeds(spark, d) if seeds is None else seeds)
    docs = read(spark, d, "documents").filter(c("doc_id").isin(ids)).select(c("doc_id").alias("k"), "source", F.coalesce("text", F.lit("")).alias("text"))
    st = _paths(spark, d).select(c("l_orderkey").alias("f"), F.round(R.structural(c("hops"), c("paths")), 6).alias("structural"))
    rows = seeds.join(st, c("f") == c("id"), "left").withColumn("structural", F.coalesce("structural", F.lit(0.0))).join(docs, c("k") == c("id"), "left").withColumn("text", F.coalesce("text", F.lit("")))
    mentioned = F.coalesce(F.arrays_overlap(T.query_terms(c("source")), F.array(*map(F.lit, QUESTION))), F.lit(False))
    rows = rows.withColumn("n", F.count("*").over(Window.partitionBy("source"))).withColumn("boost", R.entity_boost(c("n"), mentioned))
    rows = _ranked(_ranked(rows, "structural"), "boost")
    score = R.rrf(c("semantic_rank"), c("keyword_rank"), c("structural_rank"), c("boost_rank"))
    rows = rows.select("id", "semantic_score", "keyword_score", "structural", "source", "text", score.alias("score"))
    return R.best_per_text(rows, "text", [F.desc("score"), c("id")])


@query(FUSED + " SELECT id, score FROM fused ORDER BY score DESC, id LIMIT 20")
def rrf_fusion(spark: SparkSession, d: str) -> DataFrame:
    return _fused(spark, d).orderBy(F.desc("score"), "id").limit(20).select("id", "score")


@query(FUSED + ", top AS (SELECT * FROM fused ORDER BY score DESC, id LIMIT 1) SELECT id, semantic_score < 0.3 AND keyword_score < 0.3 AND structural = 0 AS abstains FROM top")
def abstain(spark: SparkSession, d: str) -> DataFrame:
    weak = (c("semantic_score") < 0.3) & (c("keyword_score") < 0.3) & (c("structural") == 0)
    return _fused(spark, d).orderBy(F.desc("score"), "id").limit(1).select("id", weak.alias("abstains"))


@query("SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents WHERE trim(coalesce(text, '')) <> '' GROUP BY lower(regexp_replace(text, '^\\s+|\\s+$', '', 'g'))")
def dedupe_text(spark: SparkSession, d: str) -> DataFrame:
    from tidewell.functions.text import strip

    rows = read(spark, d, "documents").select("doc_id", F.lower(strip(F.coalesce("text", F.lit("")))).alias("key")).filter("key <> ''")
    return rows.groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).drop("key")


@query("""WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), q AS (SELECT e AS q FROM v WHERE vec_id = 0),
a AS (SELECT vec_id AS a, label, e AS ae, round(list_cosine_similarity(e, q), 9) AS qa FROM v, q WHERE vec_id BETWEEN 1 AND 10),
s AS (SELECT a, vec_id AS sibling, round(list_cosine_similarity(e, q), 9) AS qn, round(list_cosine_similarity(e, ae), 9) AS an, qa FROM v JOIN a USING (label), q WHERE vec_id NOT BETWEEN 1 AND 10),
k AS (SELECT sibling, a, round(qn - 0.1 * (1 - an), 6) AS score FROM s WHERE round(qn - 0.1 * (1 - an), 6) > round(0.8 * qa, 6))
SELECT sibling, score, a AS anchor FROM (SELECT *, row_number() OVER (PARTITION BY sibling ORDER BY score DESC, a) AS n FROM k) WHERE n = 1 ORDER BY score DESC, sibling LIMIT 20""")
def scar_siblings(spark: SparkSession, d: str) -> DataFrame:
    """Neighbours of ten anchors in the same chunk, scored against the question and the anchor; the best anchor of each."""
    from tidewell.operators.lifecycle import latest

    q = F.array(*(F.lit(x) for x in _query_vector(spark, d)))
    v = read(spark, d, "embeddings").select("vec_id", "label", V.doubles(c("embedding")).alias("e"))
    near = lambda x, y: F.round(V.cosine(x, y), 9)
    anchors = v.filter("vec_id between 1 and 10").select(c("vec_id").alias("anchor"), "label", c("e").alias("ae"), near(c("e"), q).alias("qa"))
    rows = v.filter("vec_id not between 1 and 10").join(F.broadcast(anchors), "label")
    rows = rows.withColumn("score", F.round(near(c("e"), q) - 0.1 * (1 - near(c("e"), c("ae"))), 6)).filter(c("score") > F.round(0.8 * c("qa"), 6))
    best = latest(rows.select(c("vec_id").alias("sibling"), "score", "anchor"), ["sibling"], [F.desc("score"), c("anchor")])
    return best.orderBy(F.desc("score"), "sibling").limit(20)


@query("""WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
p AS (SELECT a.vec_id AS query, b.vec_id AS id, a.label = b.label AS hit, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_distance(a.e, b.e), 6), b.vec_id) AS rank FROM v a JOIN v b ON a.vec_id < 20 AND a.vec_id <> b.vec_id),
g AS (SELECT label, count(*) - 1 AS gold FROM v GROUP BY 1)
SELECT query, round(count(*) FILTER (hit AND rank <= 5) / any_value(gold), 6) AS recall, (count(*) FILTER (hit AND rank <= 5) > 0)::INT AS hit_at_k, round(count(*) FILTER (hit AND rank <= 5) / 5, 6) AS precision,
round(coalesce(1 / min(rank) FILTER (hit), 0), 6) AS mrr FROM p JOIN v ON v.vec_id = query JOIN g USING (label) GROUP BY query""")
def eval_retrieval(spark: SparkSession, d: str) -> DataFrame:
    """Recall, hit, precision at 5 and reciprocal rank of twenty questions against all vectors; gold is the label."""
    return _evaluate(read(spark, d, "embeddings"), "vec_id < 20")


@query("""WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
p AS (SELECT a.vec_id AS query, b.vec_id AS id, a.label = b.label AS hit, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_distance(a.e, b.e), 6), b.vec_id) AS rank FROM v a JOIN v b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id),
g AS (SELECT label, count(*) - 1 AS gold FROM v GROUP BY 1)
SELECT query, round(count(*) FILTER (hit AND rank <= 5) / any_value(gold), 6) AS recall, (count(*) FILTER (hit AND rank <= 5) > 0)::INT AS hit_at_k, round(count(*) FILTER (hit AND rank <= 5) / 5, 6) AS precision,
round(coalesce(1 / min(rank) FILTER (hit), 0), 6) AS mrr FROM p JOIN v ON v.vec_id = query JOIN g USING (label) GROUP BY query""")
def eval_retrieval_twentieth(spark: SparkSession, d: str) -> DataFrame:
    """The same of every twentieth vector, by blocks: products grow with the square of the table, rows do not."""
    return _evaluate(read(spark, d, "embeddings"), "vec_id % 20 = 0")


def _evaluate(embeddings: DataFrame, asked: str) -> DataFrame:
    found = N.first_hits(embeddings.filter(asked), embeddings, 5, 64)
    asked_ = embeddings.filter(asked).select(c("vec_id").alias("question"), "label")
    gold = asked_.join(embeddings.groupBy("label").agg((F.count("*") - 1).alias("gold")), "label").select("question", "gold")
    recall = F.when(c("gold") > 0, c("hits") / c("gold")).otherwise(float("nan"))
    mrr = F.coalesce(1 / c("first"), F.lit(0.0))
    return gold.join(found, "question").select(
        c("question").alias("query"), F.round(recall, 6).alias("recall"), (c("hits") > 0).cast("int").alias("hit_at_k"), F.round(c("hits") / 5, 6).alias("precision"), F.round(mrr, 6).alias("mrr")
    )


SWEEP = [1, 3, 5, 60]


@query(f"""WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
p AS (SELECT a.vec_id AS query, a.label = b.label AS hit, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_distance(a.e, b.e), 6), b.vec_id) AS rank FROM v a JOIN v b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id QUALIFY rank <= {SWEEP[-1]}),
g AS (SELECT label, count(*) - 1 AS gold FROM v GROUP BY 1)
SELECT query, k, round(count(*) FILTER (hit AND rank <= k) / any_value(gold), 6) AS recall, (count(*) FILTER (hit AND rank <= k) > 0)::INT AS hit_at_k, round(count(*) FILTER (hit AND rank <= k) / k, 6) AS precision,
round(coalesce(1 / min(rank) FILTER (hit), 0), 6) AS mrr FROM p JOIN v ON v.vec_id = query JOIN g USING (label), (VALUES {", ".join(f"({k})" for k in SWEEP)}) s(k) GROUP BY query, k""")
def eval_retrieval_sweep(spark: SparkSession, d: str) -> DataFrame:
    """Recall, hit, precision and reciprocal rank at 1, 3, 5 and 60 of every twentieth vector against all, by blocks; gold is the label."""
    v = read(spark, d, "embeddings")
    ranked = N.nearest(v.filter("vec_id % 20 = 0"), v, SWEEP[-1], 64, with_self=False)
    label = v.select(c("vec_id").alias("id"), c("label").alias("found"))
    asked = v.filter("vec_id % 20 = 0").select(c("vec_id").alias("question"), "label")
    judged = ranked.join(label, "id").join(asked, "question").select("question", "rank", (c("found") == c("label")).alias("hit"))
    gold = asked.join(v.groupBy("label").agg((F.count("*") - 1).alias("gold")), "label").select("question", "gold")
    found = N.metrics_at(judged, gold, SWEEP)
    return found.select(c("question").alias("query"), "k", F.round("recall", 6).alias("recall"), c("hit").alias("hit_at_k"), F.round("precision", 6).alias("precision"), F.round("mrr", 6).alias("mrr"))


_Q = r"""q AS (SELECT item_id, regexp_extract_all(text, '[\p{L}\p{N}]+') AS w FROM benchmark),
said AS (SELECT item_id, 0 AS part, w[1:3] AS words FROM q UNION ALL SELECT item_id, 1, w[5:5] FROM q UNION ALL SELECT item_id, 2, w[6:7] FROM q)"""
_STOPS = ", ".join(f"'{w}'" for w in IX.STOP_WORDS)


@query(rf"""WITH {_Q}, t AS (SELECT item_id, part, unnest(words) AS word, unnest(range(len(words))) AS spot FROM said), wanted AS (SELECT item_id, part, spot, lower(word) AS word FROM t WHERE lower(word) NOT IN ({_STOPS})),
terms AS (SELECT *, {IX.sql_stem("word")} AS term, count(*) OVER p AS size, min(spot) OVER p AS low, max(spot) OVER p AS high FROM wanted WINDOW p AS (PARTITION BY item_id, part)),
d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}]+') AS w FROM documents), tok AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS pos FROM d),
idx AS (SELECT doc_id, pos, {IX.sql_stem("word")} AS term FROM tok WHERE word NOT IN ({_STOPS})),
met AS (SELECT item_id, part, doc_id, pos - spot AS start, any_value(high - low + 1 - size) AS noise FROM terms JOIN idx USING (term) GROUP BY item_id, part, doc_id, pos - spot, size HAVING count(*) = size),
r AS (SELECT item_id, doc_id, round(sum(0.1::DOUBLE / (1 + noise)), 6) AS r FROM met GROUP BY 1, 2)
SELECT item_id, doc_id AS id, round(r / (1 + r), 6) AS keyword_score, row_number() OVER (PARTITION BY item_id ORDER BY r DESC, doc_id) AS keyword_rank FROM r QUALIFY keyword_rank <= {K}""")
def keyword_search(spark: SparkSession, d: str) -> DataFrame:
    """Many questions at once over a positional index: of each benchmark passage a phrase, a word and another phrase, joined by OR."""
    w = F.regexp_extract_all("text", F.lit(IX.WORD), F.lit(0))
    phrases = F.array(*(F.array_join(F.slice(w, at, n), " ") for at, n in ((1, 3), (5, 1), (6, 2))))
    questions = read(spark, d, "benchmark").select("item_id", T.web_query(phrases).alias("query"))
    index = IX.kept(IX.postings(read(spark, d, "documents")))  # each of its terms' buckets is read for words and for phrases
    return IX.search(index, questions, K, "item_id", "query").withColumnRenamed("question", "item_id")


@query("SELECT string_agg('[' || turn || ' | ' || role || ']: ' || left(text, 20), chr(10) ORDER BY turn) AS context, conv_id FROM conversations GROUP BY conv_id")
def reader_context(spark: SparkSession, d: str) -> DataFrame:
    """The start of each turn."""
    return _context(read(spark, d, "conversations").withColumn("text", F.substring("text", 1, 20)))


@query("SELECT string_agg('[' || turn || ' | ' || role || ']: ' || text, chr(10) ORDER BY turn) AS context, conv_id FROM conversations GROUP BY conv_id")
def reader_context_whole(spark: SparkSession, d: str) -> DataFrame:
    """The whole text of each turn."""
    return _context(read(spark, d, "conversations"))


def _context(turns: DataFrame) -> DataFrame:
    line = F.concat(F.lit("["), "turn", F.lit(" | "), "role", F.lit("]: "), "text")
    rows = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))).alias("a"))
    return rows.select(F.array_join(F.transform("a", lambda x: x["line"]), "\n").alias("context"), "conv_id")


@query("SELECT event_id, CASE WHEN sel IS NOT NULL THEN sel ELSE 5 + row_number() OVER (ORDER BY sel IS NULL DESC, event_id) END::BIGINT AS position FROM (SELECT event_id, list_position([40, 3, 17, 59, 8], event_id) AS sel FROM events WHERE event_id < 60)")
def rerank_promote(spark: SparkSession, d: str) -> DataFrame:
    """The model's picks first, in its order; the rest of the sixty keep theirs."""
    from pyspark.sql import Window

    picks = spark.createDataFrame([(x, i) for i, x in enumerate([40, 3, 17, 59, 8, 9999, 40]) if x < 60 and i < 5], "pick long, at int")
    rows = read(spark, d, "events").filter("event_id < 60").select("event_id").join(F.broadcast(picks), c("pick") == c("event_id"), "left")
    return rows.select("event_id", F.row_number().over(Window.orderBy(F.col("at").asc_nulls_last(), "event_id")).cast("long").alias("position"))


@query("""WITH top AS (SELECT event_id, row_number() OVER (ORDER BY value DESC NULLS LAST, event_id) - 1 AS place FROM events QUALIFY place < 60)
SELECT event_id, CASE WHEN sel IS NOT NULL THEN sel ELSE 5 + row_number() OVER (ORDER BY sel IS NULL DESC, place) END::BIGINT AS position FROM (SELECT event_id, place, list_position([40, 3, 17, 59, 8], place) AS sel FROM top)""")
def rerank_promote_ranked(spark: SparkSession, d: str) -> DataFrame:
    """The sixty of highest value; the picks are places among them."""
    from pyspark.sql import Window

    picks = spark.createDataFrame([(40, 0), (3, 1), (17, 2), (59, 3), (8, 4)], "pick long, at int")
    ranked = Window.orderBy(F.col("value").desc_nulls_last(), "event_id")
    top = read(spark, d, "events").select("event_id", "value").orderBy(F.col("value").desc_nulls_last(), "event_id").limit(60)
    rows = top.withColumn("place", F.row_number().over(ranked) - 1).join(F.broadcast(picks), c("pick") == c("place"), "left")
    return rows.select("event_id", F.row_number().over(Window.orderBy(F.col("at").asc_nulls_last(), "place")).cast("long").alias("position"))


@query("""SELECT p.p_partkey, p.p_name, q.p_partkey AS candidate FROM part p JOIN part q ON lower(p.p_name) = lower(q.p_name) AND p.p_partkey <> q.p_partkey AND p.p_brand = q.p_brand WHERE p.p_partkey < 300""")
def entity_exact(spark: SparkSession, d: str) -> DataFrame:
    """Candidates of the same canonical surface in one context."""
    return _namesakes(read(spark, d, "part"), "p_partkey < 300")


@query("""SELECT p.p_partkey, p.p_name, q.p_partkey AS candidate FROM part p JOIN part q ON lower(p.p_name) = lower(q.p_name) AND p.p_partkey <> q.p_partkey AND p.p_brand = q.p_brand""")
def entity_exact_all(spark: SparkSession, d: str) -> DataFrame:
    return _namesakes(read(spark, d, "part"), "true")


def _namesakes(part: DataFrame, asked: str, most: int = 256) -> DataFrame:
    """Each part with the others of its name and brand: both sides meet as lists of at most `most`, dealt over tasks before they become pairs (a task holds the pairs of two lists)."""
    from pyspark.sql import Window

    from tidewell.functions.text import canonical

    keys = ["key", "p_brand"]
    block = F.floor((F.row_number().over(Window.partitionBy(*keys).orderBy("p_partkey")) - 1) / most).alias("block")
    p = part.select("p_partkey", "p_name", canonical(c("p_name")).alias("key"), "p_brand").filter("key is not null and p_brand is not null")
    own = p.filter(asked).select("*", block).groupBy(*keys, "block").agg(F.collect_list(F.struct("p_partkey", "p_name")).alias("own"))
    others = p.select("*", block).groupBy(*keys, c("block").alias("other")).agg(F.collect_list("p_partkey").alias("others"))
    met = own.join(others, keys)
    met = met.repartition(int(part.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys, "block", "other")  # a name that is in many blocks isn't one task's
    each = met.select(F.inline("own"), "others")
    return each.select("p_partkey", "p_name", F.explode("others").alias("candidate")).filter("p_partkey <> candidate")


SITUATION = """SELECT event_id, user_id, event_type, value, ts, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS place FROM events
WHERE coalesce(list_position(['signup', 'view', 'click'], event_type), 0) <= 2 AND coalesce(nullif(user_id % 5, 0) = 3, true) AND NOT (event_id % 17 = 0)"""


@query(f"""WITH f AS ({SITUATION}) SELECT f.event_id, f.user_id, place::BIGINT AS place, coalesce(l.source, 'none') AS external_id FROM f LEFT JOIN documents l ON l.doc_id = f.event_id WHERE place <= 3""")
def retrieve_facts(spark: SparkSession, d: str) -> DataFrame:
    """Structured facts: gates of checkpoint, participant and turn before the cut, metadata after it; three a subject."""
    from pyspark.sql import Window

    from tidewell.operators.temporal import holds

    at = F.nullif(F.array_position(F.array(*map(F.lit, ("signup", "view", "click"))), c("event_type")), F.lit(0))
    rows = read(spark, d, "events").filter(holds(at <= 2) & holds(F.nullif(c("user_id") % 5, F.lit(0)) == 3) & (c("event_id") % 17 != 0))
    place = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id"))
    best = rows.withColumn("place", place).filter("place <= 3").select("event_id", "user_id", c("place").cast("long").alias("place"))
    ids = read(spark, d, "documents").select("doc_id", "source")
    return best.join(ids, c("doc_id") == c("event_id"), "left").select("event_id", "user_id", "place", F.coalesce("source", F.lit("none")).alias("external_id"))


@query(f"""WITH {{GRAPH}}, f AS (SELECT e.event_id, e.user_id, ts, value FROM events e WHERE event_id % 17 <> 0 AND ts < TIMESTAMP '2024-01-15'), n AS (SELECT user_id, count(*) AS facts FROM f GROUP BY 1)
SELECT event_id, user_id, facts, coalesce(hops, 0)::INT AS hops, coalesce(paths, 0)::BIGINT AS paths FROM f JOIN n USING (user_id) LEFT JOIN paths ON paths.f = event_id""".replace("{GRAPH}", GRAPH))
def graph_expand(spark: SparkSession, d: str) -> DataFrame:
    """Candidates that stand at the question's time, with their entity's number of retained facts and the paths to them."""
    from pyspark.sql import Window

    rows = read(spark, d, "events").filter((c("event_id") % 17 != 0) & (c("ts") < F.lit("2024-01-15").cast("timestamp_ntz")))
    rows = rows.withColumn("facts", F.count("*").over(Window.partitionBy("user_id")))
    rows = rows.join(_paths(spark, d), c("l_orderkey") == c("event_id"), "left")
    return rows.select("event_id", "user_id", "facts", F.coalesce("hops", F.lit(0)).alias("hops"), F.coalesce("paths", F.lit(0)).alias("paths"))


@query("""WITH q AS (SELECT 1 AS one), f AS (SELECT user_id, event_id, '[' || CASE WHEN event_id % 11 = 0 THEN 'Recent' ELSE strftime(ts, '%Y-%m-%d') END || ' | ' || CASE WHEN event_id % 3 = 0 THEN 'user' ELSE event_type END || ']: fact ' || event_id AS line, 1 AS part, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS n FROM events),
s AS (SELECT user_id, event_id, '- ' || CASE WHEN event_id % 11 = 0 THEN '' ELSE '[' || strftime(ts, '%Y-%m-%d') || ']: ' END || 'fact ' || event_id AS line, 3 AS part, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS n FROM events),
l AS (SELECT user_id, part, n, line FROM f WHERE n <= 3 UNION ALL SELECT user_id, part, n, line FROM s WHERE n BETWEEN 4 AND 5 UNION ALL SELECT DISTINCT user_id, 2, 0, '[related facts from the same conversation turns]:' FROM s WHERE n = 4
UNION ALL SELECT DISTINCT user_id, 0, 0, '[today''s date is 2024-02-01]' FROM events WHERE user_id % 2 = 0)
SELECT user_id, string_agg(line, chr(10) ORDER BY part, n) AS context FROM l GROUP BY 1""")
def reader_blocks(spark: SparkSession, d: str) -> DataFrame:
    """What a reader is given of each subject: the date for questions of duration, its three best facts with date and speaker, then related ones."""
    from pyspark.sql import Window

    k, best = c("event_id"), Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id")
    rows = read(spark, d, "events").withColumn("n", F.row_number().over(best)).filter("n <= 5")
    rows = rows.select("user_id", "n", F.when(k % 11 != 0, c("ts")).alias("observed"), F.when(k % 3 != 0, c("event_type")).alias("speaker"), F.concat(F.lit("fact "), k).alias("text"))
    return R.reader_context(rows, "user_id", top=3, today=F.when(c("user_id") % 2 == 0, "2024-02-01")).select("user_id", "context")


NOW = 1_705_312_800  # the time of the question
PRUNED = FUSED.replace("FROM seed LEFT JOIN st", "FROM kept AS seed LEFT JOIN st").replace(
    ", st AS (SELECT",
    f""", {FACTS}, kept AS (SELECT seed.* FROM seed LEFT JOIN facts ON fact_id = id WHERE fact_id IS NULL OR (NOT archived AND coalesce(valid_from <= {NOW}, true) AND coalesce(valid_to >= {NOW}, true)
AND observed_at < (floor({NOW} / 86400) + 1) * 86400 AND coalesce(superseded_at >= {NOW}, true))), st AS (SELECT""",
    1,
)


@query(PRUNED + """, best AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS rank FROM fused), top AS (SELECT * FROM best WHERE rank = 1)
SELECT best.id, best.rank FROM best, top WHERE best.rank <= 20 AND NOT (top.semantic_score < 0.3 AND top.keyword_score < 0.3 AND top.structural = 0)""")
def retrieve_ranked(spark: SparkSession, d: str) -> DataFrame:
    """The whole way: both seeds, what stands at the question's time (or can't be read), four channels fused, each text
    once, the best twenty; nothing where even the first is weak."""
    from tidewell.operators.temporal import visible
    from tidewell.plans.facts import facts

    now = F.lit(NOW)
    seen = facts(spark, d).select("fact_id", visible(now, now, now).alias("stands"))
    seeds = _seeds(spark, d).join(seen, c("fact_id") == c("id"), "left").filter(F.coalesce("stands", F.lit(True))).drop("fact_id", "stands")
    best = R.top_k(_fused(spark, d, seeds), [F.desc("score"), c("id")], 20, "rank")
    weak = best.filter("rank = 1 and semantic_score < 0.3 and keyword_score < 0.3 and structural = 0").select(c("rank").alias("weak"))
    return _unless(best, weak)


def _unless(best: DataFrame, weak: DataFrame) -> DataFrame:
    """The rows of best, or none if weak has a row."""
    return best.withColumn("_one", F.lit(1)).join(F.broadcast(weak.select(F.lit(1).alias("_one"))), "_one", "left_anti").select("id", "rank")
