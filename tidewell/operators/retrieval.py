"""Hybrid retrieval: vector and keyword channels, graph paths, rank fusion, abstention."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions import text as T
from tidewell.functions import vectors as V

RRF_K = 60


def top_k(df: DataFrame, order: list[Column], k: int, rank: str) -> DataFrame:
    """The first k rows in the order with their rank: the limit bounds what the one ranking task sees."""
    return df.orderBy(*order).limit(k).withColumn(rank, F.row_number().over(Window.orderBy(*order)).cast("long"))


def semantic_top_k(vectors: DataFrame, query: list[float], k: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, semantic_score, semantic_rank): 1 / (1 + cosine distance), exactly, over all vectors."""
    q = F.array(*(F.lit(float(x)) for x in query))
    distance = F.round(1 - V.cosine(V.doubles(F.col(vector_col)), q), 6)
    rows = vectors.select(F.col(id_col).alias("id"), distance.alias("distance"))
    rows = top_k(rows, [F.col("distance"), F.col("id")], k, "semantic_rank")
    return rows.select("id", F.round(V.distance_score(F.col("distance")), 6).alias("semantic_score"), "semantic_rank")


def keyword_top_k(docs: DataFrame, terms: list[str], k: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, keyword_score, keyword_rank): r is the sum over matched terms of tf / (tf + 1), the score r / (1 + r)."""
    text = F.lower(F.coalesce(F.col(text_col), F.lit("")))
    r = F.lit(float(len(terms)))
    for t in terms:  # counted in place, so that the text isn't taken apart into words, and only where it is there at all
        pattern = "(?<![a-z0-9])" + re.escape(t) + "(?![a-z0-9])"
        tf = F.when(F.contains(text, F.lit(t)), F.regexp_count(text, F.lit(pattern))).otherwise(0)
        r = r - 1 / (tf + 1)
    rows = docs.select(F.col(id_col).alias("id"), F.round(r, 6).alias("r"))
    rows = top_k(rows, [F.desc("r"), F.col("id")], k, "keyword_rank").filter("r > 0")
    return rows.select("id", F.round(F.col("r") / (1 + F.col("r")), 6).alias("keyword_score"), "keyword_rank")


def seeds(semantic: DataFrame, keyword: DataFrame) -> DataFrame:
    return semantic.join(keyword, "id", "full_outer").select(
        "id", F.coalesce("semantic_score", F.lit(0.0)).alias("semantic_score"), "semantic_rank", F.coalesce("keyword_score", F.lit(0.0)).alias("keyword_score"), "keyword_rank"
    )


def rrf(*ranks: Column) -> Column:
    score = F.lit(0.0)
    for r in ranks:
        score = score + F.coalesce(1 / (RRF_K + r), F.lit(0.0))
    return F.round(score, 9)


def structural(hops: Column, paths: Column) -> Column:
    return 1 / F.coalesce(hops, F.lit(1)) * F.least(F.coalesce(paths, F.lit(0)), F.lit(3)) / 3


def entity_boost(facts: Column, mentioned: Column) -> Column:
    return F.when(mentioned, F.least(0.5 / F.greatest(facts, F.lit(1)), F.lit(0.5))).otherwise(0.0)


def best_per_text(df: DataFrame, text_col: str, rank: list[Column]) -> DataFrame:
    """Of rows with the same text, stripped and in lower case, the best; empty texts all stay."""
    key = F.lower(T.strip(F.coalesce(F.col(text_col), F.lit(""))))
    w = Window.partitionBy("_key").orderBy(*rank)
    rows = df.withColumn("_key", key)
    empty, filled = rows.filter("_key = ''"), rows.filter("_key <> ''").withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
    return filled.unionByName(empty).drop("_key")


def entity_paths(edges: DataFrame, fact: str, entity: str, seeds_: DataFrame, archived: Column) -> DataFrame:
    """(fact, hops, paths) of the facts of seed entities, by paths of up to three edges that begin at a seed.

    A path entity-fact-entity counts one hop, entity-fact-entity-fact two; one through an archived fact doesn't count.
    It is credited to the candidate facts of the entities at its ends. edges(fact, entity) are distinct. Paths are
    counted by degrees and never listed.
    """
    e = edges.filter(~archived).select(F.col(fact).alias("f"), F.col(entity).alias("e"))
    seed = seeds_.select(F.col(entity).alias("e")).distinct()
    one = e.join(seed, "e").select("f", F.col("e").alias("s"))
    steps = one.join(e, "f").filter("s <> e").select("s", "f", "e")  # entity-fact-entity
    degree = e.join(steps.select("e").distinct(), "e", "left_semi").groupBy("e").agg((F.count("*") - 1).alias("further"))
    short = steps.groupBy("s").agg(F.count("*").alias("n")).unionByName(steps.groupBy(F.col("e").alias("s")).agg(F.count("*").alias("n"))).withColumn("hops", F.lit(1))
    long = steps.join(degree, "e").groupBy("s").agg(F.sum("further").alias("n")).filter("n > 0").withColumn("hops", F.lit(2))
    ends = short.unionByName(long).groupBy(F.col("s").alias("e")).agg(F.sum("n").alias("paths"), F.min("hops").alias("hops"))
    candidates = edges.select(F.col(fact).alias("f"), F.col(entity).alias("e")).join(one.select("f").distinct(), "f", "left_semi")
    found = candidates.join(ends, "e").groupBy("f").agg(F.min("hops").alias("hops"), F.sum("paths").alias("paths"))
    return found.select(F.col("f").alias(fact), "hops", "paths")


RELATED = "[related facts from the same conversation turns]:"


def reader_context(rows: DataFrame, key: str, top: int, today: Column) -> DataFrame:
    """rows(key, n, observed, speaker, text), a bounded number a key -> (key, context): ranked facts one a line with date and
    speaker (user where there is none), then the related ones with date; the day of the question first where today isn't null."""
    day = F.date_format("observed", "yyyy-MM-dd")
    ranked = F.concat(F.lit("["), F.coalesce(day, F.lit("Recent")), F.lit(" | "), F.coalesce("speaker", F.lit("user")), F.lit("]: "), "text")
    related = F.concat(F.lit("- "), F.coalesce(F.concat(F.lit("["), day, F.lit("]: ")), F.lit("")), "text")
    lines = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("n", F.when(F.col("n") <= top, ranked).alias("a"), F.when(F.col("n") > top, related).alias("b")))).alias("l"))
    filled = lambda name: F.filter(F.transform("l", lambda x: x[name]), lambda x: x.isNotNull())
    head = F.when(today.isNotNull(), F.array(F.concat(F.lit("[today's date is "), today, F.lit("]")))).otherwise(F.array().cast("array<string>"))
    tail = F.when(F.size(filled("b")) > 0, F.concat(F.array(F.lit(RELATED)), filled("b"))).otherwise(F.array().cast("array<string>"))
    return lines.select(key, F.array_join(F.concat(head, filled("a"), tail), "\n").alias("context"))
