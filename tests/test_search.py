"""Search over the positional index and blocked nearest vectors, against plain loops."""

import collections
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from conftest import DATA
from tidewell.operators import nearest as N
from tidewell.operators import text_index as IX

VOCABULARY = ["storm", "storms", "storming", "harbor", "light", "lightly", "the", "of", "keeper", "Ünder", "glass", "glasses", "pony", "ponies", "x9"]


def stem(word):
    for ending, kept, least in IX.ENDINGS:
        if word.endswith(ending) and len(word) - len(ending) >= least:
            return word[: len(word) - len(ending)] + kept
    return word


def terms_of(text):
    return [(i, stem(w)) for i, w in enumerate(re.findall(r"[^\W_]+", text.lower())) if w not in IX.STOP_WORDS]


def by_hand(query, text):
    """The rank of a document for a question, by windows that are tried one after another."""
    at = collections.defaultdict(set)
    for i, t in terms_of(text):
        at[t].add(i)
    total, branch, branches = 0.0, [], []
    for part in re.findall(r'-?"[^"]*"|\S+', query):
        if part.lower() == "or":
            branches.append(branch)
            branch = []
        else:
            branch.append((part.startswith("-"), terms_of(part)))
    for branch in [*branches, branch]:
        branch = [(neg, terms) for neg, terms in branch if terms]
        places = [(neg, sorted({p - terms[0][0] for p in at[terms[0][1]]}.intersection(*({p - o for p in at[t]} for o, t in terms)))) for neg, terms in branch]
        if any(neg and s for neg, s in places) or not any(not neg for neg, _ in places) or any(not s for neg, s in places if not neg):
            continue
        parts = [[(s + terms[0][0], s + terms[-1][0], len(terms)) for s in starts] for (neg, terms), (_, starts) in zip(branch, places, strict=True) if not neg]
        events = sorted((b, e, n, i) for i, p in enumerate(parts) for b, e, n in p)
        last, low = {}, None
        for b, e, n, i in events:
            last[i] = (b, e, n)
            if len(last) == len(parts) and min(x[0] for x in last.values()) != low:
                low = min(x[0] for x in last.values())
                noise = max(x[1] for x in last.values()) - low + 1 - sum(x[2] for x in last.values())
                total += 0.1 / (1 + max(noise, 0))
    return round(total, 6)


QUERIES = ["storm", "storms OR harbor", '"storm harbor"', '"light of the keeper" OR glass', "storm harbor", "storm -harbor", '-"storm harbor" light', "the", "", None, "-storm", "pony x9 OR Ünder -glass", '"the storm"', "storm storm", '"storm storm"', "OR OR light or"]


def test_search_by_hand(spark, tmp_path):
    rng = random.Random(4)
    texts = [(i, " ".join(rng.choice(VOCABULARY) for _ in range(rng.choice([0, 3, 12, 60]))) + rng.choice(["", ".", ", Storm-Harbor!"])) for i in range(120)] + [(500, None), (501, "storm " * 5000)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").withColumn("term", F.lit("clash")).withColumn("id", F.lit(1))
    IX.store(IX.postings(docs, buckets=7), f"{tmp_path}/index")
    index = IX.load(spark, f"{tmp_path}/index")
    questions = spark.createDataFrame(list(enumerate(QUERIES)), "question int, query string")
    for source in (IX.postings(docs, buckets=7), index):
        found = collections.defaultdict(list)
        for r in IX.search(source, questions, 10, buckets=7).orderBy("question", "keyword_rank").collect():
            found[r.question].append((r.id, r.keyword_score, r.keyword_rank))
        for i, query in enumerate(QUERIES):
            ranks = sorted(((-by_hand(query or "", t or ""), d) for d, t in texts if by_hand(query or "", t or "") > 0))[:10]
            assert [x[0] for x in found[i]] == [d for _, d in ranks], query
            assert all(math.isclose(s, round(-r / (1 - r), 6), abs_tol=2e-6) and n == at for at, ((r, _), (_, s, n)) in enumerate(zip(ranks, found[i], strict=True), 1)), query
    assert IX.search(IX.postings(docs.limit(0)), questions, 5).collect() == []


def test_search_reads_the_buckets_of_its_terms(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    IX.store(IX.postings(docs), f"{tmp_path}/index")
    questions = spark.createDataFrame([(1, "nothing OR storm")], "question int, query string").cache()
    questions.count()
    plan = IX.search(IX.load(spark, f"{tmp_path}/index"), questions, 5)._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan and "text" not in plan.split("FileScan parquet")[1].split("ReadSchema")[1][:200]


@pytest.mark.parametrize("with_self", [True, False])
def test_nearest_by_hand(spark, monkeypatch, with_self):
    rng = np.random.default_rng(2)
    x = rng.integers(-2, 3, (700, 6)).astype(float)  # many ties, and vectors of no length
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    bad = [(900, None), (901, [1.0]), (902, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (903, [float("nan")] * 6), (None, [1.0] * 6)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>").repartition(5).withColumn("distance", F.lit("clash"))
    unit = {i: v / np.linalg.norm(v) for i, v in enumerate(x) if np.linalg.norm(v) > 0}
    for k in (1, 7, 1000):
        found = collections.defaultdict(list)
        for r in N.nearest(df.filter("vec_id % 20 = 0 or vec_id >= 900"), df, k, 6, with_self=with_self).orderBy("question", "rank").collect():
            found[r.question].append((r.distance, r.id))
        assert set(found) == {i for i in unit if i % 20 == 0}
        for q, near in found.items():
            wanted = sorted((round(float(1 - unit[q] @ v), 6) + 0.0, i) for i, v in unit.items() if with_self or i != q)[:k]
            assert [i for _, i in near] == [i for _, i in wanted] and np.allclose([d for d, _ in near], [d for d, _ in wanted], atol=1e-9)


def test_metrics_at(spark):
    ranked = spark.createDataFrame([(1, 1, False), (1, 2, True), (1, 3, True), (2, 1, False)], "question int, rank long, hit boolean")
    gold = spark.createDataFrame([(1, 4), (2, 1), (3, 0)], "question int, gold long")
    found = {(r.question, r.k): tuple(r)[2:] for r in N.metrics_at(ranked, gold, [1, 2, 3]).collect()}
    assert found[1, 1] == (0.0, 0, 0.0, 0.5) and found[1, 2] == (0.25, 1, 0.5, 0.5) and found[1, 3] == (0.5, 1, 2 / 3, 0.5)
    assert found[2, 3] == (0.0, 0, 0.0, 0.0) and found[3, 1] == (0.0, 0, 0.0, 0.0) and len(found) == 9


def odd_vectors(spark, path):
    """Vectors of which some have no cosine, and labels that are rare, lone or missing."""
    rng = np.random.default_rng(5)
    x = rng.integers(-3, 4, (300, 64)).astype(float)
    rows = [(i, [None, "lone", "rare", *"abc"][0 if i == 40 else 1 if i == 20 else 2 if i in (60, 299) else 3 + i % 3], v.tolist()) for i, v in enumerate(x)]
    x[60] = 1.0
    rows[60], rows[299] = (60, "rare", [1.0] * 64), (299, "rare", [-1.0] * 64)  # the only one of its label lies behind all others
    rows[80], rows[81], rows[100], rows[101] = (80, "a", [0.0] * 64), (81, "a", [0.0] * 64), (100, "b", None), (101, "b", None)
    spark.createDataFrame(rows, "vec_id long, label string, embedding array<float>").repartition(5).write.parquet(f"{path}/embeddings.parquet")


def test_evaluation_with_odd_vectors(spark, duck, tmp_path):
    from conftest import rows
    from tidewell.plans import catalog

    odd_vectors(spark, tmp_path)
    con = duck.cursor()
    con.execute("CREATE SCHEMA odd; USE odd")
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    found = catalog.QUERIES["eval_retrieval_twentieth"](spark, str(tmp_path)).toArrow()
    assert rows(found) == rows(con.sql(catalog.SQL["eval_retrieval_twentieth"]).to_arrow_table())
    assert {r["query"]: r["mrr"] for r in found.to_pylist()}[60] < 1 / 250


def test_vectors_meet_by_parts(spark):
    v = spark.read.parquet(f"{DATA}/embeddings.parquet")
    plan = N.nearest(v.filter("vec_id % 20 = 0"), v, 3, 64)._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan  # which would pack the vectors again for each task of questions


def test_finds_of_a_block_are_one_batch():
    unit = np.eye(4)
    block = lambda *ids: [pa.array([list(ids)], pa.list_(pa.int64()))]
    raw = pa.array([unit.tobytes()], pa.binary())
    pair = lambda at: pa.RecordBatch.from_arrays(block(0, 1, 2, 3) + block(0, 0, 0, 0) + [pa.array([[0.0] * 4]), raw] + block(*range(at, at + 4)) + block(0, 0, 0, 0) + [raw], ["asked", "wanted", "edges", "q", "ids", "codes", "vectors"])
    found = list(N._products(4, 2, True, False)(pair(10 * i) for i in range(5)))
    assert len(found) == 1 and found[0].column("top").to_pylist()[1] == [{"distance": 0.0, "id": 1}, {"distance": 0.0, "id": 11}]


def test_postings_without_a_row_a_word(spark):
    """Terms of a document are put together before anything is shuffled; rows of one id are one document, and stems are those of the questions."""
    words = ["storming", "the", "ponies", "İstanbul", "ness", "agreements", "𐐨ing", "𐐨𐐨𐐨ing", "glass", "s"]
    docs = spark.createDataFrame([(1, " ".join(words)), (1, "storms storm"), (2, None), (3, "the of"), (None, "storm")], "doc_id long, text string")
    index = IX.postings(docs)
    assert "Generate" not in index._jdf.queryExecution().optimizedPlan().toString()
    wanted = collections.defaultdict(list)
    rows = docs.select("doc_id", F.posexplode(IX._words(F.col("text"))).alias("at", "word")).filter(~IX.stop(F.col("word"))).select("doc_id", IX.stem(F.col("word")).alias("term"), "at")
    for r in rows.collect():
        wanted[r.term, r.doc_id].append(r["at"])
    found = {(r.term, r.id): r.positions for r in index.collect()}
    assert found == {k: sorted(v) for k, v in wanted.items()} and found["storm", 1] == [0, 0, 1]
