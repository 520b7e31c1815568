"""Fill-in-the-middle, centroid clustering and packing, against versions that go row by row."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from conftest import DATA, rows
from tidewell.llm import bpe, centroids, fill_middle, packing
from tidewell.llm.queries import QUERIES, SQL

SCHEMA = "doc_id long, text string, lang string"
EXTRA = ["key", "n", "form", "output", "batch", "row", "start", "length", "group", "cluster", "x", "v", "distance", "h", "ids", "sequence_id"]
AWKWARD = [
    (1, None, "en"), (2, "", "en"), (3, " \t\n", None), (4, "one", "en"), (5, "  two words \x0b", "en"), (5, "  two words \x0b", "en"), (None, "null id " * 40, "de"),
    (7, "very long " * 60_000, "en"), (8, "a <P> b <S> c <M>", "en"), (9, "<S", "en"), (10, "ends in <P", "en"), (11, "M> begins so <", "fr"), (12, "Ünïcöde näïve 漢字 \U0001f600 x", "zh"), (13, "nul \x00 byte", "en"),
]


@pytest.fixture(scope="module")
def awkward(spark):
    base = spark.createDataFrame(AWKWARD + [(i, f"short text {i} with <S and M> words {'x ' * (i % 37)}", "en") for i in range(100, 400)], SCHEMA)
    return base.select("*", *(F.lit("x").alias(c) for c in EXTRA)).cache()


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("name", ["op11_fill_in_middle", "op12_centroids"])
def test_query_equals_its_sql(spark, duck, name):
    assert rows(QUERIES[name](spark, DATA).toArrow()) == rows(duck.sql(SQL[name]).to_arrow_table())


def middle_by_hand(doc_id, text, seed=42, rate=50, spm=80):
    text = text or ""
    tokens = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    h = sha(f"{seed}:{'' if doc_id is None else doc_id}")
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    n = len(tokens)
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return doc_id, n, "plain", text, None, None
    before, middle, after = "".join(tokens[:low]), "".join(tokens[low:high]), "".join(tokens[high:])
    if h4 % 100 < spm:
        return doc_id, n, "spm", f"<S>{after}<P>{before}<M>{middle}", len(before), len(middle)
    return doc_id, n, "psm", f"<P>{before}<S>{after}<M>{middle}", len(before), len(middle)


@pytest.mark.parametrize(("values", "most"), [({}, 1_000), ({"rate": 100, "spm": 50}, 4_000_000), ({"rate": 100, "spm": 0, "seed": 7}, 50), ({"rate": 100, "spm": 100}, 4_000_000), ({"rate": 0}, 4_000_000)])
def test_fill_in_middle_by_hand(awkward, values, most):
    made = fill_middle.fill_in_middle(awkward, batch_bytes=most, **values)
    found = made.select("doc_id", "n", "form", "output", "prefix_chars", "middle_chars", fill_middle.restored(F.col("output"), F.col("form")).alias("back"))
    expected = collections.Counter((*middle_by_hand(r["doc_id"], r["text"], **values), r["text"] or "") for r in awkward.collect())
    assert collections.Counter(map(tuple, found.collect())) == expected
    forms = {x[2] for x in expected}
    assert forms == ({"plain"} if values.get("rate") == 0 else {"plain", "spm"} if values.get("spm") == 100 else {"plain", "psm"} if values.get("spm") == 0 else {"plain", "spm", "psm"})


def test_fill_in_middle_empty(spark):
    assert fill_middle.fill_in_middle(spark.createDataFrame([], SCHEMA)).collect() == []


def clusters_by_hand(vectors, k, rounds, seed=1):
    """All distances, in Python's own whole numbers; vectors are (id, list of whole numbers)."""
    first = sorted(vectors, key=lambda r: (sha(f"{seed}:{'' if r[0] is None else r[0]}"), r[1]))[:k]
    centres = [list(x) for _, x in first]

    def nearest(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), j) for j, c in enumerate(centres))

    for _ in range(rounds):
        own = [nearest(x)[1] for _, x in vectors]
        for j in range(len(centres)):
            mine = [x for (_, x), o in zip(vectors, own, strict=True) if o == j]
            if mine:
                centres[j] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    return [(i, nearest(x)[1], nearest(x)[0]) for i, x in vectors], centres


@pytest.mark.parametrize(("spread", "k", "rounds"), [(3, 5, 4), (1, 16, 3), (1000, 7, 0), (50_000_000, 4, 3)])
def test_clusters_by_hand(spark, spread, k, rounds):
    """Small spreads give many ties and repeated vectors, large ones sums and squares near the bounds."""
    rng = np.random.default_rng(spread)
    vectors = [(None if i % 50 == 0 else i % 190, rng.integers(-spread, spread + 1, 4).tolist()) for i in range(400)]
    bad = [(1, None), (2, []), (3, [1.0, 2.0, None, 4.0]), (4, [1.0, float("nan"), 3.0, 4.0]), (5, [1.0, 2.0, float("inf"), 4.0]), (6, [1.0] * 5)]
    df = spark.createDataFrame([(i, [v / 2 + 0.25 for v in x]) for i, x in vectors] + bad, "vec_id long, embedding array<double>").repartition(7)
    df = df.select("*", *(F.lit("x").alias(c) for c in EXTRA))
    found, centres = centroids.cluster(df, k=k, rounds=rounds, dimensions=4, scale=2)
    expected, expected_centres = clusters_by_hand(vectors, k, rounds)
    assert centres.tolist() == expected_centres
    assert collections.Counter(map(tuple, found.collect())) == collections.Counter(expected)


def test_bounds_spare_distances_and_hold():
    rng = np.random.default_rng(5)
    middle = rng.integers(-500, 500, (8, 16))
    x = (middle[rng.integers(0, 8, 3000)] + rng.integers(-20, 20, (3000, 16))).astype(np.int64)
    centres, moved, spared = x[:8].copy(), None, []
    own, upper, lower = np.zeros(3000, np.int64), np.full(3000, np.inf), np.zeros((3000, 8), np.float32)
    for _ in range(5):
        if moved is not None:
            upper, lower = centroids.widened(upper, lower, own, moved)
        spared.append(3000 * 8 - centroids.elkan(x, own, upper, lower, centres))
        all_ = ((x[:, None] - centres[None]) ** 2).sum(axis=2)
        assert (own == all_.argmin(axis=1)).all()
        assert (np.sqrt(all_) >= lower).all()
        assert (np.sqrt(all_[np.arange(3000), own]) <= upper).all()
        new = np.array([x[own == j].sum(axis=0) // max(1, (own == j).sum()) if (own == j).any() else centres[j] for j in range(8)])
        moved, centres = np.sqrt(((new - centres) ** 2).sum(axis=1)), new
    assert spared[-1] > 0.6 * 3000 * 8  # a vector's own distance alone is an eighth


def test_clusters_of_few_or_no_vectors(spark):
    one = spark.createDataFrame([(3, [0.5, -0.5])], "vec_id int, embedding array<float>")
    found, centres = centroids.cluster(one, dimensions=2)
    assert [tuple(r) for r in found.collect()] == [(3, 0, 0)] and centres.tolist() == [[32, -32]]
    found, centres = centroids.cluster(one.limit(0), dimensions=2)
    assert found.collect() == [] and len(centres) == 0
    with pytest.raises(Exception, match="beyond"):
        centroids.cluster(spark.createDataFrame([(1, [1e12])], "vec_id long, embedding array<double>"), dimensions=1)


def test_query_of_clusters_without_vectors(spark, tmp_path):
    spark.createDataFrame([(1, [1.0], 0)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert QUERIES["op12_centroids"](spark, str(tmp_path)).collect() == []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 64), min_size=1, max_size=80))
def test_first_fit_decreasing_by_hand(sizes):
    held: list[list[int]] = []
    for p in sorted(range(len(sizes)), key=lambda p: -sizes[p]):
        for s in held:
            if sum(sizes[q] for q in s) + sizes[p] <= 64:
                s.append(p)
                break
        else:
            held.append([p])
    assert packing.first_fit_decreasing(np.array(sizes), 64) == held


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 64), min_size=1, max_size=80), st.sampled_from([1, 4]))
def test_sequences_hold_every_token_once(sizes, sliver):
    sequences = packing.packed(np.array(sizes), 64, sliver)
    places = sorted((p, i) for s in sequences for p, start, n in s for i in range(start, start + n))
    assert places == [(p, i) for p, n in enumerate(sizes) for i in range(n)]
    for used in (sum(n for _, _, n in s) for s in sequences):
        assert 64 - sliver < used <= 64 or used & (used - 1) == 0


def check_packed(found, docs, length):
    """Pieces tile their documents, sequences are gapless, ids are the library's; gives padding as a share of tokens."""
    tokenizer = bpe._tokenizer(bpe.default_tokenizer())
    expected = collections.Counter((d, tuple(tokenizer.encode(t or "", add_special_tokens=False).ids) + (2,)) for d, t in docs)
    whole, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in found:
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert len(ids) == r["length"] > 0
        whole[r["row"], r["doc_id"], r["doc_tokens"]].append((r["start"], ids))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    got = collections.Counter()
    for (_, d, n), pieces in whole.items():
        pieces.sort()
        assert [s for s, _ in pieces] == np.cumsum([0] + [len(i) for _, i in pieces[:-1]]).tolist()
        ids = tuple(i for _, p in pieces for i in p)
        assert len(ids) == n
        got[d, ids] += 1
    assert got == expected
    tokens = padding = 0
    for pieces in sequences.values():
        used = 0
        for offset, n in sorted(pieces):
            assert offset == used
            used += n
        assert used <= length
        tokens, padding = tokens + used, padding + (0 if used & (used - 1) == 0 else length - used)
    return padding / tokens


@pytest.mark.parametrize(("length", "group"), [(4096, 2_000_000), (64, 5_000)])
def test_packing(awkward, length, group):
    found = packing.pack(awkward, bpe.default_tokenizer(), length=length, group_tokens=group).collect()
    assert len({r["sequence_id"] >> 32 for r in found}) > (1 if group < 10_000 else 0)
    assert check_packed(found, [(r["doc_id"], r["text"]) for r in awkward.collect()], length) < 8 / 64


def test_packing_of_all_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    found = packing.pack(docs, bpe.default_tokenizer()).collect()
    assert check_packed(found, [(r["doc_id"], r["text"]) for r in docs.collect()], 4096) < 0.002
    query = {(r["doc_id"], r["start"]): r for r in QUERIES["op13_packing"](spark, DATA).collect()}
    assert len(query) == len(found)
    for r in found:
        q = query[r["doc_id"], r["start"]]
        assert (q["ids_crc32"], q["length"], q["sequence_id"], q["offset"]) == (zlib.crc32(r["ids"]), r["length"], r["sequence_id"], r["offset"])


def test_packing_keeps_documents_whole_where_they_fit(spark):
    """Only what fills room or ends a group is cut: fewer pieces than documents and sequences together."""
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.sequence(F.lit(0), F.col("id") % 301)).alias("text"))
    found = packing.pack(docs, bpe.default_tokenizer()).select("row", "sequence_id", "doc_tokens").collect()
    sequences = len({r["sequence_id"] for r in found})
    assert len(found) <= 3000 + math.ceil(sequences)
    assert packing.pack(docs.limit(0), bpe.default_tokenizer()).collect() == []
    with pytest.raises(ValueError):
        packing.pack(docs, bpe.default_tokenizer(), length=1000)


def test_words_of_another_order_end_the_job(spark):
    """Rows that come in another order at each read must not get the ids of other words."""

    def shuffled(batches):
        for b in batches:
            yield b.take(pa.array(np.random.default_rng().permutation(b.num_rows)))

    docs = spark.createDataFrame([(i, f"word{i} and others{i * 7} of row {i}") for i in range(60)], "doc_id long, text string").coalesce(1)
    assert bpe.encode(docs, bpe.default_tokenizer()).count() == 60
    for made in (bpe.encode, bpe.encode_digests, packing.pack):
        with pytest.raises(Exception, match="differ between two reads"):
            made(docs.mapInArrow(shuffled, docs.schema), bpe.default_tokenizer()).collect()
