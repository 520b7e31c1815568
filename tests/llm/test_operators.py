"""Each operator against a brute-force version, on the small tables and on rows made to be awkward."""

import collections
import hashlib
import math
import re
import types
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from conftest import DATA, rows
from tidewell.llm import bpe, exact_dedup, fingerprints, html_text, katz, language, licenses, mixing, quality, queries, simhash, tokens

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
AWKWARD = [
    (1, None, "en", "a"), (2, "", "en", None), (3, " \t\n", None, "a"), (4, "Same Text here É", "en", "b"), (5, "same text HERE É", "en", "b"), (5, "same text HERE É", "en", "b"),
    (None, "null id " * 30, "de", "a"), (7, "word " * 30_000, "en", "b"), (8, "<|endoftext|> it's 42 x", "en", "a"), (9, "Released under the MIT licence. Apache license, version 2.0", "en", "a"),
]
SCHEMA = "doc_id long, text string, lang string, source string"
EXTRA = ["id", "row", "digest", "n", "k", "fp", "part", "_tw_id", "h", "size", "start", "doc", "train", "bucket", "label_id", "stats"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="module")
def awkward(spark):
    df = spark.createDataFrame(AWKWARD, SCHEMA)
    return df.select("*", *(F.lit("x").alias(c) for c in EXTRA)).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def texts(df):
    return [(r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect()]


def words(text):
    return [w for w in re.split("[\x20\x09-\x0d]+", text.translate(LOWER)) if w]


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_its_sql(spark, duck, name):
    assert rows(queries.QUERIES[name](spark, DATA).toArrow()) == rows(duck.sql(queries.SQL[name]).to_arrow_table())


@pytest.mark.parametrize("hex_digits", [64, 1])
def test_exact_dedup(docs, awkward, empty, hex_digits):
    for df in (docs, awkward):
        groups = collections.defaultdict(list)
        for i, t in texts(df):
            groups[t.translate(LOWER)].append(-1 if i is None else i)
        found = exact_dedup.exact_dedup(df, digest_hex=hex_digits).collect()
        sha = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
        assert len(found) == df.count()
        assert sum(r.kept for r in found) == len(groups)
        for r in found:
            ids = sha[r.text_sha256]
            assert (r.group_size, -1 if r.keep_id is None else r.keep_id) == (len(ids), max(ids))
    kept = exact_dedup.drop_copies(awkward)
    assert kept.columns == awkward.columns and kept.count() == len({t.translate(LOWER) for _, t in texts(awkward)})
    assert exact_dedup.exact_dedup(empty).count() == exact_dedup.drop_copies(empty).count() == 0


def test_exact_dedup_in_many_batches(docs):
    one = sorted(map(tuple, exact_dedup.exact_dedup(docs).drop("locator").collect()))
    assert sorted(map(tuple, exact_dedup.exact_dedup(docs.repartition(6), files_per_trigger=1).drop("locator").collect())) == one


@pytest.mark.parametrize("hex_digits", [64, 1])
def test_exact_dedup_goes_on_from_kept_state(spark, docs, tmp_path, hex_digits):
    state = f"file://{tmp_path}/state"
    first, second = docs.filter("doc_id % 3 <> 0").select("doc_id", "text"), docs.filter("doc_id % 3 = 0").select("doc_id", "text")
    exact_dedup.exact_dedup(first, digest_hex=hex_digits, state=state).count()
    found = exact_dedup.exact_dedup(second, digest_hex=hex_digits, state=state, earlier=first).collect()
    ids = collections.defaultdict(list)
    for i, t in texts(docs):
        ids[hashlib.sha256(t.translate(LOWER).encode()).hexdigest()].append(i)
    assert len(found) == second.count() and any(r.keep_id % 3 for r in found)
    for r in found:
        same = ids[r.text_sha256]
        assert (r.group_size, r.keep_id, r.kept) == (len(same), max(same), r.doc_id == max(same))


def test_locators_find_the_content(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    found = exact_dedup.exact_dedup(docs)
    rows_ = exact_dedup.content_at(docs, found).select("locator", "doc_id", "text").collect()
    kept = {r.locator: r for r in rows_}
    for r in found.collect():
        assert hashlib.sha256((kept[r.locator].text or "").translate(LOWER).encode()).hexdigest() == r.text_sha256 and kept[r.locator].doc_id == r.keep_id


def test_fingerprints(docs, awkward, empty):
    for df in (docs, awkward):
        order = sorted(texts(df), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        wanted = []
        for (i, t), (_, after) in zip(order, order[1:] + order[:1], strict=True):
            quarter = len(t) // 4
            wanted.append((i, len(t), hashlib.sha256((t[: len(t) - quarter] + after[:quarter]).encode()).hexdigest()))
        found = fingerprints.fingerprints(df).collect()
        assert sorted(wanted, key=repr) == sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in found), key=repr)
        assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in found)
    found = fingerprints.fingerprints(docs).filter("n_chars > 600").agg(F.avg("near_edited").alias("edited"), F.percentile_approx("near_next", 0.5).alias("next")).first()
    assert found.edited > 0.5 and found.next < 0.2
    assert fingerprints.fingerprints(empty).count() == 0


def test_fingerprints_of_short_texts(docs):
    rank = fingerprints.rarity(fingerprints.bin_counts(docs))
    long = [t for _, t in texts(docs) if len(t) > 1200][:20]
    found = []
    for n in range(10, 201):
        one, two = long[n % 20][300 : 300 + n], long[(n + 7) % 20][500 : 500 + n]
        a, b, e = fingerprints.digests([t.encode() for t in (one, two, fingerprints.edited(one, two))], rank)
        found.append((fingerprints.likeness(a, e), fingerprints.likeness(a, b)))
    # Of a text that repeats one word but for its last quarter, most of what differs is new.
    assert all(x > 0.3 > y for x, y in found) and sum(x for x, _ in found) > 0.65 * len(found)


def test_ranges_of_ids(spark):
    import bisect

    for cuts in ([], [5], [1, 4, 4000], list(range(0, 300, 7))):
        found = spark.range(-3, 310).select("id", fingerprints.range_of(F.col("id"), cuts).alias("part")).collect()
        assert [r.part for r in found] == [bisect.bisect_left(cuts, r.id) for r in found]
    with pytest.raises(TypeError):
        fingerprints.fingerprints(spark.createDataFrame([("a", "b")], "doc_id string, text string"))


def test_fingerprints_by_force(docs):
    """Selection, filters and likeness of some texts by their definition."""
    import numpy as np

    rank = fingerprints.rarity(fingerprints.bin_counts(docs))
    for _, text in [x for x in texts(docs) if 600 < len(x[1]) < 3000][:6]:
        data = text.encode()
        bins = fingerprints.entropy_bins(np.frombuffer(data, np.uint8)).tolist()
        ranks = [int(rank[b]) for b in bins]
        wins = collections.Counter()
        for i in range(len(ranks) - fingerprints.NEIGHBOURS + 1):
            part = ranks[i : i + fingerprints.NEIGHBOURS]
            wins[i + part.index(min(part))] += 1
        strong = [i for i, n in sorted(wins.items()) if n >= fingerprints.WINS]
        assert len(strong) >= fingerprints.FEW
        (found,) = fingerprints.digests([data], rank)
        same = fingerprints.digests([data, data[:300] + data[300:]], rank)
        assert found == same[0] == same[1] and fingerprints.likeness(found, found) == 1
        bits = sum(b.bit_count() for b in found)
        assert 0 < bits <= fingerprints.HASHES * len(strong) + 64


def test_fingerprint_bins_by_definition():
    import numpy as np

    data = np.frombuffer(b"abcabcaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa" + bytes(range(120)), np.uint8)
    for k, b in enumerate(fingerprints.entropy_bins(data)):
        n = collections.Counter(data[k : k + 64].tolist())
        assert abs(b - 1000 * -sum(c / 64 * math.log2(c / 64) for c in n.values()) / 6) <= 1


def cut_by_force(costs, links):
    labels = ([bool(m >> i & 1) for i in range(len(costs))] for m in range(1 << len(costs)))
    return min(charge(x, costs, links) for x in labels)


def charge(labels, costs, links):
    return sum(abs(c) for lab, c in zip(labels, costs, strict=True) if (c > 0) != lab and c) + sum(c for i, j, c in links if labels[i] != labels[j])


def test_minimum_cut_is_least():
    import random

    rng = random.Random(5)
    for _ in range(150):
        n = rng.randint(1, 9)
        costs = [rng.randint(-9, 9) for _ in range(n)]
        links = [(i, j, rng.randint(1, 6)) for i in range(n) for j in range(i + 1, n) if rng.random() < 0.4]
        assert charge(html_text.minimum_cut(costs, links), costs, links) == cut_by_force(costs, links)


PAGE = """<html><head><title>T</title><style>p{}</style></head><body><header><h1>Site</h1></header><div class="cookie-notice"><p>We use cookies on this site, as all do.</p></div>
<nav><ul><li><a href=x>Home</a></ul></nav><article><header><h1>The &lt;title&gt;</h1></header><p>First   paragraph, caf&eacute;<br>and more of it.<p>Second <b>bold</b> one is here.
<script>var a = "</p>";</script><aside>Aside</aside><form><p>Name</p><input></form><section id="comments"><p>Great article, thank you all so much.</p></section></article><footer>c</footer>"""


def test_html(spark):
    assert html_text.main_text(PAGE) == "The <title>\nFirst paragraph, café and more of it.\nSecond bold one is here."
    assert [html_text.main_text(x) for x in ("", "<!-- a", "<p", "<nav>Menu of the site</nav>")] == [""] * 4
    pages = spark.createDataFrame([(1, None, None), (1, "u", PAGE), (None, "u", "<p>word " * 3000)], "page_id long, url string, html string").withColumn("text", F.lit(1))
    found = {(r.page_id, r.url): r.n_chars for r in html_text.extract_text(pages).collect()}
    assert found[1, None] == 0 and found[1, "u"] == len(html_text.main_text(PAGE)) and len(found) == 3
    assert html_text.extract_text(pages.limit(0)).count() == 0
    nested = "<div>" + "<b>" * 40 + "x " * 30
    assert html_text.main_text(f"<article><p>{PAGE[-60:-30]}</p>{nested}</article>").endswith("x x")


def test_html_marks_beside_other_words():
    text = "This is a long paragraph of an article that has many words, hardly any links, and goes on for a while to say what it says."
    article = f"<article><h1>Title</h1><p>{text}</p><p>Short one.</p></article>"
    for name in ("layout has-sidebar", "page-with-banner", "elementor-widget-wrap", "post form-wide", "no-comments", "noticeBoard widgetArea"):
        assert html_text.main_text(f'<body><div class="{name}">{article}</div></body>') == f"Title\n{text}\nShort one."
        assert html_text.main_text(f'<body><div class="{name}"><p>{text}</p><p>{text}</p></div></body>') == f"{text}\n{text}"
        assert html_text.main_text(f'<article><h1>Title</h1><div class="{name}"><p>{text}</p></div></article>') == f"Title\n{text}"
    for name in ("sidebar", "cookie-notice", "ad ad-1", "share-buttons", "post-share", "footerLinks"):
        assert html_text.main_text(f'<body>{article}<div class="{name}"><a href=x>Share</a> it here</div></body>') == f"Title\n{text}\nShort one."
    for name in ("share-buttons", "related-promo", "sidebar"):
        assert html_text.main_text(f'<article><p>{text}</p><div class="{name}"><p>Tell all of your friends</p></div><p>{text}</p></article>') == f"{text}\n{text}"
    assert html_text.main_text(f'<div class="sidebar"><p>{text}</p></div>') == html_text.main_text(f"<aside><p>{text}</p></aside>") == ""


def test_html_articles(spark):
    import html

    for r in queries.QUERIES["op3_html"](spark, DATA).join(spark.read.parquet(f"{DATA}/pages.parquet").select("page_id", "html"), "page_id").collect():
        body = re.search(r"<article>(.*?)(?:</article>|$)", r.html, re.S)[1]
        parts = (" ".join(html.unescape(re.sub(r"<br>", " ", re.sub("</?b>", "", p))).split()) for p in re.split(r"</?(?:p|h1)>", body))
        assert r.text == "\n".join(p for p in parts if p)


def test_html_cut_changes_labels(spark):
    pages = [r.html for r in spark.read.parquet(f"{DATA}/pages.parquet").select("html").collect()]
    changed = total = 0
    for page in pages:
        _, costs, keep = html_text.labelled(page)
        changed, total = changed + sum((c >= 0) != k for c, k in zip(costs, keep, strict=True)), total + len(costs)
    assert 0.03 < changed / total < 0.3  # the classifier alone would lose titles and short paragraphs
    long = "This paragraph tells what the page is about, in a good many words, and it has no link in it at all."
    page = f"<body><nav><ul><li><a href=x>Home</a><li><a href=y>More</a></ul></nav><div><h2>News</h2><p>{long}</p><p>So it is</p><p>{long}</p></div><footer>All of it (c) us</footer></body>"
    assert html_text.main_text(page) == f"News\n{long}\nSo it is\n{long}"
    assert html_text.main_text(f"<table><tr><td><a href=x>One</a><td><p>{long}<p>So it is<p>{long}</table>") == f"{long}\nSo it is\n{long}"


def test_language_by_force():
    import zstandard

    dictionaries = {"a": b"the cat and the dog and the house of that man " * 20, "b": "der Hund und die Katze und das Haus von dem Mann ".encode() * 20}
    for text in ("The cat, the house!", "und das Haus", "x", "the dog und die Katze " * 300):
        raw = " ".join("".join(c if c.isalpha() or ord(c) > 127 else " " for c in text.lower()).split()).encode()
        step = max(7, -(-len(raw) // 40))
        pieces = [raw[i : i + 4096] for i in range(0, len(raw), 4096)] + [raw[i : i + 40] for i in range(0, len(raw), step)]
        wanted = []
        for d in dictionaries.values():
            held = zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            coder = zstandard.ZstdCompressor(dict_data=held, compression_params=zstandard.ZstdCompressionParameters(**language.PARAMETERS))
            wanted.append(sum(len(coder.compress(p)) for p in pieces))
        sizes = language.Sizes(dictionaries)(text)
        best, score, margin = language.judge(sizes)
        assert sizes.tolist() == wanted and best == wanted.index(min(wanted)) and margin == (max(wanted) - min(wanted)) / min(wanted) and 0.5 <= score <= 1


def test_language(spark, docs, awkward, empty):
    found = queries.QUERIES["op4_language"](spark, DATA)
    judged = found.join(docs.select("doc_id", "lang"), "doc_id").filter("held_out")
    assert judged.filter("lang_pred = lang").count() >= 0.95 * judged.count() > 0
    learned = language.sample(docs.select(F.col("doc_id").alias("id"), "text", "lang"))
    odd = {r.doc_id: r.lang_pred for r in language.identify(awkward, learned).collect()}
    assert [odd[i] for i in (1, 2, 3)] == ["und"] * 3 and odd[4] in learned
    assert language.identify(empty, learned).count() == 0
    assert {r.lang_pred for r in language.identify(awkward, language.sample(empty.withColumnRenamed("doc_id", "id"))).collect()} == {"und"}


def test_words_of_slices_and_of_many_batches(spark):
    import pyarrow as pa

    texts_ = pa.array([f"A{i} b  C{i % 7}" for i in range(50)])
    offsets, found = tokens.split_words(texts_.slice(13, 20), lower=True)
    assert found.to_pylist() == [w for i in range(13, 33) for w in (f"a{i}", "b", f"c{i % 7}")] and offsets.tolist() == list(range(0, 61, 3))
    df = spark.range(2500).select(F.col("id").alias("doc_id"), F.concat(F.lit("Doc "), "id", F.lit(" of all")).alias("text")).coalesce(1)
    assert katz.katz_scores(df, F.lit(True)).agg(F.sum("n_tokens"), F.sum("n_known"), F.max("train_tokens")).first() == (12500, 12500, 12500)
    path = bpe.default_tokenizer()
    t = bpe._tokenizer(path)
    wanted = {i: len(t.encode(f"Doc {i} of all", add_special_tokens=False).ids) for i in range(2500)}
    assert {r.doc_id: r.n_tokens for r in bpe.encode_digests(df, path).collect()} == wanted


def test_blocks_hold_no_texts():
    """What is held of a block's texts is their codes: 20 MB of texts in one block once took 20 MB before they were split."""
    import pyarrow as pa

    base, most, parts = pa.total_allocated_bytes(), 0, [[f"{chr(97 + i)}{j} {'y' * 1000}" for j in range(2)] * 500 for i in range(20)]

    def batches():
        nonlocal most
        for i, part in enumerate(parts):
            yield pa.RecordBatch.from_arrays([pa.array(range(i * 1000, i * 1000 + 1000)), pa.array(part)], ["row", "text"])
            most = max(most, pa.total_allocated_bytes() - base)

    ((first, rows_, offsets, codes, found),) = tokens.text_blocks(batches(), most=30_000_000)
    assert (first, rows_.column("row").to_pylist(), offsets.tolist()) == (0, list(range(20_000)), list(range(0, 40_001, 2)))
    said = [w.encode() for part in parts for t in part for w in t.split()]
    code = {w: k for k, w in enumerate(dict.fromkeys(said))}
    assert found.to_pylist() == list(code) and codes.tolist() == [code[w] for w in said]
    assert most < 10_000_000


@pytest.mark.parametrize("most", [1, 50, 400, 10**6])
def test_blocks_end_at_the_same_rows_in_any_batches(most):
    import pyarrow as pa

    table = pa.table({"row": list(range(200)), "text": [None if i % 17 == 0 else "w" * (i % 40) + f" x{i % 5}" for i in range(200)]})
    found = [[(b, r.column("row").to_pylist(), o.tolist(), c.tolist(), w.to_pylist()) for b, r, o, c, w in tokens.text_blocks(iter(table.to_batches(n)), most=most)] for n in (200, 64, 7, 1)]
    assert found[0] == found[1] == found[2] == found[3] and [i for x in found[0] for i in x[1]] == list(range(200))
    assert len(found[0]) == {1: 200, 10**6: 1}.get(most, len(found[0]))


def test_bpe_where_the_two_reads_have_other_batches(docs, monkeypatch):
    path = bpe.default_tokenizer()
    wanted = sorted(map(tuple, bpe.encode_digests(docs, path, block=50_000).collect()))
    monkeypatch.setattr("tidewell.llm.common.BATCH_BYTES", 7_000)
    assert sorted(map(tuple, bpe.encode_digests(docs, path, block=50_000).collect())) == wanted


def test_texts_come_in_batches_of_few_bytes(spark):
    import pyarrow as pa

    from tidewell.llm.common import BATCH_BYTES, BATCH_CONF, written

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], ["n", "b"])

    docs_, before = spark.range(0, 4000, 1, 1).select(F.repeat(F.lit("text "), 1000).alias("text")), spark.conf.get(BATCH_CONF)
    found = written(docs_.mapInArrow(sizes, "n long, b long"), texts=True).agg(F.sum("n"), F.max("b")).first()
    assert found[0] == 4000 and found[1] < 1.1 * BATCH_BYTES and spark.conf.get(BATCH_CONF) == before


class KatzByForce:
    """Orders 1 to 3 over token lists, by dictionaries."""

    def __init__(self, taught):
        self.n = [collections.defaultdict(collections.Counter) for _ in range(3)]
        for s in taught:
            for k, w in enumerate(s):
                h = (["", "", *s])[k : k + 2]
                for order in range(3):
                    self.n[order][tuple(h[2 - order :])][w] += 1
        self.uni = self.n[0][()]
        self.d = [katz.discounts([sum(c == r for x in n.values() for c in x.values()) for r in range(1, 7)]) for n in self.n]
        self.tokens = sum(self.uni.values())
        ones, twos = (sum(c == r for c in self.uni.values()) for r in (1, 2))
        self.left = 1 - sum(self.d[0][min(c, 6)] * c for c in self.uni.values()) / self.tokens
        self.unseen = max(1, ones**2 / (2 * max(1, twos)))
        self.weights = {}

    def p(self, h, w):
        if not h:
            return self.d[0][min(self.uni[w], 6)] * self.uni[w] / self.tokens if w in self.uni else self.left / self.unseen
        seen = self.n[len(h)].get(h)
        if not seen:
            return self.p(h[1:], w)
        if h not in self.weights:
            total, d = sum(seen.values()), self.d[len(h)]
            mass = sum(d[min(c, 6)] * c / total for c in seen.values())
            full = mass >= 1 - 1e-12
            total, mass = (total + 1, total / (total + 1)) if full else (total, mass)
            self.weights[h] = total, full, (1 - mass) / (1 - sum(self.p(h[1:], x) for x in seen))
        total, full, weight = self.weights[h]
        return (1 if full else self.d[len(h)][min(seen[w], 6)]) * seen[w] / total if w in seen else weight * self.p(h[1:], w)


@pytest.mark.parametrize("limits", [{}, {"hot": 100, "bucket": 2000}, {"bucket": 1000, "most_parts": 5, "hot": 150}, {"bucket": 500, "hot": 20}])
def test_katz(docs, awkward, limits):
    df = docs.select("doc_id", "text", "lang", "source").limit(60).unionByName(awkward.select("doc_id", "text", "lang", "source")).cache()
    train = F.coalesce(F.col("doc_id") % 4 != 0, F.lit(True))
    tokens = lambda t: [*words(t), "\n"]
    force = KatzByForce([tokens(t) for i, t in texts(df) if i is None or i % 4])
    for h in [*list(force.n[1])[:40], *list(force.n[2])[:40]]:  # each history sums to one
        assert abs(sum(force.p(h, w) for w in force.uni) + force.unseen * force.p(h, "no such word") - 1) < 1e-9
    wanted = []
    for i, t in texts(df):
        s = tokens(t)
        base = sum(math.log10((force.uni.get(w, 0) + 0.1) / (force.tokens + 0.1 * (len(force.uni) + 1))) for w in s)
        h = ["", "", *s]
        score = sum(math.log10(force.p(tuple(h[k : k + 2]), w)) for k, w in enumerate(s))
        wanted.append((i, len(s), sum(w in force.uni for w in s), force.tokens, base, score))
    found = [(r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in katz.katz_scores(df, train, **limits).collect()]
    key = lambda r: repr(r[:3]) + f"{r[4]:.0f}"
    for a, b in zip(sorted(found, key=key), sorted(wanted, key=key), strict=True):
        assert a[:4] == b[:4] and a[4:] == pytest.approx(b[4:], abs=0.02)


def test_katz_without_rows(empty, awkward):
    assert katz.katz_scores(empty, F.lit(True)).count() == 0
    assert all(r.score == r.base_score == 0 for r in katz.katz_scores(awkward, F.lit(False)).collect())


def test_katz_has_no_row_a_word(docs, monkeypatch):
    """Words travel in packs: a row for each word of each block, sorted and joined by Spark, took half of the CPU time."""
    made, write = [], katz.written

    def spy(df, **more):
        out = write(df, **more)
        made.append(out.count())
        return out

    monkeypatch.setattr(katz, "written", spy)
    katz.katz_scores(docs, F.lit(True)).count()
    assert made and max(made) < len({w for _, t in texts(docs) for w in words(t)}) / 2


@pytest.mark.parametrize(("parts", "hot"), [(1, 10**6), (5, 40)])
def test_katz_ids_of_words(docs, awkward, parts, hot):
    """Ids are FIRST and the following, rise as counts fall, and are the same in all blocks; hot words have their places."""
    df = docs.select("doc_id", "text").limit(200).unionByName(awkward.select("doc_id", "text")).repartition(3).withColumn("train", F.coalesce(F.col("doc_id") % 4 != 0, F.lit(True)))
    rows_ = df.withColumn("row", F.monotonically_increasing_id()).select("row", "doc_id", "text", "train").cache()
    every, taught = collections.Counter(), collections.Counter()
    for r in rows_.collect():
        every.update(words(r.text or ""))
        taught.update(words(r.text or "") if r.train else [])
    blocks = katz.blocks_of(rows_)
    counted = katz.counted_words(blocks, parts, hot)
    steps = katz.steps_of(counted)
    held = katz.held_words(counted, steps, 0, 210, 150, hot)
    found = {}  # (block, code): id
    packs = counted.filter("block is not null").select("part", "block", "pack")
    for r in packs.groupBy("part").cogroup(steps.groupBy("part")).applyInArrow(katz._named(types.SimpleNamespace(value=held)), "asked_by long, pack binary").collect():
        codes, ids = tokens.unsqueezed(bytes(r.pack), 2)
        found |= {(r.asked_by, int(c)): int(i) for c, i in zip(codes.cumsum(), ids, strict=True)}
    ids = collections.defaultdict(set)
    for r in blocks.filter("words is not null").collect():
        lengths, _, _, text = tokens.unsqueezed(bytes(r.words), 4)
        text, at = bytes(text.astype("u1")), 0
        for code, n in enumerate(lengths.tolist()):
            ids[text[at : at + n].decode()].add(found.pop((r.block, code)))
            at += n
    assert not found and {len(x) for x in ids.values()} == {1}
    id_of = {w: min(x) for w, x in ids.items()}
    assert set(id_of) == set(every) and sorted(id_of.values()) == list(range(katz.FIRST, katz.FIRST + len(every)))
    order = sorted(id_of, key=id_of.get)
    assert [taught[w] for w in order] == sorted((taught[w] for w in order), reverse=True)
    assert held.count(np.array([id_of[w] for w in order])).tolist() == [taught[w] for w in order]
    own = {i: n for i, n in zip(held.hot.tolist(), held.hot_places.tolist(), strict=True) if i >= katz.FIRST}
    assert own == {id_of[w]: n for w, n in every.items() if n > hot} and (own or hot > 40)


def test_trigrams_of_names_that_are_not_there():
    """Where all names of a block are too many for one number, those that aren't there are left out, then halves are taken."""
    u, v, w, doc = (np.array(x) for x in ([5, 7, 5, 7], [7, 5, 7, 5], [5, 9, 5, 9], [3, 3, 4, 8]))
    train = np.array([1, 1, 0, 1])
    for names in (np.arange(20) * 3, np.arange(3_000_000) * 3):
        a = katz.trigrams(names, u, v, w, doc, train)
        assert list(zip(*(a[k].tolist() for k in ("v", "u", "w", "c", "m")), strict=True)) == [(15, 21, 27, 2, 2), (21, 15, 15, 1, 2)]
        assert a["doc"].tolist() == [3, 8, 3, 4]


@pytest.mark.parametrize("block", [bpe.BLOCK_BYTES, 3000])
def test_bpe(docs, awkward, empty, block):
    path = bpe.default_tokenizer()
    t = bpe._tokenizer(path)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    for df in (docs, awkward):
        wanted = []
        for i, text in texts(df):
            ids = t.encode(text, add_special_tokens=False).ids
            wanted.append((i, len(ids), sha(" ".join(map(str, ids))), sha(t.decode(ids, skip_special_tokens=False))))
        assert sorted(map(tuple, bpe.encode_digests(df, path, block=block).collect()), key=repr) == sorted(wanted, key=repr)
    encoded = bpe.encode(awkward, path, block=block).cache()
    decoded = {r.row: r.text for r in bpe.decode(encoded, path).collect()}
    assert decoded == {r.row: t.decode(r.ids, skip_special_tokens=False) for r in encoded.collect()}
    digests = sorted(r.decoded_sha256 for r in bpe.encode_digests(awkward, path, block=block).collect())
    assert digests == sorted(sha(x) for x in decoded.values())  # the digests' pieces are those of the join
    assert bpe.encode_digests(empty, path).count() == 0


def print_of(text):
    w = words(text)
    grams = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def test_simhash(docs, awkward, empty):
    near = docs.withColumn("doc_id", F.col("doc_id") + 100_000).withColumn("text", F.concat(F.col("text"), F.lit(" tail")))
    both = docs.unionByName(near).select("doc_id", "text").unionByName(awkward.filter("doc_id is not null").select((F.col("doc_id") + 500_000).alias("doc_id"), "text"))
    all_ = [(i, print_of(t)) for i, t in texts(both)]
    root = {i: i for i, _ in all_}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, a) in enumerate(all_):
        for j, b in all_[:k]:
            if (a ^ b).bit_count() <= 3:
                x, y = sorted((find(i), find(j)))
                root[y] = x
    wanted = sorted((i, f"{f:016x}", find(i)) for i, f in all_)
    assert sorted(map(tuple, simhash.simhash_groups(both).collect())) == wanted
    assert sorted(map(tuple, simhash.simhash_groups(both, cell_rows=2).collect())) == wanted  # nearly every cell is hot
    kept = simhash.drop_near_copies(both).collect()
    assert sorted(r.doc_id for r in kept) == sorted({w[2] for w in wanted})
    kept = simhash.drop_near_copies(awkward)
    texts_ = {(r.doc_id, r.text) for r in kept.collect()}
    assert kept.columns == awkward.columns and kept.count() == len(texts_) == len({print_of(t) for _, t in texts(awkward)})
    assert simhash.simhash_groups(empty).count() == 0


def test_near_copies_under_null_and_repeated_ids(spark):
    a, b, c_ = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows_ = [(1, b), (5, a), (5, b), (None, c_), (None, b), (5, a), (6, a)]
    kept = simhash.drop_near_copies(spark.createDataFrame(rows_, "doc_id long, text string"))
    assert sorted(map(tuple, kept.collect()), key=repr) == sorted([(1, b), (5, a), (None, c_)], key=repr)


def test_licenses(docs, awkward, empty):
    for df in (docs, awkward):
        found = {(r.doc_id, r.n_words): r for r in licenses.license_scan(df).collect()}
        for i, t in texts(df):
            w = [x for x in re.split("[\x00-\x2f\x3a-\x60\x7b-\x7f]+", t.translate(LOWER)) if x]
            places, labels = [], set()
            for phrase, label in licenses.BASE:
                q = phrase.split()
                at = [k for k in range(len(w)) if w[k : k + len(q)] == q]
                places += at
                labels |= {label} if at else set()
            r = found[i, len(w)]
            assert (r.n_base, r.first_word, r.last_word, r.base_labels) == (len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)))
            assert labels <= set(r.labels.split(","))
    nine = next(r for (i, _), r in found.items() if i == 9)
    assert "mit" in nine.labels and nine.base_labels == "apache-2"
    assert licenses.license_scan(empty).count() == 0


def test_license_notices_with_edits_and_no_verb():
    import random

    rng = random.Random(3)
    for phrase, label in [*(x for x in licenses.BASE if len(x[0]) >= 12), ("apache license version 2 0", "apache-2"), ("gnu general public license", "gpl"), *licenses.FUZZY]:
        name = re.sub(r"[0-9 ]*$", "", phrase)
        for edits in range(min(2, len(phrase) // 12) + 1):
            for _ in range(20):
                letters = [k for k in range(1, len(name) - 1) if name[k - 1 : k + 2 : 2] != "  "]  # a lost word of one letter is two edits
                at = sorted(rng.sample(letters, edits), reverse=True)
                text = phrase
                for k in at:
                    text = text[:k] + rng.choice(["", "q", text[k] + "q"]) + text[k + 1 :]
                assert label in licenses.scan(f"Distributed, by us; {text}. See there")["labels"].split(","), text
    for text, label in (("Distributed under the MIT licence", "mit"), ("Apache Licence, Version 2.0", "apache-2"), ("GNU General Public Licence v3", "gpl"), ("Licensed under the Apache License, Version 1.1", ""), ("GNU Lesser General Public License", "lgpl")):
        assert licenses.scan(text)["labels"] == label


def test_mixing(spark, docs, awkward, empty):
    for df in (docs, awkward):
        found = mixing.mix(df).collect()
        assert len(found) == df.count() and sorted(map(tuple, mixing.mix(df.repartition(5)).collect()), key=repr) == sorted(map(tuple, found), key=repr)
        assert all(0 <= r.taken <= 3 * r.size and r.target <= 3 * r.source_size + 1e-6 for r in found)
    sources = {r.source: (r.source_size, r.target) for r in mixing.laid_out(docs)[1].collect()}
    assert sum(t for _, t in sources.values()) == pytest.approx(sum(s for s, _ in sources.values()))
    taken = collections.Counter()
    for r in mixing.mix(docs).join(docs.select("doc_id", "source"), "doc_id").collect():
        taken[r.source] += r.taken
    assert all(abs(taken[s] - t) <= 4 * mixing.BLOCK_WORDS + 0.02 * t for s, (_, t) in sources.items())
    assert mixing.mixed(awkward).columns == awkward.columns
    assert mixing.mix(empty).count() == mixing.mixed(empty).count() == 0


def test_mixing_small_sources_of_a_large_table(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCKS", 16)
    sizes = {"a": 400, "b": 20, "c": 9, "d": 15}
    df = spark.createDataFrame([(1000 * k + i, "word " * 1000, s) for k, (s, n) in enumerate(sizes.items()) for i in range(n)], "doc_id long, text string, source string")
    taken, target = collections.Counter(), {}
    for r in mixing.mix(df).join(df.select("doc_id", "source"), "doc_id").collect():
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert all(r.blocks >= 256 for r in mixing.laid_out(df)[1].collect())
    assert all(abs(taken[s] - t) <= 0.02 * t for s, t in target.items())


def test_quality(spark, docs, awkward, empty):
    labels = spark.read.parquet(f"{DATA}/labels.parquet").select("doc_id", F.col("quality").alias("y"))
    big = spark.read.parquet(f"{DATA}/../sf0.1/documents.parquet")
    taught = spark.read.parquet(f"{DATA}/../sf0.1/labels.parquet")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3
    scores = quality.quality_scores(big, taught.filter(fold != 1).select("doc_id", F.col("quality").alias("y"))).join(taught.filter(fold == 1), "doc_id").toPandas()
    good, poor = scores.score[scores.quality == 1].to_numpy(), scores.score[scores.quality == 0].to_numpy()
    auc = ((good[:, None] > poor).mean() + (good[:, None] == poor).mean() / 2)
    assert auc > 0.85 and scores.score.between(0, 1).all()
    for df in (awkward, empty):
        assert quality.quality_scores(df, labels).count() == df.count()
    assert {r.score for r in quality.quality_scores(awkward, labels.limit(0)).collect()} == {0.5}
    assert quality.drop_low_quality(awkward, labels).columns == awkward.columns


def test_quality_by_force(spark, docs):
    """The normal equations, the pools of the calibration and the scores, from dense matrices; some labels repeat."""
    import numpy as np

    taught = [(r.doc_id, float(r.quality)) for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()]
    taught += taught[:9] + [(10**9, 1.0), (3, None)]
    stats = {i: np.float32(quality.statistics(t)).astype(float) for i, t in texts(docs)}
    known = [(stats[i], y) for i, y in taught if i in stats and y is not None]
    x, y = np.array([k[0] for k in known]), np.array([k[1] for k in known])
    model = quality.Model(x.mean(axis=0), x.std(axis=0))
    z = model.features(x)
    gram = z.T @ z
    model.weights = np.linalg.solve(gram + quality.RIDGE * max(1.0, gram[-1, -1]) / quality.FEATURES * np.eye(len(gram)), z.T @ y)
    step = np.clip(np.rint(z @ model.weights / quality.STEP), -1000, 2000)
    pools = [[s, y[step == s].mean(), float((step == s).sum())] for s in np.unique(step)]
    k = 0
    while k + 1 < len(pools):  # pool the first violators until there are none
        (s1, m1, n1), (s2, m2, n2) = pools[k], pools[k + 1]
        if m1 >= m2:
            pools[k : k + 2] = [[(s1 * n1 + s2 * n2) / (n1 + n2), (m1 * n1 + m2 * n2) / (n1 + n2), n1 + n2]]
            k = 0
        else:
            k += 1
    at, level = [p[0] * quality.STEP for p in pools], [p[1] for p in pools]
    labels = spark.createDataFrame(taught, "doc_id long, y double")
    for r in quality.quality_scores(docs, labels).collect():
        (raw,) = model.features(stats[r.doc_id][None]) @ model.weights
        assert r.score == pytest.approx(float(np.interp(raw, at, level)), abs=0.02) and r.predicted == (r.score >= 0.5)


def test_isotonic():
    import numpy as np

    at, level = quality.isotonic(np.array([0.0, 1, 2, 3]), np.array([0.1, 0.5, 0.3, 0.9]), np.ones(4))
    assert level.tolist() == pytest.approx([0.1, 0.4, 0.9]) and at.tolist() == [0, 1.5, 3]


def test_pipeline(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    df, before = docs, docs.count()
    for _, stage in p.STAGES[:-1]:
        df = p.written(stage(spark, df, DATA))
        assert df.columns == docs.columns
    good = {tuple(r) for r in docs.collect()}
    assert df.count() <= 3 * before and all(tuple(r) in good for r in df.collect())
    last = p.STAGES[-1][1](spark, df, DATA)
    assert sorted((r.doc_id, r.ids_sha256) for r in last.collect()) == sorted((r.doc_id, r.ids_sha256) for r in p.run(spark, DATA).collect())


def test_pipeline_stages_by_force(spark, awkward):
    """Each stage on null and repeated ids, equal and different texts under one id, and a clashing column."""
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    odd = awkward.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))
    twice = docs.limit(30).unionByName(odd).unionByName(docs.limit(5)).unionByName(docs.limit(5).withColumn("text", F.lit("another text under an id")))
    df = p.written(twice.select("*", F.lit(1).alias("_tw_id")))
    rows_ = df.collect()
    stages = dict(p.STAGES)
    ids = lambda r: -1 if r.doc_id is None else r.doc_id

    best = {}
    for r in rows_:
        t = (r.text or "").translate(LOWER)
        best[t] = max(best.get(t, -2), ids(r))
    found = stages["exact dedup"](spark, df, DATA).collect()
    assert sorted((ids(r), (r.text or "").translate(LOWER)) for r in found) == sorted((i, t) for t, i in best.items())

    prints = sorted({print_of(r.text or "") for r in rows_})
    root = {f: f for f in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in prints:
        for b in prints:
            if a < b and (a ^ b).bit_count() <= 3:
                root[find(b)] = find(a)
    low = {}
    for r in rows_:
        c_ = find(print_of(r.text or ""))
        low[c_] = min(low.get(c_, 1 << 62), 1 << 61 if r.doc_id is None else r.doc_id)
    found = stages["SimHash near-dedup"](spark, df, DATA).collect()
    assert sorted((find(print_of(r.text or "")), 1 << 61 if r.doc_id is None else r.doc_id) for r in found) == sorted(low.items())

    good = {r.doc_id for r in quality.quality_scores(df, quality.training_labels(spark, DATA)).filter("predicted = 1").collect()}
    found = stages["quality classifier"](spark, df, DATA).collect()
    assert sorted(map(repr, found)) == sorted(repr(r) for r in rows_ if r.doc_id in good)

    found = collections.Counter(map(repr, stages["mixing sources"](spark, df, DATA).collect()))
    there = collections.Counter(map(repr, rows_))
    assert found and all(0 < n <= 3 * there[r] for r, n in found.items()) and not any(r.text is None or not r.text.split() for r in rows_ if repr(r) in found)
    assert all(f(spark, df.limit(0), DATA).count() == 0 for f in stages.values())
