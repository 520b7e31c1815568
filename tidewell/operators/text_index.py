"""Full-text search over a positional inverted index.

The index has a row for each term of a document: (bucket, term, id, positions). It is written by buckets of terms and
sorted by term, so a search reads the buckets of its terms only, and within them the row groups that hold them. Questions
are a table too: words, "phrases", OR, and - before what must not be there. Phrases are found by intersecting positions
that are moved by their place in the phrase; nothing reads the texts again.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

WORD = r"[\p{L}\p{N}]+"
#: English words that aren't indexed; they keep their place in phrases.
STOP_WORDS = """
i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their
theirs themselves what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and
but if or because as until while of at by for with about against between into through during before after above below to from up down in out on
off over under again further then once here there when where why how all any both each few more most other some such no nor not only own same so
than too very s t can will just don should now
""".split()
#: Endings, the first that fits, what takes its place, and the least number of letters before it. A lighter table than a full English stemmer.
ENDINGS = [
    ("ational", "ate", 2), ("ization", "ize", 2), ("iveness", "ive", 2), ("fulness", "ful", 2), ("ousness", "ous", 2), ("sses", "ss", 1), ("ies", "i", 2), ("ments", "", 3), ("ment", "", 3), ("ness", "", 3),
    ("ings", "", 3), ("ing", "", 3), ("edly", "", 3), ("ed", "", 3), ("ly", "", 3), ("y", "i", 2), ("ss", "ss", 0), ("s", "", 3),
]
BUCKETS = 64
#: Files of a bucket, by documents; documents that are indexed at once.
SLICES, ROWS = 4, 512
_STOPS = frozenset(STOP_WORDS)
#: The weight of a place where a question is met, and what words between its parts take off it.
PLACE = 0.1


def stem(word: Column) -> Column:
    found = F.when(F.lit(False), word)
    for ending, kept, least in ENDINGS:
        fits = F.endswith(word, F.lit(ending)) & (F.length(word) >= least + len(ending))
        found = found.when(fits, F.concat(F.substring(word, F.lit(1), F.length(word) - len(ending)), F.lit(kept)))
    return found.otherwise(word)


def stop(word: Column) -> Column:
    return word.isin(*STOP_WORDS)


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def _bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def postings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """(bucket, term, id, positions) of whole texts; null texts have no terms, rows of one id are one document.

    Words are counted from 0, stop words too. No key is hotter than a term in one document.
    """
    words = docs.select(F.col(id_col).alias("id"), _words(F.col(text_col)).alias("words"))
    one = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("term", T.StringType()), T.StructField("places", T.ArrayType(T.IntegerType()))])
    rows = words.mapInArrow(_terms, one).groupBy("term", "id").agg(F.array_sort(F.flatten(F.collect_list("places"))).alias("positions"))
    return rows.select(_bucket(F.col("term"), buckets).alias("bucket"), "term", "id", "positions")


def _term(word: str) -> str | None:
    """stem() of a word that is no stop word."""
    if word in _STOPS:
        return None
    return next((word[: len(word) - len(ending)] + kept for ending, kept, least in ENDINGS if word.endswith(ending) and len(word) >= least + len(ending)), word)


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, term, places): a row for each term of a row of (id, words); a different word of a batch is stemmed once."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            ids, words = batch.slice(at, ROWS).columns
            coded = words.flatten().dictionary_encode()
            terms = pa.array(map(_term, coded.dictionary.to_pylist()), pa.string()).dictionary_encode()
            sizes = words.value_lengths().to_numpy()
            row = np.repeat(np.arange(len(sizes)), sizes)
            place = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            code = terms.indices.fill_null(-1).to_numpy()[coded.indices.to_numpy()] if len(row) else row
            row, place, code = (x[code >= 0] for x in (row, place, code))
            key = row * len(terms.dictionary) + code
            order = np.argsort(key, kind="stable")  # places of a term stay in order
            first = np.flatnonzero(np.diff(key[order], prepend=-1))
            places = pa.ListArray.from_arrays(pa.array(np.append(first, len(order)), pa.int32()), pa.array(place[order], pa.int32()))
            picked = order[first]
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(row[picked])), terms.dictionary.take(pa.array(code[picked])), places], ["id", "term", "places"])


def store(index: DataFrame, path: str) -> None:
    """Writes an index: a folder a bucket, files sorted by term; a bucket goes to several files, by documents, so that a frequent term isn't one task's."""
    parts = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = index.repartition(parts, "bucket", F.pmod(F.xxhash64("id"), F.lit(SLICES)))  # by ranges, all would be worked out once more to find them
    dealt.sortWithinPartitions("bucket", "term", "id").write.partitionBy("bucket").mode("overwrite").parquet(path)


def kept(index: DataFrame) -> DataFrame:
    """The index stored in the folder that the cluster shares (spark.checkpoint.dir), for one search; the index itself where none is named."""
    base = index.sparkSession.conf.get("spark.checkpoint.dir", None)
    if not base:
        return index
    path = f"{base.rstrip('/')}/index-{uuid.uuid4().hex}"
    store(index, path)
    return load(index.sparkSession, path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def parsed(questions: DataFrame, question: str, query: str, buckets: int = BUCKETS) -> DataFrame:
    """(question, branch, positive, alone, part, negative, size, first, span, at, term, bucket): a row for each term of a question.

    OR ends a branch; the parts of a branch must all be met, those after - must not. Stop words go, and parts of nothing
    else; a branch of negative parts only is met nowhere.
    """
    said = F.regexp_extract_all(F.coalesce(F.col(query), F.lit("")), F.lit(r'-?"[^"]*"|\S+'), F.lit(0))
    none = F.array().cast("array<string>")

    def step(branches: Column, part: Column) -> Column:
        kept = F.slice(branches, F.lit(1), F.size(branches) - 1)
        grown = F.concat(kept, F.array(F.array_append(F.element_at(branches, -1), part)))
        return F.when(F.lower(part) == "or", F.array_append(branches, none)).otherwise(grown)

    def read(part: Column) -> Column:
        terms = F.filter(F.transform(_words(part), lambda w, i: F.struct(i.alias("at"), F.when(~stop(w), stem(w)).alias("term"))), lambda t: t["term"].isNotNull())
        return F.struct(F.startswith(part, F.lit("-")).alias("negative"), terms.alias("terms"))

    rows = questions.select(F.col(question).alias("question"), F.posexplode(F.aggregate(said, F.array(none), step)).alias("branch", "said"))
    rows = rows.withColumn("parts", F.filter(F.transform("said", read), lambda p: F.size(p["terms"]) > 0)).drop("said")
    rows = rows.withColumn("positive", F.size(F.filter("parts", lambda p: ~p["negative"]))).filter("positive > 0")
    rows = rows.select("question", "branch", "positive", (F.size("parts") == 1).alias("alone"), F.posexplode("parts").alias("part", "p"))
    first, last = F.element_at("p.terms", 1)["at"], F.element_at("p.terms", -1)["at"]
    rows = rows.select("question", "branch", "positive", "alone", "part", "p.negative", F.size("p.terms").alias("size"), first.alias("first"), (last - first).alias("span"), F.explode("p.terms").alias("t"))
    return rows.select("*", "t.at", "t.term", _bucket(F.col("t.term"), buckets).alias("bucket")).drop("t")


def _windows(parts: Column, positive: Column) -> Column:
    """The rank of a branch in a document: places of one part, or the smallest windows that hold all parts, less by the words between."""
    event = "struct<begin: int, stop: int, size: int, part: int>"

    def places(p: Column) -> Column:
        return F.transform(p["starts"], lambda s: F.struct(s.alias("begin"), (s + p["span"]).alias("stop"), p["size"].alias("size"), p["part"].alias("part")).cast(event))

    events = F.array_sort(F.flatten(F.transform(parts, places)))
    start = F.struct(F.create_map().cast(f"map<int,{event}>").alias("last"), F.lit(-1).alias("low"), F.lit(0.0).alias("rank"))

    def step(s: Column, e: Column) -> Column:
        last = F.map_concat(F.map_filter(s["last"], lambda k, _: k != e["part"]), F.create_map(e["part"], e))
        held = F.map_values(last)
        low, high = F.array_min(F.transform(held, lambda h: h["begin"])), F.array_max(F.transform(held, lambda h: h["stop"]))
        sizes = F.aggregate(held, F.lit(0), lambda n, h: n + h["size"])
        new = (F.size(last) == positive) & (low != s["low"])
        rank = F.when(new, PLACE / (1 + F.greatest(high - low + 1 - sizes, F.lit(0)))).otherwise(0.0)
        return F.struct(last.alias("last"), F.when(new, low).otherwise(s["low"]).alias("low"), (s["rank"] + rank).alias("rank"))

    return F.aggregate(events, start, step, lambda s: s["rank"])


def search(index: DataFrame, questions: DataFrame, k: int, question: str = "question", query: str = "query", buckets: int = BUCKETS) -> DataFrame:
    """(question, id, keyword_score, keyword_rank) of the k best documents of each question: score r / (1 + r) of the rank r summed over branches.

    index is postings(), or better what store() wrote of them; buckets as there. Ties go to the smaller id. A question
    of no terms, or null, finds nothing.
    """
    wanted = parsed(questions, question, query, buckets)
    keys = ["question", "branch", "positive", "alone", "part", "negative", "size", "first", "span", "id"]
    words = wanted.filter("size = 1").join(index, ["bucket", "term"]).select(*keys, F.col("positions").alias("starts"))
    hits = wanted.filter("size > 1").join(index, ["bucket", "term"]).withColumn("moved", F.transform("positions", lambda p: p - F.col("at")))
    phrases = hits.groupBy(*keys).agg(F.collect_list("moved").alias("lists")).filter(F.size("lists") == F.col("size"))
    starts = F.aggregate(F.slice("lists", 2, F.size("lists")), F.element_at("lists", 1), F.array_intersect)
    phrases = phrases.select(*keys, F.transform(starts, lambda s: s + F.col("first")).alias("starts")).filter(F.size("starts") > 0)
    met = words.unionByName(phrases)
    # A branch of one part is met wherever the part is; only other branches have to be put together.
    alone = met.filter("alone").select("question", "id", (F.size("starts") * (PLACE / (2 + F.col("span") - F.col("size")))).alias("r"))
    part = F.when(~F.col("negative"), F.struct("part", "starts", "span", "size"))
    branches = met.filter("not alone").groupBy("question", "branch", "positive", "id").agg(F.collect_list(part).alias("parts"), F.bool_or("negative").alias("spoiled"))
    branches = branches.filter(~F.col("spoiled") & (F.size("parts") == F.col("positive"))).select("question", "id", _windows(F.col("parts"), F.col("positive")).alias("r"))
    ranks = alone.unionByName(branches).groupBy("question", "id").agg(F.round(F.sum("r"), 6).alias("r"))
    order = Window.partitionBy("question").orderBy(F.desc("r"), "id")  # limited before the shuffle, as only k of each are asked for
    best = ranks.withColumn("keyword_rank", F.row_number().over(order)).filter(F.col("keyword_rank") <= k)
    return best.select("question", "id", F.round(F.col("r") / (1 + F.col("r")), 6).alias("keyword_score"), F.col("keyword_rank").cast("long").alias("keyword_rank"))


def sql_stem(word: str) -> str:
    """The same table as DuckDB SQL, by patterns."""
    cases = " ".join(f"WHEN regexp_matches({word}, '^.{{{least},}}{ending}$') THEN regexp_replace({word}, '{ending}$', '{kept}')" for ending, kept, least in ENDINGS)
    return f"CASE {cases} ELSE {word} END"
