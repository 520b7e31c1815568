"""Mentions of a table of names in texts: whole words, any case, the longest name at a place, no overlaps.

Runs of words are looked up as keys, so a place meets the one name that stands there and not all names that begin with
its word; there is no pattern of all names, and both tables may be large.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: A word and what stands behind it up to the next.
PIECE = r"[\p{L}\p{M}\p{N}_]+[^\p{L}\p{M}\p{N}_]*"
_TAIL = r"[^\p{L}\p{M}\p{N}_]+$"


def _pieces(text):
    return F.regexp_extract_all(F.lower(text), F.lit(PIECE), F.lit(0))


def found_names(texts: DataFrame, names: DataFrame, id_cols: list[str], text_col: str = "text") -> DataFrame:
    """(*id_cols, at, words, name): places where a name stands, at counts words from 0.

    names has a column name. Case is dropped; what stands between the words of a name has to be there as it is in the
    name. Names begin and end with a word: what is around it in the table goes, and names without one are nowhere. Null
    texts and names have no places; repeated names are one. Rows of one id are one text each if they differ.
    """
    clean = F.regexp_replace(F.array_join(_pieces(F.col("name")), ""), _TAIL, "")
    known = names.select(clean.alias("name")).filter("name <> ''").distinct()
    known = known.withColumn("words", F.size(_pieces(F.col("name"))))
    lengths = [r.words for r in known.select("words").distinct().orderBy("words").collect()]  # a few small numbers
    if not lengths:
        lengths = [1]
    run = lambda n, i: F.regexp_replace(F.array_join(F.slice("_p", i + 1, F.lit(n)), ""), _TAIL, "")
    # Every run of each length that names have.
    runs = lambda i: F.array(*(F.when(i + n <= F.size("_p"), F.struct(i.alias("at"), F.lit(n).alias("words"), run(n, i).alias("name"))) for n in lengths))
    rows = texts.select(*id_cols, F.xxhash64(text_col).alias("_text"), _pieces(F.col(text_col)).alias("_p"))
    places = F.when(F.size("_p") > 0, F.sequence(F.lit(0), F.size("_p") - 1))
    spans = rows.select(*id_cols, "_text", F.explode(F.flatten(F.transform(places, runs))).alias("r")).filter("r is not null").select(*id_cols, "_text", "r.*")
    hits = spans.join(known, ["name", "words"]).distinct()
    return _apart(hits, [*id_cols, "_text"]).select(*id_cols, "at", "words", "name")


def _apart(hits: DataFrame, keys: list[str]) -> DataFrame:
    """From left to right, the longest name at each place that is past the end of the one before.

    Places that overlap form clusters, which are settled apart, each by a fold over its own places.
    """
    order = Window.partitionBy(*keys).orderBy("at", F.desc("words"))
    before = F.max(F.col("at") + F.col("words")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = hits.withColumn("_begins", (F.col("at") >= F.coalesce(before, F.lit(0))).cast("long"))
    clusters = marked.withColumn("_cluster", F.sum("_begins").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    spans = F.array_sort(F.collect_list(F.struct("at", (-F.col("words")).alias("less"), "name")))
    grouped = clusters.groupBy(*keys, "_cluster").agg(spans.alias("s"))
    start = F.struct(F.lit(0).alias("end"), F.filter("s", lambda _: F.lit(False)).alias("kept"))
    step = lambda acc, s: F.when(s.at >= acc.end, F.struct((s.at - s.less).alias("end"), F.concat(acc.kept, F.array(s)).alias("kept"))).otherwise(acc)
    return grouped.select(*keys, F.explode(F.aggregate("s", start, step, lambda acc: acc.kept)).alias("k")).select(*keys, "k.at", (-F.col("k.less")).alias("words"), "k.name")
