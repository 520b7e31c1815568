"""Mixing sources to target weights: a low-discrepancy schedule of slots over shuffled equal-token blocks.

Each source's documents are laid end to end in the order of their ids' MD5, and that line of words is cut into blocks
of nearly equal length. Slot i of the schedule is the golden-ratio point frac((i + 1) * g); cumulative weights map it
to a source, and the slot's rank among those of its source, modulo the number of blocks, is the block that it plays.
Only DataFrame functions are used. Running sums are taken in two levels, so that a source that holds most of the rows
is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewell.llm.common import prefix, same, small, table, written

#: Weights of the sources in order, repeating, and how often a source is played at most.
WEIGHTS, PASSES = (5, 2, 1), 3
GOLDEN = 0.6180339887498949
#: Words of a block at least; and about so many blocks are made of all words, if that makes them larger, but so many of each
#: source at least: with few, the points of the schedule that fall to a source are too few or too many for its target.
BLOCK_WORDS, BLOCKS, SOURCE_BLOCKS = 32, 1 << 20, 256
#: Parts of a source's line, by the start of the MD5, that are summed apart; parts of the cumulative weights for the join.
PARTS, STEPS = 1024, 4096
#: Rows up to which the table of sources may be broadcast.
SOURCES = 100_000


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def before(df: DataFrame, group: str, part: str, order: list[str], value: str, name: str) -> DataFrame:
    """Adds the sum of value over the earlier rows of the group; part ascends with the order, and bounds a task's rows."""
    parts = df.groupBy(group, part).agg(F.sum(value).alias("_sum"))
    up_to = Window.partitionBy(group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(F.col(group).alias("_g"), F.col(part).alias("_p"), F.coalesce(F.sum("_sum").over(up_to), F.lit(0)).alias("_first"))
    inner = Window.partitionBy(group, part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = df.withColumn("_inner", F.coalesce(F.sum(value).over(inner), F.lit(0)))
    rows = rows.join(parts, (rows[group] == parts._g) & (rows[part] == parts._p))
    return rows.withColumn(name, F.col("_first") + F.col("_inner")).drop("_g", "_p", "_first", "_inner")


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, passes: int = PASSES) -> DataFrame:
    """(k, source, source_size, target, blocks, low, high): one row a source, in code point order, null last.

    Targets share all words by weight; one that is above passes times its source's size stops there, and the excess
    goes to the others by weight until none is above. low and high bound the source's slots.
    """
    sums = written(sized.groupBy("source").agg(F.sum("size").alias("source_size")))
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    every = Window.partitionBy(F.lit(1))
    rows = sums.withColumn("k", F.row_number().over(ordered) - 1)
    rows = rows.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), F.col("k") % len(weights) + 1).cast("long"))
    rows = rows.withColumn("cap", passes * F.col("source_size")).withColumn("total", F.sum("source_size").over(every))
    # In the order of cap to weight: what is left after the sources before, and the weight that shares it.
    by_cap = Window.orderBy(F.col("cap") / F.col("w"), "k").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("rest", F.col("total") - F.coalesce(F.sum("cap").over(by_cap), F.lit(0)))
    rows = rows.withColumn("weight", F.sum("w").over(every) - F.coalesce(F.sum("w").over(by_cap), F.lit(0)))
    fits = F.col("rest") * F.col("w") <= F.col("cap") * F.col("weight")
    level = F.min(F.when(fits, F.struct(F.col("cap") / F.col("w"), "k", (F.col("rest") / F.col("weight")).alias("level")))).over(every)["level"]
    rows = rows.withColumn("target", F.least(F.col("cap").cast("double"), F.col("w") * level))
    block = F.greatest(F.lit(BLOCK_WORDS), F.least(F.ceil(F.col("total") / BLOCKS), F.floor(F.col("source_size") / SOURCE_BLOCKS)))
    rows = rows.withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("source_size") / block)).cast("long"))
    rows = rows.withColumn("slots", F.when(F.col("source_size") > 0, F.round(F.col("blocks") * F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    rows = rows.withColumn("high", F.sum("slots").over(ordered)).withColumn("low", F.col("high") - F.col("slots"))
    return written(rows.select("k", "source", "source_size", "target", "blocks", "low", "high"))


def schedule(sources: DataFrame, passes: int = PASSES) -> DataFrame:
    """(slot, k, rank, block): which source and block each slot of the mix plays; none beyond the passes of a source."""
    n = sources.agg(F.max("high")).first()[0] or 0
    point = (F.col("slot") + 1) * F.lit(GOLDEN)
    slots = sources.sparkSession.range(n).select(F.col("id").alias("slot")).withColumn("point", (point - F.floor(point)) * n)
    step = lambda c: F.floor(c * STEPS / F.lit(max(n, 1))).cast("int")
    spread = sources.filter("high > low").select("k", "blocks", "low", "high", F.explode(F.sequence(step(F.col("low")), step(F.col("high")))).alias("step"))
    slots = slots.withColumn("at", step(F.col("point"))).join(spread, (F.col("at") == F.col("step")) & (F.col("point") >= F.col("low")) & (F.col("point") < F.col("high")))
    slots = slots.select("slot", "k", "blocks", F.floor(F.col("slot") * PARTS / F.lit(max(n, 1))).cast("int").alias("part"), F.lit(1).alias("one"))
    slots = before(slots, "k", "part", ["slot"], "one", "rank").filter(F.col("rank") < passes * F.col("blocks"))
    return slots.select("slot", "k", "rank", (F.col("rank") % F.col("blocks")).alias("block"))


def laid_out(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> tuple[DataFrame, DataFrame]:
    """(lines, sources): each document with its place (start) on its source's line, and targets().

    Null texts have size 0, a null source is one of its own, a null id is hashed as an empty one; repeated rows each
    have their own place. An empty table gives empty ones.
    """
    sized = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), words(F.col(text_col)).alias("size"))
    sized = written(sized.withColumn("h", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))))
    sources = targets(sized)
    names = small(sources.withColumnRenamed("source", "name"), SOURCES)
    lines = sized.join(names, same(F.col("source"), F.col("name"))).drop("name", "low", "high")
    lines = lines.withColumn("part", F.floor(F.conv(F.substring("h", 1, 4), 16, 10).cast("int") * PARTS / 65536).cast("int"))
    return written(before(lines, "k", "part", ["h", "doc_id", "size"], "size", "start").drop("part", "h")), sources


def _block_at(place: Column) -> Column:
    """The block that holds a place of the line: block b starts at floor(b * source_size / blocks)."""
    return F.floor((((place + 1) * F.col("blocks")) - 1) / F.col("source_size")).cast("long")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, size, source_size, target (of its source), taken (words that the mix takes, repeats counted) of each row.

    The mix plays blocks of equal size: at least BLOCK_WORDS words, at most as many that a source has SOURCE_BLOCKS of
    them, and between those a BLOCKS-th of all words, so blocks grow with the corpus and their number doesn't. Null texts
    have size 0 and nothing taken; a null source is one of its own; repeated rows each have their own place.
    """
    lines, sources = laid_out(docs, id_col, text_col, source_col)
    uses = schedule(sources).groupBy("k", "block").agg(F.count("*").alias("uses")).withColumnsRenamed({"k": "uk", "block": "ub"})
    kept = ["doc_id", "size", "source_size", "target"]
    pieces = lines.filter("size > 0").withColumn("block", F.explode(F.sequence(_block_at(F.col("start")), _block_at(F.col("start") + F.col("size") - 1))))
    edge = lambda b: F.expr(f"({b} * source_size) div blocks")
    part = F.least(F.col("start") + F.col("size"), edge("(block + 1)")) - F.greatest(F.col("start"), edge("block"))
    pieces = pieces.join(uses, (F.col("k") == F.col("uk")) & (F.col("block") == F.col("ub"))).withColumn("words", part * F.col("uses"))
    taken = pieces.groupBy(F.col("k").alias("tk"), F.col("start").alias("ts")).agg(F.sum("words").alias("taken"))
    rows = lines.join(taken, (F.col("k") == F.col("tk")) & (F.col("start") == F.col("ts")) & (F.col("size") > 0), "left")
    return rows.select(*kept, F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of docs as often as the mix plays the block that a document begins in; documents of no words go.

    Rows that share an id, which only repeated rows do after dedup, are all repeated as the most played of them.
    """
    p = prefix(docs)
    lines, sources = laid_out(docs, id_col, text_col, source_col)
    uses = schedule(sources).groupBy("k", "block").agg(F.count("*").alias("uses")).withColumnsRenamed({"k": "uk", "block": "ub"})
    firsts = lines.filter("size > 0").withColumn("block", _block_at(F.col("start")))
    firsts = firsts.join(uses, (F.col("k") == F.col("uk")) & (F.col("block") == F.col("ub")))
    copies = small(written(firsts.groupBy(F.col("doc_id").alias(f"{p}id")).agg(F.max("uses").cast("int").alias(f"{p}uses"))), 1_000_000)
    filled = docs.filter(F.col(text_col).cast("string").rlike(r"[^\x20\x09-\x0D]"))
    rows = filled.join(copies, same(filled[id_col], copies[f"{p}id"])).withColumn(f"{p}n", F.explode(F.sequence(F.lit(1), F.col(f"{p}uses"))))
    return rows.select(*(docs[c] for c in docs.columns))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


OP9_SQL = f"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
s1 AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
s2 AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS k FROM s1),
s3 AS (SELECT *, [{", ".join(map(str, WEIGHTS))}][k % {len(WEIGHTS)} + 1]::BIGINT AS w, {PASSES} * source_size AS cap, (sum(source_size) OVER ())::BIGINT AS total FROM s2),
s4 AS (SELECT *, total - coalesce((sum(cap) OVER b)::BIGINT, 0) AS rest, (sum(w) OVER ())::BIGINT - coalesce((sum(w) OVER b)::BIGINT, 0) AS weight
  FROM s3 WINDOW b AS (ORDER BY cap / w, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
lev AS (SELECT rest / weight AS level FROM s4 WHERE rest * w <= cap * weight ORDER BY cap / w, k LIMIT 1),
s5 AS (SELECT *, least(cap::DOUBLE, w * level) AS target, greatest(1, ceil(source_size / greatest({BLOCK_WORDS}, ceil(total / {BLOCKS}))))::BIGINT AS blocks FROM s4, lev),
s6 AS (SELECT *, CASE WHEN source_size > 0 THEN round(blocks * target / source_size)::BIGINT ELSE 0 END AS slots FROM s5),
src AS (SELECT k, source, source_size, target, blocks, (sum(slots) OVER (ORDER BY k))::BIGINT AS high, (sum(slots) OVER (ORDER BY k))::BIGINT - slots AS low FROM s6),
pts AS (SELECT i, ((i + 1) * {GOLDEN} - floor((i + 1) * {GOLDEN})) * (SELECT max(high) FROM src) AS point FROM range((SELECT max(high) FROM src)) t(i)),
ranked AS (SELECT k, blocks, row_number() OVER (PARTITION BY k ORDER BY i) - 1 AS r FROM pts JOIN src ON point >= low AND point < high),
uses AS (SELECT k, r % blocks AS block, count(*) AS uses FROM ranked WHERE r < {PASSES} * blocks GROUP BY ALL),
lines AS (SELECT doc_id, size, src.*, coalesce((sum(size) OVER (PARTITION BY k ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))::BIGINT, 0) AS start
  FROM sized JOIN src ON sized.source IS NOT DISTINCT FROM src.source),
taken AS (SELECT k, start, sum((least(start + size, ((u.block + 1) * source_size) // blocks) - greatest(start, (u.block * source_size) // blocks)) * uses)::BIGINT AS taken
  FROM lines JOIN uses u USING (k) WHERE size > 0 AND (u.block * source_size) // blocks < start + size AND ((u.block + 1) * source_size) // blocks > start GROUP BY k, start)
SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken FROM lines LEFT JOIN taken ON lines.k = taken.k AND lines.start = taken.start AND size > 0
"""
