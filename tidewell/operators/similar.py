"""Similarity joins that are exact without comparing all pairs.

near_pairs: cosine at or above a threshold, within a context. Vectors lie in cells around pivots; as angles obey the
triangle inequality, a question visits only the cells that can hold a vector within its angle. What is left is compared
as matrix products of packed blocks, and only pairs that reach the threshold become rows.

similar_names: Jaccard of character trigrams at or above a threshold. Trigrams are ordered rare first; two sets that are
similar enough share one of their first few, and their sizes are near each other.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions import text as T

#: Pivots, which are what tasks are sent: 64 vectors at any size of the tables.
PIVOTS = 64
#: Vectors in a block, questions in a block, and blocks of a cell that meet one copy of its questions.
VECTORS, QUESTIONS, TOGETHER = 4096, 512, 32
#: What angles may be wrong by, in radians, and similarities before they are rounded to six places.
SLACK, HALF_PLACE = 1e-6, 1e-6
_BLOCK = "context {0}, cell int, ids array<{1}>, vectors binary"


def _sound(v: Column, dimensions: int) -> Column:
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (F.size(v) == dimensions) & finite & F.exists(v, lambda x: x != 0)


def _matrix(column: pa.Array, dimensions: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dimensions).astype(np.float64)


def _angles(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    unit = x / np.sqrt((x * x).sum(axis=1))[:, None]
    return np.arccos(np.clip(unit @ pivots.T, -1, 1))


def _placed(pivots: np.ndarray):
    """Adds each vector's cell, that of its nearest pivot, and the angle to it."""

    def run(batches):
        for b in batches:
            angle = _angles(_matrix(b.column("v"), pivots.shape[1]), pivots)
            cell = angle.argmin(axis=1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell), pa.array(angle[np.arange(len(cell)), cell])], [*b.schema.names, "cell", "angle"])

    return run


def _visiting(pivots: np.ndarray, within: float):
    """Adds the cells that a question may have to visit, with its angle to their pivots.

    A vector x of cell c is no nearer to the question's own pivot p than to c, so within the angle t of the question
    angle(q, c) <= angle(q, p) + 2 t.
    """

    def run(batches):
        for b in batches:
            angle = _angles(_matrix(b.column("v"), pivots.shape[1]), pivots)
            near = angle <= angle.min(axis=1)[:, None] + 2 * within + SLACK
            cells = [[{"cell": int(c), "angle": float(a[c])} for c in np.flatnonzero(n)] for a, n in zip(angle, near, strict=True)]
            kind = pa.list_(pa.struct([("cell", pa.int32()), ("angle", pa.float64())]))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cells, kind)], [*b.schema.names, "cells"])

    return run


def _blocks(rows: int, dimensions: int, ids: pa.DataType, context: pa.DataType):
    """Rows that come sorted by (context, cell) in blocks of one cell."""

    def block(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        key = [pa.array([table.column(c)[0].as_py()], t) for c, t in (("context", context), ("cell", pa.int32()))]
        x = _matrix(table.column("v").combine_chunks(), dimensions)
        names = pa.array([table.column("id").to_pylist()], pa.list_(ids))
        return pa.RecordBatch.from_arrays([*key, names, pa.array([x.tobytes()], pa.binary())], ["context", "cell", "ids", "vectors"])

    def run(batches):
        held, n, last = [], 0, None
        for b in batches:
            keys = list(zip(b.column("context").to_pylist(), b.column("cell").to_pylist(), strict=True))
            at = 0
            while at < len(keys):
                to = at
                while to < len(keys) and keys[to] == keys[at] and to - at < rows:
                    to += 1
                if held and (keys[at] != last or n + to - at > rows):
                    yield block(held)
                    held, n = [], 0
                held.append(b.slice(at, to - at).select(["context", "cell", "id", "v"]))
                n, last, at = n + to - at, keys[at], to
        if held:
            yield block(held)

    return run


def _products(dimensions: int, near: float, plain: bool, question: pa.DataType, ids: pa.DataType):
    def matrix(raw: bytes) -> np.ndarray:
        x = np.frombuffer(raw).reshape(-1, dimensions)
        return x if plain else x / np.sqrt((x * x).sum(axis=1))[:, None]

    def run(batches):
        for b in batches:
            for asked, q, found, v in zip(*(b.column(c).to_pylist() for c in ("asked", "q", "ids", "vectors")), strict=True):
                x = np.round(matrix(q) @ matrix(v).T, 6)
                row, column = np.nonzero(x >= near)
                for at in range(0, len(row), 65536):
                    r, c = row[at : at + 65536], column[at : at + 65536]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([asked[i] for i in r], question), pa.array([found[i] for i in c], ids), pa.array(x[r, c])], ["question", "id", "similarity"]
                    )

    return run


def _packed(rows: DataFrame, size: int, dimensions: int, keys: list[str]) -> DataFrame:
    """Blocks of (context, cell). A cell of many rows is cut among several tasks by the rows' ids."""
    from pyspark.sql.pandas.types import to_arrow_type

    kinds = rows.schema["id"].dataType, rows.schema["context"].dataType
    shares = rows.groupBy(*keys).agg(F.ceil(F.count("*") / (16 * size)).cast("int").alias("shares"))
    dealt = rows.join(shares, keys).withColumn("share", F.pmod(F.xxhash64("id"), F.col("shares")).cast("int"))
    sorted_ = dealt.repartition(*keys, "share").sortWithinPartitions(*keys, "share").select(*keys, "id", "v")
    return sorted_.mapInArrow(_blocks(size, dimensions, *map(to_arrow_type, kinds)), _BLOCK.format(kinds[1].simpleString(), kinds[0].simpleString()))


def near_pairs(questions: DataFrame, vectors: DataFrame, near: float, dimensions: int, *, plain: bool = False, pivots: int = PIVOTS) -> DataFrame:
    """(question, id, similarity): all pairs of one context whose cosine, rounded to six places, is at least near.

    questions and vectors have id, context and v (array<double>). With plain, vectors have a length of 1 within 1e-6 and
    the plain product is taken. Vectors that are null, of another length, zero, or not finite, and rows without a context,
    are in no pair; repeated rows each count. Pivots are the vectors of smallest hash; any give the same rows.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    clean = lambda df: df.select("id", "context", F.col("v").cast("array<double>").alias("v")).filter(_sound(F.col("v"), dimensions) & F.col("context").isNotNull() & F.col("id").isNotNull())
    questions, vectors = clean(questions), clean(vectors)
    chosen = vectors.select("v").orderBy(F.xxhash64("v"), "v").limit(pivots).collect()  # 64 rows at any size
    kind, q_kind, context = vectors.schema["id"].dataType, questions.schema["id"].dataType, vectors.schema["context"].dataType.simpleString()
    if not chosen:
        return vectors.select(F.lit(None).cast(q_kind).alias("question"), "id", F.lit(0.0).alias("similarity"))
    p = np.array([r.v for r in chosen])
    p = np.unique(p / np.sqrt((p * p).sum(axis=1))[:, None], axis=0)
    within = float(np.arccos(np.clip(near - HALF_PLACE - (4e-6 if plain else 0), -1, 1))) + SLACK

    head = f"id {{0}}, context {context}, v array<double>, "
    placed = vectors.mapInArrow(_placed(p), head.format(kind.simpleString()) + "cell int, angle double")
    ring = placed.groupBy("context", "cell").agg(F.min("angle").alias("inner"), F.max("angle").alias("outer"), F.ceil(F.count("*") / (VECTORS * TOGETHER)).cast("int").alias("parts"))
    visiting = questions.mapInArrow(_visiting(p, within), head.format(q_kind.simpleString()) + "cells array<struct<cell: int, angle: double>>")
    visits = visiting.select("id", "context", "v", F.explode("cells").alias("to")).select("id", "context", "v", "to.cell", "to.angle")
    reached = visits.join(ring, ["context", "cell"]).filter((F.col("angle") <= F.col("outer") + within + SLACK) & (F.col("angle") >= F.col("inner") - within - SLACK))

    keys = ["context", "cell"]
    blocks = _packed(placed.select("id", "context", "v", "cell"), VECTORS, dimensions, keys)
    asked = _packed(reached.select("id", "context", "v", "cell"), QUESTIONS, dimensions, keys).withColumnsRenamed({"ids": "asked", "vectors": "q"})
    # A cell of many blocks is dealt over parts, each of which meets all questions of the cell.
    blocks = blocks.join(ring.select(*keys, "parts"), keys).withColumn("part", F.pmod(F.xxhash64("ids"), F.col("parts")).cast("int")).drop("parts")
    asked = asked.join(ring.select(*keys, "parts"), keys).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    met = blocks.join(asked, [*keys, "part"]).select("asked", "q", "ids", "vectors")
    return met.mapInArrow(_products(dimensions, near, plain, to_arrow_type(q_kind), to_arrow_type(kind)), f"question {q_kind.simpleString()}, id {kind.simpleString()}, similarity double")


def similar_names(left: DataFrame, right: DataFrame, least: float = 0.25) -> DataFrame:
    """(left, right, similarity): all pairs of distinct names whose trigram sets have a Jaccard of at least least, which is above 0.

    left and right have a column name; null names are in no pair, the empty name has the trigrams of its padding. Each
    name is compared once, however many rows have it; join the names back to the rows.
    """
    names = lambda df: df.select("name").filter("name is not null").distinct().withColumn("grams", T.trigrams(F.col("name")))
    a, b = names(left), names(right)
    often = a.select("grams").unionByName(b.select("grams")).select(F.explode("grams").alias("g")).groupBy("g").agg(F.count("*").alias("n"))

    def prefixed(df: DataFrame) -> DataFrame:
        ranked = df.select("name", F.explode("grams").alias("g")).join(often, "g").groupBy("name").agg(F.array_sort(F.collect_list(F.struct("n", "g"))).alias("o"))
        ordered = ranked.select("name", F.transform("o", lambda s: _code(s.g)).alias("grams"))
        n = F.size("grams")
        first = F.slice("grams", F.lit(1), (n - F.ceil(least * n - 1e-9) + 1).cast("int"))
        return ordered.withColumn("first", first).select("name", "grams", "first", F.posexplode("first").alias("at", "g"))

    x = prefixed(a).select(F.col("name").alias("left"), F.col("grams").alias("lg"), F.col("first").alias("lf"), F.col("at").alias("la"), "g")
    y = prefixed(b).select(F.col("name").alias("right"), F.col("grams").alias("rg"), F.col("first").alias("rf"), F.col("at").alias("ra"), "g")
    n, m = F.size("lg"), F.size("rg")
    # Where a pair shares its first trigram, what stands behind it on either side bounds what else they can share.
    enough = F.least(n - F.col("la"), m - F.col("ra")) >= least / (1 + least) * (n + m) - 1e-9
    sizes = (n >= least * m - 1e-9) & (m >= least * n - 1e-9)
    once = F.element_at(F.array_intersect("lf", "rf"), 1) == F.col("g")  # of the trigrams that a pair meets at, the rarest
    met = x.join(y, "g").filter(sizes & enough)
    both = F.size(F.array_intersect("lg", "rg"))
    found = met.filter(once).select("left", "right", (n + m).alias("total"), both.alias("both"))
    similarity = F.col("both") / (F.col("total") - F.col("both"))
    return found.select("left", "right", similarity.alias("similarity")).filter(F.col("similarity") >= least)


def _code(gram: Column) -> Column:
    """A trigram's three code points as one number."""
    point = lambda i: F.ascii(F.substring(gram, i, 1)).cast("long")
    return point(1) * (1 << 42) + point(2) * (1 << 21) + point(3)


def best_of(pairs: DataFrame, question: str, order: list[Column], most: int) -> DataFrame:
    """Of each question, the first rows in the order given."""
    w = Window.partitionBy(question).orderBy(*order)
    return pairs.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= most).drop("_n")
