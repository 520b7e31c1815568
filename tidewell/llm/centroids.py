"""Centroid clustering of whole-number vectors with Elkan's bounds.

Every vector keeps, from round to round, its cluster, an upper bound of the distance to its centroid and a lower bound
of the distance to each of the k centroids, in a table beside the vector. Where a centroid moves, bounds widen by the
way it went. A distance is worked out only if neither the lower bound nor half the distance between the two centroids
says that it can't matter. Upper bounds are rounded up and lower bounds down, and only strictly greater ones rule a
centroid out, so ties go to the smaller number as without bounds. Distances are squared in whole numbers.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.common import dropped, table, written

DIMENSIONS, SCALE, K, ROUNDS, SEED = 64, 64, 16, 3, 1
#: Components beyond this would give squared distances that a long can't hold.
LIMIT = 1 << 27
#: Vectors that are worked on at a time.
BATCH = 10_000
#: Four units in the last place of a double, as one rounding of a square root and one of its argument are less.
_UP, _DOWN = 1 + 4 * np.finfo(float).eps, 1 - 4 * np.finfo(float).eps


def whole(vector: Column, dimensions: int = DIMENSIONS) -> Column:
    """True for vectors of the right length whose components are all there and finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce((F.size(vector) == dimensions) & finite, F.lit(False))


def _numbers(column, dimensions: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dimensions)


def _lists(values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1) * values.shape[1], pa.int32()), pa.array(values.reshape(-1)))


def _slices(batches):
    for b in batches:
        for at in range(0, b.num_rows, BATCH):
            yield b.slice(at, BATCH)


def _scaled(dimensions: int, scale: int):
    """floor(scale * x) of each component."""

    def run(batches):
        for b in _slices(batches):
            x = np.floor(scale * _numbers(b.column("v"), dimensions).astype(np.float64))
            if len(x) and np.abs(x).max() > LIMIT:
                raise ValueError(f"a component is beyond {LIMIT} after scaling: its squared distances don't fit a long")
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), _lists(x.astype(np.int32))], ["vec_id", "x"])

    return run


def _squares(x: np.ndarray, rows: np.ndarray, centroid: np.ndarray) -> np.ndarray:
    """Exact squared distances of some vectors to one centroid, or each to its own."""
    way = x[rows] - centroid
    return np.einsum("ij,ij->i", way, way)


def _low(squares: np.ndarray) -> np.ndarray:
    """Roots rounded down to a float of 32 bits."""
    return np.nextafter((np.sqrt(squares) * _DOWN).astype(np.float32), np.float32(-np.inf))


def elkan(x: np.ndarray, own: np.ndarray, upper: np.ndarray, lower: np.ndarray, centroids: np.ndarray) -> int:
    """Moves own to the nearest centroid of each vector and tightens the bounds, all in place; gives how many distances that took.

    own, upper and lower are of the same centroids; no bound is an infinite upper and zero lower ones.
    """
    k = len(centroids)
    if not len(x):
        return 0
    between = np.sqrt(((centroids[:, None] - centroids[None]) ** 2).sum(axis=2)) * _DOWN / 2

    def open_(rows: np.ndarray) -> np.ndarray:
        """Which centroids bounds don't rule out, for each of some vectors."""
        held = upper[rows, None]
        out = (held >= lower[rows]) & (held >= between[own[rows]])
        out[np.arange(len(rows)), own[rows]] = False
        return out

    rows = np.flatnonzero(open_(np.arange(len(x))).any(axis=1))
    best = np.zeros(len(x), np.int64)
    best[rows] = _squares(x, rows, centroids[own[rows]])
    upper[rows], lower[rows, own[rows]] = np.sqrt(best[rows]) * _UP, _low(best[rows])
    done = len(rows)
    for j in range(k):
        held = upper[rows]
        at = rows[(own[rows] != j) & (held >= lower[rows, j]) & (held >= between[own[rows], j])]
        squares = _squares(x, at, centroids[j])
        done += len(at)
        lower[at, j] = _low(squares)
        nearer = (squares < best[at]) | ((squares == best[at]) & (j < own[at]))
        at, squares = at[nearer], squares[nearer]
        own[at], best[at], upper[at] = j, squares, np.sqrt(squares) * _UP
    return done


def widened(upper: np.ndarray, lower: np.ndarray, own: np.ndarray, moved: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds after each centroid went a way of at most moved."""
    less = np.nextafter(lower - (moved * _UP).astype(np.float32) * np.float32(1 + 1e-6), np.float32(-np.inf))
    return (upper + moved[own] * _UP) * _UP, np.maximum(less, np.float32(0))


def _assigned(centroids: np.ndarray, moved: np.ndarray | None, dimensions: int, last: bool):
    """A round: vectors with their new cluster and bounds; the last one with exact distances in their place."""
    k = len(centroids)

    def run(batches):
        for b in _slices(batches):
            x = _numbers(b.column("x"), dimensions).astype(np.int64)
            if moved is None:
                own, upper, lower = np.zeros(len(x), np.int64), np.full(len(x), np.inf), np.zeros((len(x), k), np.float32)
            else:
                own = b.column("cluster").to_numpy(zero_copy_only=False).astype(np.int64)
                upper, lower = widened(b.column("upper").to_numpy(), _numbers(b.column("lower"), k), own, moved)
            elkan(x, own, upper, lower, centroids)
            cluster = pa.array(own.astype(np.int32))
            if last:
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), cluster, pa.array(_squares(x, np.arange(len(x)), centroids[own]))], ["vec_id", "cluster", "distance"])
            else:
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("x"), cluster, pa.array(upper), _lists(lower)], ["vec_id", "x", "cluster", "upper", "lower"])

    return run


def _sums(k: int, dimensions: int):
    """Of each cluster in a task: its number of vectors and the sums of their components."""

    def run(batches):
        total = np.zeros((k, dimensions + 1), np.int64)
        for b in _slices(batches):
            own, x = b.column("cluster").to_numpy(zero_copy_only=False), _numbers(b.column("x"), dimensions).astype(np.int64)
            for j in np.unique(own):
                mine = x[own == j]
                total[j, 0] += len(mine)
                total[j, 1:] += mine.sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k, dtype=np.int32)), _lists(total)], ["cluster", "total"])

    return run


def _moved_to(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The floor of each cluster's mean; k times the dimensions come to the driver."""
    k, dimensions = centroids.shape
    parts = state.select("cluster", "x").mapInArrow(_sums(k, dimensions), "cluster int, total array<long>").select("cluster", F.posexplode("total").alias("at", "n"))
    total = [[0] * (dimensions + 1) for _ in range(k)]
    for r in parts.groupBy("cluster", "at").agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n")).collect():
        total[r["cluster"]][r["at"]] = int(r["n"])
    return np.array([[s // t[0] for s in t[1:]] if t[0] else c for t, c in zip(total, centroids.tolist(), strict=True)], np.int64)


def first_centroids(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors of smallest SHA-256 of seed and id; of equal ids, the smaller vector first."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("")))
    found = vectors.select(F.sha2(text.cast("binary"), 256).alias("h"), "x").orderBy("h", "x").limit(k).collect()
    return np.array([r["x"] for r in found], np.int64)


def cluster(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", *, k: int = K, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE, seed: int = SEED) -> tuple[DataFrame, np.ndarray]:
    """((vec_id, cluster, distance) of each vector kept, the final centroids).

    Vectors that are null, of another length, or with a null or non-finite component aren't kept; if fewer than k are,
    there are as many centroids. Ids may be null or repeated: each row counts by itself. Of centroids at one distance,
    the smaller number wins. Components beyond 2^27 after scaling end the job with a message. An empty table gives no
    rows. Other columns don't matter.
    """
    kind = vectors.schema[id_col].dataType.simpleString()
    v = F.col(vector_col) if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else F.col(vector_col).cast("array<double>")
    kept = vectors.select(F.col(id_col).alias("vec_id"), v.alias("v")).filter(whole(F.col("v"), dimensions))
    state = written(kept.mapInArrow(_scaled(dimensions, scale), f"vec_id {kind}, x array<int>"))
    centroids, moved = first_centroids(state, k, seed), None
    if not len(centroids):
        return state.selectExpr("vec_id", "0 as cluster", "0L as distance"), np.zeros((0, dimensions), np.int64)
    for _ in range(rounds):
        found = written(state.mapInArrow(_assigned(centroids, moved, dimensions, False), f"vec_id {kind}, x array<int>, cluster int, upper double, lower array<float>"))
        dropped(state)
        state, before = found, centroids
        centroids = _moved_to(state, before)
        moved = np.sqrt(((centroids - before) ** 2).sum(axis=1)) * _UP
    found = written(state.mapInArrow(_assigned(centroids, moved, dimensions, True), f"vec_id {kind}, cluster int, distance long"))
    dropped(state)
    return found, centroids


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, centroids = cluster(table(spark, sf_dir, "embeddings"))
    total = F.sum(F.col("distance").cast("decimal(38,0)"))
    sums = {r["cluster"]: int(r["total"]) for r in found.groupBy("cluster").agg(total.alias("total")).collect()}  # k rows at most
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    kinds = "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"
    clusters = spark.createDataFrame([(j, n, sum(sums.values()), digests[j]) for j, n in sums.items()], kinds)
    return found.join(F.broadcast(clusters), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql_round(n: int) -> str:
    """Assignment to the centroids of round n, and the centroids after it."""
    return f"""
), a{n} AS (
    SELECT rid, arg_min(j, struct_pack(d := d, j := j)) AS j, min(d) AS d
    FROM (SELECT v.rid, c.j, list_sum(list_transform(range(1, 65), lambda i: (v.x[i] - c.x[i]) * (v.x[i] - c.x[i])))::BIGINT AS d FROM v, c{n} c)
    GROUP BY rid
), m{n} AS (
    SELECT j, i, sum(x[i]) AS s, count(*) AS n FROM v JOIN a{n} USING (rid), range(1, 65) AS r(i) GROUP BY j, i
), c{n + 1} AS (
    SELECT c.j, coalesce(f.x, c.x) AS x
    FROM c{n} c LEFT JOIN (SELECT j, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS x FROM m{n} GROUP BY j) f USING (j)"""


#: All distances of all rounds, without bounds.
OP12_SQL = f"""
WITH v AS MATERIALIZED (
    SELECT vec_id, row_number() OVER () AS rid, list_transform(embedding, lambda e: CAST(floor(64 * CAST(e AS DOUBLE)) AS BIGINT)) AS x
    FROM embeddings
    WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = 64
), c0 AS (
    SELECT row_number() OVER (ORDER BY h, x) - 1 AS j, x
    FROM (SELECT sha256('1:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS h, x FROM v ORDER BY h, x LIMIT 16)
{"".join(_sql_round(n) for n in range(ROUNDS))}
), f AS (
    SELECT rid, arg_min(j, struct_pack(d := d, j := j)) AS j, min(d) AS d
    FROM (SELECT v.rid, c.j, list_sum(list_transform(range(1, 65), lambda i: (v.x[i] - c.x[i]) * (v.x[i] - c.x[i])))::BIGINT AS d FROM v, c{ROUNDS} c)
    GROUP BY rid
)
SELECT v.vec_id, CAST(f.j AS INTEGER) AS cluster, f.d AS distance, CAST(sum(f.d) OVER (PARTITION BY f.j) AS BIGINT) AS cluster_inertia,
    CAST(sum(f.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM f JOIN v USING (rid) JOIN c{ROUNDS} c ON c.j = f.j
"""
