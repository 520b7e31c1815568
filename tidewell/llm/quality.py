"""Quality classifier: document statistics, random Fourier features, ridge scores, isotonic calibration.

The features approximate a Gaussian kernel. Each partition sums its share of the normal equations; the sums are added
by row of the matrix, so that no task holds more than its part, and the driver solves one small system. Calibration
pools the scores of the training rows in fixed steps. Training uses all labelled rows it is given.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.common import crc_mod, prefix, table, text_batches, written

FEATURES, SEED, RIDGE = 256, 7, 1e-3
#: Groups in which the sums of tasks are added first.
SUMS = 64
#: Width of the kernel, in standard deviations for each root of the number of statistics.
WIDTH = 0.7
#: Steps of the raw score that calibration pools.
STEP = 0.002

_CLASS = np.zeros((256, 12))
for _i in range(256):
    _c = chr(_i)
    _CLASS[_i] = [
        "a" <= _c <= "z", "A" <= _c <= "Z", "0" <= _c <= "9", _c == " ", _c == "\n", _c in ".?", _c in ",;:", _c == "!", _c == "|",
        _c in "#$%&*@^~=+<>{}[]\\_", _c in "\"'()-/", _i >= 0x80,
    ]


def statistics(text: str) -> list[float]:
    """What a text looks like, from the whole of it; all zeros but for the last when it is empty."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    words, lines = text.split(), text.split("\n")
    if not words:
        return [0.0] * 30 + [1.0]
    counts = np.bincount(raw, minlength=256)
    share = counts / len(raw)
    used = share[share > 0]
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    kinds: dict[str, int] = {}
    for w in words:
        kinds[w] = kinds.get(w, 0) + 1
    n = len(words)
    again = sum(map(str.__eq__, words, words[1:]))
    upper, title = sum(map(str.isupper, words)), sum(map(str.istitle, words))
    marked = sum(not w[-1].isalnum() for w in words)
    inner = [line for line in lines if line]
    return [
        *(share @ _CLASS), float(-(used * np.log2(used)).sum()), np.log1p(len(raw)), np.log1p(n),
        lengths.mean(), lengths.std(), np.log1p(lengths.max()), (lengths <= 3).mean(), (lengths == 1).mean(),
        len(kinds) / n, np.log1p(n) * len(kinds) / n, max(kinds.values()) / n, again / n, upper / n, title / n, marked / n,
        len(set(inner)) / max(1, len(inner)), np.log1p(len(raw) / len(lines)), sum(c == 1 for c in kinds.values()) / n, 0.0,
    ]


N_STATS = 31


def _statistics(batches):
    for b in batches:
        rows = [statistics(t or "") for t in b.column("text").to_pylist()]
        flat = pa.array(np.array(rows, np.float32).reshape(-1))
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * N_STATS, pa.int32()), flat)], ["doc_id", "stats"])


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return text_batches(rows, _statistics, f"doc_id {docs.schema[id_col].dataType.simpleString()}, stats array<float>")


def _matrix(column) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, N_STATS).astype(np.float64)


class Model:
    """Standardisation, the random features, the ridge weights and the calibration steps."""

    def __init__(self, mean: np.ndarray, std: np.ndarray):
        rng = np.random.default_rng(SEED)
        self.mean, self.std = mean, np.where(std > 1e-9, std, 1.0)
        self.directions = rng.normal(0, 1 / (WIDTH * np.sqrt(N_STATS)), (N_STATS, FEATURES))
        self.phases = rng.uniform(0, 2 * np.pi, FEATURES)
        self.weights = np.zeros(FEATURES + 1)
        self.at, self.level = np.array([0.0]), np.array([0.5])

    def features(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) / self.std, -6, 6)
        return np.hstack((np.cos(z @ self.directions + self.phases) * np.sqrt(2 / FEATURES), np.ones((len(z), 1))))

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(stats), self.at, self.level)


def isotonic(at: np.ndarray, mean: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: increasing means at increasing places, each pool at its own mean place."""
    pools: list[list[float]] = []
    for a, m, w in zip(at, mean, weight, strict=True):
        pools.append([a * w, m * w, w])
        while len(pools) > 1 and pools[-2][1] / pools[-2][2] >= pools[-1][1] / pools[-1][2]:
            last = pools.pop()
            pools[-1] = [x + y for x, y in zip(pools[-1], last, strict=True)]
    return np.array([p[0] / p[2] for p in pools]), np.array([p[1] / p[2] for p in pools])


def _equations(model: Model):
    def run(batches):
        total = np.zeros((FEATURES + 1, FEATURES + 2))
        for b in batches:
            z, y = model.features(_matrix(b.column("stats"))), b.column("y").to_numpy(zero_copy_only=False)
            total += z.T @ np.hstack((z, y[:, None]))
        flat = pa.ListArray.from_arrays(pa.array(np.arange(FEATURES + 2) * (FEATURES + 2), pa.int32()), pa.array(total.reshape(-1)))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(FEATURES + 1)), flat], ["i", "row"])

    return run


def _add_rows(rows: pa.Table) -> pa.Table:
    total = rows["row"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, FEATURES + 2).sum(axis=0)
    return pa.table({"i": rows["i"][:1], "row": [total.tolist()], "part": rows["part"][:1]})


def _raw(model: Model):
    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.clip(np.rint(model.raw(_matrix(b.column("stats"))) / STEP), -1000, 2000).astype(np.int64)), b.column("y")], ["step", "y"])

    return run


def fit(rows: DataFrame) -> Model | None:
    """rows(stats, y double 0 or 1) -> a model, or None without rows."""
    rows = written(rows)
    one = rows.select(F.posexplode("stats").alias("k", "v")).groupBy("k").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s")).collect()
    if not one:
        return None
    one = sorted(one, key=lambda r: r["k"])
    model = Model(np.array([r["m"] for r in one]), np.array([r["s"] for r in one]))
    parts = rows.mapInArrow(_equations(model), "i long, row array<double>").withColumn("part", F.spark_partition_id() % SUMS)
    for keys in (["i", "part"], ["i"]):  # in two levels, as every task of the scan adds a row to each sum
        parts = parts.groupBy(*keys).applyInArrow(_add_rows, "i long, row array<double>, part int")
    parts = parts.collect()
    total = np.array([r["row"] for r in sorted(parts, key=lambda r: r["i"])])
    gram, right = total[:, :-1], total[:, -1]
    model.weights = np.linalg.solve(gram + RIDGE * max(1.0, gram[-1, -1]) / FEATURES * np.eye(len(gram)), right)
    steps = rows.mapInArrow(_raw(model), "step long, y double").groupBy("step").agg(F.avg("y").alias("y"), F.count("*").alias("n")).orderBy("step").collect()
    model.at, model.level = isotonic(*(np.array(x, float) for x in zip(*((r["step"] * STEP, r["y"], r["n"]) for r in steps), strict=True)))
    return model


def _predict(model: Model | None):
    def run(batches):
        for b in batches:
            score = model.score(_matrix(b.column("stats"))) if model else np.full(b.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    return run


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score (0 to 1), predicted (1 if score >= 0.5) of every row; labels(doc_id, y) teach.

    Null and empty texts are scored like any other, by their statistics. Labels without a document, and null labels,
    teach nothing; without any, every score is 0.5. A repeated label or document counts as often as it is there.
    """
    stats = written(document_statistics(docs, id_col, text_col), texts=True)
    taught = labels.select(F.col("doc_id").alias("label_id"), F.col("y").cast("double").alias("y")).filter("y is not null")
    model = fit(stats.join(taught, stats.doc_id == taught.label_id).select("stats", "y"))
    return stats.mapInArrow(_predict(model), f"doc_id {docs.schema[id_col].dataType.simpleString()}, score double, predicted int")


def training_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").filter(crc_mod(F.col("doc_id"), 3) != 1).select("doc_id", F.col("quality").alias("y"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = quality_scores(table(spark, sf_dir, "documents"), training_labels(spark, sf_dir))
    return scores.select("doc_id", (crc_mod(F.col("doc_id"), 3) == 1).alias("held_out"), "score", "predicted")


def drop_low_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs whose predicted quality is 1; rows of one id go only if each of them is rejected."""
    p = prefix(docs)
    from tidewell.llm.common import same, small

    scores = quality_scores(docs, labels, id_col, text_col)
    gone = scores.groupBy("doc_id").agg(F.max("predicted").alias("p")).filter("p = 0").select(F.col("doc_id").alias(f"{p}id"))
    gone = small(written(gone), 1_000_000)
    return docs.join(gone, same(docs[id_col], gone[f"{p}id"]), "left_anti")
