"""Document fingerprints: improbable byte windows in a chain of Bloom filters.

The entropy of each window of 64 bytes is binned; a corpus-wide histogram of the bins gives each a rank, the rarest
the lowest. Among each 64 neighbouring windows the leftmost of lowest rank is the winner; windows that win 16 times
or more are the features. A text with few features, as short ones have, adds all its windows of 8 bytes, and of 4, 2
and 1 the shorter it is. A feature sets 5 bits of a 2048-bit filter; after 160 features a new filter is chained.
"""

from __future__ import annotations

import base64
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from tidewell.llm.common import partitions, table, text_batches, written

WINDOW, NEIGHBOURS, WINS = 64, 64, 16
#: A text of no feature, or under SHORT_BYTES and of fewer than FEW, adds all windows of SHORT[0] bytes, and those of w bytes
#: if it is shorter than 8 w. Longer ones are told by their features: windows of repeated lines would outweigh these.
FEW, SHORT_BYTES, SHORT = 8, 600, (8, 4, 2, 1)
BINS = 1000
#: Bins of windows that say little: nearly constant bytes, or nearly all bytes different.
WEAK = (100, 990)
FILTER_BITS, FEATURES, HASHES = 2048, 160, 5
#: Bytes of texts that are worked on together; they fit a core's cache.
BLOCK = 1 << 15
#: Code points of texts for each partition, at least as many partitions as the session shuffles to.
PARTITION_CHARS = 64_000_000

_G = np.concatenate(([0.0], np.arange(1, WINDOW + 1) * np.log2(np.arange(1, WINDOW + 1))))
#: What one more byte adds to the sum of c * log2(c) when there were c of it; fixed point, so sums are exact (modulo 2^32).
_STEP = np.round((_G[1:] - _G[:-1]) * (1 << 16)).astype(np.uint32)
_FULL = 6 * WINDOW << 8  # that sum for WINDOW equal bytes, in units of 2^-8
_MIX = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB], np.uint64)


def entropy_bins(data: np.ndarray) -> np.ndarray:
    """Bin, 0 to BINS, of the entropy of each window of data (uint8, at least WINDOW of them)."""
    n = len(data)
    before, after = np.zeros(n, np.uint8), np.zeros(n, np.uint8)  # equal bytes among the WINDOW - 1 before, after
    for lag in range(1, WINDOW):
        equal = (data[lag:] == data[:-lag]).view(np.uint8)
        before[lag:] += equal
        after[:-lag] += equal
    total = np.cumsum(_STEP.take(before), dtype=np.uint32)[WINDOW - 1 :]
    total[1:] -= np.cumsum(_STEP.take(after[: n - WINDOW]), dtype=np.uint32)
    rest = _FULL - (total >> np.uint32(8)).astype(np.int32)
    return np.clip((rest * BINS + _FULL // 2) // _FULL, 0, BINS)


def _blocks(texts: list[bytes]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """(indexes of texts, their bytes one after another, where each starts), about BLOCK bytes each."""
    at, size = [], 0
    for i, t in enumerate(texts):
        at.append(i)
        size += len(t)
        if size >= BLOCK or i == len(texts) - 1:
            lengths = [len(texts[k]) for k in at]
            yield at, np.frombuffer(b"".join([texts[k] for k in at]), np.uint8), np.concatenate(([0], np.cumsum(lengths)))
            at, size = [], 0


def _count_bins(batches):
    total = np.zeros(BINS + 1, np.int64)
    for b in batches:
        texts = [(t or "").encode("utf-8", "surrogatepass") for t in b.column("text").to_pylist()]
        for _, data, starts in _blocks(texts):
            if len(data) >= WINDOW:
                ok = np.ones(len(data), bool)
                for s in starts[1:-1]:
                    ok[max(0, s - WINDOW + 1) : s] = False  # windows over the end of a text
                total += np.bincount(entropy_bins(data)[ok[: len(data) - WINDOW + 1]], minlength=BINS + 1)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(BINS + 1)), pa.array(total)], ["bin", "windows"])


def rarity(counts: np.ndarray) -> np.ndarray:
    """Rank of each bin, the rarest 0; weak bins come last."""
    rank = np.empty(BINS + 1, np.int32)
    rank[np.lexsort((np.arange(BINS + 1), counts))] = np.arange(BINS + 1)
    rank[: WEAK[0]] = rank[WEAK[1] + 1 :] = BINS + 1
    return rank


def _features(data: np.ndarray, starts: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the selected windows, and the text that each is of."""
    if len(data) < WINDOW:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    n = len(data) - WINDOW + 1
    worth = rank[entropy_bins(data)]
    outside = np.zeros(n + 1, bool)
    for s in starts[1:-1]:
        outside[max(0, s - WINDOW + 1) : s] = True
    outside = outside[:n]
    worth[outside] = BINS + 2
    kind, bits = (np.int32, 20) if n < 1 << 20 else (np.int64, 40)
    best = (worth.astype(kind) << kind(bits)) | np.arange(n, dtype=kind)
    reach = 1
    while reach < NEIGHBOURS and reach < n:
        step = min(reach, NEIGHBOURS - reach)
        best[:-step] = np.minimum(best[:-step], best[step:])
        reach += step
    # The windows over a text's end separate it from the next, so the neighbours of its own windows are its own.
    best = best[(best < kind((BINS + 1) << bits)) & ~outside] & kind((1 << bits) - 1)
    # Winners come in runs: a window wins its neighbourhoods one after another.
    runs = np.flatnonzero(np.concatenate(([True], best[1:] != best[:-1]))) if len(best) else np.zeros(0, np.int64)
    won = np.diff(np.append(runs, len(best)))
    chosen = best[runs][won >= WINS].astype(np.int64)
    return chosen, np.searchsorted(starts, chosen, "right") - 1


def _hashes(data: np.ndarray, places: np.ndarray, width: int = WINDOW) -> np.ndarray:
    words = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, width)[places]).view(f"u{min(width, 8)}")
    h = np.full(len(places), _MIX[0] ^ np.uint64(WINDOW - width), np.uint64)
    for k in range(words.shape[1]):
        h = (h ^ words[:, k]) * _MIX[1]
        h ^= h >> np.uint64(29)
        h *= _MIX[2]
        h ^= h >> np.uint64(32)
    return h


def digests(texts: list[bytes], rank: np.ndarray) -> list[bytes]:
    """A chain of filters for each text, b"" for an empty one.

    What a text with few features adds comes after them, so that texts on both sides of FEW still share those.
    """
    out: list[bytes] = [b""] * len(texts)
    for at, data, starts in _blocks(texts):
        places, owner = _features(data, starts, rank)
        hashes = _hashes(data, places) if len(places) else np.zeros(0, np.uint64)
        different = np.bincount(np.unique(np.rec.fromarrays([owner, hashes])).f0, minlength=len(at))
        few = np.flatnonzero((different == 0) | (different < FEW) & (np.diff(starts) < SHORT_BYTES))
        for width in SHORT:
            those = [k for k in few if width <= (size := starts[k + 1] - starts[k]) and (width == SHORT[0] or size < 8 * width)]
            if those:
                every = np.concatenate([np.arange(starts[k], starts[k + 1] - width + 1) for k in those])
                owner = np.append(owner, np.searchsorted(starts, every, "right") - 1)
                hashes = np.append(hashes, _hashes(data, every, width))
        # Each feature once a text, in the order of first places.
        order = np.lexsort((np.arange(len(owner)), hashes, owner))
        first = np.ones(len(order), bool)
        first[1:] = (owner[order][1:] != owner[order][:-1]) | (hashes[order][1:] != hashes[order][:-1])
        keep = np.sort(order[first])
        keep = keep[np.argsort(owner[keep], kind="stable")]
        owner, hashes = owner[keep], hashes[keep]
        cuts = np.searchsorted(owner, np.arange(len(at) + 1))
        rows = -(-np.diff(cuts) // FEATURES)
        base = np.concatenate(([0], np.cumsum(rows)))
        filters = np.zeros((base[-1], FILTER_BITS), bool)
        row = base[owner] + (np.arange(len(owner)) - cuts[owner]) // FEATURES
        for j in range(HASHES):
            filters[row, ((hashes >> np.uint64(11 * j)) & np.uint64(FILTER_BITS - 1)).astype(np.int64)] = True
        packed = np.packbits(filters, axis=1)
        for k, i in enumerate(at):
            out[i] = packed[base[k] : base[k + 1]].tobytes()
    return out


def likeness(a: bytes, b: bytes) -> float:
    """0 to 1: for each filter of the shorter chain the best bit overlap, beyond that expected by chance; their mean."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    size = FILTER_BITS // 8
    x, y = ([int.from_bytes(c[i : i + size], "big") for i in range(0, len(c), size)] for c in ((a, b) if len(a) <= len(b) else (b, a)))
    total = weight = 0.0
    for f in x:
        best, bits = 0.0, f.bit_count()
        for g in y:
            most = min(bits, g.bit_count())
            chance = bits * g.bit_count() / FILTER_BITS
            best = max(best, ((f & g).bit_count() - chance) / max(most - chance, 1e-9))
        total, weight = total + min(best, 1.0) * bits, weight + bits
    return total / weight


def edited(text: str, following: str) -> str:
    """The last quarter of the code points replaced by as many of the next text's first (or all)."""
    quarter = len(text) // 4
    return text[: len(text) - quarter] + following[:quarter]


SCHEMA = "doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compare(kind: pa.DataType, rank: np.ndarray):
    def run(batches):
        held: tuple | None = None  # the last row, which waits for the next
        for b in batches:
            rows = list(zip(b.column("part").to_pylist(), b.column("extra").to_pylist(), b.column("doc_id").to_pylist(), [t or "" for t in b.column("text").to_pylist()], strict=True))
            raw = [r[3].encode("utf-8", "surrogatepass") for r in rows]
            prints = digests(raw, rank)
            rows = ([held] if held else []) + [(*r, p) for r, p in zip(rows, prints, strict=True)]
            pairs = [(x, y) for x, y in zip(rows, rows[1:], strict=False) if not x[1] and x[0] == y[0]]
            held = rows[-1] if rows else None
            new = [edited(x[3], y[3]).encode("utf-8", "surrogatepass") for x, y in pairs]
            changed = digests(new, rank)
            text = lambda p: base64.b64encode(p).decode()
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([x[2] for x, _ in pairs], kind),
                    pa.array([len(x[3]) for x, _ in pairs], pa.int64()),
                    pa.array([hashlib.sha256(t).hexdigest() for t in new], pa.string()),
                    pa.array([text(x[4]) for x, _ in pairs], pa.string()),
                    pa.array([text(p) for p in changed], pa.string()),
                    pa.array([likeness(x[4], p) for (x, _), p in zip(pairs, changed, strict=True)], pa.float64()),
                    pa.array([likeness(x[4], y[4]) for x, y in pairs], pa.float64()),
                ],
                ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )

    return run


def bin_counts(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Windows of all texts in each entropy bin."""
    rows = text_batches(docs.select(F.col(text_col).cast("string").alias("text")), _count_bins, "bin long, windows long")
    counts = np.zeros(BINS + 1, np.int64)
    for r in rows.groupBy("bin").agg(F.sum("windows").alias("n")).collect():  # BINS + 1 rows
        counts[r["bin"]] = r["n"]
    return counts


def range_of(key: Column, cuts: list[int]) -> Column:
    """How many of the ascending cuts lie below the key, by looking at about twice the root of their number."""
    step = max(1, math.isqrt(len(cuts)))
    heads = F.size(F.filter(F.lit(cuts[::step] or [0]), lambda c: c < key)) if cuts else F.lit(0)
    runs = [cuts[i : i + step] for i in range(0, len(cuts), step)]
    within = F.size(F.filter(F.get(F.lit(runs), F.greatest(heads - 1, F.lit(0))), lambda c: c < key)) if cuts else F.lit(0)
    return F.when(heads > 0, (heads - 1) * step + within).otherwise(0)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each row's text and of its edited text, with their likeness, and that to the next row's.

    Rows follow each other by id, nulls first, ties by text; after the last comes the first. Null counts as empty.
    Of equal texts, fingerprints are equal; two empty ones are alike (1), an empty and another are not (0).
    The rows are dealt by ranges of ids, and the first of each range also goes to the range before. Ids are whole numbers.
    """
    spark = docs.sparkSession
    if not isinstance(docs.schema[id_col].dataType, IntegralType):
        raise TypeError(f"{id_col} must be a whole number, as the order of texts is that of their ids")
    rank = rarity(bin_counts(docs, text_col))
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63)))
    rows = docs.select(F.col(id_col).alias("doc_id"), key.alias("k"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    chars = docs.agg(F.sum(F.length(text_col))).first()[0] or 0
    n = max(partitions(spark), -(-chars // PARTITION_CHARS))
    ids = written(rows.select("k"))
    cuts = ids.agg(F.percentile_approx("k", [i / n for i in range(1, n)] or [0.5], 20 * n)).first()[0]
    if cuts is None:
        return spark.createDataFrame([], SCHEMA.format(kind=docs.schema[id_col].dataType.simpleString()))
    part = range_of(F.col("k"), sorted(set(cuts)))
    firsts = [(r["part"], r["k"]) for r in ids.groupBy(part.alias("part")).agg(F.min("k").alias("k")).orderBy("part").collect()]  # one for each range
    before = [(firsts[i][1], firsts[i - 1][0]) for i in range(len(firsts))]  # the first also goes to the last range
    edges = F.broadcast(spark.createDataFrame(before, "edge long, previous int"))
    own = rows.withColumn("part", part)
    both = own.join(edges, own.k == edges.edge, "left").withColumn(
        "to", F.expr("if(previous is null, array(struct(part, false as extra)), array(struct(part, false as extra), struct(previous as part, true as extra)))")
    )
    dealt = both.select("doc_id", "k", "text", F.inline("to")).repartition(n, "part").sortWithinPartitions("part", "extra", "k", "text")
    kind = docs.schema[id_col].dataType.simpleString()
    from pyspark.sql.pandas.types import to_arrow_type

    run = _compare(to_arrow_type(docs.schema[id_col].dataType), rank)
    return text_batches(dealt.select("part", "extra", "doc_id", "text"), run, SCHEMA.format(kind=kind))


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
