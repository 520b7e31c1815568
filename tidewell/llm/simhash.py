"""SimHash near-dedup: fingerprints are embedded as per-segment bit counts and joined on a grid of them.

The 64 bits are 32 segments of two bits. A flipped bit changes one segment's count by one, so the Manhattan
distance of the count vectors is a lower bound of the bit distance. Counts 0, 1, 2 are stored as 00, 01, 11,
so that distance is the number of differing bits of two embeddings. Of two vectors at distance 3 or less, one half
(16 segments) differs by 1 or less: a grid cell is the counts of one half, and each vector also probes the cells
one count above its own. Candidates pass the Manhattan bound, then the exact bit distance.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.llm.common import partitions, prefix, same, small, table, text_batches, written
from tidewell.llm.components import components

SEED, WORDS, MAX_BITS = 42, 3, 3
#: Vectors in one cell above which its rows are dealt over several tasks.
CELL_ROWS = 20_000
#: Pairs compared at once.
PAIR_BLOCK = 2_000_000
LOW = np.uint64(0x5555555555555555)


def fingerprint(text: bytes) -> bytes:
    """64 bits, the first the highest: a bit is set if over half of the shingles' hashes set it; no words: zero."""
    words = text.lower().split()
    if not words:
        return bytes(8)
    joined, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate(([0], ends[:-1]))
    n = max(1, len(words) - WORDS + 1)
    stops = (ends[WORDS - 1 :] if len(words) >= WORDS else ends[-1:]) - 1
    digest, sums = xxhash.xxh64_digest, np.zeros(64, np.int64)
    spans = list(zip(starts[:n].tolist(), stops.tolist(), strict=True))
    for at in range(0, n, 65536):
        raw = b"".join([digest(joined[a:b], SEED) for a, b in spans[at : at + 65536]])
        sums += np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(sums * 2 > n).tobytes()


def _fingerprints(batches):
    for b in batches:
        prints = b"".join([fingerprint((t or "").encode("utf-8", "surrogatepass")) for t in b.column("text").to_pylist()])
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.frombuffer(prints, ">i8").astype(np.int64))], ["doc_id", "fp"])


def embed(x: np.ndarray) -> np.ndarray:
    high, low = (x >> np.uint64(1)) & LOW, x & LOW
    return (high | low) | ((high & low) << np.uint64(1))


def _cells(batches):
    """Rows (cell, fp, probe): each fingerprint at home in two cells, and probing those one count above."""
    for b in batches:
        x = b.column("fp").to_numpy().view(np.uint64)
        t = embed(x)
        for half in (0, 1):
            own = (t >> np.uint64(32 * half)) & np.uint64(0xFFFFFFFF)
            tag = np.uint64(half << 32)
            cells, prints, probes = [own | tag], [x], [np.zeros(len(x), bool)]
            for segment in range(16):
                at = np.uint64(2 * segment)
                count = (own >> at) & np.uint64(3)
                can = count != np.uint64(3)
                step = np.where(count == np.uint64(0), np.uint64(1), np.uint64(2)) << at
                cells.append(((own | step) | tag)[can])
                prints.append(x[can])
                probes.append(np.ones(int(can.sum()), bool))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(cells).view(np.int64)), pa.array(np.concatenate(prints).view(np.int64)), pa.array(np.concatenate(probes))], ["cell", "fp", "probe"]
            )


def hang(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of n nodes by links a-b."""
    low = np.arange(n)
    while True:
        x, y = low[a], low[b]
        open_ = x != y
        if not open_.any():
            return low
        np.minimum.at(low, np.maximum(x, y)[open_], np.minimum(x, y)[open_])
        while not np.array_equal(low, low[low]):
            low = low[low]


def linked(cell: np.ndarray, fp: np.ndarray, probe: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links among rows of whole cells: a spanning forest of all pairs at MAX_BITS or fewer, home with home or probe."""
    nodes, index = np.unique(fp, return_inverse=True)
    home = np.flatnonzero(~probe)
    home = home[np.argsort(cell[home], kind="stable")]
    keys, t = cell[home], embed(fp)
    first, last = np.searchsorted(keys, cell, "left"), np.searchsorted(keys, cell, "right")
    place = np.empty(len(cell), np.int64)
    place[home] = np.arange(len(home))
    first = np.where(probe, first, place + 1)  # a home row meets those after it
    size = np.maximum(last - first, 0)
    rows = np.flatnonzero(size)
    low = np.arange(len(nodes))
    ends = np.cumsum(size[rows])
    at = 0
    while at < len(rows):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIR_BLOCK, "right")))
        part = rows[at:stop]
        left = np.repeat(part, size[part])
        offset = np.arange(len(left)) - np.repeat(np.cumsum(size[part]) - size[part], size[part])
        right = home[np.repeat(first[part], size[part]) + offset]
        near = np.bitwise_count(t[left] ^ t[right]) <= MAX_BITS  # the lower bound
        left, right = left[near], right[near]
        near = np.bitwise_count(fp[left] ^ fp[right]) <= MAX_BITS  # exactly
        a, b = low[index[left[near]]], low[index[right[near]]]
        low = hang(len(nodes), np.concatenate((np.arange(len(nodes)), a)), np.concatenate((low, b)))
        at = stop
    moved = np.flatnonzero(low != np.arange(len(nodes)))
    return nodes[moved], nodes[low[moved]]


def _links(batches):
    """Batches sorted by cell, split anywhere: whole cells are joined, the last one waits for more of its rows."""
    held: list[np.ndarray] = []
    def out(part):
        a, b = linked(part[0].view(np.uint64), part[1].view(np.uint64), part[2].astype(bool))
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])
    for batch in batches:
        new = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("cell", "fp", "probe")]
        held = [np.concatenate(x) for x in zip(held, new, strict=True)] if held else new
        if len(held[0]) >= 200_000 and held[0][0] != held[0][-1]:
            cut = int(np.searchsorted(held[0], held[0][-1], "left"))
            yield out([x[:cut] for x in held])
            held = [x[cut:] for x in held]
    if held and len(held[0]):
        yield out(held)


def link_prints(prints: DataFrame, cell_rows: int = CELL_ROWS) -> DataFrame:
    """prints(fp), distinct -> links (a, b) that connect all fingerprints which differ in MAX_BITS or fewer."""
    rows = prints.select("fp").mapInArrow(_cells, "cell long, fp long, probe boolean")
    homes = rows.filter("not probe").groupBy("cell").agg(F.count("*").alias("homes"))
    hot = written(homes.filter(F.col("homes") > cell_rows).select(F.col("cell").alias("hot"), F.ceil(F.col("homes") / cell_rows).cast("int").alias("parts")))
    n = partitions(prints.sparkSession)
    if not hot.isEmpty():
        return _links_of_hot(rows, small(hot, 1_000_000), n)
    return rows.repartition(n, "cell").sortWithinPartitions("cell").mapInArrow(_links, "a long, b long").distinct()


def _links_of_hot(rows: DataFrame, hot: DataFrame, n: int) -> DataFrame:
    """Hot cells: block i of a cell meets each block j, every pair of blocks a cell of its own."""
    rows = rows.join(hot, rows.cell == hot.hot, "left").withColumn("part", F.pmod(F.xxhash64("fp"), F.coalesce("parts", F.lit(1))))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)))
    # As itself in (part, other); and as the home row that others meet in (other, part).
    mine = rows.select(F.xxhash64("cell", "part", "other").alias("cell"), "fp", (F.col("probe") | (F.col("part") != F.col("other"))).alias("probe"))
    met = rows.filter("not probe and part <> other").select(F.xxhash64("cell", "other", "part").alias("cell"), "fp", "probe")
    return mine.unionByName(met).repartition(n, "cell").sortWithinPartitions("cell").mapInArrow(_links, "a long, b long").distinct()


def _placed(docs: DataFrame, id_col: str, text_col: str, cell_rows: int) -> tuple[DataFrame, DataFrame]:
    """(rows: doc_id, fp; prints: fp, first_id, root): the smallest id of each fingerprint, and its component by a fingerprint of it."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = written(text_batches(rows, _fingerprints, f"doc_id {kind}, fp long"), texts=True)
    prints = written(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    roots = components(link_prints(prints, cell_rows))
    return rows, prints.join(roots, prints.fp == roots.node, "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, cell_rows: int = CELL_ROWS) -> DataFrame:
    """One row per row of docs: doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id reachable).

    Null and empty texts have fingerprint zero and are linked like any other. Null ids count as larger than all
    others; a component of null ids only has a null component_id. Repeated rows are one node. No rows: none.
    """
    rows, placed = _placed(docs, id_col, text_col, cell_rows)
    lowest = placed.groupBy("root").agg(F.min("first_id").alias("component_id"))
    placed = placed.join(lowest, "root").select(F.col("fp").alias("p"), "component_id")
    return rows.join(placed, rows.fp == placed.p).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _with_prints(text_col: str, name: str):
    def run(batches):
        for b in batches:
            prints = b"".join([fingerprint((t or "").encode("utf-8", "surrogatepass")) for t in b.column(text_col).to_pylist()])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.frombuffer(prints, ">i8").astype(np.int64))], [*b.schema.names, name])

    return run


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of docs for each component: the one with the smallest id, null ids last; of several texts under that id, the
    one with the smallest fingerprint; of rows repeated under both, any one.

    Ids may be null or repeated, with equal or different texts: only rows under such ids are fingerprinted a second time.
    """
    p = prefix(docs)
    rows, placed = _placed(docs, id_col, text_col, CELL_ROWS)
    best = F.min_by(F.struct("first_id", "fp"), F.struct(F.col("first_id").isNull(), "first_id", "fp"))
    first = written(placed.groupBy("root").agg(best.alias("k")).select(F.col("k.first_id").alias(f"{p}id"), F.col("k.fp").alias(f"{p}fp")))
    pairs = rows.groupBy("doc_id", "fp").agg(F.count("*").alias("n"))
    pairs = pairs.join(first, same(F.col("doc_id"), F.col(f"{p}id")) & (F.col("fp") == F.col(f"{p}fp")), "left")
    stays = F.col(f"{p}fp").isNotNull()
    ids = pairs.groupBy("doc_id").agg(F.bool_or(stays).alias("some"), F.bool_and(stays & (F.col("n") == 1)).alias("whole"))
    ids = written(ids.filter("not whole").select(F.col("doc_id").alias(f"{p}id"), F.col("some").alias(f"{p}some")))
    kept = docs.join(small(ids, 1_000_000), same(docs[id_col], ids[f"{p}id"]), "left_anti")
    mixed = ids.filter(f"{p}some").select(f"{p}id")
    if mixed.isEmpty():
        return kept
    again = docs.join(mixed, same(docs[id_col], mixed[f"{p}id"]), "left_semi").withColumn(f"{p}text", F.col(text_col).cast("string"))
    schema = T.StructType([*again.schema.fields, T.StructField(f"{p}print", T.LongType())])
    again = text_batches(again, _with_prints(f"{p}text", f"{p}print"), schema)
    again = again.join(first, same(again[id_col], first[f"{p}id"]) & (again[f"{p}print"] == first[f"{p}fp"]), "left_semi")
    return kept.unionByName(again.dropDuplicates([id_col, f"{p}print"]).select(*docs.columns))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(table(spark, sf_dir, "documents"))
