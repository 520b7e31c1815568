"""LM scoring by Katz backoff over trigrams, from plain tables of n-grams, in buckets by the middle word.

Texts are cut into blocks of words. The distinct words of each block are dealt by word, packed, so that a part has all
there is of its words: their counts, and their ranks by count in that part. What each part has of each count then gives
every word an id, rising as counts fall; the ids go back to the blocks, and the texts become a table of ids. Every trigram (u, v, w) of a
text is dealt by its middle word v, so that a bucket holds all that the backoff of v and of (u, v) needs, and the places
where it is asked for. Buckets are stored as a table of lists: trigrams, their training counts, their places. From it
come the counts of counts of both orders, then every text's log-probability:

P(w|u,v) = d(c(u,v,w)) c(u,v,w) / c(u,v) where u v w was seen, else a(u,v) P(w|v), and so on down:
P(w|v) = d(c(v,w)) c(v,w) / c(v) where v w was seen, else a(v) P(w), with
a(h) = (1 - sum of P(w|h) over seen w) / (1 - sum of the lower order over seen w), so that each history sums to one.
P(w) = d(c(w)) c(w) / N where w was seen; what the discounts leave is shared evenly by the unseen words, of which there
are N1^2 / (2 N2) by Chao's estimate.

A middle word of very many places is split over buckets by w, and where w has as many, by u too. Sums over such a word
and over its (u, v) then come from all its buckets: the former are as few as such words, the latter go by a shuffle.
"""

from __future__ import annotations

import dataclasses
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewell.llm.common import crc_mod, dropped, partitions, table, text_batches, written
from tidewell.llm.tokens import Lookup, lists, runs, squeezed, text_blocks, unsqueezed

#: Ids: what stands before the first words of a text, the token after its last; words have the following ones. NONE is no word.
NONE, START, END, FIRST = 0, 1, 2, 3
#: Good-Turing discounts hold for counts up to this.
DISCOUNTED = 5
#: Places of a bucket; places of a middle word that is split; tokens that are sorted at once; trigrams of a stored row.
BUCKET, HOT, CUT, ROW = 600_000, 1_000_000, 600_000, 60_000
#: Words, and bytes of words, of a part of the words of all blocks; parts at most, which leaves each block some words a part.
PART, PART_BYTES, MOST_PARTS = 100_000, 4_000_000, 4096
#: Parts that a block of trigrams is cut into at once; bytes of packs that are then cut again; texts of a group whose scores are added in one task.
FAN, SPREAD_BYTES, GROUP = 8192, 3_000_000, 16_384
#: Parts of the histories of hot words at most, which leaves each bucket some histories a part.
HISTORIES = 1024
#: Scores of a part of a text are passed on in whole parts of this.
GRAIN = 1 << 20
SMOOTH = 0.1


def discounts(spectrum: list[int]) -> np.ndarray:
    """Factors of counts 0 to DISCOUNTED + 1 (the last stands for all above) from n[1], n[2], ...: Katz's form of Good-Turing.

    k is lowered until the factors lie in (0, 1]; where none fits, half a count is taken off each.
    """
    n = [0, *spectrum]
    for k in range(DISCOUNTED, 0, -1):
        if all(n[r] for r in range(1, k + 2)):
            a = (k + 1) * n[k + 1] / n[1]
            d = [((r + 1) * n[r + 1] / (n[r] * r) - a) / (1 - a) if a != 1 else 0.0 for r in range(1, k + 1)]
            if all(0 < x <= 1 for x in d):
                return np.array([1.0, *d, *[1.0] * (DISCOUNTED + 1 - k)])
    return np.array([1.0, *((r - 0.5) / r for r in range(1, DISCOUNTED + 1)), 1.0]) if n[1] else np.ones(DISCOUNTED + 2)


@dataclasses.dataclass
class Words:
    """Counts of all words by id: ids rise as counts fall, so there are at most sqrt(2 N) steps. And the hot words."""

    ends: np.ndarray  # first id beyond each step
    values: np.ndarray  # count of each step, falling
    end_count: int
    hot: np.ndarray  # ids with more than HOT places, ascending
    hot_places: np.ndarray

    def __post_init__(self):
        taught = self.values > 0
        numbers = np.diff(np.append(FIRST, self.ends))
        self.tokens = int((self.values * numbers).sum()) + self.end_count
        self.types = int(numbers[taught].sum()) + (self.end_count > 0)
        self.spectrum = [int(numbers[self.values == r].sum()) + (self.end_count == r) for r in range(1, DISCOUNTED + 2)]

    def count(self, ids: np.ndarray) -> np.ndarray:
        n = np.append(self.values, 0)[np.searchsorted(self.ends, ids, "right")]
        return np.where(ids == END, self.end_count, np.where(ids < FIRST, 0, n))

    def first(self, counts: np.ndarray) -> np.ndarray:
        """First ids of the steps of these counts."""
        return np.append(FIRST, self.ends)[np.searchsorted(-self.values, -counts)]

    def places(self, ids: np.ndarray) -> np.ndarray:
        """Places of hot words, 0 for the others."""
        at = Lookup(self.hot)(ids)
        return np.where(at >= 0, self.hot_places[at], 0) if len(self.hot) else np.zeros(len(ids), np.int64)

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + SMOOTH) / (self.tokens + SMOOTH * (self.types + 1)))

    def probability(self, c: np.ndarray) -> np.ndarray:
        d = discounts(self.spectrum)
        left = sum(n * r * (1 - d[r]) for r, n in enumerate(self.spectrum[:DISCOUNTED], 1))
        total = self.tokens if left > 0 else self.tokens + 1
        unseen = max(1.0, self.spectrum[0] ** 2 / (2 * max(1, self.spectrum[1])))
        return np.where(c > 0, d[np.minimum(c, DISCOUNTED + 1)] * c / total, (left or 1) / total / unseen)


_BLOCK = ["block", "row", "doc_id", "train", "length", "codes", "distinct", "size", "words"]


def _split(batches):
    """A row for each text; and one for each block, with where words stand in its texts, and its distinct words with their counts (compressed for the way)."""
    for block, rows, offsets, codes, words in text_blocks(batches, lower=True):
        train = rows.column("train").combine_chunks().to_numpy(zero_copy_only=False).astype(bool)
        every = np.bincount(codes, minlength=len(words))
        taught = np.bincount(codes[np.repeat(train, np.diff(offsets))], minlength=len(words))
        raw = zstandard.ZstdCompressor(level=1).compress(codes.astype("<i4").tobytes())
        text = np.frombuffer(pc.binary_join(lists(np.array([0, len(words)]), words), b"")[0].as_buffer() if len(words) else b"", np.uint8)
        listed = squeezed(pc.binary_length(words).to_numpy(zero_copy_only=False), taught, every, text)
        n, own = len(rows), ((raw, pa.binary()), (len(words), pa.int64()), (len(text), pa.int64()), (listed, pa.binary()))
        columns = [*(rows.column(c).combine_chunks() for c in ("row", "doc_id", "train")), pa.array(np.diff(offsets))]
        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, block)), *columns, *(pa.nulls(n, kind) for _, kind in own)], _BLOCK)
        yield pa.RecordBatch.from_arrays([pa.array([block]), *(pa.nulls(1, c.type) for c in columns), *(pa.array([x], kind) for x, kind in own)], _BLOCK)


def blocks_of(docs: DataFrame) -> DataFrame:
    """docs(row, doc_id, train, text) -> the table of blocks."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"block long, row long, doc_id {kind}, train boolean, length long, codes binary, distinct long, size long, words binary"
    return written(text_batches(docs.select("row", "doc_id", "train", "text"), _split, schema), texts=True)


def word_hash(lengths: np.ndarray, text: np.ndarray) -> np.ndarray:
    """A hash of each word; text has the bytes of all, none of them empty."""
    starts = np.cumsum(lengths) - lengths
    weights = mix(np.arange(1 << 16))[runs(np.zeros(len(lengths), np.int64), lengths) & 0xFFFF]
    return mix(np.add.reduceat(weights * text.astype(np.uint64), starts).view(np.int64), lengths) if len(lengths) else weights


def _dealt_words(parts: int):
    """The words of blocks by part: codes, lengths, counts and bytes."""

    def run(batches):
        for b in batches:
            for block, raw in zip(b.column("block").to_pylist(), b.column("words").to_pylist(), strict=True):
                lengths, taught, every, text = unsqueezed(raw, 4)
                part = (word_hash(lengths, text) % np.uint64(parts)).astype(np.int64)
                order = np.argsort(part, kind="stable")
                text = text[runs((np.cumsum(lengths) - lengths)[order], lengths[order])]
                part, lengths, taught, every = (x[order] for x in (part, lengths, taught, every))
                ends, cuts = np.append(0, np.cumsum(lengths)), [*changes(part).tolist(), len(part)] if len(part) else [0]
                packs = [squeezed(np.diff(order[i:j], prepend=0), lengths[i:j], taught[i:j], every[i:j], text[ends[i] : ends[j]]) for i, j in zip(cuts, cuts[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([pa.array(part[cuts[:-1]]), pa.array(np.full(len(packs), block)), pa.array(packs, pa.binary())], ["bucket", "block", "pack"])

    return run


_COUNTED = ["part", "block", "pack", "n", "words", "hot_n", "hot_at", "hot_places"]


def _count(hot: int):
    """Counts and ranks of the words of a part: a row with how many words have each count, and its hot words (their places among
    those of their count); and one for each block, with the ranks of its words."""

    def finish(part, packs):
        each = [unsqueezed(raw, 5) for _, raw in packs]
        codes, (lengths, taught, every, text) = [e[0] for e in each], (np.concatenate([e[k] for e in each]) for k in (1, 2, 3, 4))
        words = pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(np.append(0, np.cumsum(lengths))), pa.py_buffer(text.astype(np.uint8))])
        of = words.dictionary_encode().indices.to_numpy()
        n, places = (np.bincount(of, x).astype(np.int64) for x in (taught, every))
        order = np.lexsort((-places, -n))
        n, places, rank = n[order], places[order], np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        firsts, crowded = changes(n), np.flatnonzero(places > hot)
        own = (n[firsts], np.diff(np.append(firsts, len(n))), n[crowded], crowded - firsts[np.searchsorted(firsts, crowded, "right") - 1], places[crowded])
        yield pa.RecordBatch.from_arrays([pa.array([part]), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), *(lists(np.array([0, len(x)]), pa.array(x)) for x in own)], _COUNTED)
        ends = np.append(0, np.cumsum([len(x) for x in codes])).tolist()
        ranks = [squeezed(x, rank[of[i:j]]) for x, i, j in zip(codes, ends, ends[1:], strict=False)]
        m = len(ranks)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(m, part)), pa.array([b for b, _ in packs]), pa.array(ranks, pa.binary()), *(pa.nulls(m, pa.list_(pa.int64())) for _ in own)], _COUNTED)

    return lambda batches: _by_bucket(batches, finish, "block")


def counted_words(blocks: DataFrame, parts: int, hot: int) -> DataFrame:
    """The table of words by part: how many have each training count, and the ranks that a block's words have in the part."""
    dealt = blocks.filter("words is not null").select("block", "words").mapInArrow(_dealt_words(parts), "bucket long, block long, pack binary")
    dealt = dealt.repartition(parts, "bucket").sortWithinPartitions("bucket")
    return written(dealt.mapInArrow(_count(hot), "part long, block long, pack binary, " + ", ".join(f"{k} array<long>" for k in _COUNTED[3:])))


def steps_of(counted: DataFrame) -> DataFrame:
    """The table (part, n, words, before): words of each count in a part, and in the parts before it."""
    each = counted.filter("n is not null").select("part", F.inline(F.arrays_zip("n", "words")))
    window = Window.partitionBy("n").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a part
    return written(each.withColumn("before", F.coalesce(F.sum("words").over(window), F.lit(0))))


def held_words(counted: DataFrame, steps: DataFrame, places: int, texts: int, taught: int, hot: int) -> Words:
    """What tasks hold of the words: steps of counts, at most sqrt(2 N) rows, and hot words, at most sqrt(N)."""
    total = sorted(((r["n"], r["words"]) for r in steps.groupBy("n").agg(F.sum("words").alias("words")).collect()), reverse=True)
    whole = lambda values: np.array(values, np.int64)
    held = Words(FIRST + np.cumsum(whole([n for _, n in total])), whole([c for c, _ in total]), taught, whole([]), whole([]))
    crowded = counted.select("part", F.inline(F.arrays_zip("hot_n", "hot_at", "hot_places"))).withColumnRenamed("hot_n", "n")
    crowded = steps.join(F.broadcast(crowded), ["part", "n"]).select("n", "before", "hot_at", "hot_places")
    found = [(int(held.first(whole([r["n"]]))[0]) + r["before"] + r["hot_at"], r["hot_places"]) for r in crowded.collect()]
    found = [(i, texts) for i in (START, END) if texts > hot] + sorted(found)
    held.hot, held.hot_places = whole([i for i, _ in found]), whole([n for _, n in found])
    held.all_places, held.least_hot = places, hot
    return held


def _named(shared):
    """The ids of the words of each block in a part."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        n, words, before = (right.sort_by([("n", "descending")]).column(k).to_numpy() for k in ("n", "words", "before"))
        ids, packs = runs(shared.value.first(n) + before, words), []
        for raw in left.column("pack").to_pylist():
            codes, rank = unsqueezed(raw, 2)
            packs.append(squeezed(codes, ids[rank]))
        return pa.Table.from_arrays([left.column("block"), pa.array(packs, pa.binary())], ["asked_by", "pack"])

    return run


_TEXT = ["row", "doc_id", "n_tokens", "n_known", "base_score", "pack"]
#: Numbers of a block of texts.
_TOKENS = ("doc", "train", "length", "token", "id")


def _with_ids(shared):
    """The texts of a block with what they score by counts of words alone; and a row with all their tokens, END last in each, as places among the block's ids."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        held: Words = shared.value
        whole = left.filter(pc.is_valid(left.column("codes"))).column("codes")[0].as_py()
        left = left.filter(pc.is_valid(left.column("row")))
        left = left.take(pc.sort_indices(left.column("row"))).combine_chunks()
        codes = np.frombuffer(zstandard.ZstdDecompressor().decompress(whole), "<i4")
        each = [unsqueezed(x, 2) for x in right.column("pack").to_pylist()]
        ids = np.zeros(sum(len(x) for x, _ in each), np.int64)
        for steps, own in each:
            ids[np.cumsum(steps)] = own
        docs, lengths = left.column("row").to_numpy(), left.column("length").to_numpy()
        names = np.unique(np.append(ids, (START, END)))
        at = np.searchsorted(names, ids)
        local = np.full(lengths.sum() + len(left), np.searchsorted(names, END), np.int64)
        starts = np.cumsum(lengths + 1) - lengths - 1
        local[runs(starts, lengths)] = at[codes]
        c = held.count(names)
        sums = [lengths + 1, np.add.reduceat((c > 0).astype(np.int64)[local], starts), np.add.reduceat(held.base(c)[local], starts)]
        train = left.column("train").to_numpy().astype(np.int64)
        raw = pack(int(docs[0]), _TOKENS, {"doc": docs, "train": train, "length": lengths + 1, "token": local, "id": np.diff(names, prepend=0)})
        n = len(left)
        texts = pa.Table.from_arrays([left.column("row"), left.column("doc_id"), *map(pa.array, sums), pa.nulls(n, pa.binary())], _TEXT)
        block = pa.Table.from_arrays([*(pa.nulls(1, texts.schema.field(i).type) for i in range(5)), pa.array([raw], pa.binary())], _TEXT)
        return pa.concat_tables([texts, block])

    return run


def texts_of(blocks: DataFrame, counted: DataFrame, steps: DataFrame, shared) -> DataFrame:
    """The table of texts (row, doc_id, n_tokens, n_known, base_score), and of blocks of their tokens (pack)."""
    kind = blocks.schema["doc_id"].dataType.simpleString()
    packs = counted.filter("block is not null").select("part", "block", "pack")
    found = packs.groupBy("part").cogroup(steps.groupBy("part")).applyInArrow(_named(shared), "asked_by long, pack binary")
    texts = blocks.select("block", "row", "doc_id", "train", "length", "codes")
    schema = f"row long, doc_id {kind}, n_tokens long, n_known long, base_score double, pack binary"
    return written(texts.groupBy("block").cogroup(found.groupBy("asked_by")).applyInArrow(_with_ids(shared), schema))


def mix(*keys: np.ndarray) -> np.ndarray:
    h = np.full(len(keys[0]), 0x9E3779B97F4A7C15, np.uint64)
    for k in keys:
        h = (h ^ k.astype(np.int64).view(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(31)
        h *= np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(29)
    return h


def changes(*keys: np.ndarray) -> np.ndarray:
    """Places where a run of equal keys begins."""
    new = np.ones(len(keys[0]), bool)
    np.not_equal(keys[0][1:], keys[0][:-1], out=new[1:])
    for k in keys[1:]:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def order_of(first: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """Places in order of the keys, whole numbers from 0: by one number where they fit, the first by its place among its values."""
    high = [int(k.max()) + 1 if len(k) else 1 for k in (first, *keys)]
    if math.prod(high) >= 1 << 63:
        names = np.unique(first)
        first, high[0] = np.searchsorted(names, first), len(names)
    if math.prod(high) >= 1 << 63:
        return np.lexsort((*keys[::-1], first))
    for k, n in zip(keys, high[1:], strict=True):
        first = first * n + k
    return np.argsort(first)


@dataclasses.dataclass
class Deal:
    """How trigrams fall into buckets: the first by v, the rest for hot v by (v, w), or by (v, w, sub) where w is hot too."""

    buckets: int
    hot_buckets: int
    parts: int  # places that split a pair of hot words

    @classmethod
    def of(cls, held: Words, bucket: int, least: int) -> Deal:
        hot = int(held.hot_places.sum())
        up = lambda n: -(-n // bucket)
        return cls(max(least, up(max(0, held.all_places - hot))), up(hot), held.least_hot)

    @property
    def all(self) -> int:
        return self.buckets + self.hot_buckets

    def subs(self, held: Words, v: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Parts of the pair v, w; 0 where it isn't split."""
        return -(-np.minimum(held.places(v), held.places(w)) // self.parts)

    def __call__(self, held: Words, v: np.ndarray, w: np.ndarray, sub: np.ndarray, split: np.ndarray) -> np.ndarray:
        plain = mix(v) % np.uint64(self.buckets)
        if not self.hot_buckets:
            return plain.astype(np.int64)
        hot = np.where(split, mix(v, w, sub), mix(v, w)) % np.uint64(self.hot_buckets) + np.uint64(self.buckets)
        return np.where(held.places(v) > 0, hot, plain).astype(np.int64)


#: Numbers of a trigram; those and its places.
_GRAM = ("v", "u", "w", "c", "m", "sub")
_PACK = (*_GRAM, "doc")


def _steps(x: np.ndarray) -> np.ndarray:
    """From 0 to the first, and from each to the next."""
    out = x.copy()
    out[1:] -= x[:-1]
    return out


def _planes(a: np.ndarray) -> tuple[int, bytes]:
    width = max(1, (int(a.max()).bit_length() + 7) // 8) if len(a) else 1
    return width, a.astype(np.uint8).tobytes() if width == 1 else a.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def pack(low: int, names: tuple[str, ...], a: dict[str, np.ndarray]) -> bytes:
    """Whole numbers from 0, for the way between tasks: sorted ones as steps, documents from low, in planes of bytes, compressed."""
    head, body = [np.array([low], "<i8").tobytes()], []
    for k in names:
        x = a[k]
        if k == "v":
            x = _steps(x)
        elif k == "u":
            firsts, own = changes(a["v"]), x
            x = _steps(own)
            x[firsts] = own[firsts]
        elif k == "doc":
            x = x - low
        width, raw = _planes(x)
        head.append(np.array([width, len(x)], "<i4").tobytes())
        body.append(raw)
    return zstandard.ZstdCompressor(level=1, write_checksum=False).compress(b"".join(head + body))


def unpack(names: tuple[str, ...], raw: bytes) -> dict[str, np.ndarray]:
    raw, a = zstandard.ZstdDecompressor().decompress(raw), {}
    low, head, at = np.frombuffer(raw, "<i8", 1)[0], np.frombuffer(raw, "<i4", 2 * len(names), 8).reshape(-1, 2), 8 + 8 * len(names)
    for k, (width, n) in zip(names, head.tolist(), strict=True):
        x = np.zeros((n, 8), np.uint8)
        x[:, :width] = np.frombuffer(raw, np.uint8, width * n, at).reshape(width, n).T
        a[k], at = x.view("<i8").ravel(), at + width * n
    if "v" in a:
        a["v"] = np.cumsum(a["v"])
        steps = np.cumsum(a["u"])
        firsts = changes(a["v"])
        before = np.append(0, steps)[firsts]
        a["u"] = steps - np.repeat(before, np.diff(np.append(firsts, len(steps))))
    if "doc" in a:
        a["doc"] = a["doc"] + low
    return a


def trigrams(names, u, v, w, doc, train) -> dict[str, np.ndarray]:
    """Distinct trigrams in order of v, u, w with their training counts c and numbers m of places; the places (doc, once for each time), in order.

    u, v and w are places among the ascending ids names. doc ascends; train tells of each place whether it teaches.
    """
    own = changes(doc)
    k, d, docs = len(names), len(own), doc[own]
    if k**3 * d >= 1 << 63:  # too many for one number: names that aren't here are left out, then halves are taken
        here = np.zeros(k, bool)
        here[u] = here[v] = here[w] = True
        if not here.all():
            at = np.cumsum(here) - 1
            return trigrams(names[here], at[u], at[v], at[w], doc, train)
        if len(w) == 1:
            raise OverflowError("a single place can't have that many words")
        half = len(w) // 2
        return _appended([trigrams(names, *(x[i] for x in (u, v, w, doc, train))) for i in (slice(None, half), slice(half, None))])
    key = ((v * k + u) * k + w) * d + np.repeat(np.arange(d), np.diff(np.append(own, len(doc))))
    key.sort()
    gram = key // d
    at = key - gram * d
    firsts = changes(gram)
    g = gram[firsts]
    vu = g // k
    first = vu // k
    return {
        "v": names[first], "u": names[vu - first * k], "w": names[g - vu * k], "c": np.add.reduceat((train[own] > 0).astype(np.int64)[at], firsts),
        "m": np.diff(np.append(firsts, len(gram))), "doc": docs[at],
    }


def _appended(parts: list[dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    """Trigrams of several parts; one that is in two stays two rows, which merged() adds."""
    a = {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}
    order = np.lexsort((a["w"], a["u"], a["v"]))
    at = runs((np.cumsum(a["m"]) - a["m"])[order], a["m"][order])
    return {k: x[at] if k == "doc" else x[order] for k, x in a.items()}


def parted(held: Words, deal: Deal, a: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """With sub: the trigrams of two hot words v, w fall into parts by u; each part has a row with u = NONE and the count of v w."""
    p = deal.subs(held, a["v"], a["w"]) if deal.hot_buckets else np.zeros(len(a["v"]), np.int64)
    split = p > 0
    sub = np.where(split, (mix(a["u"]) % np.maximum(p, 1).astype(np.uint64)).astype(np.int64), 0)
    a = a | {"sub": sub, "split": split}
    if not split.any():
        return a
    v, w, c, p = (x[split] for x in (a["v"], a["w"], a["c"], p))
    order = np.lexsort((w, v))
    v, w, c, p = (x[order] for x in (v, w, c, p))
    firsts = changes(v, w)
    c, p = np.add.reduceat(c, firsts), p[firsts]
    rows = np.repeat(np.arange(len(firsts)), p)
    zero = np.zeros(len(rows), np.int64)
    more = {"v": v[firsts][rows], "u": zero + NONE, "w": w[firsts][rows], "c": c[rows], "m": zero, "sub": runs(np.zeros(len(p), np.int64), p), "split": zero == 0}
    return a | {k: np.concatenate((a[k], x)) for k, x in more.items()}


def packed(deal: Deal, held: Words, a: dict[str, np.ndarray], fan: int, low: int):
    """(bucket // fan, packed trigrams with their places), bucket by bucket; a is in order but for the rows that parted() added."""
    bucket = deal(held, a["v"], a["w"], a["sub"], a["split"]) // fan
    order = np.lexsort((a["w"], a["u"], a["v"], bucket)) if a["split"].any() else np.argsort(bucket.astype(np.uint16) if deal.all <= 1 << 16 else bucket, kind="stable")
    at = runs((np.cumsum(a["m"]) - a["m"])[order], a["m"][order])
    a = {k: a[k][order] for k in _GRAM} | {"doc": a["doc"][at]}
    bucket, ends = bucket[order], np.append(0, np.cumsum(a["m"]))
    cuts = [*changes(bucket).tolist(), len(bucket)] if len(bucket) else [0]
    for i, j in zip(cuts, cuts[1:], strict=False):
        yield int(bucket[i]), pack(low, _PACK, {k: a[k][i:j] for k in _GRAM} | {"doc": a["doc"][ends[i] : ends[j]]})


def _packs(made) -> pa.RecordBatch:
    made = list(made)
    return pa.RecordBatch.from_arrays([pa.array([b for b, _ in made], pa.int64()), pa.array([x for _, x in made], pa.binary())], ["bucket", "pack"])


def _deal(shared, deal: Deal, fan: int):
    def run(batches):
        held: Words = shared.value
        for b in batches:
            for raw in b.column("pack"):
                a = unpack(_TOKENS, raw.as_py())
                w, lengths, names = a["token"], a["length"], np.cumsum(a["id"])
                starts, before = np.cumsum(lengths) - lengths, np.searchsorted(names, START)
                v = np.append(before, w[:-1])
                v[starts] = before
                u = np.append(before, v[:-1])
                u[starts] = before
                low, doc, train = int(a["doc"][0]), np.repeat(a["doc"], lengths), np.repeat(a["train"], lengths)
                for i in range(0, len(w), CUT):
                    yield _packs(packed(deal, held, parted(held, deal, trigrams(names, *(x[i : i + CUT] for x in (u, v, w, doc, train)))), fan, low))

    return run


def merged(parts: list[dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    """Trigrams of many packs, each (and each part) once, in order of v, u, w, sub, with all places."""
    a = {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}
    order = order_of(*(a[k] for k in ("v", "u", "w", "sub")))
    at = runs((np.cumsum(a["m"]) - a["m"])[order], a["m"][order])
    keys = {k: a[k][order] for k in ("v", "u", "w", "sub")}
    firsts = changes(*keys.values())
    return {k: x[firsts] for k, x in keys.items()} | {k: np.add.reduceat(a[k][order], firsts) for k in ("c", "m")} | {"doc": a["doc"][at]}


def _by_bucket(batches, finish, *more: str):
    """Rows (bucket, pack) sorted by bucket: finish(bucket, its packs) for each; with more columns, tuples of those and the pack."""
    now, held = None, []
    for b in batches:
        packs = b.column("pack").to_pylist()
        for bucket, raw in zip(b.column("bucket").to_pylist(), zip(*(b.column(k).to_pylist() for k in more), packs, strict=True) if more else packs, strict=True):
            if bucket != now and held:
                yield from finish(now, held)
                held = []
            now = bucket
            held.append(raw)
    if held:
        yield from finish(now, held)


def _spread(shared, deal: Deal):
    """Packs of fan buckets each, dealt to one task: many of them are merged and cut by bucket."""

    def run(batches):
        held: Words = shared.value

        def make(packs):
            a = merged([unpack(_PACK, x.as_py()) for x in packs])
            a["split"] = deal.subs(held, a["v"], a["w"]) > 0
            yield _packs(packed(deal, held, a, 1, int(a["doc"].min()) if len(a["doc"]) else 0))

        waiting, n = [], 0
        for b in batches:
            for x in b.column("pack"):
                waiting.append(x)
                n += len(x.as_buffer())
                if n >= SPREAD_BYTES:
                    yield from make(waiting)
                    waiting, n = [], 0
        if waiting:
            yield from make(waiting)

    return run


_STORED = ["bucket", "v", "grams", "u", "w", "c", "sub", "spectra", "places"]


def _store(batches):
    """A bucket in rows of whole middle words, about ROW trigrams each; the first has how many pairs, and trigrams, have each low count."""

    def finish(bucket, raw):
        a = merged([unpack(_PACK, x) for x in raw])
        p, _ = pairs(a)
        count = lambda c: np.bincount(c[c <= DISCOUNTED + 1], minlength=DISCOUNTED + 2)[1:]
        spectra = np.concatenate((count(p["c"][p["sub"] == 0]), count(a["c"][a["u"] != NONE])))
        ends, n = np.append(0, np.cumsum(a["m"])), len(a["v"])
        firsts = changes(a["v"])
        heads = firsts[changes(firsts // ROW)]
        one = lambda x: lists(np.array([0, len(x)]), pa.array(x))
        for i, j in zip(heads.tolist(), [*heads[1:].tolist(), n], strict=True):
            own = firsts[(firsts >= i) & (firsts < j)]
            grams = np.diff(np.append(own, j))
            sub = one(a["sub"][i:j]) if a["sub"][i:j].any() else pa.nulls(1, pa.list_(pa.int64()))
            doc = a["doc"][ends[i] : ends[j]]
            places = pack(int(doc.min()) if len(doc) else 0, ("m", "doc"), {"m": a["m"][i:j], "doc": doc})
            first = pa.nulls(1, pa.list_(pa.int64())) if i else one(spectra)
            yield pa.RecordBatch.from_arrays([pa.array([bucket]), one(a["v"][own]), one(grams), *(one(a[k][i:j]) for k in ("u", "w", "c")), sub, first, pa.array([places], pa.binary())], _STORED)

    return _by_bucket(batches, finish)


def store(texts: DataFrame, held: Words, shared, deal: Deal, most_parts: int) -> DataFrame:
    """The table of trigrams, some middle words a row: lists of v and their numbers of trigrams; of u, w, training count c, and
    part sub (null for 0); spectra of a bucket; places is packed: how many each trigram has (m), and the texts (doc)."""
    fan = -(-deal.all // most_parts)  # where a block can't be cut into as many parts as there are buckets, it is cut twice
    schema = "bucket long, pack binary"
    dealt = texts.filter("pack is not null").select("pack").mapInArrow(_deal(shared, deal, fan), schema)
    if fan > 1:
        dealt = dealt.repartition(min(deal.all, most_parts), "bucket").mapInArrow(_spread(shared, deal), schema)
    dealt = dealt.repartition(min(deal.all, 16 * most_parts), "bucket").sortWithinPartitions("bucket")
    return written(dealt.mapInArrow(_store, "bucket long, " + ", ".join(f"{k} array<long>" for k in _STORED[1:-1]) + ", places binary"))


def _rows(batches):
    """Stored rows as arrays of trigrams, and of places where those are read."""
    for b in batches:
        for i in range(b.num_rows):
            row = {k: b.column(k)[i] for k in b.schema.names}
            a = {k: row[k].values.to_numpy() for k in ("v", "grams", "u", "w", "c")}
            a["v"] = np.repeat(a["v"], a.pop("grams"))
            a["sub"] = row["sub"].values.to_numpy() if row["sub"].is_valid else np.zeros(len(a["v"]), np.int64)
            if "places" in row:
                a |= unpack(("m", "doc"), row["places"].as_py())
            yield a | {"bucket": row["bucket"].as_py()}


def pairs(a: dict[str, np.ndarray]) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The pairs v, w (and parts of them) of a bucket in order of v, with training counts; and the pair of each trigram."""
    order = order_of(a["v"], a["w"], a["sub"])
    keys = {k: a[k][order] for k in ("v", "w", "sub")}
    firsts = changes(*keys.values())
    of = np.empty(len(order), np.int64)
    of[order] = np.repeat(np.arange(len(firsts)), np.diff(np.append(firsts, len(order))))
    p = {k: x[firsts] for k, x in keys.items()}
    # A pair in parts has its count in a row of its own; the other pairs are sums over u.
    told = np.bincount(of, a["u"] == NONE, len(firsts)) > 0
    c = np.bincount(of, np.where(told[of] & (a["u"] != NONE), 0, a["c"]), len(firsts)).astype(np.int64)
    return p | {"c": c}, of


@dataclasses.dataclass
class Backoff:
    """What scoring needs beside the buckets: discounts of pairs and trigrams; count, discounted mass and lower mass of hot words."""

    pair: np.ndarray
    trigram: np.ndarray
    hot: dict[int, tuple[int, float, float]]


def history_sums(d: np.ndarray, c: np.ndarray, lower: np.ndarray, firsts: np.ndarray, counted: np.ndarray) -> list[np.ndarray]:
    """For runs of one history each: c(h), what its seen words have of P(w|h) c(h), and of the lower order."""
    seen = (c > 0) & counted
    return [np.add.reduceat(np.where(seen, x, 0), firsts) if len(firsts) else x[:0] for x in (c, d[np.minimum(c, DISCOUNTED + 1)] * c, lower)]


def backed_off(d: np.ndarray, c: np.ndarray, lower: np.ndarray, of: np.ndarray, sums: list[np.ndarray]) -> np.ndarray:
    """P(w|h) for each word and its history `of`: one step of the recursion, lower being P(w) of the order below."""
    count, mass, below = sums
    # A history without a discounted count keeps one part in c(h) + 1 for its unseen words.
    full = mass >= count * (1 - 1e-12)
    total = np.where(full, count + 1, count)
    left = np.where(full, 1.0, count - mass) / np.maximum(total, 1)
    weight = np.where(count > 0, left / np.maximum(1 - below, 1e-300), 1.0)
    own = np.where(full[of], 1.0, d[np.minimum(c, DISCOUNTED + 1)]) * c / np.maximum(total, 1)[of]
    return np.where(c > 0, own, weight[of] * lower)


def _run_ids(firsts: np.ndarray, n: int) -> np.ndarray:
    return np.repeat(np.arange(len(firsts)), np.diff(np.append(firsts, n)))


def pair_probabilities(held: Words, model: Backoff, a: dict[str, np.ndarray]) -> np.ndarray:
    """P(w|v) of each trigram of a bucket."""
    p, of = pairs(a)
    lower = held.probability(held.count(p["w"]))
    firsts = changes(p["v"])
    sums = history_sums(model.pair, p["c"], lower, firsts, p["sub"] == 0)
    v = p["v"][firsts]
    for i in np.flatnonzero(held.places(v)).tolist():
        for x, whole in zip(sums, model.hot.get(int(v[i]), (0, 0.0, 0.0)), strict=True):
            x[i] = whole
    return backed_off(model.pair, p["c"], lower, _run_ids(firsts, len(p["v"])), sums)[of]


def _hot_sums(shared, d: np.ndarray):
    """For hot v, what its pairs in a bucket add to its sums."""

    def run(batches):
        held: Words = shared.value
        for a in _rows(batches):
            p, _ = pairs(a)
            firsts = changes(p["v"])
            sums = history_sums(d, p["c"], held.probability(held.count(p["w"])), firsts, p["sub"] == 0)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (p["v"][firsts], *sums)], ["v", "c", "mass", "lower"])

    return run


def _bits(x: np.ndarray) -> np.ndarray:
    """Numbers from 0.0 as whole numbers, or back."""
    return x.view(np.int64 if x.dtype == np.float64 else np.float64)


def _history_parts(shared, model: Backoff, parts: int):
    """For hot v, what a bucket adds to the sums of its (u, v): packs by part, from the stored row that begins with v = head."""

    def run(batches):
        held: Words = shared.value
        for a in _rows(batches):
            firsts = changes(a["v"], a["u"])
            sums = history_sums(model.trigram, a["c"], pair_probabilities(held, model, a), firsts, a["u"] != NONE)
            firsts, sums = firsts[real := a["u"][firsts] != NONE], [x[real] for x in sums]
            part = (mix(a["u"][firsts], a["v"][firsts]) % np.uint64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            all_of = [a["u"][firsts[order]], a["v"][firsts[order]], sums[0][order], *(_bits(x[order]) for x in sums[1:])]
            part = part[order]
            cuts = [*changes(part).tolist(), len(part)] if len(part) else [0]
            packs = [squeezed(_steps(order[i:j]), *(x[i:j] for x in all_of)) for i, j in zip(cuts, cuts[1:], strict=False)]
            own = (np.full(len(packs), x) for x in (a["bucket"], a["v"][0]))
            yield pa.RecordBatch.from_arrays([pa.array(part[cuts[:-1]]), *map(pa.array, own), pa.array(packs, pa.binary())], ["bucket", "owner", "head", "pack"])

    return run


def _sum_histories(batches):
    """Sums of the histories of a part over all buckets, back to each of them."""

    def finish(_, packs):
        packs.sort()
        each = [unsqueezed(raw, 6) for _, _, raw in packs]
        u, v, *sums = (np.concatenate([e[k] for e in each]) for k in range(1, 6))
        order = order_of(v, u)
        firsts = changes(v[order], u[order])
        of = np.empty(len(order), np.int64)
        of[order] = _run_ids(firsts, len(order))
        c, mass, lower = (np.add.reduceat(x[order], firsts)[of] for x in (sums[0], _bits(sums[1]), _bits(sums[2])))
        ends = np.append(0, np.cumsum([len(e[0]) for e in each])).tolist()
        back = [squeezed(e[0], c[i:j], _bits(mass[i:j]), _bits(lower[i:j])) for e, i, j in zip(each, ends, ends[1:], strict=False)]
        yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in packs]), pa.array([p[1] for p in packs]), pa.array(back, pa.binary())], ["owner", "head", "pack"])

    return _by_bucket(batches, finish, "owner", "head")


def log_probabilities(held: Words, model: Backoff, a: dict[str, np.ndarray], given: list[np.ndarray] | None = None) -> np.ndarray:
    """log10 P(w|u,v) of each trigram of a bucket; given has the sums of its histories in order where they go beyond it."""
    lower = pair_probabilities(held, model, a)
    firsts = changes(a["v"], a["u"])
    sums = history_sums(model.trigram, a["c"], lower, firsts, a["u"] != NONE)
    if given is not None:
        real = a["u"][firsts] != NONE
        for x, whole in zip(sums, given, strict=True):
            x[real] = whole
    with np.errstate(divide="ignore"):
        return np.log10(backed_off(model.trigram, a["c"], lower, _run_ids(firsts, len(a["v"])), sums))


_SUMS = ("doc", "score")


def group_of(doc: np.ndarray, groups: int) -> np.ndarray:
    """Texts whose rows are close share a group, which keeps their numbers short in a pack."""
    return (mix(doc >> 8) % np.uint64(groups)).astype(np.int64)


def _added(docs: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    docs, at = np.unique(docs, return_inverse=True)
    return docs, np.bincount(at, values, len(docs))


class _Scores:
    """Scores of texts over many buckets, passed on by groups of texts."""

    def __init__(self, groups: int):
        self.groups, self.parts, self.n = groups, [], 0

    def add(self, a: dict[str, np.ndarray], scores: np.ndarray):
        self.parts.append(_added(a["doc"], np.repeat(scores, a["m"])))
        self.n += len(self.parts[-1][0])

    def out(self):
        docs, values = _added(*(np.concatenate(x) for x in zip(*self.parts, strict=True)))
        self.parts, self.n = [], 0
        values, group = np.rint(-values * GRAIN).astype(np.int64), group_of(docs, self.groups)
        order = np.argsort(group, kind="stable")
        cuts = [*changes(group[order]).tolist(), len(order)] if len(order) else [0]
        made = [(int(group[order[i]]), pack(int(docs[order[i]]), _SUMS, {"doc": docs[order[i:j]], "score": values[order[i:j]]})) for i, j in zip(cuts, cuts[1:], strict=False)]
        return pa.RecordBatch.from_arrays([pa.array([g for g, _ in made], pa.int64()), pa.array([x for _, x in made], pa.binary())], ["group", "pack"])


def _score(shared, model: Backoff, groups: int):
    def run(batches):
        scores = _Scores(groups)
        for a in _rows(batches):
            scores.add(a, log_probabilities(shared.value, model, a))
            if scores.n > 2 * BUCKET:
                yield scores.out()
        if scores.parts:
            yield scores.out()

    return run


def _for_the_way(batches):
    """Stored rows, their lists packed."""
    for b in batches:
        for i, a in enumerate(_rows([b.drop_columns(["places"])])):
            raw = squeezed(_steps(a["v"]), *(a[k] for k in _GRAM[1:4]), a["sub"])
            yield pa.RecordBatch.from_arrays([pa.array([a["bucket"]]), pa.array([raw], pa.binary()), b.column("places").slice(i, 1)], ["bucket", "grams", "places"])


def _score_hot(shared, model: Backoff, groups: int):
    """One bucket, and the sums of all its histories."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        packs, scores = {}, _Scores(groups)
        for head, raw in zip(right.column("head").to_pylist(), right.column("pack").to_pylist(), strict=True):
            packs.setdefault(head, []).append(raw)
        for grams, places in zip(left.column("grams").to_pylist(), left.column("places").to_pylist(), strict=True):
            a = dict(zip(("v", "u", "w", "c", "sub"), unsqueezed(grams, 5), strict=True)) | unpack(("m", "doc"), places)
            a["v"] = np.cumsum(a["v"])
            each = [unsqueezed(raw, 4) for raw in packs.pop(int(a["v"][0]), [])]
            given = [np.zeros(sum(len(e[0]) for e in each), kind) for kind in (np.int64, np.float64, np.float64)]
            for at, c, mass, lower in each:
                for x, own in zip(given, (c, _bits(mass), _bits(lower)), strict=True):
                    x[np.cumsum(at)] = own
            scores.add(a, log_probabilities(shared.value, model, a, given))
        return pa.Table.from_batches([scores.out()] if scores.parts else [], pa.schema([("group", pa.int64()), ("pack", pa.binary())]))

    return run


_RESULT = ["doc_id", "n_tokens", "n_known", "base_score", "score"]


def _total(left: pa.Table, right: pa.Table) -> pa.Table:
    """The texts of a group and all that was scored of them."""
    docs, total = np.zeros(0, np.int64), np.zeros(0)
    for raw in right.column("pack"):
        a = unpack(_SUMS, raw.as_py())
        docs, total = _added(np.append(docs, a["doc"]), np.append(total, a["score"]))
    score = -total[np.searchsorted(docs, left.column("row").to_numpy())] / GRAIN if len(left) else total
    return pa.Table.from_arrays([*(left.column(k) for k in _RESULT[:-1]), pa.array(score)], _RESULT)


def _groups(groups: int):
    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(group_of(b.column("row").to_numpy(), groups)), *b.columns], ["group", *b.schema.names])

    return run


def katz_scores(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", *, bucket: int = BUCKET, hot: int = HOT, most_parts: int = FAN) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of each row of docs; train marks the rows that teach.

    A-Z are lowered; null counts as empty, which has one token, the end. Repeated rows each have their score, and teach
    as often as they are there. Without rows that teach, all words are unseen and share everything. An empty table
    gives no rows.
    """
    spark, kind = docs.sparkSession, docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    blocks = blocks_of(rows)
    n, taught, places, distinct, size = (x or 0 for x in blocks.agg(F.count("row"), F.count_if("train"), *(F.sum(c) for c in ("length", "distinct", "size"))).first())
    places += n
    hot = max(hot, math.isqrt(places)) if places > hot**2 else hot
    counted = counted_words(blocks, min(MOST_PARTS, max(partitions(spark), -(-distinct // PART), -(-size // PART_BYTES))), hot)
    steps = steps_of(counted)
    held = held_words(counted, steps, places, n, taught, hot)
    shared, deal = spark.sparkContext.broadcast(held), Deal.of(held, bucket, partitions(spark))
    texts = texts_of(blocks, counted, steps, shared)
    dropped(blocks, counted, steps)
    grams = store(texts, held, shared, deal, most_parts)
    kept = written(texts.filter("row is not null").drop("pack"))
    dropped(texts)
    keys = grams.drop("places", "spectra")
    counts = {r["pos"]: r["n"] for r in grams.select(F.posexplode("spectra")).groupBy("pos").agg(F.sum("col").alias("n")).collect()}
    of_order = lambda k: discounts([counts.get(k * (DISCOUNTED + 1) + r, 0) for r in range(DISCOUNTED + 1)])
    model, groups = Backoff(of_order(0), of_order(1), {}), max(partitions(spark), -(-n // GROUP))
    kinds = "group long, pack binary"
    grams = grams.drop("spectra")
    plain = grams.filter(F.col("bucket") < deal.buckets)
    parts = plain.mapInArrow(_score(shared, model, groups), kinds)
    if deal.hot_buckets:
        crowded = F.col("bucket") >= deal.buckets
        sums = keys.filter(crowded).mapInArrow(_hot_sums(shared, model.pair), "v long, c long, mass double, lower double")
        model.hot = {r[0]: (r[1], r[2], r[3]) for r in sums.groupBy("v").agg(F.sum("c"), F.sum("mass"), F.sum("lower")).collect()}  # one row a hot word
        histories = min(deal.hot_buckets, HISTORIES)
        each = keys.filter(crowded).mapInArrow(_history_parts(shared, model, histories), "bucket long, owner long, head long, pack binary")
        each = each.repartition(histories, "bucket").sortWithinPartitions("bucket").mapInArrow(_sum_histories, "owner long, head long, pack binary")
        full = grams.filter(crowded).mapInArrow(_for_the_way, "bucket long, grams binary, places binary")
        hot_scores = full.groupBy("bucket").cogroup(each.groupBy("owner")).applyInArrow(_score_hot(shared, model, groups), kinds)
        parts = parts.unionByName(hot_scores)
    parts = written(parts)
    texts = kept.mapInArrow(_groups(groups), f"group long, row long, doc_id {kind}, n_tokens long, n_known long, base_score double")
    total = texts.groupBy("group").cogroup(parts.groupBy("group")).applyInArrow(_total, f"doc_id {kind}, n_tokens long, n_known long, base_score double, score double")
    return total.select("doc_id", "n_tokens", "n_known", F.lit(held.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def perplexity(score: float, tokens: int) -> float:
    return math.pow(10, -score / tokens)


def op5_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = crc_mod(F.col("doc_id"), 10) == 0
    scores = katz_scores(docs, ~held_out)
    return scores.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
