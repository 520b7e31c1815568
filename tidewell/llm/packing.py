"""Packing token sequences: first-fit decreasing over randomised groups of documents, with a tournament tree.

Documents are encoded by way of a table of distinct words and cut into pieces of at most a sequence. Pieces are dealt at random to groups of bounded size; each group is packed by itself: pieces from the longest
to the shortest go to the first sequence that has room, which a tournament tree of the room left in each sequence finds
in a logarithmic number of steps. What room is left then is filled from the emptiest sequences, and the last of these
is cut at powers of two, so that it needs no padding either.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.bpe import BLOCK_BYTES, _cogrouped, _placed, _tokenizer, default_tokenizer
from tidewell.llm.common import table
from tidewell.llm.tokens import runs

LENGTH, END = 4096, 2
#: Tokens that a group is meant to hold; what a token takes of a text, in bytes, to say how many groups that makes.
GROUP_TOKENS, BYTES_A_TOKEN = 2_000_000, 4
#: Room below this is left as padding, and not filled with slivers of a document.
SLIVER = 8

_PIECE = ["row", "doc_id", "start", "length", "doc_tokens", "ids"]


def _lengths_of(tokens: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, length) of the pieces of documents of so many tokens, in order."""
    many = -(-tokens // most)
    doc = np.repeat(np.arange(len(tokens)), many)
    start = runs(np.zeros(len(tokens), np.int64), many) * most
    return doc, start, np.minimum(most, tokens[doc] - start)


def _pieces(length: int, end: int, width: str):
    """The pieces of a block's documents with their ids: each document's ids and the end, cut every length ids."""

    def cut(rows: pa.Table, many: np.ndarray, found: np.ndarray) -> pa.Table:
        tokens = many + 1
        ids = np.full(int(tokens.sum()), end, width)
        own = np.ones(len(ids), bool)
        own[np.cumsum(tokens) - 1] = False  # there a document ends
        ids[own] = found
        doc, start, size = _lengths_of(tokens, length)
        ends = (np.append(0, np.cumsum(size)) * ids.itemsize).astype(np.int32)
        binary = pa.Array.from_buffers(pa.binary(), len(doc), [None, pa.py_buffer(ends), pa.py_buffer(ids)])
        kept = rows.select(["row", "doc_id"]).take(pa.array(doc))
        return pa.Table.from_arrays([*kept.columns, pa.array(start), pa.array(size), pa.array(tokens[doc]), binary], _PIECE)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        kinds = [pa.int64(), left.schema.field("doc_id").type, pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        none = pa.schema(list(zip(_PIECE, kinds, strict=True))).empty_table()
        return pa.concat_tables([none, *(cut(*x) for x in _placed(left, right))])

    return run


class Room:
    """A tournament tree over the room that is left in sequences 0, 1, ...: each inner node has the most of those below."""

    def __init__(self, sequences: int, room: int):
        self.leaves = 1 << max(0, sequences - 1).bit_length()
        self.most = [room] * (2 * self.leaves)

    def first(self, size: int) -> int:
        """The first sequence that has room for size."""
        node = 1
        while node < self.leaves:
            node *= 2
            node += self.most[node] < size
        return node - self.leaves

    def take(self, sequence: int, size: int) -> None:
        node = sequence + self.leaves
        self.most[node] -= size
        while node > 1:
            node //= 2
            best = max(self.most[2 * node], self.most[2 * node + 1])
            if self.most[node] == best:
                return
            self.most[node] = best


def first_fit_decreasing(sizes: np.ndarray, length: int) -> list[list[int]]:
    """The pieces, by place in sizes, of each sequence; equal sizes go in the order in which they come."""
    order = np.argsort(-sizes, kind="stable")
    # Two sequences at most half full would have been one.
    room, out = Room(2 * int(sizes.sum()) // length + 2, length), []
    for at, size in zip(order.tolist(), sizes[order].tolist(), strict=True):
        sequence = room.first(size)
        room.take(sequence, size)
        if sequence == len(out):
            out.append([])
        out[sequence].append(at)
    return out


def packed(sizes: np.ndarray, length: int, sliver: int = SLIVER) -> list[list[tuple[int, int, int]]]:
    """Sequences as lists of (piece, start in it, length): first fit, room filled from the emptiest, the last cut at powers of two."""
    held = [[(p, 0, int(sizes[p])) for p in s] for s in first_fit_decreasing(sizes, length)]
    used = [sum(n for _, _, n in s) for s in held]
    order = sorted(range(len(held)), key=lambda s: (used[s], s))
    low, high = 0, len(order) - 1
    while low < high:
        giver, taker = order[low], order[high]
        room = length - used[taker]
        if room < sliver:
            high -= 1
            continue
        piece, start, n = held[giver].pop()
        moved = min(n, room)
        held[taker].append((piece, start, moved))
        if moved < n:
            held[giver].append((piece, start + moved, n - moved))
        used[taker] += moved
        used[giver] -= moved
        low += not held[giver]
    out = [s for k, s in enumerate(held) if s and k != order[low]]
    rest, left = list(reversed(held[order[low]])), used[order[low]]
    if length - left < sliver:
        return [*out, rest[::-1]]
    while left:
        own, room = [], 1 << (left.bit_length() - 1)
        left -= room
        while room:
            piece, start, n = rest.pop()
            own.append((piece, start, min(n, room)))
            if n > room:
                rest.append((piece, start + room, n - room))
            room -= own[-1][2]
        out.append(own)
    return out


def _packed(length: int, sliver: int):
    """A group's pieces, in order of documents, as sequences of them."""

    def run(t: pa.Table) -> pa.Table:
        t = t.take(pc.sort_indices(t, sort_keys=[("row", "ascending"), ("start", "ascending")])).combine_chunks()
        sizes, start = t.column("length").to_numpy(), t.column("start").to_numpy()
        sequences = packed(sizes, length, sliver)
        piece, skip, size = (np.array([x[k] for s in sequences for x in s], np.int64) for k in range(3))
        number = np.repeat(np.arange(len(sequences)), [len(s) for s in sequences])
        before = np.cumsum(size) - size
        offset = before - np.append(0, np.cumsum(np.bincount(number, size, len(sequences)).astype(np.int64)))[number]
        width = {2: "<u2", 4: "<u4"}[pc.binary_length(t.column("ids"))[0].as_py() // int(sizes[0])]
        flat = np.concatenate([np.frombuffer(x, width) for x in t.column("ids").to_pylist()])
        ids = flat[runs((np.cumsum(sizes) - sizes)[piece] + skip, size)].astype("<u4")
        binary = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer((np.append(0, np.cumsum(size)) * 4).astype(np.int32)), pa.py_buffer(ids.tobytes())])
        group = t.column("group")[0].as_py()
        own = [t.column(c).take(pa.array(piece)) for c in ("row", "doc_id", "doc_tokens")]
        return pa.Table.from_arrays(
            [own[0], own[1], pa.array(start[piece] + skip), pa.array(size), own[2], pa.array((group << 32) + number), pa.array(offset), binary],
            ["row", "doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"],
        )

    return run


def pack(
    docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", *, length: int = LENGTH, end: int = END, group_tokens: int = GROUP_TOKENS, sliver: int = SLIVER, seed: int = 42
) -> DataFrame:
    """(row, doc_id, start, length, doc_tokens, sequence_id, offset, ids) of each piece, ids as little-endian unsigned 32-bit numbers.

    A document is its ids by the tokenizers file (a path on every machine) and the end id; row tells repeated ids
    apart. length must be a power of two. In each group of about group_tokens, all sequences but a few are full or
    lack less than sliver; the others have lengths that are powers of two. Null counts as empty: such a document is
    its end id. Texts of any length are cut; docs must give its rows in the same order again, see bpe.encode(); an empty table gives no rows; other columns don't matter.
    """
    if length & (length - 1):
        raise ValueError("length must be a power of two")
    text = F.col(text_col).cast("string")
    size = docs.agg(F.sum(F.octet_length(text).cast("decimal(38,0)")).alias("bytes"), F.count("*").alias("n")).first()
    groups = max(1, -(-(int(size["bytes"] or 0) // BYTES_A_TOKEN + size["n"]) // group_tokens))
    both, kind = _cogrouped(docs, tokenizer, id_col, text_col, block=BLOCK_BYTES)
    width = "<u2" if max(_tokenizer(tokenizer).get_vocab_size(), end + 1) <= 1 << 16 else "<u4"  # two bytes an id on the way where that is enough
    pieces = both.applyInArrow(_pieces(length, end, width), f"row long, doc_id {kind}, start long, length long, doc_tokens long, ids binary")
    dealt = pieces.withColumn("group", F.pmod(F.xxhash64(F.lit(seed), "row", "start"), F.lit(groups)))
    schema = f"row long, doc_id {kind}, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
    return dealt.groupBy("group").applyInArrow(_packed(length, sliver), schema)


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pack(table(spark, sf_dir, "documents"), default_tokenizer())
    return found.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
