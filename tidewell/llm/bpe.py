"""BPE encoding and decoding by a table of distinct words.

A text's tokens are those of its white-space separated words, one after another, as the tokenizer's normaliser and
splitter never look across white space. Texts are cut into blocks; each block lists its distinct words. The lists are
dealt and sorted by word, so that all blocks' rows of a word meet; it is encoded once, and its ids go back to the
positions of the word in the texts of each block. Decoding joins ids to pieces: decode() does for any table of ids; the
digests look the pieces up by id, in the same pass that places the ids. There is one way for words of any number:
nothing is collected, and what is broadcast is the table of pieces, as large as the vocabulary.
"""

from __future__ import annotations

import hashlib
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.common import dropped, table, text_batches, written
from tidewell.llm.tokens import gathered, lists, runs, squeezed, text_blocks, unsqueezed

#: Bytes of the texts of a block; words that a task puts in order of blocks at a time; words whose ids are placed at a time.
BLOCK_BYTES, PACKED, SHARE = 16_000_000, 200_000, 120_000
#: Words given to the library at a time: what it returns of a word takes a kilobyte.
CALL = 10_000


def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def _ids_of(tokenizer, words: list[bytes]) -> pa.Array:
    """The ids of each word."""
    parts = [pa.array([], pa.list_(pa.int32()))]
    for at in range(0, len(words), CALL):
        found = tokenizer.encode_batch_fast([w.decode() for w in words[at : at + CALL]], add_special_tokens=False)
        parts.append(pa.array([e.ids for e in found], pa.list_(pa.int32())))
    return pa.concat_arrays(parts)


def _key(block: int, words: pa.Array) -> int:
    """A block's key: a hash of its first row and of its distinct words in their order.

    Two reads that differ in order give other keys, which find no words: such a job fails. So does one where two blocks
    have one hash, which is for 10^7 blocks as likely as 10^-5.
    """
    h = xxhash.xxh64(np.int64(block).tobytes())
    h.update(pc.binary_length(words).to_numpy(zero_copy_only=False).tobytes())
    h.update(pc.binary_join(lists(np.array([0, len(words)]), words), b"")[0].as_buffer() if len(words) else b"")
    return int(np.uint64(h.intdigest()).astype(np.int64))


def _asked(most: int):
    """The distinct words of each block."""

    def run(batches):
        for block, _, _, _, words in text_blocks(batches, most=most):
            block = _key(block, words)
            yield pa.RecordBatch.from_arrays([pa.array([block]), lists(np.array([0, len(words)]), words)], ["block", "words"])

    return run


def _encoded(path: str, most: int):
    """Rows (block, code, word) sorted by word: each distinct word is encoded once, and its ids go to all blocks that ask for it.

    Gives one row for each block and some of its words: their codes, numbers of ids and ids, packed.
    """

    def run(batches):
        tokenizer, last = _tokenizer(path), (None, pa.array([[]], pa.list_(pa.int32())))

        def make(held):
            nonlocal last
            t = pa.Table.from_batches(held).combine_chunks()
            d = t.column("word").combine_chunks().dictionary_encode()
            words = d.dictionary.to_pylist()
            fresh = words[1:] if words[0] == last[0] else words
            ids = _ids_of(tokenizer, fresh)
            ids = pa.concat_arrays([last[1], ids]) if len(fresh) < len(words) else ids
            last = words[-1], ids.slice(len(ids) - 1)
            order = np.lexsort((t.column("code").to_numpy(), t.column("block").to_numpy()))
            blocks, codes = (t.column(c).to_numpy()[order] for c in ("block", "code"))
            ids = ids.take(d.indices.take(pa.array(order)))
            cuts = np.append(np.flatnonzero(np.append(True, blocks[1:] != blocks[:-1])), len(blocks))
            lengths, flat = pc.list_value_length(ids).to_numpy().astype(np.int64), ids.flatten().to_numpy()
            ends = np.append(0, np.cumsum(lengths))[cuts]
            packs = [squeezed(np.diff(codes[i:j], prepend=0), lengths[i:j], flat[a:b]) for i, j, a, b in zip(cuts[:-1], cuts[1:], ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(blocks[cuts[:-1]]), pa.array(packs, pa.binary())], ["block", "pack"])

        return gathered(batches, lambda b: b.num_rows, make, most)

    return run


_TEXT = ["block", "row", "doc_id", "ends", "codes"]


def _coded(most: int):
    """The texts of each block: where their codes end, and on the first row of a block the codes of all, compressed for the way."""

    def run(batches):
        for block, rows, offsets, codes, words in text_blocks(batches, most=most):
            block = _key(block, words)
            raw = zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(codes, "<i4"))
            columns = [rows.column(c).combine_chunks() for c in ("row", "doc_id")]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), block)), *columns, pa.array(offsets[1:]), pa.array([raw] + [None] * (len(rows) - 1), pa.binary())], _TEXT)

    return run


def _pieces(tokenizer: str) -> list[str | None]:
    t = _tokenizer(tokenizer)
    return [t.id_to_token(i) for i in range(t.get_vocab_size())]


def pieces(spark: SparkSession, tokenizer: str) -> DataFrame:
    """(id, piece): a table as large as the vocabulary."""
    return spark.createDataFrame(list(enumerate(_pieces(tokenizer))), "id int, piece string")


def _placed(left: pa.Table, right: pa.Table):
    """(some texts of a block, numbers of their ids, the ids) one after another, from the block's codes and the ids of its words."""
    left = left.take(pc.sort_indices(left.column("row"))).combine_chunks()
    raw = left.column("codes").drop_null()
    codes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw[0].as_py()), "<i4") if len(raw) else np.zeros(0, np.int32)
    parts = [unsqueezed(x.as_py(), 3) for x in right.column("pack").drop_null()]
    at = np.concatenate([np.zeros(0, np.int64), *(np.cumsum(p[0]) for p in parts)])
    lengths, flat = (np.concatenate([np.zeros(0, np.int64), *(p[k] for p in parts)]) for k in (1, 2))
    n = int(codes.max()) + 1 if len(codes) else 0
    if len(at) != n or len(raw) != (len(left) > 0):
        raise RuntimeError("a block's words differ between two reads of the texts: write the input to a table first")
    starts, sizes, flat = np.zeros(n, np.int64), np.zeros(n, np.int64), flat.astype(np.int32)
    starts[at], sizes[at] = np.cumsum(lengths) - lengths, lengths
    ends = np.append(0, left.column("ends").to_numpy())
    i = 0
    while i < len(left):
        j = max(i + 1, int(np.searchsorted(ends, ends[i] + SHARE, "right")) - 1)  # whole texts of about SHARE words
        own = codes[ends[i] : ends[j]]
        many = sizes[own]
        yield left.slice(i, j - i), np.diff(np.append(0, np.cumsum(many))[ends[i : j + 1] - ends[i]]), flat[runs(starts[own], many)]
        i = j


def _joined(lengths: np.ndarray, values: pa.Array) -> list[str]:
    """SHA-256 of each run of values, joined by one space."""
    texts = pc.binary_join(lists(np.append(0, np.cumsum(lengths)), values), " ")
    return [hashlib.sha256(t).hexdigest() for t in texts.cast(pa.large_binary()).to_pylist()]


def _ids(left: pa.Table, right: pa.Table) -> pa.Table:
    kind = pa.schema([("row", pa.int64()), ("doc_id", left.schema.field("doc_id").type), ("ids", pa.list_(pa.int32()))])
    tables = [pa.Table.from_arrays([x.column("row"), x.column("doc_id"), lists(np.append(0, np.cumsum(lengths)), pa.array(ids))], schema=kind) for x, lengths, ids in _placed(left, right)]
    return pa.concat_tables(tables) if tables else kind.empty_table()


def _digests(shared, keep_ids: bool):
    """Ids as decimals, and joined to their pieces: the table of pieces is at each task, in the order of ids."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        texts = pa.string()
        kinds = [("doc_id", left.schema.field("doc_id").type), ("n_tokens", pa.int64()), ("ids_sha256", texts), ("decoded_sha256", texts)] + [("ids", pa.list_(pa.int32()))] * keep_ids
        piece = pa.array(shared.value, texts)
        number, tables = pa.array(range(len(piece)), pa.int32()).cast(texts), []
        for x, lengths, ids in _placed(left, right):
            columns = [x.column("doc_id"), pa.array(lengths), *(pa.array(_joined(lengths, t.take(pa.array(ids))), texts) for t in (number, piece))]
            tables.append(pa.Table.from_arrays([*columns, *([lists(np.append(0, np.cumsum(lengths)), pa.array(ids))] if keep_ids else [])], schema=pa.schema(kinds)))
            pa.default_memory_pool().release_unused()
        return pa.concat_tables(tables) if tables else pa.schema(kinds).empty_table()

    return run


def _cogrouped(docs: DataFrame, tokenizer: str, id_col: str, text_col: str, block: int):
    """(texts by block, words with ids by block); each text is split twice, so docs must come in the same order again."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    listed = written(text_batches(rows.select("row", "text"), _asked(block), "block long, words array<binary>"), texts=True)
    asked = listed.select("block", F.posexplode("words").alias("code", "word"))
    found = asked.repartition("word").sortWithinPartitions("word").mapInArrow(_encoded(tokenizer, PACKED), "block long, pack binary")
    packs = written(found)
    dropped(listed)
    kind = rows.schema["doc_id"].dataType.simpleString()
    texts = text_batches(rows, _coded(block), f"block long, row long, doc_id {kind}, ends long, codes binary")
    return texts.groupBy("block").cogroup(packs.groupBy("block")), kind


def encode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", *, block: int = BLOCK_BYTES) -> DataFrame:
    """(row, doc_id, ids array<int>) of each row of docs, as the tokenizers library encodes its whole text.

    tokenizer is the path of a tokenizers file on every machine. Null counts as empty and has no ids; repeated rows
    each have theirs; an empty table gives no rows. docs is read twice and must give its rows in the same order, as
    tables do; where a block's words or their order differ, the job fails: write such input to a table first.
    """
    both, kind = _cogrouped(docs, tokenizer, id_col, text_col, block=block)
    return both.applyInArrow(_ids, f"row long, doc_id {kind}, ids array<int>")


def encode_digests(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", *, keep_ids: bool = False, block: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: ids as decimals, and their pieces, each joined by one space; ids on demand. See encode()."""
    both, kind = _cogrouped(docs, tokenizer, id_col, text_col, block=block)
    shared = docs.sparkSession.sparkContext.broadcast(_pieces(tokenizer))  # as large as the vocabulary
    return both.applyInArrow(_digests(shared, keep_ids), f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids)


def decode(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """(row, text): each id joined to its piece, pieces joined by one space in order, as decode() does without a decoder."""
    ids = encoded.select("row", F.posexplode_outer("ids").alias("pos", "id"))
    found = ids.join(F.broadcast(pieces(encoded.sparkSession, tokenizer)), "id", "left").groupBy("row").agg(F.array_sort(F.collect_list(F.struct("pos", "piece"))).alias("all"))
    return found.select("row", F.array_join(F.transform("all", lambda x: x["piece"]), " ").alias("text"))


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digests(table(spark, sf_dir, "documents"), default_tokenizer())
