"""Words of whole texts as Arrow arrays, in blocks of many texts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard

#: Bytes of the texts of a block.
BLOCK_BYTES = 8_000_000


def split_words(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, pa.Array]:
    """(n + 1 offsets, words): the runs outside `[\\x20\\x09-\\x0D]` of n texts, null as empty; lower folds A-Z only."""
    texts = texts.take(pa.array(range(len(texts)))) if texts.offset else texts  # a cast reads a slice from the wrong place
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    words, offsets = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
    offsets = offsets - offsets[0]
    filled = pc.greater(pc.binary_length(words), 0)
    seen = np.concatenate(([0], np.cumsum(filled.to_numpy(zero_copy_only=False))))
    return seen[offsets], words.filter(filled)


def joined(parts: list[tuple[np.ndarray, pa.DictionaryArray]]) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(offsets, codes, distinct words by code) of split and coded batches as one; words in the order in which they come first."""
    lengths = np.concatenate([np.diff(offsets) for offsets, _ in parts])
    coded = pa.chunked_array([words for _, words in parts]).unify_dictionaries().chunks
    return np.concatenate(([0], np.cumsum(lengths))), np.concatenate([c.indices.to_numpy(zero_copy_only=False) for c in coded]), coded[0].dictionary


def gathered(batches, size, make, most: int, keep=lambda b: b):
    """make(batches) for runs of input batches in which size adds up to most or more, and for the rest; keep(batch) is what is held of each."""
    held, n = [], 0
    for b in batches:
        if not b.num_rows:
            continue
        n += size(b)
        held.append(keep(b))
        if n >= most:
            yield from make(held)
            held, n = [], 0
            pa.default_memory_pool().release_unused()
    if held:
        yield from make(held)


def _ends(b: pa.RecordBatch) -> np.ndarray:
    """Bytes up to the end of each row's text, four a row included."""
    return np.cumsum(pc.fill_null(pc.binary_length(b.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 4)


def _cut(batches, most: int):
    """The batches, cut behind the rows at which blocks of most bytes are full: where a block ends doesn't depend on the batches."""
    n = 0
    for b in batches:
        ends, at = np.append(0, _ends(b)), 0
        while at < b.num_rows:
            stop = min(b.num_rows, int(np.searchsorted(ends, ends[at] + most - n)))
            n += int(ends[stop] - ends[at])
            n = 0 if n >= most else n
            yield b if stop - at == b.num_rows else b.take(pa.array(range(at, stop)))
            at = stop


def text_blocks(batches, lower: bool = False, most: int = BLOCK_BYTES):
    """Rows (row, ..., text) as blocks: (block, its rows without text, offsets, codes, distinct words by code).

    A block is named by the first of its rows; codes are places in its distinct words. Each batch is split as it comes: what
    is held of it are codes and distinct words, not texts.
    """

    def keep(b):
        offsets, words = split_words(b.column("text"), lower)
        return pa.Table.from_batches([b]).drop_columns(["text"]), (offsets, words.dictionary_encode())

    def make(held):
        offsets, codes, words = joined([coded for _, coded in held])
        rows = pa.concat_tables([rows for rows, _ in held]).combine_chunks()
        held.clear()
        yield rows.column("row")[0].as_py(), rows, offsets, codes, words.cast(pa.binary())

    return gathered(_cut(batches, most), lambda b: int(_ends(b)[-1]), make, most, keep)


def lists(offsets: np.ndarray, values) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)


def squeezed(*arrays: np.ndarray) -> bytes:
    """Whole numbers from 0 for the way between tasks: in planes of bytes, compressed."""
    head, body = [], []
    for a in arrays:
        width = max(1, (int(a.max()).bit_length() + 7) // 8) if len(a) else 1
        head += [width, len(a)]
        body.append(a.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes())
    return zstandard.ZstdCompressor(level=1, write_checksum=False).compress(b"".join([np.array(head, "<i4").tobytes(), *body]))


def unsqueezed(raw: bytes, n: int) -> list[np.ndarray]:
    """The n arrays of squeezed()."""
    raw, at, out = zstandard.ZstdDecompressor().decompress(raw), 8 * n, []
    for width, size in np.frombuffer(raw, "<i4", 2 * n).reshape(-1, 2).tolist():
        x = np.zeros((size, 8), np.uint8)
        x[:, :width] = np.frombuffer(raw, np.uint8, width * size, at).reshape(width, size).T
        out.append(x.view("<i8").ravel())
        at += width * size
    return out


def runs(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Places start, start + 1, ... of each run, one run after another."""
    return np.arange(lengths.sum()) + np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)


class Lookup:
    """Places of keys in a sorted array, -1 where missing."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys

    def __call__(self, wanted: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(wanted), -1)
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, at, -1)
