"""Language ID by compression: the language whose dictionary makes the text smallest.

Each language has a raw-content zstandard dictionary of pieces of its texts. A text is cut into pieces, so that the
dictionary counts all along it, each piece is compressed with every dictionary, and the sizes are summed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewell.llm.common import crc_mod, table, text_batches

#: A dictionary is fitted on a bounded sample of a language's rows: so many pieces of so many characters.
DICT_PIECES, DICT_CHARS = 160, 400
#: Bytes of the pieces that a text is cut into.
PIECE = 4096
#: A text also counts as windows of WINDOW bytes, STEP bytes apart and further where more than WINDOWS would be, so that the
#: whole bytes of a short text tell enough.
WINDOW, STEP, WINDOWS = 40, 7, 40
PARAMETERS = dict(window_log=17, hash_log=15, chain_log=16, search_log=3, min_match=4, target_length=16, strategy=zstandard.STRATEGY_LAZY, write_content_size=False, write_dict_id=False)
#: Least relative distance of the second-smallest size to the smallest; below it the prediction is marked as rejected.
MARGIN = 0.005
#: How fast the score nears 1 with that distance.
SHARPNESS = 60.0

_BLANK = str.maketrans({c: " " for c in map(chr, range(0x80)) if not c.isalpha()})


def normal(text: str) -> str:
    """Lower case, ASCII characters other than letters as blanks, one blank at a time."""
    return " ".join(text.lower().translate(_BLANK).split())


def sample(rows: DataFrame) -> dict[str, bytes]:
    """rows(id, text, lang) -> a dictionary for each language; rows without text or language teach nothing.

    The pieces are of the rows first in the order of their ids' hashes, each from a place that the hash gives.
    """
    spot = F.xxhash64("id")
    letters = rows.filter("lang is not null and text rlike '[^ -@\\\\[-`{-~\\\\s]'")
    cut = letters.select("lang", "id", spot.alias("h"), F.substring("text", F.pmod(spot, F.greatest(F.lit(1), F.length("text") - DICT_CHARS)).cast("int") + 1, F.lit(DICT_CHARS)).alias("piece"))
    ranked = cut.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("h", "id", "piece"))).filter(F.col("n") <= DICT_PIECES)
    found: dict[str, list] = {}
    for r in ranked.select("lang", "n", "piece").collect():  # DICT_PIECES rows a language
        found.setdefault(r["lang"], []).append((r["n"], r["piece"]))
    return {k: " ".join(normal(p) for _, p in sorted(v, reverse=True)).encode("utf-8", "surrogatepass") for k, v in sorted(found.items())}


class Sizes:
    """Compressed size of a text with each dictionary."""

    def __init__(self, dictionaries: dict[str, bytes]):
        self.coders = []
        for raw in dictionaries.values():
            d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            p = zstandard.ZstdCompressionParameters(**PARAMETERS)
            d.precompute_compress(compression_params=p)
            self.coders.append(zstandard.ZstdCompressor(dict_data=d, compression_params=p))

    def __call__(self, text: str) -> np.ndarray:
        raw = normal(text).encode("utf-8", "surrogatepass")
        pieces = [raw[i : i + PIECE] for i in range(0, len(raw), PIECE)]
        pieces += [raw[i : i + WINDOW] for i in range(0, len(raw), max(STEP, -(-len(raw) // WINDOWS)))]
        return np.array([sum(len(c.compress(p)) for p in pieces) for c in self.coders])


def judge(sizes: np.ndarray) -> tuple[int, float, float]:
    """(index of the smallest, score, margin); ties go to the first."""
    best = int(sizes.argmin())
    if len(sizes) == 1:
        return best, 1.0, 1.0
    away = (np.delete(sizes, best) - sizes[best]) / max(1, sizes[best])
    return best, float(1 / (1 + np.exp(-SHARPNESS * away).sum())), float(away.min())


def _predict(dictionaries: dict[str, bytes]):
    names = list(dictionaries)

    def run(batches):
        sizes = Sizes(dictionaries)
        for b in batches:
            rows = []
            for t in b.column("text").to_pylist():
                if not names or t is None or not any(map(str.isalpha, t)):
                    rows.append(("und", 0.0, False))
                    continue
                best, score, margin = judge(sizes(t))
                rows.append((names[best], score, margin < MARGIN))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.float64()), pa.array([r[2] for r in rows], pa.bool_())],
                ["doc_id", "lang_pred", "score", "rejected"],
            )

    return run


def identify(docs: DataFrame, dictionaries: dict[str, bytes], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, rejected (the margin is narrow) for each row; one pass, no shuffle.

    `und` with score 0 where the text is null or has no letter, or where nothing was learned.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return text_batches(rows, _predict(dictionaries), f"doc_id {docs.schema[id_col].dataType.simpleString()}, lang_pred string, score double, rejected boolean")


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = crc_mod(F.col("doc_id"), 4) == 2
    learned = sample(docs.filter(~held_out).select(F.col("doc_id").alias("id"), "text", "lang"))
    return identify(docs, learned).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")
