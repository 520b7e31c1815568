"""Fill-in-the-middle documents: DuckDB cuts and reorders whole batches of texts inside Spark's tasks.

Each task opens one DuckDB connection in memory, registers every Arrow batch as a table and runs one SELECT on it:
regexp_extract_all cuts texts into tokens, list_slice and array_to_string build the three spans, sha256 of a seed and
the id says where to cut and whether to. No row is seen by Python.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.common import table

#: A token: a word with the white space before it, or the white space that is left at the end.
TOKEN = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Bytes of the texts that DuckDB is given at a time; a token takes some 30 bytes there.
BATCH_BYTES = 4_000_000

_SELECT = """
SELECT doc_id, n, form,
    CASE form
        WHEN 'plain' THEN text
        WHEN 'psm' THEN $p || before || $s || after || $m || middle
        ELSE $s || after || $p || before || $m || middle
    END AS output,
    CASE WHEN form <> 'plain' THEN length(before) END AS prefix_chars,
    CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars
FROM (
    SELECT doc_id, text, n, form,
        array_to_string(list_slice(tokens, 1, low), '') AS before,
        array_to_string(list_slice(tokens, low + 1, high), '') AS middle,
        array_to_string(list_slice(tokens, high + 1, n), '') AS after
    FROM (
        SELECT doc_id, text, tokens, n, least(h1 % (n + 1), h2 % (n + 1)) AS low, greatest(h1 % (n + 1), h2 % (n + 1)) AS high,
            CASE
                WHEN n = 0 OR contains(text, $p) OR contains(text, $s) OR contains(text, $m) OR h3 % 100 >= $rate THEN 'plain'
                WHEN h4 % 100 < $spm THEN 'spm'
                ELSE 'psm'
            END AS form
        FROM (
            SELECT doc_id, text, tokens, CAST(len(tokens) AS BIGINT) AS n,
                CAST('0x' || substr(digest, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(digest, 9, 8) AS BIGINT) AS h2,
                CAST('0x' || substr(digest, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(digest, 25, 8) AS BIGINT) AS h4
            FROM (SELECT doc_id, text, regexp_extract_all(text, $token) AS tokens, sha256($seed || ':' || key) AS digest FROM batch)
        )
    )
)
"""


def _by_bytes(batches, most: int):
    """The batches in runs of rows of about `most` bytes of text, copied."""
    for b in batches:
        ends = np.cumsum(pc.binary_length(b.column("text")).to_numpy(zero_copy_only=False)) if b.num_rows else []
        at = 0
        while at < b.num_rows:
            held = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, held + most, "right")))
            yield b.take(pa.array(range(at, to)))
            at = to


def _run(values: dict, most: int):
    def run(batches):
        import duckdb

        with duckdb.connect(config={"threads": 1}) as con:  # a task has one core
            con.execute("SET enable_progress_bar = false")
            for b in _by_bytes(batches, most):
                con.register("batch", pa.Table.from_batches([b]))
                found = con.sql(_SELECT, params=values).to_arrow_table()
                con.unregister("batch")
                yield from found.to_batches()
                del found
                pa.default_memory_pool().release_unused()

    return run


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, seed: int = 42, rate: int = 50, spm: int = 80, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """doc_id, n (tokens), form (plain, psm, spm), output (the text of that form), prefix_chars, middle_chars of every row.

    rate is the percentage of documents that are rearranged, spm the percentage of these with the suffix first. A null
    text counts as empty, a null id as the empty text in the seed's hash. Empty texts, and those that hold one of the
    three marks, stay plain. Rows of one id and text are alike; an empty table gives no rows; other columns don't matter.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("key"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    values = {"p": PREFIX, "s": SUFFIX, "m": MIDDLE, "seed": str(seed), "rate": rate, "spm": spm, "token": TOKEN}
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_run(values, batch_bytes), f"doc_id {kind}, n long, form string, output string, prefix_chars long, middle_chars long")


def restored(output: Column, form: Column) -> Column:
    """The text that an output of a form was made from: marks can't be in it, so the first of each is the right one."""
    middle, front = F.substring_index(output, MIDDLE, -1), F.substring_index(output, MIDDLE, 1)

    def between(first: str, second: str) -> tuple[Column, Column]:
        return F.substring_index(F.substring_index(front, second, 1), first, -1), F.substring_index(front, second, -1)

    (psm_prefix, psm_suffix), (spm_suffix, spm_prefix) = between(PREFIX, SUFFIX), between(SUFFIX, PREFIX)
    return F.when(form == "psm", F.concat(psm_prefix, middle, psm_suffix)).when(form == "spm", F.concat(spm_prefix, middle, spm_suffix)).otherwise(output)


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(table(spark, sf_dir, "documents"))
    output, form = F.col("output"), F.col("form")
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(output).alias("output_sha256"), digest(restored(output, form)).alias("restored_sha256"))


#: The spans by places of code points instead of by lists of tokens.
OP11_SQL = r"""
WITH d AS (
    SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
        list_transform(regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+'), lambda x: length(x)) AS sizes
    FROM documents
), c AS (
    SELECT doc_id, text, sizes, len(sizes) AS n, list_transform([1, 9, 17, 25], lambda i: CAST('0x' || substr(h, i, 8) AS BIGINT)) AS g FROM d
), f AS (
    SELECT *, CASE WHEN text = '' OR regexp_matches(text, '<[PSM]>') OR g[3] % 100 >= 50 THEN 'plain' WHEN g[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form,
        coalesce(list_sum(sizes[1:least(g[1] % (n + 1), g[2] % (n + 1))]), 0)::BIGINT AS a,
        coalesce(list_sum(sizes[1:greatest(g[1] % (n + 1), g[2] % (n + 1))]), 0)::BIGINT AS b
    FROM c
), o AS (
    SELECT *, CASE form WHEN 'plain' THEN text
        WHEN 'psm' THEN '<P>' || substr(text, 1, a) || '<S>' || substr(text, b + 1) || '<M>' || substr(text, a + 1, b - a)
        ELSE '<S>' || substr(text, b + 1) || '<P>' || substr(text, 1, a) || '<M>' || substr(text, a + 1, b - a) END AS output
    FROM f
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
    sha256(output) AS output_sha256, sha256(text) AS restored_sha256
FROM o
"""
