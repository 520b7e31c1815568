"""The queries of this subpackage and the SQL that some of them are compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidewell.llm.bpe import op6_bpe
from tidewell.llm.centroids import OP12_SQL, op12_centroids
from tidewell.llm.exact_dedup import OP1_SQL, op1_exact_dedup
from tidewell.llm.fill_middle import OP11_SQL, op11_fill_in_middle
from tidewell.llm.fingerprints import op2_fingerprints
from tidewell.llm.html_text import op3_html
from tidewell.llm.katz import op5_katz
from tidewell.llm.language import op4_language
from tidewell.llm.licenses import op8_licenses
from tidewell.llm.mixing import OP9_SQL, op9_mixing
from tidewell.llm.packing import op13_packing
from tidewell.llm.quality import op10_quality
from tidewell.llm.simhash import op7_simhash

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_fingerprints": op2_fingerprints,
    "op3_html": op3_html,
    "op4_language": op4_language,
    "op5_katz": op5_katz,
    "op6_bpe": op6_bpe,
    "op7_simhash": op7_simhash,
    "op8_licenses": op8_licenses,
    "op9_mixing": op9_mixing,
    "op10_quality": op10_quality,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_centroids": op12_centroids,
    "op13_packing": op13_packing,
}

SQL: dict[str, str] = {
    "op1_exact_dedup": OP1_SQL,
    "op9_mixing": OP9_SQL,
    "op11_fill_in_middle": OP11_SQL,
    "op12_centroids": OP12_SQL,
}
