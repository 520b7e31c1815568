"""The training-corpus pipeline: each stage reads what the one before it wrote.

Null texts count as empty; ids, languages and sources may be null; ids may repeat, with equal or different texts. An empty
table stays empty. All stages but the last return the columns of documents, whatever others there are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewell.llm.bpe import default_tokenizer, encode_digests
from tidewell.llm.common import written
from tidewell.llm.exact_dedup import drop_copies
from tidewell.llm.mixing import mixed
from tidewell.llm.quality import drop_low_quality, training_labels
from tidewell.llm.simhash import drop_near_copies


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier predicts as 1; it learns as op10_quality does.

    Rows under one id go only if each of them is rejected; without labels nothing is.
    """
    return drop_low_quality(docs, training_labels(spark, sf_dir))


def dedup_exactly(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest id; a null id is smaller than any, and of repeated rows one stays."""
    return drop_copies(docs)


def dedup_nearly(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each SimHash component, the row with the smallest id, null ids last; see drop_near_copies for repeated ids."""
    return drop_near_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources plays them, up to three times; some sources' rest isn't played.

    Documents of no words go; a null source is one of its own; rows under one id are repeated alike.
    """
    return mixed(docs)


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and ids of each row."""
    return encode_digests(docs, default_tokenizer(), keep_ids=True)


STAGES = [
    ("quality classifier", keep_quality),
    ("exact dedup", dedup_exactly),
    ("SimHash near-dedup", dedup_nearly),
    ("mixing sources", mix_sources),
    ("BPE encoding", encode_texts),
]

#: Classifier, fingerprints and tokenizer are beyond SQL; tests/llm compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
