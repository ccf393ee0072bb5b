"""Five operators in a row over the documents; each stage's rows are written and read again before the next.

quality rules drop texts, near-deduplication keeps one of each class, personal data is masked, sources are mixed to their
targets (texts are repeated or cut to the words that the mix takes), and byte-level BPE encodes what is left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quiverlake.llm import bpe, mixing, neardup, pii, quality
from quiverlake.llm.common import stored, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.without_copies(docs)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each row of the mix."""
    import public_tokenizers

    return bpe.encode_digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("quality rules", quality_stage), ("near-dedup", dedup_stage), ("pii", pii_stage), ("mixing", mixing_stage), ("byte-level bpe", bpe_stage)]
#: Label models, sampling and merges are not for SQL; the stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
