"""The subpackage's queries for ``__spark_entry__``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bpe import op9_byte_bpe
from .embedding_dedup import OP1_SQL, op1_embedding_near_dedup
from .html_text import op4_html_extraction
from .licenses import op3_license_scan
from .mixing import op5_source_mixing
from .neardup import op10_minhash_near_dedup
from .pii import op6_pii
from .quality import op2_quality_rules
from .substrings import OP8_SQL, op8_suffix_array_dedup
from .toxicity import op7_toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_embedding_near_dedup, op2_quality_rules, op3_license_scan, op4_html_extraction, op5_source_mixing, op6_pii, op7_toxicity, op8_suffix_array_dedup, op9_byte_bpe, op10_minhash_near_dedup)}


def oracle_sql() -> dict[str, str]:
    """Models, sampling, permutations and tokenizers are not for SQL; those queries are tested against plain Python."""
    return {"op1_embedding_near_dedup": OP1_SQL, "op8_suffix_array_dedup": OP8_SQL}
