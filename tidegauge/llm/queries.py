"""The queries of this subpackage, by name, and the SQL that states the same results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chatformat, decontaminate, exactdedup, langid, licenses, mixing, neardup, toxicity
from .tokencounts import op2_token_counts
from .trainorder import op1_training_order

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_training_order": op1_training_order,
    "op2_token_counts": op2_token_counts,
    "op3_exact_dedup": exactdedup.op3_exact_dedup,
    "op4_language_id": langid.op4_language_id,
    "op5_chat_formatting": chatformat.op5_chat_formatting,
    "op6_decontamination": decontaminate.op6_decontamination,
    "op7_license_scan": licenses.op7_license_scan,
    "op8_jaccard_join": neardup.op8_jaccard_join,
    "op9_source_mixing": mixing.op9_source_mixing,
    "op10_toxicity": toxicity.op10_toxicity,
}
ORACLE_SQL: dict[str, str] = {
    "op3_exact_dedup": exactdedup.SQL,
    "op5_chat_formatting": chatformat.SQL,
    "op6_decontamination": decontaminate.SQL,
    "op7_license_scan": licenses.SQL,
    "op9_source_mixing": mixing.SQL,
}
