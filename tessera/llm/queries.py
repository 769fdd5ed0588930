"""Queries of this subpackage's operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .decontaminate import op1_decontamination
from .html_text import op5_html_text
from .langid import op7_language_id
from .licenses import op8_license_scan
from .near_dedup import op9_near_dedup
from .packing import op4_packing
from .pii import op6_pii
from .substrings import op3_repeated_passages
from .token_files import op10_token_ids
from .topk import OP2_SQL, op2_exact_topk

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_exact_topk": op2_exact_topk,
    "op3_repeated_passages": op3_repeated_passages,
    "op4_packing": op4_packing,
    "op5_html_text": op5_html_text,
    "op6_pii": op6_pii,
    "op7_language_id": op7_language_id,
    "op8_license_scan": op8_license_scan,
    "op9_near_dedup": op9_near_dedup,
    "op10_token_ids": op10_token_ids,
}

ORACLE_SQL: dict[str, str] = {
    "op2_exact_topk": OP2_SQL,
}
