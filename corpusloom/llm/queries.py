"""Queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .exact_dedup import OP1_SQL, op1_exact_dedup
from .licenses import op5_license_scans
from .packing import op2_best_fit_packing
from .quality import op3_quality_classifier
from .sentencepiece_codec import op7_sentencepiece
from .simhash import op6_simhash_near_dedup
from .token_store import op10_token_store
from .tool_calls import OP8_SQL, op8_tool_call_linking
from .url_filter import OP9_SQL, op9_url_filter
from .winnow import op4_document_fingerprints


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_exact_dedup, op2_best_fit_packing, op3_quality_classifier, op4_document_fingerprints, op5_license_scans, op6_simhash_near_dedup, op7_sentencepiece, op8_tool_call_linking, op9_url_filter, op10_token_store]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_dedup": OP1_SQL, "op8_tool_call_linking": OP8_SQL, "op9_url_filter": OP9_SQL}
