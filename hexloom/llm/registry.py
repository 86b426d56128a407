"""The queries of this subpackage, one for each operator, over the whole tables."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

#: Query name and the module that has its ``query(spark, sf_dir)`` and, where SQL can express it, ``ORACLE_SQL``.
MODULES = {
    "op1_ngram_jaccard_join": "ngram_join",
    "op2_chat_format": "chat_format",
    "op3_license_scan": "license_scan",
    "op4_packing": "packing",
    "op5_decontamination": "decontamination",
    "op6_html_extraction": "html_extraction",
    "op7_url_filter": "url_filter",
    "op8_media_sniffing": "media_sniffing",
    "op9_pii_disclosure": "pii_disclosure",
    "op10_quality_classifier": "quality_classifier",
    "op11_sharding": "sharding",
    "op12_fill_in_middle": "fill_in_middle",
    "op13_ball_kmeans": "ball_kmeans",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: import_module(f"hexloom.llm.{module}").query for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(import_module(f"hexloom.llm.{module}"), "ORACLE_SQL", None) for name, module in MODULES.items()}
    return {name: sql for name, sql in found.items() if sql}
