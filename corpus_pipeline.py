"""The corpus pipeline: quality, near duplicates, decontamination, personal data, packing.

Each stage works on all that the one before it kept. Between stages ``run`` writes the
rows to the shared checkpoint folder and reads them from there.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from hexloom.llm.decontamination import decontamination_stage
from hexloom.llm.ngram_join import near_duplicate_stage
from hexloom.llm.packing import packing_stage
from hexloom.llm.pii_disclosure import pii_stage
from hexloom.llm.quality_classifier import quality_stage
from hexloom.session import cut_lineage

STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("pii", pii_stage),
    ("packing", packing_stage),
]

#: A classifier, sanitisation and packing are not SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of all documents that the stages keep."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = cut_lineage(docs)
    return docs
