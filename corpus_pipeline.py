"""Corpus preparation: toxicity, near-duplicates, repeated passages, mixing, packing.

Each stage gets what the one before it kept, written as Parquet and read again; all but the last return the columns
of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from basalt.llm.common import stage
from basalt.llm.exact_substrings import suffix_dedup_stage
from basalt.llm.mixing import mixing_stage
from basalt.llm.near_dedup import near_dedup_stage
from basalt.llm.packing import packing_stage
from basalt.llm.toxicity import toxicity_stage

STAGES = [
    ("toxicity", toxicity_stage),
    ("near_dedup", near_dedup_stage),
    ("suffix_dedup", suffix_dedup_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]
# models and token ids take part, which SQL does not express
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed sequences of the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
