"""A corpus pipeline of the llm operators: language ID, near-dedup, decontamination, secret scan, mixing (see quire/llm/stages.py)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quire.llm import stages
from quire.session import materialize, table

STAGES = [("language", stages.identify_language), ("simhash", stages.near_dedup), ("decontaminate", stages.decontaminated), ("secrets", stages.secret_scan), ("mixing", stages.mix_sources)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES applied to documents, each result written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: Not expressible in SQL (trained models, bit-parallel matching): tests/llm/test_stages.py holds each stage against brute force.
ORACLE_SQL = None
