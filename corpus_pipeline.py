"""The corpus pipeline: language identification, line dedup, near-duplicates, decontamination, packing.

Each stage reads what the one before it wrote as Parquet and calls one operator of beamgrid.llm; all but the last return
the columns of documents. Tables beside documents (the benchmark) are read from sf_dir.

Stages keep clean documents: language identification drops texts without a letter; line dedup rewrites texts and drops
those of which nothing is left; of a group of near-duplicates the one with the smallest doc_id stays; documents that hold
a benchmark item go; packing gives the pieces of all that are left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from beamgrid.llm import decontaminate, language, line_dedup, near_dup, packing
from beamgrid.llm.common import materialize

STAGES = [
    ("language", language.stage),
    ("line_dedup", line_dedup.stage),
    ("near_dup", near_dup.stage),
    ("decontaminate", decontaminate.stage),
    ("pack", packing.stage),
]

#: Tokenizers and trained profiles are beyond SQL; tests hold each stage against a plain form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
