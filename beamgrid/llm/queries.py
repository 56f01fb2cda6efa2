"""The registered queries of the numbered operators and of the pipeline, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline

from . import best_fit, decontaminate, divergence, language, line_dedup, near_dup, neighbours, packing, pii, quality, spelling, token_store, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_token_store": token_store.query,
        "op2_warc": warc.query,
        "op3_pii": pii.query,
        "op4_neighbours": neighbours.query,
        "op5_packing": packing.query,
        "op6_language": language.query,
        "op7_decontaminate": decontaminate.query,
        "op8_line_dedup": line_dedup.query,
        "op9_near_dup": near_dup.query,
        "op10_quality": quality.query,
        "op11_best_fit": best_fit.query,
        "op12_spelling": spelling.query,
        "op13_divergence": divergence.query,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_warc": warc.SQL, "op9_near_dup": near_dup.SQL, "op12_spelling": spelling.SQL, "op13_divergence": divergence.SQL}
