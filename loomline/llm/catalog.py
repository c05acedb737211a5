"""Queries of the training-data operators and the SQL that some of them can be held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomline.llm import chat_format, exact_dedup, fingerprints, hpy_lm, mixing, near_dedup, packing, secrets, substring_dedup, toxicity


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "pipeline": pipeline,
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_mix_sources": mixing.op2_mix_sources,
    "op3_hpy_lm": hpy_lm.op3_hpy_lm,
    "op4_chat_format": chat_format.op4_chat_format,
    "op5_substring_dedup": substring_dedup.op5_substring_dedup,
    "op6_packing": packing.op6_packing,
    "op7_fingerprints": fingerprints.op7_fingerprints,
    "op8_secrets": secrets.op8_secrets,
    "op9_near_dedup": near_dedup.op9_near_dedup,
    "op10_exact_dedup": exact_dedup.op10_exact_dedup,
}
ORACLES: dict[str, str] = {
    "op4_chat_format": chat_format.OP4_SQL,
    "op10_exact_dedup": exact_dedup.OP10_SQL,
}
