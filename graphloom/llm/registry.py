"""Queries of the training-data operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from graphloom.llm import op01_warc, op02_toxicity, op03_bpe, op04_pii, op05_simhash, op06_substring, op07_mixing, op08_quality, op09_ego, op10_language


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_warc_salvage": op01_warc.op1_warc_salvage,
        "op2_toxicity": op02_toxicity.op2_toxicity,
        "op3_byte_bpe": op03_bpe.op3_byte_bpe,
        "op4_pii": op04_pii.op4_pii,
        "op5_simhash_neardup": op05_simhash.op5_simhash_neardup,
        "op6_substring_dedup": op06_substring.op6_substring_dedup,
        "op7_mixing": op07_mixing.op7_mixing,
        "op8_quality": op08_quality.op8_quality,
        "op9_ego_neardup": op09_ego.op9_ego_neardup,
        "op10_language": op10_language.op10_language,
    }


def oracle_sql() -> dict[str, str]:
    return {"op7_mixing": op07_mixing.SQL, "op9_ego_neardup": op09_ego.SQL}
