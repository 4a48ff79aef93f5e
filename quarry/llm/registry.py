"""Queries of the corpus operators, their SQL where SQL can express them, and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quarry.llm import bpe, decontaminate, html, huffman, licenses, parts, quality, sharding, simhash, tokencount, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": simhash.op1_simhash,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_decontaminate": decontaminate.op3_decontaminate,
    "op4_licenses": licenses.op4_licenses,
    "op5_huffman": huffman.op5_huffman,
    "op6_token_counts": tokencount.op6_token_counts,
    "op7_quality": quality.op7_quality,
    "op8_sharding": sharding.op8_sharding,
    "op9_html": html.op9_html,
    "op10_bpe": bpe.op10_bpe,
    **parts.QUERIES,
}

#: Of the ten queries none is SQL as a whole; `parts` has what of them is.
ORACLE_SQL: dict[str, str] = dict(parts.ORACLE_SQL)
