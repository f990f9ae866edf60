"""Queries of the text operators, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quantloom.llm import bpe, line_dedup, lm, ngram_join, packing, pii, quality_classifier, quality_rules, secrets, sketch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": pii.op1_pii,
    "op2_ngram_join": ngram_join.op2_ngram_join,
    "op3_quality_rules": quality_rules.op3_quality_rules,
    "op4_sketch": sketch.op4_sketch,
    "op5_line_dedup": line_dedup.op5_line_dedup,
    "op6_bpe": bpe.op6_bpe,
    "op7_lm": lm.op7_lm,
    "op8_secrets": secrets.op8_secrets,
    "op9_quality_classifier": quality_classifier.op9_quality_classifier,
    "op10_packing": packing.op10_packing,
}

#: The others rest on fitted models, sketches or a tokenizer, which SQL cannot express; tests hold them to brute force.
ORACLE: dict[str, str] = {
    "op3_quality_rules": quality_rules.OP3_SQL,
    "op5_line_dedup": line_dedup.OP5_SQL,
}
