"""The registered queries of this subpackage and, where SQL can say them, the same in DuckDB."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

#: Query name: its module.
OPERATORS = {
    "op1_warc": "warc",
    "op2_media": "media",
    "op3_bpe": "bpe",
    "op4_minhash": "minhash",
    "op5_quality": "quality",
    "op6_packing": "packing",
    "op7_sharding": "sharding",
    "op8_substrings": "substrings",
    "op9_lines": "lines",
    "op10_chat": "chat",
    "op11_ngrams": "ngrams",
    "op12_centroids": "centroids",
    "op13_divergence": "divergence",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: import_module(f"modelwatch.llm.{module}").query for name, module in OPERATORS.items()}


def oracle_sql() -> dict[str, str]:
    """Only of queries that SQL can express; tests hold the others against brute force."""
    found = {name: getattr(import_module(f"modelwatch.llm.{module}"), "SQL", None) for name, module in OPERATORS.items()}
    return {name: sql for name, sql in found.items() if sql}
