"""The corpus pipeline: documents through classifier, rules, near-dedup, substring dedup and packing.

Every stage takes any documents: an empty table gives an empty table, extra columns pass
through all but the last, and a very long text is worked on by itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from modelwatch.llm import lines, minhash, packing, quality, substrings
from modelwatch.llm.shared import Scratch


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on labelled rows, accepts; each row by its own text, whatever repeats or lacks a doc_id."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def good_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are content for the most part; null and short texts go, repeated rows are each judged.

    The field learns from all labelled documents: among those that the classifier let
    through there are hardly any bad lines.
    """
    field = lines.train(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return lines.keep_content(docs, field)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of the smallest doc_id; rows equal in doc_id and text are one, rows without doc_id stay."""
    return minhash.deduplicated(docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that one with a smaller doc_id has.

    Who loses all words stays with the empty text. Rows that share a doc_id, or have none,
    take nothing from one another.
    """
    return substrings.remove_repeats(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces in sequences of 4096 tokens; an empty or null text is its end token."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality", good_quality), ("rules", good_lines), ("near-dedup", one_of_each), ("substrings", without_repeats), ("packing", packed)]
#: Trained models decide the first two stages and a tokenizer the last: SQL can't say them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies STAGES to ``documents``; each stage's rows are a table that the next one reads."""
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
        scratch.keep(name)
    return docs
