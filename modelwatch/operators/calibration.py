"""Calibration of class probabilities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modelwatch.functions.numbers import argmax, rounded


def expected_calibration_error(rows: DataFrame, proba: str = "proba", label: str = "y_true", bins: int = 10) -> DataFrame:
    """Mean gap of accuracy and confidence over equal-width bins (lo, hi], the first closed at 0 too."""
    conf = F.array_max(proba)
    edges = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    seen = rows.select(conf.alias("conf"), (argmax(F.col(proba)) == F.col(label)).cast("double").alias("hit"))
    binned = seen.withColumn("bin", F.size(F.filter(edges, lambda e: F.col("conf") > e)))
    by = binned.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.abs(F.avg("hit") - F.avg("conf")).alias("gap"))
    return by.agg(F.coalesce(rounded(F.sum(F.col("n") * F.col("gap")) / F.sum("n")), F.lit(0.0)).alias("ece"))


def brier(rows: DataFrame, proba: str = "proba", label: str = "y_true") -> DataFrame:
    """Mean over rows of the squared distance to the label's unit vector."""
    off = F.aggregate(F.transform(proba, lambda p, i: (p - (i == F.col(label)).cast("double")) ** 2), F.lit(0.0), lambda s, x: s + x)
    return rows.agg(rounded(F.avg(off)).alias("brier"))


def confidence_band(confidence: Column, high: float = 0.70, moderate: float = 0.40) -> Column:
    return F.when(confidence >= high, "high").when(confidence >= moderate, "moderate").otherwise("low")
