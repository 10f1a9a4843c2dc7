"""Telemetry: counters, histograms and gauges over event tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modelwatch.functions.numbers import rounded


def counter(events: DataFrame, labels: list[str], spine: DataFrame | None = None) -> DataFrame:
    """(labels, n); ``spine``: label rows that are there with 0 too."""
    n = events.groupBy(*labels).agg(F.count(F.lit(1)).alias("n"))
    return n if spine is None else spine.join(n, labels, "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def histogram(events: DataFrame, value: str, buckets: list[float], labels: list[str] | None = None) -> DataFrame:
    """(labels, le, n): cumulative counts by bucket, the last one without bound (null le)."""
    by = events.groupBy(*(labels or []))
    wide = by.agg(*[F.count_if(F.col(value) <= b).alias(f"b{i}") for i, b in enumerate(buckets)], F.count(value).alias("all"))
    cells = F.array(*[F.struct(F.lit(b).cast("double").alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate(buckets)], F.struct(F.lit(None).cast("double").alias("le"), F.col("all").alias("n")))
    return wide.select(*(labels or []), F.explode(cells).alias("c")).select(*(labels or []), "c.le", "c.n")


def gauge(events: DataFrame, labels: list[str], value: str, at: str) -> DataFrame:
    """(labels, value): the last one by time."""
    return events.groupBy(*labels).agg(F.max_by(value, at).alias(value))


def observed(acuity: Column, confidence: Column) -> tuple[Column, Column]:
    """A prediction's label and value: blank acuity is ``unknown``, confidence is clamped to [0, 1]."""
    return F.coalesce(F.nullif(F.trim(acuity), F.lit("")), F.lit("unknown")), F.greatest(F.lit(0.0), F.least(F.lit(1.0), confidence))


def usage(calls: DataFrame, model: str = "model") -> DataFrame:
    """(model, prompt, completion, cost, priced): negatives count as 0, unpriced calls count tokens only."""
    plus = lambda c: F.greatest(F.col(c), F.lit(0))
    return calls.groupBy(model).agg(F.sum(plus("prompt")).alias("prompt"), F.sum(plus("completion")).alias("completion"), rounded(F.coalesce(F.sum(plus("cost")), F.lit(0.0))).alias("cost"), F.count("cost").alias("priced"))


def latency(calls: DataFrame, labels: list[str], seconds: str = "seconds") -> DataFrame:
    """(labels, n, mean): failed calls are in it under their outcome."""
    return calls.groupBy(*labels).agg(F.count(F.lit(1)).alias("n"), rounded(F.avg(seconds)).alias("mean"))


def component_states(rows: DataFrame, present: str, component: str) -> DataFrame:
    """(component, state, n): null is not_applicable, true present, false degraded."""
    state = F.when(F.col(present).isNull(), "not_applicable").when(F.col(present), "present").otherwise("degraded")
    return rows.groupBy(component, state.alias("state")).agg(F.count(F.lit(1)).alias("n"))
