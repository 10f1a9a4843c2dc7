"""Joins of logs with labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modelwatch.functions.numbers import rounded


def class_index(code: Column, codes: list[str], unknown: int | None = None) -> Column:
    """0-based place of a code among ``codes``; ``unknown`` (or null) where it isn't one of them."""
    at = F.nullif(F.array_position(F.array(*map(F.lit, codes)), code), F.lit(0)) - 1
    return (at if unknown is None else F.coalesce(at, F.lit(unknown))).cast("int")


def latest_label(truth: DataFrame, codes: list[str], key: str = "case_id", code: str = "label_code", seq: str = "seq") -> DataFrame:
    """(key, y_true): the latest valid code of each key; later null or unknown ones don't erase it."""
    valid = truth.withColumn("y_true", class_index(F.col(code), codes)).where(F.col("y_true").isNotNull() & F.col(key).isNotNull())
    return valid.groupBy(key).agg(F.max_by("y_true", seq).alias("y_true"))


def labelled_join(log: DataFrame, truth: DataFrame, codes: list[str], key: str = "case_id", pred: str = "pred_code", limit: int | None = 5000, seq: str = "seq") -> DataFrame:
    """Predictions with their case's latest valid label; repeated predictions stay, unmatched rows of either side go.

    ``limit``: the last rows of the log only, as a live monitor reads them. Neither side
    is broadcast by hint: a label table can be as large as the log, and adaptive
    execution broadcasts a side that turns out small.
    """
    recent = log if limit is None else log.orderBy(F.col(seq).desc()).limit(limit)
    return recent.withColumn("y_pred", class_index(F.col(pred), codes)).where("y_pred is not null").join(latest_label(truth, codes, key), key)


def labelled_performance(joined: DataFrame, group: str = "grp", age: str = "age_provided", least: int = 20) -> DataFrame:
    """(n, accuracy, red_flag_recall, gap, age_defaulted_share, note); nulls and a note under ``least`` rows."""
    severe = F.col("y_true") <= 1
    hit = (F.col("y_true") == F.col("y_pred")).cast("double")
    # One grouped pass serves the totals and the gap.
    by = joined.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.sum(hit).alias("hits"), F.count_if(severe).alias("severe"), F.count_if(severe & (F.col("y_pred") <= 1)).alias("caught"), F.count_if(~F.coalesce(F.col(age), F.lit(False))).alias("defaulted"))
    acc = rounded(F.col("hits") / F.col("n"))
    out = by.agg(F.sum("n").alias("n"), F.sum("hits").alias("hits"), F.sum("severe").alias("severe"), F.sum("caught").alias("caught"), F.sum("defaulted").alias("defaulted"), rounded(F.max(acc) - F.min(acc)).alias("gap"))
    n = F.coalesce("n", F.lit(0).cast("long"))
    enough = lambda x: F.when(n >= least, x)
    recall = F.when(F.col("severe") == 0, 1.0).otherwise(F.col("caught") / F.nullif("severe", F.lit(0)))
    return out.select(n.alias("n"), enough(rounded(F.col("hits") / F.col("n"))).alias("accuracy"), enough(rounded(recall)).alias("red_flag_recall"), enough(F.col("gap")).alias("gap"), enough(rounded(F.col("defaulted") / F.col("n"))).alias("age_defaulted_share"), F.when(n < least, "too few labelled rows").alias("note"))


def rescore_direction(before: Column, after: Column) -> Column:
    """more_urgent, less_urgent or unchanged, by class index; a missing index counts as unchanged."""
    return F.when(after < before, "more_urgent").when(after > before, "less_urgent").otherwise("unchanged")


def batch_rescore(rows: DataFrame, before: str = "before", after: str = "after", text: str = "text") -> DataFrame:
    """(scored, failed, more_urgent, less_urgent, unchanged): zero buckets are there too; blank texts fail."""
    blank = F.trim(F.coalesce(text, F.lit(""))) == ""
    d = rescore_direction(F.col(before), F.col(after))
    return rows.agg(F.count_if(~blank).alias("scored"), F.count_if(blank).alias("failed"), *(F.count_if(~blank & (d == k)).alias(k) for k in ("more_urgent", "less_urgent", "unchanged")))


def with_defaults(jobs: DataFrame, purposes: DataFrame, statuses: DataFrame) -> DataFrame:
    """Jobs with purpose and status by name, each defaulted."""
    return jobs.join(purposes, "name", "left").join(statuses, "name", "left").withColumns({"purpose": F.coalesce("purpose", F.lit("-")), "status": F.coalesce("status", F.lit("not run"))})
