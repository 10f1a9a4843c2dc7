"""Explanations: top contributions, agreement of two attributions, cross-validation statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from modelwatch.functions.numbers import rounded


def cross_validation(folds: DataFrame, value: str, fold: str = "fold") -> DataFrame:
    """(mean, std, folds): sample deviation, values in fold order."""
    values = F.transform(F.array_sort(F.collect_list(F.struct(fold, value))), lambda s: rounded(s[value]).cast("string"))
    return folds.agg(rounded(F.avg(value)).alias("mean"), rounded(F.stddev_samp(value)).alias("std"), F.array_join(values, ",").alias("folds"))


def top_contributions(long: DataFrame, row: str = "row_id", feature: str = "feature", value: str = "value", k: int = 6, least: float = 1e-9) -> DataFrame:
    """(row, feature, value, rank): the k largest by size of each row; equal ones by name."""
    w = Window.partitionBy(row).orderBy(F.abs(value).desc(), feature)
    return long.where(F.abs(value) > least).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def mean_attribution(long: DataFrame, feature: str = "feature", value: str = "value") -> DataFrame:
    return long.groupBy(feature).agg(rounded(F.avg(F.abs(value)), 6).alias("mean_abs"))


def top_features(long: DataFrame, k: int = 10, feature: str = "feature", value: str = "value") -> DataFrame:
    return mean_attribution(long, feature, value).orderBy(F.col("mean_abs").desc(), feature).limit(k)


def _average_rank(by: list[str], value: Column) -> Column:
    w = Window.partitionBy(*by).orderBy(value)
    return F.rank().over(w) + (F.count(F.lit(1)).over(Window.partitionBy(*by, value)) - 1) / 2


def agreement(long: DataFrame, row: str = "row_id", feature: str = "feature", one: str = "a", two: str = "b", k: int = 3) -> DataFrame:
    """(overlap, spearman, sign, top1) of two attributions, means over rows; rows without a correlation don't count in it."""
    sized = long.withColumns({"_x": F.abs(one), "_y": F.abs(two)})
    ranked = sized.withColumns({"_rx": _average_rank([row], F.col("_x")), "_ry": _average_rank([row], F.col("_y"))})
    top = lambda c: F.transform(F.slice(F.array_sort(F.collect_list(F.struct((-F.col(c)).alias("s"), F.col(feature).alias("f")))), 1, k), lambda s: s["f"])
    by = ranked.groupBy(row).agg(top("_x").alias("ta"), top("_y").alias("tb"), (F.covar_pop("_rx", "_ry") / F.nullif(F.stddev_pop("_rx") * F.stddev_pop("_ry"), F.lit(0.0))).alias("rho"), F.avg((F.signum(one) == F.signum(two)).cast("double")).alias("sign"))
    same = (F.element_at("ta", 1) == F.element_at("tb", 1)).cast("double")
    return by.agg(rounded(F.avg(F.size(F.array_intersect("ta", "tb")) / k)).alias("overlap"), rounded(F.avg("rho")).alias("spearman"), rounded(F.avg("sign")).alias("sign"), rounded(F.avg(same)).alias("top1"))


def urgency(contributions: Column, weights: tuple[float, ...] = (1.0, 0.5, 0.0, -0.5, -1.0)) -> Column:
    """Signed urgency of contributions by class."""
    return F.aggregate(F.zip_with(contributions, F.array(*map(F.lit, weights)), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)


def best_flips(flips: DataFrame, row: str = "row_id", direction: str = "direction", p: str = "p", feature: str = "feature_index") -> DataFrame:
    """For each row and direction the flip with the largest probability; ties go to the lower feature."""
    best = F.max_by(F.struct(F.col(feature), F.col(p)), F.struct(F.col(p), (-F.col(feature)).alias("less")))
    return flips.groupBy(row, direction).agg(best.alias("m")).select(row, direction, F.col(f"m.{feature}").alias(feature), F.col(f"m.{p}").alias(p))
