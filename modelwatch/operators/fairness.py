"""Accuracy, safety and fairness metrics of labelled predictions.

Rows are (label, prediction, group); severities 0 and 1 are the severe ones. Metrics
by group come from one grouped aggregate, gaps from a second one over the groups'
rounded values. Ratios are rounded to four places unless a docstring says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modelwatch.functions.numbers import ratio, rounded

SEVERE = 1  # the largest severe class


def _severe(name: str) -> Column:
    return F.col(name) <= SEVERE


def _share(hit: Column, of: Column | None = None) -> Column:
    """Share of rows with ``hit`` among those with ``of``; null where there are none."""
    if of is None:
        return ratio(F.count_if(hit), F.count(F.lit(1)))
    return ratio(F.count_if(hit & of), F.count_if(of))


def accuracy(rows: DataFrame, label: str = "y_true", pred: str = "y_pred") -> DataFrame:
    return rows.agg(rounded(_share(F.col(label) == F.col(pred))).alias("accuracy"), F.count(F.lit(1)).alias("n"))


def subgroup_accuracy(rows: DataFrame, label: str = "y_true", pred: str = "y_pred", group: str = "grp") -> DataFrame:
    """(group, accuracy, n)."""
    return rows.groupBy(group).agg(rounded(_share(F.col(label) == F.col(pred))).alias("accuracy"), F.count(F.lit(1)).alias("n"))


def gap(by_group: DataFrame, value: str, name: str = "gap") -> DataFrame:
    """Largest less smallest of already rounded group values; 0.0 without groups."""
    return by_group.agg(F.coalesce(rounded(F.max(value) - F.min(value)), F.lit(0.0)).alias(name))


def red_flag_recall(rows: DataFrame, label: str = "y_true", pred: str = "y_pred") -> DataFrame:
    """Share of severe rows predicted severe, whichever severe class; 1.0 without severe rows."""
    return rows.agg(F.coalesce(rounded(_share(_severe(pred), _severe(label))), F.lit(1.0)).alias("red_flag_recall"))


def subgroup_red_flag_recall(rows: DataFrame, label: str = "y_true", pred: str = "y_pred", group: str = "grp") -> DataFrame:
    """(group, recall, n_severe); recall is null where a group has no severe rows."""
    return rows.groupBy(group).agg(rounded(_share(_severe(pred), _severe(label))).alias("recall"), F.count_if(_severe(label)).alias("n_severe"))


def demographic_parity(rows: DataFrame, pred: str = "y_pred", group: str = "grp") -> DataFrame:
    """(group, rate of severe predictions)."""
    return rows.groupBy(group).agg(rounded(_share(_severe(pred))).alias("rate"))


def equal_opportunity(rows: DataFrame, label: str = "y_true", pred: str = "y_pred", group: str = "grp") -> DataFrame:
    """(group, tpr) of groups that have severe rows."""
    return rows.where(_severe(label)).groupBy(group).agg(rounded(_share(_severe(pred))).alias("tpr"))


def equalized_odds(rows: DataFrame, label: str = "y_true", pred: str = "y_pred", group: str = "grp") -> DataFrame:
    """(tpr_gap, fpr_gap, equalized_odds): the headline is the larger gap."""
    by = rows.groupBy(group).agg(rounded(_share(_severe(pred), _severe(label))).alias("tpr"), rounded(_share(_severe(pred), ~_severe(label))).alias("fpr"))
    spread = lambda c: F.coalesce(rounded(F.max(c) - F.min(c)), F.lit(0.0))
    gaps = by.agg(spread("tpr").alias("tpr_gap"), spread("fpr").alias("fpr_gap"))
    return gaps.withColumn("equalized_odds", F.greatest("tpr_gap", "fpr_gap"))


def disparate_impact(rows: DataFrame, pred: str = "y_pred", group: str = "grp") -> DataFrame:
    """(difference, ratio, passes): smallest over largest rate of severe predictions.

    1.0 without groups or where no group has any; passes from four fifths on.
    """
    rates = rows.groupBy(group).agg(rounded(_share(_severe(pred))).alias("r"))
    out = rates.agg(F.max("r").alias("hi"), F.min("r").alias("lo"))
    quotient = F.when(F.coalesce("hi", F.lit(0.0)) == 0, 1.0).otherwise(F.col("lo") / F.col("hi"))
    return out.select(F.coalesce(rounded(F.col("hi") - F.col("lo")), F.lit(0.0)).alias("difference"), rounded(quotient).alias("ratio"), (rounded(quotient) >= 0.8).alias("passes"))


def macro_f1(rows: DataFrame, label: str = "y_true", pred: str = "y_pred") -> DataFrame:
    """Mean F1 over the classes that labels or predictions name; a class without hits has 0."""
    sides = F.array(F.struct(F.col(label).alias("class"), F.lit(1).alias("is_label")), F.struct(F.col(pred).alias("class"), F.lit(0).alias("is_label")))
    long = rows.select(F.explode(sides).alias("s"), (F.col(label) == F.col(pred)).alias("hit"))
    by = long.groupBy("s.class").agg(F.count_if(F.col("hit") & (F.col("s.is_label") == 1)).alias("tp"), F.count(F.lit(1)).alias("both"))
    return by.agg(rounded(F.avg(2 * F.col("tp") / F.col("both"))).alias("macro_f1"))


def worst_gated_recall(recalls: DataFrame, support: int = 20) -> DataFrame:
    """Least recall over groups with at least ``support`` severe rows; 1.0 without any."""
    return recalls.where(F.col("n_severe") >= support).agg(F.coalesce(F.min("recall"), F.lit(1.0)).alias("worst_recall"))


def shortfalls(recalls: DataFrame, support: int = 20, floor: float = 0.95, group: str = "grp") -> DataFrame:
    """Groups that a release gate stops at: enough severe rows, recall under the floor."""
    return recalls.where((F.col("n_severe") >= support) & (F.col("recall") < floor)).select(group, "recall", "n_severe")


def opportunity_thresholds(rows: DataFrame, p_severe: str = "p_severe", label: str = "y_true", pred: str = "y_pred", group: str = "grp", floor: int = 30, top: int = 99) -> DataFrame:
    """(group, threshold): the highest hundredth at which a trailing group reaches the best group's recall.

    A severe row counts as caught when it is predicted severe already or its severe
    probability reaches the threshold. Each severe row turns into the highest hundredth
    that catches it, so one histogram by group and hundredth replaces a search over the
    grid. Groups at the best recall, or without severe rows, have 1.0: never raise. Where
    no hundredth is low enough it is ``floor``.
    """
    now = _severe(pred) | (F.col(p_severe) >= 1.0)
    caught_at = F.when(now, F.lit(top)).otherwise(F.least(F.lit(top), F.floor(F.col(p_severe) * 100 + 1e-9).cast("int")))
    counted = rows.select(F.col(group), F.when(_severe(label), caught_at).alias("at"), (now & _severe(label)).cast("int").alias("now"))
    histogram = counted.groupBy(group, "at").agg(F.count("at").alias("n"), F.sum("now").alias("now"))
    by = histogram.groupBy(group).agg(F.sum("n").alias("n"), F.sum("now").alias("now"), F.collect_list(F.struct("at", "n")).alias("bins"))  # at most 100 bins a group
    share = F.col("now") / F.nullif("n", F.lit(0))
    best = by.agg(F.max(share).alias("best"))
    grid = F.sequence(F.lit(top), F.lit(floor), F.lit(-1))
    reached = lambda t: F.aggregate(F.filter("bins", lambda b: b["at"] >= t), F.lit(0).cast("long"), lambda s, b: s + b["n"]) / F.col("n") >= F.col("best") - 1e-12
    found = F.coalesce(F.get(F.filter(grid, reached), F.lit(0)), F.lit(floor)) / 100.0
    trailing = F.coalesce(share < F.col("best") - 1e-12, F.lit(False))
    return by.crossJoin(F.broadcast(best)).select(group, F.when(trailing, found).otherwise(1.0).alias("threshold"))  # one row


def raise_only(rows: DataFrame, thresholds: DataFrame, p_severe: str = "p_severe", pred: str = "y_pred", group: str = "grp", raise_to: int = 1) -> DataFrame:
    """Adds ``final``: a prediction that isn't severe becomes ``raise_to`` where the group's threshold is reached.

    Groups without a threshold count as 1.0. Thresholds are one row a group.
    """
    t = thresholds.select(F.col(group), F.col("threshold").alias("_t"))
    bound = F.coalesce(F.col("_t"), F.lit(1.0))
    return rows.join(t, group, "left").withColumn("final", F.when((F.col(pred) > SEVERE) & (F.col(p_severe) >= bound), F.lit(raise_to)).otherwise(F.col(pred))).drop("_t")


def sex_flips(probes: DataFrame, key: list[str], sex: str = "sex", pred: str = "y_pred") -> DataFrame:
    """(flip_rate, mean_delta, n) of probes that are scored once for each sex."""
    pairs = probes.groupBy(*key).pivot(sex, ["F", "M"]).agg(F.first(pred))
    delta = F.abs(F.col("F") - F.col("M"))
    return pairs.agg(rounded(F.avg((delta > 0).cast("double"))).alias("flip_rate"), rounded(F.avg(delta)).alias("mean_delta"), F.count(F.lit(1)).alias("n"))
