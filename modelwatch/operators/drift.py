"""Distances between a reference and a current distribution.

Features come in long form, (feature, side, value) with side ``ref`` or ``cur``, so
that one pass serves all features.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from modelwatch.functions.numbers import rounded
from modelwatch.functions.quantiles import exact_quantiles
from modelwatch.sources.shared import checkpoints

CLIP = 1e-6
THRESHOLD = 0.25


def _term(e: Column, a: Column) -> Column:
    e, a = F.greatest(e, F.lit(CLIP)), F.greatest(a, F.lit(CLIP))
    return (a - e) * F.ln(a / e)


def long_form(rows: DataFrame, side: Column, features: list[str]) -> DataFrame:
    """(feature, side, value) of wide rows."""
    cells = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features])).alias("c")
    return rows.select(side.alias("side"), cells).select("c.feature", "side", "c.value")


def feature_psi(long: DataFrame, places: int = 6) -> DataFrame:
    """(feature, psi).

    A feature with at most two distinct reference values compares the shares of these;
    what else the current side has is one more bucket. Others use the distinct edges of
    the reference's deciles: bins are half open, the last one closed, and values outside
    don't count. Edges are rounded to six places so that engines agree on ties.
    """
    ref = long.where(F.col("side") == "ref")
    deciles = exact_quantiles(ref, "feature", "value", [i / 10 for i in range(11)])
    edges = F.array_distinct(F.transform("quantiles", lambda q: rounded(q, 6)))
    bounds = deciles.select("feature", F.element_at("quantiles", 1).alias("lo"), F.element_at("quantiles", -1).alias("hi"), edges.alias("edges"))
    with_bounds = long.join(F.broadcast(bounds), "feature")  # one row a feature
    inside = (F.col("value") >= F.element_at("edges", 1)) & (F.col("value") <= F.element_at("edges", -1))
    last = F.size("edges")
    in_bin = F.when(inside, F.greatest(F.least(F.size(F.filter("edges", lambda e: e <= F.col("value"))), last - 1), F.lit(1)))
    level = F.when(F.col("value") == F.col("lo"), 1).when(F.col("value") == F.col("hi"), 2).otherwise(3)
    # One pass counts both by level and by bin; a third level of the reference tells which of them holds.
    binned = with_bounds.select("feature", "side", F.greatest(last - 1, F.lit(1)).alias("bins"), (F.col("lo") == F.col("hi")).alias("single"), in_bin.alias("bin"), level.alias("level"), ((F.col("value") > F.col("lo")) & (F.col("value") < F.col("hi"))).alias("between"))
    counts = binned.groupBy("feature", "bins", "single", "bin", "level").agg(F.count_if(F.col("side") == "ref").cast("double").alias("e"), F.count_if(F.col("side") == "cur").cast("double").alias("a"), F.count_if((F.col("side") == "ref") & F.col("between")).alias("between"))
    by = counts.groupBy("feature", "bins", "single").agg((F.sum("between") > 0).alias("many"), F.collect_list(F.struct("bin", "level", "e", "a")).alias("cells"))
    by = by.withColumn("cells", F.filter(F.transform("cells", lambda c: F.struct(F.when(F.col("many"), c["bin"]).otherwise(c["level"]).alias("bin"), c["e"].alias("e"), c["a"].alias("a"))), lambda c: c["bin"].isNotNull()))
    total = lambda cells, f: F.aggregate(cells, F.lit(0.0), lambda s, c: s + c[f])
    by = by.withColumns({"ne": F.greatest(total("cells", "e"), F.lit(1.0)), "na": F.greatest(total("cells", "a"), F.lit(1.0))})
    # Deciles with a single edge hold one point; both sides then have all of what counts.
    few = F.when(F.exists("cells", lambda c: c["bin"] == 3), F.array(F.lit(3))).otherwise(F.array().cast("array<int>"))
    spine = F.when(F.col("many"), F.sequence(F.lit(1), F.col("bins"))).otherwise(F.concat(F.sequence(F.lit(1), F.when(F.col("single"), 1).otherwise(2)), few))
    share = lambda b, f, n: total(F.filter("cells", lambda c: c["bin"] == b), f) / F.col(n)
    psi = F.aggregate(spine, F.lit(0.0), lambda s, b: s + _term(share(b, "e", "ne"), share(b, "a", "na")))
    return by.where(F.size("cells") > 0).select("feature", rounded(psi, places).alias("psi"))


def drift_detail(psis: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(max_psi, mean_psi, drifted, share, features): 0.0 and an empty list without features."""
    over = F.col("psi") >= threshold
    return psis.agg(
        F.coalesce(F.max("psi"), F.lit(0.0)).alias("max_psi"),
        F.coalesce(rounded(F.avg("psi")), F.lit(0.0)).alias("mean_psi"),
        F.count_if(over).alias("drifted"),
        F.coalesce(rounded(F.avg(over.cast("double"))), F.lit(0.0)).alias("share"),
        F.array_join(F.array_sort(F.collect_list(F.when(over, F.col("feature")))), ",").alias("features"),
    )


def target_drift(rows: DataFrame, side: str = "side", label: str = "y", classes: int = 5, name: str = "target_psi") -> DataFrame:
    """PSI of class shares; the denominators are all rows of a side, at least 1. Serves predictions as well."""
    sums = [F.count_if((F.col(side) == s) & (F.col(label) == k)).alias(f"{s}{k}") for s in ("ref", "cur") for k in range(classes)]
    totals = [F.greatest(F.count_if(F.col(side) == s), F.lit(1)).alias(s) for s in ("ref", "cur")]
    total = sum((_term(F.col(f"ref{k}") / F.col("ref"), F.col(f"cur{k}") / F.col("cur")) for k in range(classes)), F.lit(0.0))
    return rows.agg(*sums, *totals).select(rounded(total, 6).alias(name))


def concept_drift(rows: DataFrame, side: str = "side", label: str = "y_true", pred: str = "y_pred") -> DataFrame:
    """(reference, current, drop): how far accuracy fell, never under 0."""
    acc = lambda s: rounded(F.avg(F.when(F.col(side) == s, (F.col(label) == F.col(pred)).cast("double"))))
    return rows.agg(acc("ref").alias("reference_accuracy"), acc("cur").alias("current_accuracy")).withColumn("accuracy_drop", F.greatest(F.lit(0.0), rounded(F.col("reference_accuracy") - F.col("current_accuracy"))))


# -- tests of single columns ------------------------------------------------------------


def _sides(rows: DataFrame, *by: str) -> DataFrame:
    return rows.groupBy(*by).agg(*(F.count_if(F.col("side") == s).alias(s) for s in ("ref", "cur")))


def kolmogorov_smirnov(long: DataFrame) -> DataFrame:
    """(feature, statistic, n_ref, n_cur): the largest distance of the two sides' distribution functions.

    Nulls and NaN don't count; a side without values gives a null statistic. Equal values
    are counted first. The counts are dealt by ranges of (feature, value), so a sum before a
    value is that of the earlier ranges, a row each, and of the values before it in its own
    range: no task sorts a column, however long or uneven.
    """
    checkpoints(long.sparkSession)
    some = long.where(F.col("value").isNotNull() & ~F.isnan("value"))
    # Behind a checkpoint, as a range that is drawn anew may end elsewhere.
    dealt = _sides(some, "feature", "value").repartitionByRange("feature", "value").withColumn("part", F.spark_partition_id()).checkpoint()
    parts = dealt.groupBy("feature", "part").agg(*(F.sum(s).alias(f"{s}_part") for s in ("ref", "cur")))
    before = Window.partitionBy("feature").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("feature")
    starts = parts.select("feature", "part", *(F.coalesce(F.sum(f"{s}_part").over(before), F.lit(0)).alias(f"{s}_before") for s in ("ref", "cur")), *(F.sum(f"{s}_part").over(whole).alias(f"n_{s}") for s in ("ref", "cur")))
    upto = Window.partitionBy("feature", "part").orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    share = lambda s: (F.col(f"{s}_before") + F.sum(s).over(upto)) / F.nullif(F.col(f"n_{s}"), F.lit(0))
    apart = dealt.join(starts, ["feature", "part"]).select("feature", "n_ref", "n_cur", F.abs(share("ref") - share("cur")).alias("apart"))
    return apart.groupBy("feature").agg(F.max("apart").alias("statistic"), F.first("n_ref").alias("n_ref"), F.first("n_cur").alias("n_cur"))


def smirnov_tail(statistic: Column, n: Column, m: Column, terms: int = 100) -> Column:
    """The chance of a distance at least as large for equal distributions, in the limit of many rows with the usual correction for few."""
    n, m = n.cast("double"), m.cast("double")
    root = F.sqrt(n * m / F.nullif(n + m, F.lit(0.0)))
    x = (root + 0.12 + 0.11 / F.nullif(root, F.lit(0.0))) * statistic
    each = F.transform(F.sequence(F.lit(1), F.lit(terms)), lambda k: F.when(k % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2.0 * k * k * x * x))
    tail = F.aggregate(each, F.lit(0.0), lambda s, v: s + v)
    # Near 0 the series converges slowly; there the chance is 1 to twelve places.
    return F.when(x < 0.2, 1.0).when(x.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), tail)))


def chi_square_tail(x: float | None, degrees: int | None) -> float | None:
    """The chance of a chi-square variable of so many degrees over x: a finite sum, and for odd degrees a normal tail more."""
    if x is None or degrees is None:
        return None
    if degrees <= 0 or x <= 0:
        return 1.0
    half = x / 2
    power, total = (0.5, math.erfc(math.sqrt(half))) if degrees % 2 else (0.0, 0.0)
    while power < degrees / 2 - 1e-9:
        total += math.exp(power * math.log(half) - half - math.lgamma(power + 1))
        power += 1
    return min(1.0, total)


def chi_square(levels: DataFrame) -> DataFrame:
    """(feature, statistic, n_ref, n_cur, degrees) of (feature, side, value) with a text as value: are the levels' shares equal on both sides?

    A null is a level. A side without rows gives a null statistic, a single level 0.0.
    """
    counts = _sides(levels, "feature", "value").where("ref + cur > 0")
    totals = counts.groupBy("feature").agg(F.sum("ref").alias("n_ref"), F.sum("cur").alias("n_cur"), (F.count(F.lit(1)) - 1).cast("int").alias("degrees"))
    cells = counts.join(totals, "feature").withColumn("n", F.col("n_ref") + F.col("n_cur"))
    expected = lambda s: (F.col("ref") + F.col("cur")) * F.col(f"n_{s}") / F.col("n")
    part = lambda s: (F.col(s) - expected(s)) ** 2 / F.nullif(expected(s), F.lit(0.0))
    return cells.groupBy("feature").agg(F.sum(part("ref") + part("cur")).alias("statistic"), F.first("n_ref").alias("n_ref"), F.first("n_cur").alias("n_cur"), F.first("degrees").alias("degrees"))


def column_drift(rows: DataFrame, side: Column, numbers: list[str], levels: list[str] = (), alpha: float = 0.05, least: float = 0.0) -> DataFrame:
    """(feature, test, statistic, p_value, adjusted, drifted), a row a column.

    Numbers are held by Kolmogorov-Smirnov, levels by chi-square. ``adjusted`` is Holm's
    correction for the number of columns that can be tested. A column drifted if that is
    under ``alpha`` and its statistic ``least`` at least; one that can't be tested has nulls
    and did not.
    """
    found = []
    if numbers:
        ks = kolmogorov_smirnov(long_form(rows, side, list(numbers)))
        found.append(ks.select("feature", F.lit("ks").alias("test"), "statistic", smirnov_tail(F.col("statistic"), F.col("n_ref"), F.col("n_cur")).alias("p_value")))
    if levels:
        cells = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("string").alias("value")) for f in levels])).alias("c")
        chi = chi_square(rows.select(side.alias("side"), cells).select("c.feature", "side", "c.value"))
        tail = F.udf(lambda x, d: chi_square_tail(x, d), "double")  # of a row a column
        found.append(chi.select("feature", F.lit("chi2").alias("test"), "statistic", tail("statistic", "degrees").alias("p_value")))
    every = found[0] if len(found) == 1 else found[0].unionByName(found[1])
    # A row a column of the table: their order fits in one array.
    cell = F.struct("p_value", "feature", "test", "statistic")
    ranked = every.agg(F.array_sort(F.collect_list(F.when(F.col("p_value").isNotNull(), cell))).alias("r"), F.collect_list(F.when(F.col("p_value").isNull(), cell)).alias("rest"))
    scaled = F.transform("r", lambda x, i: F.least(F.lit(1.0), x["p_value"] * (F.size("r") - i)))
    tested = F.transform("r", lambda x, i: F.struct(x.alias("x"), F.array_max(F.slice("a", F.lit(1), i + 1)).alias("adjusted")))
    untested = F.transform("rest", lambda x: F.struct(x.alias("x"), F.lit(None).cast("double").alias("adjusted")))
    steps = ranked.withColumn("a", scaled).select(F.explode(F.concat(tested, untested)).alias("s"))
    drifted = F.coalesce((F.col("s.adjusted") < alpha) & (F.col("s.x.statistic") >= least), F.lit(False))
    return steps.select("s.x.feature", "s.x.test", "s.x.statistic", "s.x.p_value", "s.adjusted", drifted.alias("drifted"))


def dataset_drift(columns: DataFrame, share: float = 0.5) -> DataFrame:
    """(datasetDrift, driftShare, driftedColumns, columns) of ``column_drift``; 0.0 and no drift without columns."""
    part = F.coalesce(F.avg(F.col("drifted").cast("double")), F.lit(0.0))
    return columns.agg((part >= share).alias("datasetDrift"), rounded(part).alias("driftShare"), F.count_if("drifted").alias("driftedColumns"), F.count(F.lit(1)).alias("columns"))
