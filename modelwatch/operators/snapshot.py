"""Dataset snapshots: statistics, content hashes, validation, splits and samples.

Samples and splits follow a hash of the key, so they don't depend on partitions and a
lost executor's rows come out the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from modelwatch.functions.numbers import rounded


def balance(rows: DataFrame, by: str) -> DataFrame:
    return rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"))


def feature_statistics(rows: DataFrame, features: list[str], places: int = 6) -> DataFrame:
    """(feature, lo, hi, mean, std): population deviation; one pass over the columns, then a row a feature."""
    aggs = [f(F.col(c).cast("double")).alias(f"{i}_{n}") for i, c in enumerate(features) for n, f in (("lo", F.min), ("hi", F.max), ("mean", F.avg), ("std", F.stddev_pop))]
    wide = rows.agg(*aggs)
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), *(rounded(F.col(f"{i}_{n}"), places).alias(n) for n in ("lo", "hi", "mean", "std"))) for i, c in enumerate(features)])
    return wide.select(F.explode(cells).alias("s")).select("s.*")


def row_hash(*columns: str) -> Column:
    return F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), 256)


def content_hash(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(sha256, n): an identity of the rows as a multiset, whatever their order and partitions.

    The eight 32-bit words of each row's SHA-256 are summed up and the sums hashed: one
    aggregate of constant size a task, where sorting the hashes would move them all.
    """
    words = [F.conv(F.substring("h", 8 * i + 1, 8), 16, 10).cast("decimal(20,0)") for i in range(8)]
    sums = rows.select(row_hash(*columns).alias("h")).agg(*[F.coalesce(F.sum(w).cast("string"), F.lit("0")).alias(f"w{i}") for i, w in enumerate(words)], F.count(F.lit(1)).alias("n"))
    return sums.select(F.sha2(F.concat_ws("|", *[f"w{i}" for i in range(8)], F.col("n").cast("string")), 256).alias("sha256"), "n")


def version_id(data_hash: Column, config: str) -> Column:
    """First 12 hex digits of SHA-256 over data hash and configuration."""
    return F.left(F.sha2(F.concat(data_hash, F.lit("|" + config)), 256), F.lit(12))


def validation(rows: DataFrame, features: list[str], label: str = "y", classes: int = 5, least: int = 100, most: float = 0.6) -> DataFrame:
    """(ord, rule, passed) of the rules in order; empty data fails the class rules."""
    n = F.count(F.lit(1))
    finite = F.count_if(~_all(F.col(c).isNotNull() & ~F.isnan(F.col(c)) & (F.abs(F.col(c)) != float("inf")) for c in features))
    inside = F.count_if(~F.coalesce(_all(F.col(c).between(0.0, 1.0) for c in features), F.lit(False)))
    known = F.count_if(~F.coalesce(F.col(label).between(0, classes - 1), F.lit(False)))
    sizes = [F.count_if(F.col(label) == k) for k in range(classes)]
    wide = rows.agg(n.alias("n"), finite.alias("not_finite"), inside.alias("outside"), known.alias("unknown"), F.array(*sizes).alias("sizes"))
    rules = [
        ("finite", F.col("not_finite") == 0),
        ("in_unit_range", F.col("outside") == 0),
        ("known_labels", F.col("unknown") == 0),
        ("class_rows", F.array_min("sizes") >= least),
        ("class_share", (F.col("n") > 0) & (F.array_max("sizes") <= most * F.col("n"))),
    ]
    return wide.select(F.explode(F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(r).alias("rule"), p.alias("passed")) for i, (r, p) in enumerate(rules)])).alias("r")).select("r.*")


def _all(conditions) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def first_failure(rules: DataFrame) -> DataFrame:
    """(passed, failed_rule): the first rule in order that fails, null if all pass."""
    return rules.agg(F.bool_and("passed").alias("passed"), F.min_by(F.when(~F.col("passed"), F.col("rule")), F.when(~F.col("passed"), F.col("ord"))).alias("failed_rule"))


def ordering(key: str, seed: str) -> Column:
    """A pseudorandom order of keys that other engines can reproduce."""
    return F.md5(F.concat(F.lit(seed + ":"), F.col(key).cast("string")))


def _ranked(rows: DataFrame, key: str, stratum: str, seed: str) -> DataFrame:
    """Adds ``_rank``, 0-based within the stratum in the hash order.

    Strata are few and large, so no window sorts one: keys fall into buckets by the
    first three digits of the hash, a small table of bucket counts gives each bucket's
    start, and ranks are counted within buckets.
    """
    marked = rows.withColumn("_o", ordering(key, seed)).withColumn("_b", F.left("_o", F.lit(3)))
    sizes = marked.groupBy(stratum, "_b").agg(F.count(F.lit(1)).alias("_n"))
    start = sizes.withColumn("_start", F.coalesce(F.sum("_n").over(Window.partitionBy(stratum).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    at = F.row_number().over(Window.partitionBy(stratum, "_b").orderBy("_o", key)) - 1
    return marked.withColumn("_at", at).join(start, [stratum, "_b"]).withColumn("_rank", F.col("_at") + F.col("_start")).drop("_o", "_b", "_at", "_start")


def stratified_split(rows: DataFrame, key: str, stratum: str, test_percent: int = 25, seed: str = "split") -> DataFrame:
    """Adds ``part``: test for the rounded share of each stratum, train for the rest."""
    sizes = rows.groupBy(stratum).agg(F.count(F.lit(1)).alias("_all"))
    cut = F.floor((F.col("_all") * test_percent * 2 + 100) / 200)
    return _ranked(rows, key, stratum, seed).join(sizes, stratum).withColumn("part", F.when(F.col("_rank") < cut, "test").otherwise("train")).drop("_rank", "_all")


def stratified_folds(rows: DataFrame, key: str, stratum: str, folds: int = 5, seed: str = "fold") -> DataFrame:
    """Adds ``fold``: each stratum dealt round robin in the hash order."""
    return _ranked(rows, key, stratum, seed).withColumn("fold", F.pmod("_rank", F.lit(folds)).cast("int")).drop("_rank")


def oversample(rows: DataFrame, key: str, stratum: str, seed: str = "over") -> DataFrame:
    """Adds ``copy``: every row once (0), and rows of smaller strata again until all are as large as the largest.

    A row of rank r in a stratum of n rows with d rows missing comes ceil((d - r) / n)
    more times: as many as a walk round the stratum would give it.
    """
    sizes = rows.groupBy(stratum).agg(F.count(F.lit(1)).alias("_n"))
    most = sizes.agg(F.max("_n").alias("_most"))
    lacking = sizes.crossJoin(F.broadcast(most)).select(stratum, "_n", (F.col("_most") - F.col("_n")).alias("_d"))  # one row
    more = F.greatest(F.lit(0), F.ceil((F.col("_d") - F.col("_rank")) / F.col("_n"))).cast("int")
    return _ranked(rows, key, stratum, seed).join(lacking, stratum).withColumn("copy", F.explode(F.sequence(F.lit(0), more))).drop("_rank", "_n", "_d")


def sample_rows(rows: DataFrame, key: str, n: int, seed: str = "sample") -> DataFrame:
    """``n`` rows without replacement, those first in the hash order."""
    return rows.orderBy(ordering(key, seed), key).limit(n)


def flip_labels(rows: DataFrame, key: str, percent: int, label: str = "y", to: int = 4, severe: int = 1, seed: str = "flip") -> DataFrame:
    """Adds ``poisoned``: ``percent`` of the severe labels, by hash, become ``to``."""
    chosen = (F.col(label) <= severe) & (F.pmod(F.conv(F.left(ordering(key, seed), F.lit(7)), 16, 10).cast("int"), F.lit(100)) < percent)
    return rows.withColumn("poisoned", F.when(chosen, F.lit(to)).otherwise(F.col(label)))
