"""Gates and decision rules over small metric tables.

What is absent never counts as clean: each rule says what a missing value means.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from modelwatch.functions.numbers import rounded


def release_gate(audits: DataFrame, *keys: str) -> DataFrame:
    """(keys, passed, failed) of each audit: the first failed rule in order, or null.

    Columns: accuracy, red_flag_recall, shortfalls, gap_before, gap_after, ece, agreement,
    eo_gap_after. Missing values fail.
    """
    absent = lambda ok: F.coalesce(ok, F.lit(False))
    rules = [
        ("accuracy", absent(F.col("accuracy") >= 0.75)),
        ("red_flag_recall", absent(F.col("red_flag_recall") >= 0.95)),
        ("subgroup_recall", absent(F.col("shortfalls") == 0)),
        ("gap_widened", absent(F.col("gap_after") <= F.col("gap_before") + 1e-9)),
        ("gap_ceiling", absent(F.col("gap_after") <= 0.35)),
        ("ece", absent(F.col("ece") <= 0.05)),
        ("agreement", absent(F.col("agreement") >= 0.75)),
        ("eo_gap", absent(F.col("eo_gap_after") <= 0.10)),
    ]
    failed = F.filter(F.array(*[F.when(~ok, F.lit(name)) for name, ok in rules]), lambda x: x.isNotNull())
    return audits.select(*keys, (F.size(failed) == 0).alias("passed"), F.get(failed, F.lit(0)).alias("failed"))


def drift_gate(metrics: DataFrame, threshold: float = 0.25, share_threshold: float = 0.5, target_threshold: float = 0.25, drop_threshold: float = 0.10) -> DataFrame:
    """Adds breached, reason, signals and retrain_reason to rows of drift metrics.

    The headline is driftShare for the backend ``evidently``, else dataDriftPSI; a
    missing headline is a breach without signals. Target drift and accuracy drop, where
    missing, are not breaches. ``reason`` speaks of the headline only; retrain_reason names
    the signals that breached, or else the headline.
    """
    shares = F.coalesce(F.col("backend") == "evidently", F.lit(False))
    value = F.when(shares, F.col("driftShare")).otherwise(F.col("dataDriftPSI"))
    name = F.when(shares, F.lit("driftShare")).otherwise(F.lit("dataDriftPSI"))
    bound = F.when(shares, F.lit(share_threshold)).otherwise(F.lit(threshold))
    drop = F.col("referenceAccuracy") - F.col("currentAccuracy")
    known = value.isNotNull()
    signal = lambda n, v, b: F.struct(n.alias("metric"), rounded(v).alias("value"), F.coalesce(v >= b, F.lit(False)).alias("breached"))
    signals = F.when(known, F.array(signal(name, value, bound), signal(F.lit("targetDriftPSI"), F.col("targetDriftPSI"), F.lit(target_threshold)), signal(F.lit("accuracyDrop"), drop, F.lit(drop_threshold)))).otherwise(F.array().cast("array<struct<metric:string,value:double,breached:boolean>>"))
    out = metrics.withColumn("signals", signals)
    over = F.filter("signals", lambda s: s["breached"])
    named = F.when(F.size(over) > 0, over).otherwise(F.slice("signals", 1, 1))
    text = F.array_join(F.transform(named, lambda s: F.concat(s["metric"], F.lit("="), s["value"].cast("string"))), ",")
    return out.withColumns({
        "breached": ~known | (F.size(over) > 0),
        "reason": F.when(~known, "drift metric unavailable").when(value >= bound, "above threshold").otherwise("below threshold"),
        "retrain_reason": F.when(known, F.concat(F.lit("drift:"), text)),
    })


def retrain_decision(gate: DataFrame, triggered_by_retrain: bool = False) -> DataFrame:
    """Adds ``retrain``: not_attempted where drift is unmeasured, skipped inside a retrain, triggered or not_needed."""
    decision = F.when(F.col("reason") == "drift metric unavailable", "not_attempted").when(F.col("breached") & F.lit(triggered_by_retrain), "skipped").when(F.col("breached"), "triggered").otherwise("not_needed")
    return gate.withColumn("retrain", decision)


def canary_steps(metrics: DataFrame, error: float = 0.01, tool: float = 0.02) -> DataFrame:
    """Adds ``breaches``, what is missing or over its bound, and ``verdict``: ABORT with breaches, else PROCEED."""
    parts = [F.when(F.col(m).isNull(), F.lit(f"{m} missing")).when(F.col(m) > bound, F.concat(F.lit(f"{m} "), F.col(m).cast("string"), F.lit(f" > {bound}"))) for m, bound in (("errorRate", error), ("toolFailureRate", tool))]
    out = metrics.withColumn("breaches", F.filter(F.array(*parts), lambda b: b.isNotNull()))
    return out.withColumn("verdict", F.when(F.size("breaches") > 0, "ABORT").otherwise("PROCEED"))


def canary_ramp(metrics: DataFrame, ramp: str | None = None) -> DataFrame:
    """Steps up to and including the first ABORT, of each ramp (a ramp has few steps)."""
    steps = canary_steps(metrics)
    by = Window.partitionBy(ramp) if ramp else Window.partitionBy()
    before = by.orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    return steps.withColumn("_b", F.coalesce(F.sum((F.col("verdict") == "ABORT").cast("int")).over(before), F.lit(0))).where("_b = 0").drop("_b")


def champion_challenger(pairs: DataFrame, slack: float = 0.005) -> DataFrame:
    """Adds ``promoted``: the candidate is within ``slack`` of the champion on both metrics; no champion passes."""
    holds = lambda m: F.coalesce(F.col(f"candidate_{m}") >= F.col(f"champion_{m}") - slack, F.col(f"champion_{m}").isNull())
    return pairs.withColumn("promoted", holds("accuracy") & holds("recall"))


def pipeline_digest(jobs: DataFrame, run: str = "run") -> DataFrame:
    """(run, verdict, total, blocking, tolerated): failures that aren't allowed block; jobs without status are unknown."""
    failed, allowed = F.col("status") == "failed", F.coalesce("allow_failure", F.lit(False))
    blocking, tolerated = F.count_if(failed & ~allowed), F.count_if(failed & allowed)
    n = F.count("name")
    return jobs.groupBy(run).agg(n.alias("total"), blocking.alias("blocking"), tolerated.alias("tolerated")).withColumn("verdict", F.when(F.col("total") == 0, "UNKNOWN").when(F.col("blocking") > 0, "FAILED").otherwise("PASSED"))


def status_counts(jobs: DataFrame, run: str = "run") -> DataFrame:
    return jobs.groupBy(run, F.coalesce("status", F.lit("unknown")).alias("status")).agg(F.count(F.lit(1)).alias("n"))


def stage_for(passed: Column) -> Column:
    return F.when(passed, "Staging").otherwise("Development")


def version_tags(versions: DataFrame, passed: Column) -> DataFrame:
    """Adds what a registered version says of itself: stage, release_gate, and its metrics with four places.

    Columns accuracy, red_flag_recall and ece become text; hashes and names stay as they are.
    """
    four = lambda c: F.format_string("%.4f", F.col(c))
    return versions.withColumns({
        "stage": stage_for(passed),
        "release_gate": F.when(passed, "passed").otherwise("failed"),
        "overall_accuracy": F.when(F.col("accuracy").isNotNull(), four("accuracy")),
        "red_flag_recall": F.when(F.col("red_flag_recall").isNotNull(), four("red_flag_recall")),
        "calibration_ece": F.when(F.col("ece").isNotNull(), four("ece")),
    })


def pointer_gate(pointers: DataFrame) -> DataFrame:
    """Adds ``passed``: the committed pointer's text is the regenerated one's; a missing one fails."""
    return pointers.withColumn("passed", F.coalesce(F.col("committed") == F.col("current"), F.lit(False)))


def lineage(committed: DataFrame, regenerated: DataFrame, model: DataFrame) -> DataFrame:
    """(intact): three one-row frames with the same ``sha256``; a missing row is not intact."""
    one = lambda df, name: df.agg(F.max("sha256").alias(name))
    rows = one(committed, "a").crossJoin(one(regenerated, "b")).crossJoin(one(model, "c"))  # one row each
    return rows.select(F.coalesce((F.col("a") == F.col("b")) & (F.col("b") == F.col("c")), F.lit(False)).alias("intact"))


def reproducible(recorded: DataFrame, regenerated: DataFrame) -> DataFrame:
    """(status): match, mismatch, or no_baseline where nothing was recorded yet."""
    rows = recorded.agg(F.max("sha256").alias("a")).crossJoin(regenerated.agg(F.max("sha256").alias("b")))
    return rows.select(F.when(F.col("a").isNull(), "no_baseline").when(F.col("a") == F.col("b"), "match").otherwise("mismatch").alias("status"))


def promote(versions: DataFrame, aliases: DataFrame, version: str | None = None) -> DataFrame:
    """The alias table after a promotion of ``version`` (the challenger by default): champion moves.

    Raises where there is no such version or its gate failed.
    """
    spark: SparkSession = versions.sparkSession
    named = {r["alias"]: r["version"] for r in aliases.collect()}  # a handful
    target = version or named.get("challenger")
    row = versions.where(F.col("version") == target).limit(1).collect() if target else []
    if not row:
        raise ValueError("no version is staged for promotion")
    if row[0]["release_gate"] == "failed":
        raise ValueError(f"version {target} failed its release gate")
    before = named.get("champion")
    after = named | {"champion": target} | ({"previous": before} if before and before != target else {})
    return spark.createDataFrame(sorted(after.items()), "alias string, version string")


def newest_version(versions: DataFrame, run: str = "run_id") -> DataFrame:
    """(run, version): the numerically largest version."""
    return versions.groupBy(run).agg(F.max_by("version", F.col("version").cast("int")).alias("version"))
