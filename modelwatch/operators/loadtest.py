"""Load tests: latencies as sketches that are kept and merged, and what service objectives say of them.

A sketch is rows (keys, bucket, n). A latency of x microseconds falls into the bucket of its
leading 7 bits, so a bucket's bounds differ by less than one part in 64 and a sketch has at most
3,776 rows however long the run was. Sketches of runs, hours or tasks merge by adding counts:
percentiles over many runs read their sketches, not the calls. Counts don't depend on the
order of rows, so a task that runs again gives the same sketch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from modelwatch.functions.numbers import rounded

BITS = 6


def bucket(micros: Column) -> Column:
    """The bucket of a number of microseconds; negative ones count as 0."""
    x = F.greatest(micros.cast("long"), F.lit(0))
    e = F.length(F.bin(x)) - 1
    wide = (e - BITS + 1) * (1 << BITS) + F.call_function("shiftright", x, e - BITS).cast("int") - (1 << BITS)
    return F.when(x < (1 << BITS), x.cast("int")).otherwise(wide).cast("int")


def upper(b: Column) -> Column:
    """The largest number of microseconds of a bucket."""
    shift = F.greatest(F.floor(b / (1 << BITS)).cast("int") - 1, F.lit(0))
    head = F.when(b < 2 << BITS, b).otherwise(F.pmod(b, F.lit(1 << BITS)) + (1 << BITS)).cast("long")
    return F.call_function("shiftleft", head + 1, shift) - 1


def sketch(calls: DataFrame, by: list[str], seconds: str = "seconds") -> DataFrame:
    """(by, bucket, n); calls without a latency are in no bucket."""
    rows = calls.where(F.col(seconds).isNotNull() & ~F.isnan(F.col(seconds).cast("double")))
    return rows.groupBy(*by, bucket(F.round(F.col(seconds) * 1_000_000)).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def totals(calls: DataFrame, by: list[str], failed: str = "failed", at: str = "ts") -> DataFrame:
    """(by, requests, failures, first, last), which merge as the sketches do; a null ``failed`` counts as a failure."""
    return calls.groupBy(*by).agg(F.count(F.lit(1)).alias("requests"), F.count_if(F.coalesce(F.col(failed), F.lit(True))).alias("failures"), F.min(at).alias("first"), F.max(at).alias("last"))


def merged(sketches: DataFrame, by: list[str]) -> DataFrame:
    return sketches.groupBy(*by, "bucket").agg(F.sum("n").alias("n"))


def merged_totals(parts: DataFrame, by: list[str]) -> DataFrame:
    """Adds up ``totals``; ``seconds`` is the time that the parts took, without the gaps between them."""
    at = lambda c: F.col(c).cast("timestamp").cast("double")
    took = at("last") - at("first")
    return parts.groupBy(*by).agg(F.sum("requests").alias("requests"), F.sum("failures").alias("failures"), F.sum(took).alias("seconds"))


def percentiles(sketches: DataFrame, by: list[str], shares: dict[str, int]) -> DataFrame:
    """(by, a column of milliseconds a share): the upper bound of the bucket in which a percentage of the calls is reached.

    At most 1/64 above the exact one. A group's buckets are at most 3,776 rows, so its window is small.
    """
    run = merged(sketches, by)
    before = F.sum("n").over(Window.partitionBy(*by).orderBy("bucket"))
    seen = run.withColumns({"_seen": before, "_all": F.sum("n").over(Window.partitionBy(*by))})
    reached = [F.min(F.when(F.col("_seen") * 100 >= F.col("_all") * p, F.col("bucket"))).alias(name) for name, p in shares.items()]
    return seen.groupBy(*by).agg(*reached).select(*by, *[(upper(F.col(n)) / 1000.0).alias(n) for n in shares])


def verdicts(sketches: DataFrame, sums: DataFrame, by: list[str], p95_ms: float, fail_ratio: float, least: int = 1) -> DataFrame:
    """(by, requests, p50_ms, p95_ms, p99_ms, rps, fail_ratio, breaches, verdict).

    PASS without a breach, else REVIEW. Fewer than ``least`` requests or no latency at all are
    breaches of their own: a load test that didn't load anything is no evidence.
    """
    out = sums.join(percentiles(sketches, by, {"p50_ms": 50, "p95_ms": 95, "p99_ms": 99}), by, "left")
    out = out.withColumns({"rps": rounded(F.when(F.col("seconds") > 0, F.col("requests") / F.col("seconds")), 4), "fail_ratio": rounded(F.when(F.col("requests") > 0, F.col("failures") / F.col("requests")), 6)})
    said = F.array(
        F.when(F.col("requests") < least, "too few requests"),
        F.when(F.col("p95_ms").isNull(), "no latencies").when(F.col("p95_ms") > p95_ms, "p95"),
        F.when(F.coalesce(F.col("fail_ratio"), F.lit(1.0)) > fail_ratio, "failures"),
    )
    out = out.withColumn("breaches", F.array_join(F.array_compact(said), ","))
    return out.select(*by, "requests", "p50_ms", "p95_ms", "p99_ms", "rps", "fail_ratio", "breaches", F.when(F.col("breaches") == "", "PASS").otherwise("REVIEW").alias("verdict"))
