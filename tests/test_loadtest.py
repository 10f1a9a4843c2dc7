import math

from modelwatch.operators import loadtest
from pyspark.sql import functions as F


def test_buckets(spark):
    xs = [*range(5000), *(2**k + d for k in range(7, 62) for d in (-1, 0, 1))]
    rows = spark.createDataFrame([(x,) for x in xs], "x bigint").select("x", loadtest.bucket(F.col("x")).alias("b")).withColumn("u", loadtest.upper(F.col("b")))
    got = sorted(map(tuple, rows.collect()))
    assert all(x <= u <= x + max(x // 64, 0) for x, _, u in got)
    assert all(b0 <= b1 and (b0 == b1) == (x1 <= u0) for (_, b0, u0), (x1, b1, _) in zip(got, got[1:]))
    assert max(b for _, b, _ in got) < 3776


def test_merging_is_one_sketch(spark, rows):
    n = 4000
    calls = spark.range(n).select((F.col("id") % 7).alias("run"), (F.col("id") % 2).alias("job"), F.pow(F.lit(1.003), F.col("id")).alias("seconds"), (F.col("id") % 50 == 0).alias("failed"), F.timestamp_seconds("id").alias("ts"))
    kept = loadtest.sketch(calls, ["run", "job"])
    whole, joined = loadtest.sketch(calls, ["job"]), loadtest.merged(kept, ["job"])
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, joined.collect()))
    exact = {j: sorted(1.003**i * 1000 for i in range(n) if i % 2 == j) for j in (0, 1)}
    for r in loadtest.percentiles(kept, ["job"], {"p50": 50, "p95": 95, "p99": 99}).collect():
        for p in (50, 95, 99):
            want = exact[r["job"]][math.ceil(len(exact[r["job"]]) * p / 100) - 1]
            assert want * 0.999999 - 0.001 <= r[f"p{p}"] <= want * 65 / 64 + 0.001


def test_verdicts(rows):
    at = F.timestamp_seconds("t").alias("ts")
    calls = rows([("good", 0.1, False, 0), ("good", 0.1, False, 10), ("slow", 9.0, False, 0), ("slow", 9.0, False, 1), ("bad", 0.1, True, 0), ("bad", None, None, 4), ("none", None, False, 0), ("none", None, False, 1), ("few", 0.1, False, 0)], "job string, seconds double, failed boolean, t int").select("job", "seconds", "failed", at)
    out = loadtest.verdicts(loadtest.sketch(calls, ["job"]), loadtest.merged_totals(loadtest.totals(calls, ["job"]), ["job"]), ["job"], p95_ms=500, fail_ratio=0.01, least=2)
    got = {r["job"]: (r["requests"], r["rps"], r["breaches"], r["verdict"]) for r in out.collect()}
    assert got == {"good": (2, 0.2, "", "PASS"), "slow": (2, 2.0, "p95", "REVIEW"), "bad": (2, 0.5, "failures", "REVIEW"), "none": (2, 2.0, "no latencies", "REVIEW"), "few": (1, None, "too few requests", "REVIEW")}
    assert out.where("false").count() == 0
    empty = calls.where("false")
    assert loadtest.verdicts(loadtest.sketch(empty, ["job"]), loadtest.merged_totals(loadtest.totals(empty, ["job"]), ["job"]), ["job"], 500, 0.01).count() == 0
