"""Tests of single columns against plain ones."""

import math
import random

from pyspark.sql import functions as F

from modelwatch.operators import drift


def distance(a, b):
    return max(abs(sum(x <= v for x in a) / len(a) - sum(x <= v for x in b) / len(b)) for v in {*a, *b})


def test_distances_equal_plain(spark):
    rng = random.Random(4)
    sides = {"ref": {"a": [rng.gauss(0, 1) for _ in range(300)], "b": [float(rng.randrange(3)) for _ in range(300)], "hot": [1.0] * 290 + [2.0] * 10}, "cur": {"a": [rng.gauss(0.4, 1) for _ in range(170)], "b": [float(rng.randrange(3)) for _ in range(170)], "hot": [1.0] * 100 + [0.0] * 70}}
    data = [(f, s, v) for s, of in sides.items() for f, vs in of.items() for v in vs]
    data += [("a", "ref", None), ("a", "cur", float("nan")), ("lone", "ref", 1.0), ("none", "ref", None)]
    got = {r["feature"]: r for r in drift.kolmogorov_smirnov(spark.createDataFrame(data, "feature string, side string, value double").repartition(6)).collect()}
    for f in "a", "b", "hot":
        assert abs(got[f]["statistic"] - distance(sides["ref"][f], sides["cur"][f])) < 1e-12
    assert (got["a"]["n_ref"], got["a"]["n_cur"]) == (300, 170)
    assert got["lone"]["statistic"] is None and "none" not in got


def test_tails(spark):
    # A chi-square variable of 2 degrees is exponential; of 1 the square of a normal one.
    assert abs(drift.chi_square_tail(3.0, 2) - math.exp(-1.5)) < 1e-12
    assert abs(drift.chi_square_tail(3.841458820694124, 1) - 0.05) < 1e-9
    assert abs(drift.chi_square_tail(11.070497693516351, 5) - 0.05) < 1e-9
    assert abs(drift.chi_square_tail(18.307038053275146, 10) - 0.05) < 1e-9
    assert drift.chi_square_tail(0.0, 3) == 1.0 and drift.chi_square_tail(None, 3) is None and drift.chi_square_tail(5.0, 0) == 1.0
    # Kolmogorov's distribution has 0.05 above 1.3581 in the limit.
    n = 10**8
    got = spark.range(1).select(drift.smirnov_tail(F.lit(1.3581 / math.sqrt(n / 2)), F.lit(n), F.lit(n)).alias("p"), drift.smirnov_tail(F.lit(0.0), F.lit(5), F.lit(5)).alias("one")).first()
    assert abs(got["p"] - 0.05) < 1e-4 and got["one"] == 1.0


def test_columns_and_correction(spark):
    rng = random.Random(6)
    data = [(i, "ref" if i < 400 else "cur", rng.gauss(0 if i < 400 else 2, 1), rng.gauss(0, 1), rng.choice("xyz"), "u" if i < 350 else "v", None) for i in range(700)]
    rows = spark.createDataFrame(data, "id long, side string, moved double, still double, level string, shifted string, empty double")
    got = {r["feature"]: r for r in drift.column_drift(rows, F.col("side"), ["moved", "still", "empty"], ["level", "shifted"]).collect()}
    assert {f for f, r in got.items() if r["drifted"]} == {"moved", "shifted"}
    tested = sorted((r["p_value"], f) for f, r in got.items() if r["p_value"] is not None)
    top = 0.0
    for i, (p, f) in enumerate(tested):
        top = max(top, min(1.0, p * (len(tested) - i)))
        assert abs(got[f]["adjusted"] - top) < 1e-12
    cells = {(v, s): sum(d[1] == s and d[5] == v for d in data) for v in "uv" for s in ("ref", "cur")}
    want = sum((o - e) ** 2 / e for (v, s), o in cells.items() for e in [(cells[v, "ref"] + cells[v, "cur"]) * (400 if s == "ref" else 300) / 700])
    assert abs(got["shifted"]["statistic"] - want) < 1e-9
    whole = drift.dataset_drift(drift.column_drift(rows, F.col("side"), ["moved", "still"], ["level", "shifted"])).first()
    assert (whole["datasetDrift"], whole["driftShare"], whole["driftedColumns"], whole["columns"]) == (True, 0.5, 2, 4)
    none = drift.dataset_drift(drift.column_drift(rows.limit(0), F.col("side"), ["moved"], ["level"])).first()
    assert (none["datasetDrift"], none["driftShare"], none["columns"]) == (False, 0.0, 0)
