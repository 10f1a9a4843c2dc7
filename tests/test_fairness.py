from modelwatch.operators import calibration, drift, fairness

SCHEMA = "y_true int, y_pred int, grp string"


def _one(df):
    return df.first().asDict()


def test_equalized_odds(rows):
    df = rows(list(zip([0, 1, 2, 3, 0, 1, 2, 3], [0, 1, 2, 3, 0, 1, 0, 1], "FFFFMMMM")), SCHEMA)
    assert _one(fairness.equalized_odds(df)) == {"tpr_gap": 0.0, "fpr_gap": 1.0, "equalized_odds": 1.0}
    assert _one(fairness.gap(fairness.equal_opportunity(df), "tpr"))["gap"] == 0.0


def test_disparate_impact(rows):
    df = rows([(2, 1 if i < 1 else 3, "F") for i in range(10)] + [(2, 1 if i < 3 else 3, "M") for i in range(10)], SCHEMA)
    assert _one(fairness.disparate_impact(df)) == {"difference": 0.2, "ratio": 0.3333, "passes": False}
    same = rows([(0, p, g) for g in "FM" for p in (0, 2, 2, 2)], SCHEMA)
    assert _one(fairness.disparate_impact(same)) == {"difference": 0.0, "ratio": 1.0, "passes": True}
    assert _one(fairness.disparate_impact(rows([], SCHEMA))) == {"difference": 0.0, "ratio": 1.0, "passes": True}


def test_red_flag_recall(rows):
    assert _one(fairness.red_flag_recall(rows([(y, y, "a") for y in range(5)], SCHEMA)))["red_flag_recall"] == 1.0
    missed = rows([(y, p, "a") for y, p in zip(range(5), (2, 2, 2, 3, 4))], SCHEMA)
    assert _one(fairness.red_flag_recall(missed))["red_flag_recall"] == 0.0
    none = rows([(3, 3, "a")], SCHEMA)
    assert _one(fairness.red_flag_recall(none))["red_flag_recall"] == 1.0
    assert _one(fairness.subgroup_red_flag_recall(none))["recall"] is None


def test_subgroup_accuracy_and_gap(rows):
    df = rows(list(zip([0, 0, 1, 1, 2, 2], [0, 1, 1, 1, 2, 2], "AAABBB")), SCHEMA)
    by = {r["grp"]: (r["accuracy"], r["n"]) for r in fairness.subgroup_accuracy(df).collect()}
    assert by == {"A": (0.6667, 3), "B": (1.0, 3)}
    assert _one(fairness.gap(fairness.subgroup_accuracy(df), "accuracy"))["gap"] == 0.3333
    assert _one(fairness.gap(fairness.subgroup_accuracy(rows([], SCHEMA)), "accuracy"))["gap"] == 0.0


def _psi(rows, ref, cur):
    long = rows([("f", "ref", float(v)) for v in ref] + [("f", "cur", float(v)) for v in cur], "feature string, side string, value double")
    return drift.feature_psi(long).first()["psi"]


def test_psi_levels(rows):
    assert _psi(rows, [0] * 95 + [1] * 5, [0] * 5 + [1] * 95) > 0.25
    assert _psi(rows, [0] * 50, [0] * 50) < 1e-6
    assert _psi(rows, [0] * 50, [1] * 50) > 0.25


def test_psi_quantiles(rows):
    import numpy as np

    x = np.random.default_rng(0).normal(size=800)
    assert abs(_psi(rows, x, x)) < 1e-6
    assert _psi(rows, x, x + 2) > 0.1
    edges = np.unique(np.round(np.quantile(x, np.linspace(0, 1, 11)), 6))
    cur = x * 1.3
    e, a = (np.histogram(v, edges)[0] / max(1, np.histogram(v, edges)[0].sum()) for v in (x, cur))
    e, a = np.maximum(e, 1e-6), np.maximum(a, 1e-6)
    assert abs(_psi(rows, x, cur) - ((a - e) * np.log(a / e)).sum()) < 2e-6


def test_drift_detail(rows):
    psis = rows([("a", 0.01), ("b", 0.4)], "feature string, psi double")
    assert _one(drift.drift_detail(psis)) == {"max_psi": 0.4, "mean_psi": 0.205, "drifted": 1, "share": 0.5, "features": "b"}
    assert _one(drift.drift_detail(psis.limit(0)))["max_psi"] == 0.0


def test_concept_drift(rows):
    df = rows([(0, int(i >= 9), "ref") for i in range(10)] + [(0, int(i >= 8), "cur") for i in range(10)], "y_true int, y_pred int, side string")
    assert _one(drift.concept_drift(df))["accuracy_drop"] == 0.1


def test_calibration(rows):
    df = rows([(0, [0.9, 0.1]), (1, [0.9, 0.1])], "y_true int, proba array<double>")
    assert _one(calibration.expected_calibration_error(df))["ece"] == 0.4
    assert _one(calibration.brier(df))["brier"] == 0.82


def test_exact_quantiles_by_narrowing(spark):
    import numpy as np

    from modelwatch.functions.quantiles import exact_quantiles

    rng = np.random.default_rng(1)
    data = {"normal": rng.normal(size=3000), "levels": rng.integers(0, 4, 2000).astype(float), "skewed": np.exp(rng.normal(0, 4, 3000)), "one": np.array([3.0]), "same": np.full(50, 2.5)}
    df = spark.createDataFrame([(k, float(v)) for k, x in data.items() for v in x] + [("none", None), ("normal", None), ("normal", float("nan"))], "f string, v double")
    qs = [i / 10 for i in range(11)]
    for few in (10**6, 100, 0):
        got = {r["f"]: r["quantiles"] for r in exact_quantiles(df, "f", "v", qs, bins=16, few=few).collect()}
        assert set(got) == set(data)
        for k, x in data.items():
            assert np.allclose(got[k], np.quantile(x, qs), rtol=1e-12, atol=0)
    assert exact_quantiles(df.limit(0), "f", "v", qs).count() == 0
