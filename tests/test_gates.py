import pytest

from modelwatch.operators import gates

AUDIT = "accuracy double, red_flag_recall double, shortfalls int, gap_before double, gap_after double, ece double, agreement double, eo_gap_after double"
HEALTHY = [0.9, 0.99, 0, 0.5, 0.14, 0.02, 0.9, 0.03]


@pytest.mark.parametrize(
    ("at", "value", "failed"),
    [(None, None, None), (1, 0.5, "red_flag_recall"), (4, 0.6, "gap_widened"), (4, 0.45, "gap_ceiling"), (5, 0.2, "ece"), (5, None, "ece"), (2, None, "subgroup_recall"), (0, 0.7, "accuracy")],
)
def test_release_gate(rows, at, value, failed):
    audit = list(HEALTHY)
    if at is not None:
        audit[at] = value
    out = gates.release_gate(rows([tuple(audit)], AUDIT)).first()
    assert (out["passed"], out["failed"]) == (failed is None, failed)


METRICS = "backend string, dataDriftPSI double, driftShare double, targetDriftPSI double, referenceAccuracy double, currentAccuracy double"


@pytest.mark.parametrize(
    ("row", "breached", "reason", "retrain"),
    [
        (("builtin", 0.30, None, None, None, None), True, "above threshold", "triggered"),
        (("builtin", 0.10, None, None, None, None), False, "below threshold", "not_needed"),
        (("builtin", None, None, 0.8, None, None), True, "drift metric unavailable", "not_attempted"),
        (("builtin", 0.01, None, 0.80, None, None), True, "below threshold", "triggered"),
        (("builtin", 0.01, None, None, 0.91, 0.55), True, "below threshold", "triggered"),
        (("builtin", 0.07, None, 0.11, 0.9145, 0.8855), False, "below threshold", "not_needed"),
        (("evidently", None, 0.6, None, None, None), True, "above threshold", "triggered"),
    ],
)
def test_drift_gate(rows, row, breached, reason, retrain):
    out = gates.retrain_decision(gates.drift_gate(rows([row], METRICS))).first()
    assert (out["breached"], out["reason"], out["retrain"]) == (breached, reason, retrain)


def test_retrain_reason_names_what_breached(rows):
    out = gates.drift_gate(rows([("builtin", 0.01, None, 0.8, 0.9, 0.5)], METRICS)).first()
    assert out["retrain_reason"] == "drift:targetDriftPSI=0.8,accuracyDrop=0.4"


STEP = "step int, errorRate double, toolFailureRate double"


def test_canary_steps(rows):
    df = rows([(5, 0.001, 0.001), (6, 0.02, 0.0), (7, 0.0, 0.05), (8, None, 0.0), (9, None, None), (10, 0.01, 0.02)], STEP)
    assert [r["verdict"] for r in gates.canary_steps(df).orderBy("step").collect()] == ["PROCEED", "ABORT", "ABORT", "ABORT", "ABORT", "PROCEED"]


def test_canary_ramp_stops_at_the_first_breach(rows):
    df = rows([(5, 0.0, 0.0), (25, 0.0, 0.0), (50, 0.5, 0.0), (100, 0.0, 0.0)], STEP)
    assert [r["step"] for r in gates.canary_ramp(df).collect()] == [5, 25, 50]


def test_digest(rows):
    df = rows([(1, "a", "failed", True), (1, "b", "success", None), (2, "a", "failed", None), (3, None, None, None)], "run int, name string, status string, allow_failure boolean")
    assert {r["run"]: r["verdict"] for r in gates.pipeline_digest(df).collect()} == {1: "PASSED", 2: "FAILED", 3: "UNKNOWN"}


def test_promotion(rows):
    versions = rows([("1", "passed"), ("2", "passed"), ("3", "failed")], "version string, release_gate string")
    aliases = rows([("champion", "1"), ("challenger", "2")], "alias string, version string")
    assert dict(map(tuple, gates.promote(versions, aliases).collect())) == {"champion": "2", "challenger": "2", "previous": "1"}
    with pytest.raises(ValueError, match="gate"):
        gates.promote(versions, aliases, "3")


def test_lineage_and_baseline(rows):
    one, two, none = rows([("a",)], "sha256 string"), rows([("b",)], "sha256 string"), rows([], "sha256 string")
    assert gates.lineage(one, one, one).first()["intact"] and not gates.lineage(one, two, one).first()["intact"] and not gates.lineage(none, none, none).first()["intact"]
    assert [gates.reproducible(a, one).first()["status"] for a in (one, two, none)] == ["match", "mismatch", "no_baseline"]
