"""The build and the transformer: equal to the forests themselves, whole or not visible, one scan without actions."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from modelwatch.functions.numbers import argmax
from modelwatch.operators import attribution, models, scoring
from modelwatch.sources.shared import folder, read_text

FLAGS, NAMES = 3, ["fever", "cough", "rash", "count", "len", "sex"]
SETTINGS = scoring.Settings(FLAGS, trees=5, depth=4, leaf=2, folds=2, novelty_trees=20, novelty_sample=64)


def cases(spark, n=400):
    u = lambda k: F.pmod(F.xxhash64("id", F.lit(k)), F.lit(2)).cast("double")
    df = spark.range(n).withColumn("x", F.array(u(1), u(2), u(3), (u(1) + u(2) + u(3)) / 6, F.lit(0.5), u(4)))
    return df.withColumn("y", F.when(F.col("x")[0] == 1, 0).when(F.col("x")[1] == 1, 2).otherwise(4)).withColumn("grp", F.when(u(5) == 1, "a").otherwise("b"))


@pytest.fixture(scope="module")
def built(spark):
    root, rows = folder(spark, "built"), cases(spark).cache()
    return root, rows, scoring.build(rows, root, SETTINGS, NAMES)


def test_nodes_give_the_forests_probabilities(spark):
    rows = cases(spark, 200).cache()
    scorer, model = models.forest(rows, trees=6, depth=5, leaf=1)
    grove = scoring.Grove.of(attribution.node_table(model, folder(spark, "forest")).collect())
    for r in scorer(rows).select("x", "proba").collect():
        assert np.abs(grove.probabilities(np.array([r["x"]]))[0] - np.array(r["proba"])).max() < 1e-12


def test_scores(spark, built):
    root, rows, _ = built
    out = {r["id"]: r for r in scoring.Triage(root=root).transform(rows.select("id", "x", "grp")).collect()}
    truth = {r["id"]: r for r in rows.collect()}
    assert len(out) == 400 and sum(out[i]["y_pred"] == truth[i]["y"] for i in out) > 380
    model = scoring.load(spark, root)
    for i, r in list(out.items())[:40]:
        x = np.array(r["x"])
        assert abs(sum(r["proba"]) - 1) < 1e-9
        other = x.copy()
        other[-1] = 1 - x[-1]
        assert np.allclose(model.blind(np.array([x])), model.blind(np.array([other])))  # blind to the last entry
        assert r["evidence"] == [f for f in r["evidence"] if x[NAMES.index(f)] > 0.5] and len(r["evidence"]) <= 3
        assert all(-1 <= e["weight"] <= 1 for e in r["explanation"])
        assert (r["up"] is None) == (r["y_pred"] == 0) and (r["down"] is None) == (r["y_pred"] == 4)
        assert r["final"] == (1 if r["raised"] else r["y_pred"])
        best = []
        for k in range(FLAGS):  # each flag by hand
            moved = x.copy()
            moved[k] = 1 - moved[k]
            moved[FLAGS] = min(moved[:FLAGS].sum(), 6) / 6
            best.append(model.blind(np.array([moved]))[0])
        if r["up"]:
            assert r["up"]["feature_index"] == int(np.argmax([b[r["y_pred"] - 1] for b in best]))


def test_raise_only(spark, built):
    root, rows, _ = built
    triage = scoring.Triage(root=root)
    triage.model().thresholds = {"a": 0.0}
    out = triage.transform(rows.select("id", "x", "grp")).collect()
    assert all(r["final"] == (min(r["y_pred"], 1) if r["grp"] == "a" else r["y_pred"]) for r in out)
    assert all(r["confidence"] == (r["p_severe"] if r["raised"] else max(r["proba"])) for r in out) and any(r["raised"] for r in out)


def test_odd_rows(spark, built):
    root, _, _ = built
    odd = [(1, None, "a"), (2, [1.0], "a"), (3, [1.0, 0.0, 0.0, None, 0.5, 0.0], "a"), (4, [float("nan")] * 6, "a"), (5, [1.0, 0.0, 0.0, 1 / 6, 0.5, 0.0], None), (5, [1.0, 0.0, 0.0, 1 / 6, 0.5, 0.0], "new"), (6, [50.0, -40.0, 9.0, 9.0, 99.0, 7.0], "a")]
    triage = scoring.Triage(root=root)
    got = triage.transform(spark.createDataFrame(odd, "id long, x array<double>, grp string")).collect()
    assert [(r["id"], r["final"] is None, r["ood"]) for r in got if r["id"] < 5] == [(i, True, True) for i in range(1, 5)]
    assert [r["final"] for r in got if r["id"] == 5] == [0, 0] and next(r for r in got if r["id"] == 6)["novelty"] is not None
    assert triage.transform(spark.createDataFrame([], "id long, x array<double>, grp string")).collect() == []
    assert scoring.log_rows(triage.transform(spark.createDataFrame(odd, "id long, x array<double>, grp string"))).count() == 3
    assert scoring.probe(triage, [1.0, 0.0, 0.0, 1 / 6, 0.5, 0.0], "a")["final"] == 0
    assert scoring.probe(scoring.Triage(root=f"{root}-none"), [1.0] * 6, "a") is None


def test_one_scan_and_no_action(spark, built, tmp_path):
    root, rows, _ = built
    rows.select("id", "x", "grp").write.parquet(str(tmp_path / "rows"))
    triage = scoring.Triage(root=root)
    triage.model()
    group = "transform-only"
    spark.sparkContext.setJobGroup(group, "no job may start")
    out = triage.transform(spark.read.schema("id long, x array<double>, grp string").parquet(str(tmp_path / "rows")))
    assert spark.sparkContext.statusTracker().getJobIdsForGroup(group) == []
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan parquet") == 1 and "Exchange" not in plan
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    triage.write().overwrite().save(str(tmp_path / "stage"))
    again = scoring.Triage.load(str(tmp_path / "stage"))
    assert again.getOrDefault("root") == root and again.transform(rows.limit(3)).count() == 3


def test_build_is_whole_or_not_visible(spark, built, monkeypatch):
    root, rows, path = built
    before = read_text(spark, f"{root}/served.json")
    calls = []
    monkeypatch.setattr(scoring.models, "forest", lambda *a, **k: calls.append(1))
    assert scoring.build(rows.repartition(7), root, SETTINGS, NAMES) == path and not calls  # same rows and settings: nothing to do
    monkeypatch.undo()
    more = rows.union(rows.select(F.col("id") + 1000, "x", "y", "grp"))
    monkeypatch.setattr(scoring, "publish", lambda *a: (_ for _ in ()).throw(RuntimeError("killed")))
    with pytest.raises(RuntimeError):
        scoring.build(more, root, SETTINGS, NAMES)
    assert read_text(spark, f"{root}/served.json") == before  # tables are there, and nobody sees them
    assert scoring.load(spark, root).settings == SETTINGS
    monkeypatch.undo()
    second = scoring.build(more, root, SETTINGS, NAMES)
    assert second != path and json.loads(read_text(spark, f"{root}/served.json"))["version"] == second.rsplit("/", 1)[1]
    with pytest.raises(FileNotFoundError):
        scoring.load(spark, f"{root}/nowhere")


def test_curves_are_pools_of_adjacent_violators(spark):
    data = [(i, [p, 1 - p], y) for i, (p, y) in enumerate(zip([0.1, 0.2, 0.2, 0.3, 0.4, 0.5, 0.6, 0.6, 0.8, 0.9], [1, 0, 0, 1, 1, 0, 1, 0, 0, 0]))]
    df = spark.createDataFrame(data, "id long, proba array<double>, y int")
    pools = []
    for p in sorted({p for _, (p, _), _ in data}):
        ys = [float(y == 0) for _, (q, _), y in data if q == p]
        pools.append([sum(ys), len(ys), [p]])
        while len(pools) > 1 and pools[-2][0] / pools[-2][1] >= pools[-1][0] / pools[-1][1]:
            s, n, ps = pools.pop()
            pools[-1] = [pools[-1][0] + s, pools[-1][1] + n, pools[-1][2] + ps]
    want = {p: s / n for s, n, ps in pools for p in ps}
    xs, ys = models.curve(df, 0)
    assert all(abs(np.interp(p, xs, ys) - v) < 1e-12 for p, v in want.items())
    got = models.curved(df, [(xs, ys), ([0.0, 1.0], [0.0, 1.0])], "c").collect()
    assert all(abs(r["c"][0] - want[r["proba"][0]]) < 1e-12 and abs(r["c"][1] - r["proba"][1]) < 1e-12 for r in got)
