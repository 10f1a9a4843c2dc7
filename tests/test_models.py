import numpy as np
import pytest
from pyspark.sql import functions as F

from modelwatch.operators import explain, models
from modelwatch.streaming import monitor


@pytest.fixture(scope="module")
def data(spark, tmp_path_factory):
    spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))
    u = lambda k: F.pmod(F.xxhash64("id", F.lit(k)), F.lit(2)).cast("double")
    df = spark.range(600).withColumn("x", F.array(u(1), u(2), u(3), (u(1) + u(2) + u(3)) / 6, F.lit(0.5), u(4)))
    return df.withColumn("y", F.when(F.col("x")[0] == 1, 0).when(F.col("x")[1] == 1, 2).otherwise(4)).cache()


def test_forest_blind_and_probes(spark, data):
    scorer, model = models.forest(data, trees=10, depth=5)
    blind = models.sex_blind(scorer, "id")
    out = models.predict(data, blind)
    assert out.where("y_pred = y").count() > 590 and model.featureImportances.size == 6
    base, _ = models.forest(data, trees=5, depth=5, width=5)
    assert models.predict(data, base).where("y_pred = y").count() > 590
    best = explain.best_flips(models.flips(data.limit(20), scorer, "id", 3), row="id").collect()
    assert best and {r["direction"] for r in best} <= {"up", "down"}
    dep = {r["value"]: r["p_severe"] for r in models.partial_dependence(data.limit(100), scorer, 0).collect()}
    assert dep[1.0] > dep[0.0] + 0.5


def test_calibrated(data):
    cal = models.isotonic(data, lambda d: models.forest(d, trees=5, depth=4)[0], "id")
    out = models.predict(data, cal)
    assert out.where("y_pred = y").count() > 590
    assert out.where(F.abs(F.aggregate("proba", F.lit(0.0), lambda s, v: s + v) - 1) > 1e-9).count() == 0


def test_surrogate(data):
    scorer, _ = models.forest(data, trees=10, depth=5)
    weights = models.local_surrogate(data.limit(2), scorer, "id", 3, perturbations=60).groupBy("feature_index").agg(F.avg("weight").alias("w")).collect()
    assert max(weights, key=lambda r: r["w"])["feature_index"] == 0


def test_novelty(spark):
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(i, [float(v) for v in rng.normal(size=3)]) for i in range(200)] + [(-1, [7.0, -7.0, 7.0])], "id long, x array<double>")
    trees = models.isolation_trees(df, "id", trees=40)
    got = {r["id"]: r["novelty"] for r in models.novelty(df, trees).collect()}
    assert max(got, key=got.get) == -1 and all(0 < v <= 1 for v in got.values())
    flagged = models.out_of_distribution(models.novelty(df, trees), F.col("id") != 5, 2.0)
    assert [r["id"] for r in flagged.where("ood").collect()] == [5]


def test_class_mix_stream(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([(f"2024-01-0{d} 00:10:00", "P1", 0.5) for d in range(1, 6)], "ts string, acuity string, confidence double").withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(src)
    stream = spark.readStream.schema("ts timestamp, acuity string, confidence double").parquet(src)
    q = monitor.each_batch(monitor.class_mix(stream), lambda b: b, str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4  # the last window waits for the watermark
