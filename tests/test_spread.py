"""Model work is dealt by rows, not by a file's row groups, and is done once for rows that a forest can't tell apart."""

import numpy as np
from pyspark.sql import functions as F

from modelwatch.operators import attack, attribution, models, scoring
from modelwatch.plans import catalogue, learned
from modelwatch.sources.shared import spread, stored


def test_rows_are_spread_in_order(spark):
    df = spark.range(100).coalesce(1).withColumn("v", -F.col("id"))
    out = spread(df, "id", each=30)
    parts = out.rdd.glom().collect()
    assert len(parts) == 4 and all(p == sorted(p) for p in parts) and sorted(r["id"] for p in parts for r in p) == list(range(100))
    assert spread(df, "id", each=100) is df
    assert sorted(map(tuple, stored(df, "t").collect())) == sorted(map(tuple, df.collect()))


def test_queries_do_not_work_in_one_task(spark, tmp_path):
    n = spark.range(70_000)
    n.select(F.col("id").alias("p_partkey"), F.pmod("id", F.lit(50)).alias("p_size")).coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    n.select(F.col("id").alias("c_custkey"), F.pmod("id", F.lit(25)).alias("c_nationkey"), F.pmod("id", F.lit(9000)).cast("double").alias("c_acctbal")).coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    for rows in (learned._cases(spark, str(tmp_path)), learned._balances(spark, str(tmp_path))):
        sizes = [r[0] for r in rows.groupBy(F.spark_partition_id()).count().select("count").collect()]
        assert len(sizes) == 3 and max(sizes) < 32_768
    assert catalogue.sex_flips(spark, str(tmp_path)).first()["n"] == 280_000


def test_cells_change_nothing(spark):
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(i, [float(v) for v in rng.integers(0, 6, 4)], int(rng.integers(0, 3))) for i in range(400)], "id long, x array<double>, y int")
    nodes = attribution.node_table(models.forest(df, trees=5, depth=4, leaf=1, weights=None)[1], f"{spark.sparkContext.getCheckpointDir() or '/tmp'}/spread-forest-{np.random.default_rng().integers(1 << 60)}")
    grove, paths = scoring.Grove.of(nodes.collect()), attribution.paths(nodes, 4)
    x = np.concatenate([rng.integers(-1, 8, (300, 4)) / 1.0, rng.uniform(-1, 7, (300, 4)), [[np.inf, -np.inf, 0.0, -0.0], [np.nan, 9.0, 9.0, 9.0], [9.0, 9.0, 9.0, 9.0]]])
    for _ in range(2):  # new cells, then known ones
        assert np.array_equal(grove.probabilities(x), grove._descended(x))
        phi = attribution.explained(x, paths)
        assert np.array_equal(phi, attribution._explained(x, paths)) and np.allclose(phi.sum(1) + paths.base, grove.probabilities(x))
    asked = []
    work = lambda rows: asked.append(len(rows)) or grove._descended(rows)
    small = attribution.Cells(dict(enumerate([{0.5}, {1.5, 2.5}])), most=3)
    a = np.array([[0.0, 0.0, 0, 0], [0.4, 1.0, 0, 0], [1.0, 0.0, 0, 0], [1.0, 3.0, 0, 0]])
    small.of(a, work), small.of(a[:2], work)
    assert asked == [3, 1]  # three cells don't fit beside the end mark, so each call works out its own
    large = attribution.Cells({f: set(range(1 << 16)) for f in range(4)})
    assert not large.numbered and np.array_equal(large.of(x, grove._descended), grove._descended(x))


def test_blind_scores_stay_where_the_rows_are(spark, tmp_path):
    rows = [(1, [0.5, 1.0]), (1, [0.25, 0.0]), (2, [1.0, 0.0]), (None, [1.0, 1.0])]
    spark.createDataFrame(rows, "id long, x array<double>").write.parquet(f"{tmp_path}/rows")
    df = spark.read.parquet(f"{tmp_path}/rows")
    scorer = lambda d: d.withColumn("proba", F.array(F.col("x")[0] * F.col("x")[1], 1 - F.col("x")[0] * F.col("x")[1]))
    out = models.sex_blind(scorer, "id")(df)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan
    assert sorted((r["id"], r["x"], r["proba"]) for r in out.collect()) == sorted((i, x, [x[0] / 2, 1 - x[0] / 2]) for i, x in rows if i is not None)


def test_trees_of_repeated_keys_are_whole(spark):
    df = spark.range(3000).select(F.lit(7).alias("id"), F.array(F.col("id").cast("double")).alias("x"))
    assert [len(x) for x in models.tree_rows(df, "id", 3, 64, 11)] == [64] * 3


def test_attack_in_other_batches(spark):
    df = spark.range(60).select("id", F.array(F.col("id") / 60, F.lit(0.5)).alias("x"))
    score = lambda p: np.column_stack([p[:, 0] <= 0.5, p[:, 0] > 0.5]).astype(float)
    one, two = (sorted(map(str, attack.attacked(df, score, "id", at_once=n).collect())) for n in (7, 1024))
    assert one == two


def test_agreement_has_small_tasks(spark, tmp_path):
    li = spark.range(600_000).select((F.col("id") / 4).cast("long").alias("l_orderkey"), (F.col("id") % 4).alias("l_linenumber"), (F.col("id") % 11 / 100).alias("l_discount"), (F.col("id") % 9 / 100).alias("l_tax"))
    li.coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    sizes = [r[0] for r in catalogue._attributions(spark, str(tmp_path)).groupBy(F.spark_partition_id()).count().select("count").collect()]
    assert sum(sizes) == 600_000 and len(sizes) == 3
    plan = catalogue.explanation_agreement(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
