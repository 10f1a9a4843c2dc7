"""Every isolation tree has rows of its own, from the whole table."""

import numpy as np
from pyspark.sql import functions as F

from modelwatch.operators import models
from modelwatch.plans import learned

DATA = "/root/testdata/sf0.001"


def test_rows_of_trees(spark):
    df = spark.range(6000).select("id", F.array(F.col("id").cast("double"), F.lit(1.0)).alias("x")).repartition(5)
    got = models.tree_rows(df, "id", 40, 256, 11)
    hashes = {r["id"]: r["h"] for r in df.select("id", F.xxhash64(F.lit(11), "id").alias("h")).collect()}
    ids = np.array(sorted(hashes))
    for t, x in enumerate(got):
        v = models._draws(np.array([hashes[i] for i in ids]), t, 11)
        assert sorted(x[:, 0]) == sorted(ids[np.argsort(v)[:256]])
    assert len({v for x in got for v in x[:, 0]}) > 256 * 16
    assert [len(x) for x in models.tree_rows(df.limit(100), "id", 3, 256, 11)] == [100] * 3
    assert models.isolation_trees(df.limit(0), "id", trees=3) == []


def test_query_has_the_operators_trees(spark, monkeypatch):
    made, whole = [], models.isolation_trees
    monkeypatch.setattr(models, "isolation_trees", lambda *a, **k: made.append(whole(*a, **k)) or made[-1])
    assert learned.novelty(spark, DATA).count() > 0 and len(made[0]) == 200
