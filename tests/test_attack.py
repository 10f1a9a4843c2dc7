"""The boundary attack on models whose boundary is known."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from modelwatch.operators import attack


def _step():
    """Class 1 where the first entry is over 0.5; made here, so that workers get it with the task."""

    def step(x):
        return np.column_stack([x[:, 0] <= 0.5, x[:, 0] > 0.5]).astype(float)

    return step


step = _step()


@pytest.fixture
def rows(spark):
    return spark.range(60).select("id", F.array(F.col("id") / 60.0, F.lit(0.3), F.lit(0.9)).alias("x"), (F.col("id") > 30).cast("int").alias("y"), F.lit("k").alias("g"))


def test_flips_lie_in_the_ball_at_the_boundary(rows):
    how = attack.Search()
    out = attack.attacked(rows, step, "id", how).collect()
    assert len(out) == 60
    for r in out:
        x, gap = np.array(r["x"]), abs(r["id"] / 60 - 0.5)
        assert r["scorings"] <= how.scorings
        if r["adversarial"] is None:
            assert gap > 0.1  # what is near the boundary is found
            continue
        z = np.array(r["adversarial"])
        assert step(z[None]).argmax() != r["y_pred"] and np.abs(z - x).max() <= 0.25 + 1e-12 and ((z >= 0) & (z <= 1)).all()
        assert gap <= r["distance"] <= gap + 0.02 and abs(r["distance"] - np.abs(z - x).max()) < 1e-12
    assert all(r["adversarial"] is None for r in out if abs(r["id"] / 60 - 0.5) > 0.25)


def test_same_whatever_the_partitions(rows):
    a, b = ({r["id"]: r["adversarial"] for r in attack.attacked(rows.repartition(n), step, "id", at_once=k).collect()} for n, k in ((1, 256), (5, 7)))
    assert a == b


def test_accuracy_and_hardening(rows):
    out = attack.attacked(rows, step, "id").cache()
    got = attack.robust_accuracy(out).first()
    right = [r for r in out.collect() if r["y"] == r["y_pred"]]
    assert got["accuracy"] == 1.0 and got["robust_accuracy"] == pytest.approx(sum(r["adversarial"] is None for r in right) / 60, abs=1e-4)
    more = attack.hardened_rows(out, "id").collect()
    assert len(more) == 60 + got["flipped"] and all((r["x"][0] > 0.5) != (r["y"] == 1) for r in more[60:])
    flat = attack.robust_accuracy(attack.attacked(rows, lambda x: np.tile([1.0, 0.0], (len(x), 1)), "id")).first()
    assert flat["flipped"] == 0 and flat["robust_accuracy"] == flat["accuracy"] and flat["mean_distance"] is None


def test_odd_rows(spark):
    kind = "id long, x array<double>, y int"
    odd = spark.createDataFrame([(1, None, 0), (2, [], 0), (3, [0.1, None], 0), (4, [float("inf"), 0.0], 0), (5, [0.45, 0.2], 0), (5, [0.45, 0.2], 0), (None, [0.9, 0.1], None), (7, [3.0, -2.0], 1)], kind)
    got = attack.attacked(odd, step, "id").collect()
    assert [r["y_pred"] for r in got] == [None] * 4 + [0, 0, 1, 1]
    assert got[4]["adversarial"] == got[5]["adversarial"] and got[4]["adversarial"] is not None
    assert attack.attacked(odd.limit(0), step, "id").collect() == []
    assert attack.robust_accuracy(attack.attacked(odd.limit(0), step, "id")).first()["accuracy"] is None
