"""Attributions against the definition, over all subsets of features, and against the forest's own probabilities."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from modelwatch.operators import attribution, explain, models
from modelwatch.sources.shared import folder

WIDTH = 12


@pytest.fixture(scope="module")
def forest(spark):
    cells = [(F.pmod(F.xxhash64("id", F.lit(i)), F.lit(3 + i)) / (2.0 + i)).alias(f"f{i}") for i in range(WIDTH)]
    df = spark.range(500).select("id", F.array(*cells).alias("x"))
    df = df.withColumn("y", F.when(F.col("x")[0] + F.col("x")[3] > 1, 0).when(F.col("x")[1] > 0.5, 1).when(F.col("x")[2] * F.col("x")[5] > 0.4, 2).otherwise(4)).cache()
    scorer, model = models.forest(df, trees=7, depth=6, leaf=2)
    nodes = attribution.node_table(model, folder(spark, "forest")).cache()
    return df, scorer, nodes


def by_subsets(nodes, x):
    """Each feature's mean gain over all orders, from the trees' conditional means; every subset of 12 features is looked at."""
    trees = {}
    for r in nodes:
        trees.setdefault(r["tree"], {})[r["node"]] = r

    def mean(tree, at, known):
        r = tree[at]
        if r["left"] < 0:
            return np.array(r["stats"]) / sum(r["stats"])
        if r["feature"] in known:
            return mean(tree, r["left"] if x[r["feature"]] <= r["threshold"] else r["right"], known)
        sides = [(sum(tree[k]["stats"]), mean(tree, k, known)) for k in (r["left"], r["right"])]
        return sum(n * v for n, v in sides) / sum(n for n, _ in sides)

    value = {s: sum(mean(t, 0, s) for t in trees.values()) / len(trees) for k in range(WIDTH + 1) for s in map(frozenset, itertools.combinations(range(WIDTH), k))}
    out = []
    for i in range(WIDTH):
        out.append(sum(math.factorial(len(s)) * math.factorial(WIDTH - 1 - len(s)) / math.factorial(WIDTH) * (value[s | {i}] - v) for s, v in value.items() if i not in s))
    return np.array(out), value[frozenset()]


def test_equal_to_the_definition(forest):
    df, _, nodes = forest
    rows, found = nodes.collect(), attribution.paths(nodes, WIDTH)
    for r in df.orderBy("id").limit(2).collect():
        phi, base = by_subsets(rows, r["x"])
        assert np.abs(found.base - base).max() < 1e-12
        assert np.abs(attribution.explained(np.array([r["x"]]), found)[0] - phi).max() < 1e-9


def test_sum_to_the_prediction(forest):
    df, scorer, nodes = forest
    found = attribution.paths(nodes, WIDTH)
    out = scorer(attribution.attributed(df, found)).select("phi", "proba").collect()
    assert len(out) == 500
    for r in out:
        assert np.abs(np.array(r["phi"]).sum(0) + found.base - np.array(r["proba"])).max() < 1e-9
    # A feature that no tree splits on gets nothing.
    unused = set(range(WIDTH)) - {int(r["feature"]) for r in nodes.where("left >= 0").collect()}
    assert all(not np.array(r["phi"])[list(unused)].any() for r in out)


def test_odd_rows_and_top(spark, forest):
    df, _, nodes = forest
    found = attribution.paths(nodes, WIDTH)
    odd = spark.createDataFrame([(1, None), (2, [0.5] * 11), (3, [0.5] * 11 + [None]), (4, [0.5] * 12), (4, [0.5] * 12)], "id long, x array<double>")
    got = sorted((r["id"], r["phi"] is None) for r in attribution.attributed(odd, found).collect())
    assert got == [(1, True), (2, True), (3, True), (4, False), (4, False)]
    assert attribution.attributed(odd.limit(0), found).collect() == []
    long = attribution.long_form(attribution.attributed(df.limit(5), found), "id")
    top = explain.top_contributions(long, row="id", feature="feature_index", k=3).collect()
    assert top and all(1 <= r["rank"] <= 3 for r in top)
    by = {}
    for r in top:
        by.setdefault(r["id"], []).append((r["rank"], abs(r["value"])))
    assert all([v for _, v in sorted(vs)] == sorted((v for _, v in vs), reverse=True) for vs in by.values())


def test_a_stump_by_hand(spark):
    """One split at 0.5 of feature 1, three rows of four to the left, pure leaves: the feature gets all."""
    nodes = spark.createDataFrame([(0, 0, 1, 2, 1, 0.5, [3.0, 1.0]), (0, 1, -1, -1, -1, None, [3.0, 0.0]), (0, 2, -1, -1, -1, None, [0.0, 1.0])], attribution._NODES)
    found = attribution.paths(nodes, 3)
    assert found.base.tolist() == [0.75, 0.25]
    assert np.allclose(attribution.explained(np.array([[9.0, 0.5, 9.0], [9.0, 0.6, 9.0]]), found), [[[0, 0], [0.25, -0.25], [0, 0]], [[0, 0], [-0.75, 0.75], [0, 0]]])
