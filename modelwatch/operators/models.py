"""Classifiers over feature vectors: training, calibration, blind scoring and probing on ``pyspark.ml``."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from multiprocessing.pool import ThreadPool

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modelwatch.functions.numbers import argmax, rounded
from modelwatch.functions.quantiles import exact_quantiles
from modelwatch.operators.fairness import SEVERE
from modelwatch.operators.snapshot import ordering, stratified_folds
from modelwatch.sources.shared import spread, stored

#: A scorer adds ``proba`` (array<double>) to rows that have ``x`` (array<double>).
Scorer = Callable[[DataFrame], DataFrame]
CLASS_WEIGHTS = (2.0, 2.0, 1.0, 1.0, 1.0)


def forest(rows: DataFrame, label: str = "y", trees: int = 200, leaf: int = 5, depth: int = 15, weights: tuple[float, ...] | None = CLASS_WEIGHTS, width: int | None = None, seed: int = 42) -> tuple[Scorer, object]:
    """(scorer, model): a forest on ``x``; ``width``: on its first entries only, as a baseline without demographics."""
    vec = lambda df: df.withColumn("_v", array_to_vector(F.slice("x", 1, width) if width else F.col("x")))
    data = vec(rows).withColumn("_y", F.col(label).cast("double"))
    data = data.withColumn("_w", F.element_at(F.array(*map(F.lit, weights)), F.col(label).cast("int") + 1) if weights else F.lit(1.0))
    model = RandomForestClassifier(featuresCol="_v", labelCol="_y", weightCol="_w", numTrees=trees, minInstancesPerNode=leaf, maxDepth=depth, seed=seed).fit(data)

    def scorer(df: DataFrame) -> DataFrame:
        out = model.setPredictionCol("_p").setRawPredictionCol("_r").setProbabilityCol("_q").transform(vec(df))
        return out.withColumn("proba", vector_to_array("_q")).drop("_v", "_p", "_r", "_q")

    return scorer, model


def curve(held: DataFrame, c: int, grid: int = 10_000, label: str = "y") -> tuple[list[float], list[float]]:
    """The isotonic curve of class c over rows with ``proba``: its points and their values.

    Chances are counted at ``grid`` + 1 points, so neither the fit nor the curve grows with
    the rows.
    """
    p = F.round(F.get("proba", F.lit(c)) * grid) / grid
    points = held.groupBy(p.alias("f")).agg(F.avg((F.col(label) == c).cast("double")).alias("t"), F.count(F.lit(1)).cast("double").alias("w"))
    m = IsotonicRegression(featuresCol="f", labelCol="t", weightCol="w").fit(points)
    return [float(v) for v in m.boundaries.toArray()], [float(v) for v in m.predictions.toArray()]


def curved(df: DataFrame, curves: list[tuple[list[float], list[float]]], name: str) -> DataFrame:
    """Adds ``name``: ``proba`` with each class on its curve, straight between two points; a binary search a value, in Arrow."""
    import pyarrow as pa

    known = df.sparkSession.sparkContext.broadcast([tuple(map(np.array, c)) for c in curves])  # grid + 1 points each

    def run(batches):
        for b in batches:
            raw = np.array(b.column(b.schema.names.index("proba")).to_pylist(), float).reshape(b.num_rows, len(known.value))
            out = np.column_stack([np.interp(raw[:, c], *xy) for c, xy in enumerate(known.value)])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out.tolist(), pa.list_(pa.float64()))], names=[*b.schema.names, name])

    return df.mapInArrow(run, df.withColumn(name, F.lit(None).cast("array<double>")).schema)


def isotonic(rows: DataFrame, train: Callable[[DataFrame], Scorer], key: str, label: str = "y", classes: int = 5, folds: int = 3, grid: int = 10_000) -> Scorer:
    """A calibrated scorer: for each fold a model on the others and a curve per class on it; means, renormalised."""
    dealt = stored(spread(stratified_folds(rows, key, label, folds), key), "folds")
    parts: list[tuple[Scorer, list[tuple[list[float], list[float]]]]] = []
    for k in range(folds):
        scorer = train(dealt.where(F.col("fold") != k))
        held = stored(scorer(dealt.where(F.col("fold") == k)).select("proba", label), f"held{k}")
        parts.append((scorer, [curve(held, c, grid, label) for c in range(classes)]))

    def calibrated(df: DataFrame) -> DataFrame:
        out, names = df, []
        for k, (scorer, curves) in enumerate(parts):
            out = curved(scorer(out), curves, f"_c{k}").drop("proba")
            names.append(f"_c{k}")
        total = F.array(*[sum((F.get(n, F.lit(c)) for n in names), F.lit(0.0)) for c in range(classes)])
        whole = F.aggregate("_t", F.lit(0.0), lambda s, v: s + v)
        return out.withColumn("_t", total).withColumn("proba", F.when(whole > 0, F.transform("_t", lambda v: v / whole)).otherwise(F.array_repeat(F.lit(1.0 / classes), classes))).drop("_t", *names)

    return calibrated


def cross_validated(rows: DataFrame, train: Callable[[DataFrame], Scorer], key: str, group: str = "grp", label: str = "y", folds: int = 5, jobs: int = 2) -> DataFrame:
    """(fold, n, accuracy, red_flag_recall, gap) of a model a fold, fitted to the other folds and judged on its own.

    Folds are dealt once, within classes, into a table that all fits read; ``jobs`` of them
    run at a time, and one grouped pass over (fold, group) judges them all. ``gap`` is that
    of the groups' accuracies; recall is 1.0 in a fold without severe rows. Rows without a
    label take no part. ``explain.cross_validation`` sums up each value.
    """
    dealt = stratified_folds(rows.where(F.col(label).isNotNull()), key, label, folds).checkpoint()

    def fitted(k: int) -> Scorer:
        return train(dealt.where(F.col("fold") != k).drop("fold"))

    with ThreadPool(jobs) as pool:
        scorers = pool.map(inheritable_thread_target(rows.sparkSession)(fitted), range(folds))
    judged = reduce(DataFrame.unionByName, [predict(dealt.where(F.col("fold") == k), s).select("fold", group, label, "y_pred") for k, s in enumerate(scorers)])
    severe, raised = F.col(label) <= SEVERE, F.col("y_pred") <= SEVERE
    by = judged.groupBy("fold", group).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(label) == F.col("y_pred")).alias("hits"), F.count_if(severe).alias("severe"), F.count_if(severe & raised).alias("caught"))
    each = rounded(F.col("hits") / F.col("n"))
    return by.groupBy("fold").agg(
        F.sum("n").alias("n"),
        rounded(F.sum("hits") / F.sum("n")).alias("accuracy"),
        F.coalesce(rounded(F.try_divide(F.sum("caught"), F.sum("severe"))), F.lit(1.0)).alias("red_flag_recall"),
        rounded(F.max(each) - F.min(each)).alias("gap"),
    )


def sex_blind(scorer: Scorer, key: str) -> Scorer:
    """Mean of the probabilities with the last entry of ``x`` at 0 and at 1.

    Every row is answered by its own ``x``, also where ``key`` repeats, and scored twice where
    it lies: nothing is shuffled, and no side of a join can be sent to all. Rows without
    ``key`` take no part.
    """

    def scored(df: DataFrame) -> DataFrame:
        out = df.where(F.col(key).isNotNull()).withColumn("_x", F.col("x"))
        for value, name in ((0.0, "_a"), (1.0, "_b")):
            out = scorer(out.withColumn("x", F.concat(F.slice("_x", F.lit(1), F.size("_x") - 1), F.array(F.lit(value))))).withColumnRenamed("proba", name)
        return out.withColumn("x", F.col("_x")).withColumn("proba", F.zip_with("_a", "_b", lambda a, b: (a + b) / 2)).drop("_x", "_a", "_b")

    return scored


def predict(rows: DataFrame, scorer: Scorer) -> DataFrame:
    """Adds proba, y_pred (first maximum), confidence (three places) and p_severe."""
    out = scorer(rows)
    return out.withColumns({"y_pred": argmax(F.col("proba")), "confidence": rounded(F.array_max("proba"), 3), "p_severe": F.get("proba", F.lit(0)) + F.get("proba", F.lit(1))})


def flips(rows: DataFrame, scorer: Scorer, key: str, n_flags: int) -> DataFrame:
    """(key, feature_index, direction, p): each flag of each row toggled once, the count kept in step, and scored.

    direction is ``up`` towards the next more severe class and ``down`` towards the next
    milder one; p is that class's probability. ``n_flags`` neighbours a row.
    """
    base = predict(rows, scorer).select(key, "x", F.col("y_pred").alias("_now"))
    each = base.withColumn("feature_index", F.explode(F.sequence(F.lit(0), F.lit(n_flags - 1))))
    flags = F.transform(F.slice("x", 1, n_flags), lambda v, i: F.when(i == F.col("feature_index"), 1 - v).otherwise(v))
    each = each.withColumn("_f", flags)
    count = F.least(F.aggregate("_f", F.lit(0.0), lambda s, v: s + v), F.lit(6.0)) / 6
    moved = each.withColumn("x", F.concat("_f", F.array(count), F.slice("x", F.lit(n_flags + 2), F.size("x")))).drop("_f")
    scored = scorer(moved)
    sides = F.array(F.struct(F.lit("up").alias("d"), (F.col("_now") - 1).alias("c")), F.struct(F.lit("down").alias("d"), (F.col("_now") + 1).alias("c")))
    return scored.withColumn("_s", F.explode(sides)).where((F.col("_s.c") >= 0) & (F.col("_s.c") < F.size("proba"))).select(key, "feature_index", F.col("_s.d").alias("direction"), F.get("proba", F.col("_s.c")).alias("p"))


def partial_dependence(rows: DataFrame, scorer: Scorer, feature: int, levels: int = 5) -> DataFrame:
    """(value, p_severe): mean severe probability with one entry of ``x`` set to each grid value.

    The grid has the observed values if there are ``levels`` at most, else as many quantiles.
    """
    v = F.get("x", F.lit(feature))
    few = [r[0] for r in rows.select(v.alias("v")).distinct().orderBy("v").limit(levels + 1).collect()]
    if len(few) > levels:
        few = exact_quantiles(rows.select(F.lit(feature).alias("feature"), v.alias("value")), "feature", "value", [i / (levels - 1) for i in range(levels)]).first()["quantiles"]
    grid = rows.withColumn("value", F.explode(F.array(*map(F.lit, sorted(set(few))))))
    moved = grid.withColumn("x", F.concat(F.slice("x", 1, feature) if feature else F.array().cast("array<double>"), F.array("value"), F.slice("x", F.lit(feature + 2), F.size("x"))))
    return scorer(moved).groupBy("value").agg(rounded(F.avg(F.get("proba", F.lit(0)) + F.get("proba", F.lit(1)))).alias("p_severe"))


def local_surrogate(instances: DataFrame, scorer: Scorer, key: str, n_flags: int, perturbations: int = 1000, seed: int = 7) -> DataFrame:
    """(key, feature_index, weight): a weighted ridge fit around each instance's flags.

    Perturbations flip flags by draws from hashes; Spark scores them, and one small solve
    an instance runs grouped in Python.
    """
    width = 0.75 * float(np.sqrt(n_flags))
    active = F.aggregate(F.slice("x", 1, n_flags), F.lit(0.0), lambda s, v: s + v)
    p = F.least(F.lit(0.5), 2 / F.greatest(active, F.lit(1.0)))
    each = instances.select(key, "x").withColumn("_flip", p).withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(perturbations - 1))))
    draw = lambda j: F.pmod(F.xxhash64(F.lit(seed), F.col(key), F.col("_i"), j), F.lit(1 << 20)) / float(1 << 20)
    flags = F.transform(F.slice("x", 1, n_flags), lambda v, j: F.when((F.col("_i") > 0) & (draw(j) < F.col("_flip")), 1 - v).otherwise(v))
    each = each.withColumn("_f", flags)
    changed = F.aggregate(F.zip_with("_f", F.slice("x", 1, n_flags), lambda a, b: (a != b).cast("double")), F.lit(0.0), lambda s, v: s + v)
    count = F.least(F.aggregate("_f", F.lit(0.0), lambda s, v: s + v), F.lit(6.0)) / 6
    moved = each.withColumn("_h", changed).withColumn("x", F.concat("_f", F.array(count), F.slice("x", F.lit(n_flags + 2), F.size("x"))))
    scored = scorer(moved).select(key, F.col("_f").alias("flags"), F.exp(-(F.col("_h") ** 2) / width**2).alias("w"), (F.get("proba", F.lit(0)) + F.get("proba", F.lit(1))).alias("p"))
    kind = dict(instances.dtypes)[key]

    def solve(pdf):
        import pandas as pd

        a = np.column_stack([np.ones(len(pdf)), np.stack(pdf["flags"].to_numpy())])
        w = pdf["w"].to_numpy()[:, None]
        ridge = 1e-2 * np.eye(a.shape[1])
        ridge[0, 0] = 0
        beta = np.linalg.solve((a * w).T @ a + ridge, (a * w).T @ pdf["p"].to_numpy())
        return pd.DataFrame({key: pdf[key].iloc[0], "feature_index": np.arange(n_flags), "weight": beta[1:]})

    return scored.groupBy(key).applyInPandas(solve, f"{key} {kind}, feature_index int, weight double")


def _draws(h: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """A hash of (seed, tree, key) from each key's hash; 63 bits."""
    mask = (1 << 64) - 1
    z = h.view(np.uint64) ^ np.uint64((seed * 0xD6E8FEB86659FD93 + (tree + 1) * 0x9E3779B97F4A7C15) & mask)
    for m in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB):
        z = (z ^ (z >> np.uint64(29))) * np.uint64(m)
    return ((z ^ (z >> np.uint64(32))) >> np.uint64(1)).astype(np.int64)


def tree_rows(rows: DataFrame, key: str, trees: int, sample: int, seed: int) -> list[np.ndarray]:
    """For each tree the ``x`` of the ``sample`` rows with the smallest hashes of (tree, key).

    The rows are counted first, and hashes so large that they are hardly among the smallest
    stay where they are; if that leaves a tree short, as with keys that repeat, all are looked
    at again. So the tasks together send little more than ``trees`` x ``sample`` rows on, and
    the driver gets as many.
    """
    import pyarrow as pa
    from pyspark.sql import Window

    schema = pa.schema([("tree", pa.int32()), ("v", pa.int64()), ("x", pa.list_(pa.float64()))])

    def run(batches, limit):
        best = [(np.zeros(0, np.int64), None)] * trees
        for b in batches:
            if not b.num_rows:
                continue
            x, h = np.array(b.column("x").to_pylist(), dtype=float).reshape(b.num_rows, -1), b.column("h").to_numpy()
            for t in range(trees):
                v, (had, kept) = _draws(h, t, seed), best[t]
                near = np.flatnonzero(v < had.max() if len(had) == sample else v <= limit)
                if len(near) > sample:
                    near = near[np.argpartition(v[near], sample - 1)[:sample]]
                if len(near):
                    v, rows_ = np.append(had, v[near]), x[near] if kept is None else np.concatenate([kept, x[near]])
                    first = np.argsort(v, kind="stable")[:sample]
                    best[t] = v[first], rows_[first]
        for t, (v, kept) in enumerate(best):
            if len(v):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), t, np.int32)), pa.array(v), pa.array(kept.tolist(), pa.list_(pa.float64()))], schema=schema)

    hashed = rows.select(F.xxhash64(F.lit(seed), key).alias("h"), F.col("x").cast("array<double>").alias("x"))
    rank = F.row_number().over(Window.partitionBy("tree").orderBy("v", "x"))
    n, top = hashed.count(), (1 << 63) - 1
    likely = (sample + 10 * sample**0.5 + 50) / max(1, n)
    for limit in dict.fromkeys((min(top, int(likely * top)), top)):
        near = hashed.mapInArrow(lambda batches, limit=limit: run(batches, limit), "tree int, v long, x array<double>")
        out = [[] for _ in range(trees)]
        for r in sorted((r["tree"], r["v"], r["x"]) for r in near.withColumn("_rank", rank).where(F.col("_rank") <= sample).collect()):
            out[r[0]].append(r[2])
        if all(len(o) == min(sample, n) for o in out):
            break
    return [np.array(o, dtype=float) for o in out]


def isolation_trees(rows: DataFrame, key: str, trees: int = 200, sample: int = 256, seed: int = 11) -> list[list]:
    """Isolation trees, each from ``sample`` rows of its own (``tree_rows``); a node is [feature, split, left, right] or [size]."""
    rng, out = np.random.default_rng(seed), []

    def grow(rows_: np.ndarray, depth: int, limit: int) -> list:
        spread = np.flatnonzero(rows_.max(0) > rows_.min(0)) if len(rows_) else []
        if depth >= limit or len(rows_) <= 1 or not len(spread):
            return [len(rows_)]
        f = int(rng.choice(spread))
        cut = float(rng.uniform(rows_[:, f].min(), rows_[:, f].max()))
        low = rows_[:, f] < cut
        return [f, cut, grow(rows_[low], depth + 1, limit), grow(rows_[~low], depth + 1, limit)]

    for x in tree_rows(rows, key, trees, sample, seed):
        if len(x):
            out.append(grow(x, 0, int(np.ceil(np.log2(max(2, len(x)))))))
    return out


def novelties(x: np.ndarray, trees: list[list], sample: int = 256) -> np.ndarray:
    """For each row of x a number in (0, 1], near 1 where trees isolate it early."""

    def usual(n: float) -> float:
        return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n

    def depths(node: list, at: np.ndarray, depth: int) -> None:
        if len(node) == 1:
            total[at] += depth + usual(node[0])
            return
        low = x[at, node[0]] < node[1]
        for side, part in ((node[2], at[low]), (node[3], at[~low])):
            if len(part):
                depths(side, part, depth + 1)

    total = np.zeros(len(x))
    for t in trees:
        depths(t, np.arange(len(x)), 0)
    return 2.0 ** (-total / max(1, len(trees)) / max(usual(sample), 1e-9))


def novelty(rows: DataFrame, trees: list[list], sample: int = 256) -> DataFrame:
    """Adds ``novelty`` from trees of ``isolation_trees``; bounded batches in Arrow."""
    import pyarrow as pa

    def run(batches):
        for b in batches:
            x = np.array(b.column("x").to_pylist(), dtype=float).reshape(b.num_rows, -1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(novelties(x, trees, sample))], names=[*b.schema.names, "novelty"])

    return rows.mapInArrow(run, rows.withColumn("novelty", F.lit(0.0)).schema)


def out_of_distribution(scored: DataFrame, valid: Column, threshold: float) -> DataFrame:
    """Adds ``ood``: novel or invalid; a missing novelty is not novel."""
    return scored.withColumn("ood", F.coalesce(F.col("novelty") > threshold, F.lit(False)) | ~valid)


def surrogate_agreement(queries: DataFrame, holdout: DataFrame, train: Callable[[DataFrame], Scorer], key: str, budgets: tuple[int, ...] = (100, 500, 2000), label: str = "y_pred") -> list[tuple[int, float]]:
    """(budget, agreement): surrogates trained on the model's own answers, first rows of a hash order."""
    out = []
    for n in budgets:
        scorer = train(queries.orderBy(ordering(key, "budget"), key).limit(n))
        got = scorer(holdout).agg(rounded(F.avg((argmax(F.col("proba")) == F.col(label)).cast("double"))).alias("a")).first()
        out.append((n, got["a"]))
    return out
