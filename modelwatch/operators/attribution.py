"""Exact attributions of a forest's class probabilities to features, given the trees' own covers.

What a feature gets from a leaf is the leaf's value times an average over the orders in
which features may become known: a feature that is known passes the leaf's conditions or
not, one that is unknown passes with the share of training rows that did. This average is
the integral over u from 0 to 1 of the product of (1 - u) * share + u * passed over the
other features of the leaf's path, a polynomial in u; a Gauss-Legendre rule with half as
many points as the path has features gives it exactly. The work is a product a leaf, not a
sum over subsets.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from modelwatch.operators.explain import urgency

_NODES = "tree int, node int, left int, right int, feature int, threshold double, stats array<double>"


class Cells:
    """The grid that all thresholds of a forest make: the forest says the same of all rows in a cell.

    What a cell gets is worked out once and kept, for ``most`` cells at most; what comes
    beyond these is worked out once a call. A grid with too many cells to number shares nothing.
    """

    def __init__(self, cuts: dict[int, set[float]], most: int = 1 << 16):
        self.cuts = [(f, np.array(sorted(c))) for f, c in sorted(cuts.items())]
        self.numbered = sum(np.log2(len(c) + 1) for _, c in self.cuts) < 62
        self.most, self.seen, self.values = most, np.array([np.iinfo(np.int64).max]), None

    def of(self, x: np.ndarray, work: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        """``work(x)``, a row of values a row, by one row of each cell."""
        if not self.numbered or not len(x):
            return work(x)
        code = np.zeros(len(x), np.int64)
        for f, cuts in self.cuts:
            code = code * (len(cuts) + 1) + np.searchsorted(cuts, x[:, f])
        at = np.searchsorted(self.seen, code)
        known = self.seen[at] == code
        if known.all():
            return self.values[at]
        new, first, back = np.unique(code[~known], return_index=True, return_inverse=True)
        found = work(x[~known][first])
        out = np.empty((len(x), *found.shape[1:]))
        out[~known] = found[back]
        if known.any():
            out[known] = self.values[at[known]]
        if len(self.seen) + len(new) <= self.most:
            place = np.searchsorted(self.seen, new)
            self.values = found if self.values is None else np.insert(self.values, place, found, 0)
            self.seen = np.insert(self.seen, place, new)
        return out


@dataclass
class Leaf:
    """A path's distinct features, the interval (low, high] each must be in, the shares that pass, and the class values."""

    features: np.ndarray
    low: np.ndarray
    high: np.ndarray
    shares: np.ndarray
    value: np.ndarray


@dataclass
class Paths:
    """All leaves of a forest, what it says of nothing in particular, and its number of features."""

    leaves: list[Leaf]
    base: np.ndarray
    width: int

    def __post_init__(self):
        cuts: dict[int, set[float]] = {}
        for leaf in self.leaves:
            for f, *bounds in zip(leaf.features.tolist(), leaf.low.tolist(), leaf.high.tolist(), strict=True):
                cuts.setdefault(f, set()).update(b for b in bounds if np.isfinite(b))
        self.cells = Cells(cuts, 1 << 14)


def node_table(model, path: str) -> DataFrame:
    """_NODES of a fitted forest, from what its writer saves at ``path``; at most trees * 2**(depth + 1) rows."""
    spark = SparkSession.active()
    model.write().overwrite().save(path)
    d = F.col("nodeData")
    return spark.read.parquet(f"{path}/data").select(
        F.col("treeID").cast("int").alias("tree"), d["id"].alias("node"), d["leftChild"].alias("left"), d["rightChild"].alias("right"),
        d["split"]["featureIndex"].alias("feature"), F.get(d["split"]["leftCategoriesOrThreshold"], F.lit(0)).alias("threshold"), d["impurityStats"].alias("stats"),
    )


def paths(nodes: DataFrame, width: int) -> Paths:
    """The leaves of ``nodes`` for the driver and, by broadcast, the tasks: the model's size, whatever the rows."""
    trees: dict[int, dict[int, tuple]] = {}
    for r in nodes.collect():
        trees.setdefault(r["tree"], {})[r["node"]] = (r["left"], r["right"], r["feature"], r["threshold"], np.array(r["stats"], float))
    leaves, base = [], 0.0
    for tree in trees.values():
        root = tree[0][4]
        base = base + root / root.sum() / len(trees)
        open_ = [(0, {})]
        while open_:
            at, passed = open_.pop()
            left, right, feature, threshold, stats = tree[at]
            if left < 0:
                bounds = [np.array([p[k] for p in passed.values()], float) for k in range(3)]
                leaves.append(Leaf(np.array(list(passed), int), *bounds, stats / stats.sum() / len(trees)))
                continue
            low, high, share = passed.get(feature, (-np.inf, np.inf, 1.0))
            for below, bound in ((left, (low, min(high, threshold))), (right, (max(low, threshold), high))):
                open_.append((below, passed | {feature: (*bound, share * tree[below][4].sum() / stats.sum())}))
    return Paths(leaves, np.asarray(base, float), width)


def explained(x: np.ndarray, found: Paths) -> np.ndarray:
    """[rows, features, classes] of attributions; with ``base`` they add up to the forest's probabilities."""
    return found.cells.of(x, lambda rows: _explained(rows, found))


def _explained(x: np.ndarray, found: Paths) -> np.ndarray:
    out = np.zeros((len(x), found.width, len(found.base)))
    rules: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for leaf in found.leaves:
        d = len(leaf.features)
        if not d:
            continue
        if d not in rules:
            u, w = np.polynomial.legendre.leggauss((d + 1) // 2)
            rules[d] = (u + 1) / 2, w / 2
        u, w = rules[d]
        v = x[:, leaf.features]
        # As the forest itself goes: what is no number to the right, and an open side is open to infinities too.
        passed = ((leaf.low == -np.inf) | ~(v <= leaf.low)) & ((leaf.high == np.inf) | (v <= leaf.high))
        # Rows that pass the same features share their sums.
        if d < 63:
            _, first, of = np.unique(passed @ (1 << np.arange(d)), return_index=True, return_inverse=True)
            kinds = passed[first]
        else:
            kinds, of = np.unique(passed, axis=0, return_inverse=True)
        factor = (1 - u)[:, None, None] * leaf.shares + u[:, None, None] * kinds  # [points, kinds, d]
        before, after = np.ones_like(factor), np.ones_like(factor)
        np.cumprod(factor[..., :-1], axis=-1, out=before[..., 1:])
        after[..., :-1] = np.cumprod(factor[..., :0:-1], axis=-1)[..., ::-1]
        weight = (w[:, None, None] * before * after).sum(0) * (kinds - leaf.shares)
        out[:, leaf.features] += weight[of.ravel()][:, :, None] * leaf.value
    return out


def attributed(rows: DataFrame, found: Paths, x: str = "x", name: str = "phi", at_once: int = 5000) -> DataFrame:
    """Adds ``name``, array<array<double>> by feature and class, to rows with ``x``; in Arrow, ``at_once`` rows at a time.

    A row whose ``x`` is null, short, long or has a null gets null.
    """
    import pyarrow as pa

    known = rows.sparkSession.sparkContext.broadcast(found)
    kind = pa.list_(pa.list_(pa.float64()))

    def run(batches):
        paths_ = known.value
        for whole in batches:
            for i in range(0, whole.num_rows, at_once):
                b = whole.slice(i, at_once)
                values = b.column(b.schema.names.index(x)).to_pylist()
                ok = [k for k, v in enumerate(values) if v is not None and len(v) == paths_.width and None not in v]
                out = [None] * len(values)
                if ok:
                    for k, phi in zip(ok, explained(np.array([values[k] for k in ok], float), paths_).tolist(), strict=True):
                        out[k] = phi
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, kind)], names=[*b.schema.names, name])

    return rows.mapInArrow(run, rows.withColumn(name, F.lit(None).cast("array<array<double>>")).schema)


def long_form(attributions: DataFrame, key: str, name: str = "phi") -> DataFrame:
    """(key, feature_index, contributions, value): a row a feature; value is the signed urgency of its contributions by class."""
    each = attributions.select(key, F.posexplode(name).alias("feature_index", "contributions"))
    return each.withColumn("value", urgency(F.col("contributions")))
