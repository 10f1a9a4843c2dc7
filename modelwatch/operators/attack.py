"""A decision-boundary attack: rows moved as little as flips their class, by predictions alone, within a ball of the largest norm.

Each row is searched by itself: from a random point of another class in the ball the way
back to the row is halved until it lies at the boundary; there the boundary's direction is
estimated from the classes of random neighbours, a step is taken along it, shorter and
shorter until it stays beyond the boundary, and the way back is halved again. A row's number
of scorings is bounded by ``scorings``, and it stops as soon as a round brings it no nearer.
Draws follow from the row's key, so a lost executor's rows come out the same.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modelwatch.functions.numbers import rounded


@dataclass
class Search:
    """radius of the ball; random starts, halvings of a way, rounds, neighbours of an estimate, and shortenings of a step."""

    radius: float = 0.25
    starts: int = 32
    halvings: int = 12
    rounds: int = 4
    neighbours: int = 24
    shorter: int = 5
    least: float = 1e-3
    seed: int = 13

    @property
    def scorings(self) -> int:
        """Most points of a row that the model is asked for, itself included."""
        return 1 + self.starts + self.halvings + self.rounds * (self.neighbours + self.shorter + self.halvings)


def nearest_flips(x: np.ndarray, keys: np.ndarray, classes: Callable[[np.ndarray], np.ndarray], how: Search) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(points, found, scorings) for the rows of x; a point of another class, of [0, 1] where its row is, for each row that has one."""
    n, width = x.shape
    used = np.ones(n, int)
    own = classes(x)
    draws = [np.random.default_rng([how.seed, int(k) & (1 << 63) - 1]) for k in keys]
    floor, ceiling = np.minimum(x, 0.0), np.maximum(x, 1.0)

    def flipped(rows: np.ndarray, points: np.ndarray) -> np.ndarray:
        """Which of ``points`` [rows, m, width] have another class."""
        used[rows] += points.shape[1]
        return classes(points.reshape(-1, width)).reshape(points.shape[:2]) != own[rows, None]

    def inside(rows: np.ndarray, points: np.ndarray, radius) -> np.ndarray:
        shape = (-1, *[1] * (points.ndim - 2), width)
        base = x[rows].reshape(shape)
        far = np.asarray(radius).reshape(-1, *[1] * (points.ndim - 1))
        return np.clip(np.clip(points, base - far, base + far), floor[rows].reshape(shape), ceiling[rows].reshape(shape))

    def drawn(rows: np.ndarray, m: int) -> np.ndarray:
        return np.stack([draws[i].uniform(-1, 1, (m, width)) for i in rows]) if len(rows) else np.zeros((0, m, width))

    def back(rows: np.ndarray, points: np.ndarray) -> np.ndarray:
        """The points drawn towards their rows, as near as stays beyond the boundary."""
        low, high = np.zeros(len(rows)), np.abs(points - x[rows]).max(1)
        for _ in range(how.halvings):
            middle = (low + high) / 2
            beyond = flipped(rows, inside(rows, points, middle)[:, None])[:, 0]
            low, high = np.where(beyond, low, middle), np.where(beyond, middle, high)
        return inside(rows, points, high)

    every = np.arange(n)
    starts = inside(every, x[:, None] + how.radius * drawn(every, how.starts), how.radius)
    other = flipped(every, starts)
    found = other.any(1)
    active = np.flatnonzero(found)
    best = x.copy()
    best[active] = back(active, starts[active, other[active].argmax(1)])
    for _ in range(how.rounds):
        if not len(active):
            break
        at, far = best[active], np.abs(best[active] - x[active]).max(1)
        around = drawn(active, how.neighbours)
        side = np.where(flipped(active, inside(active, at[:, None] + 0.1 * far[:, None, None] * around, how.radius)), 1.0, -1.0)
        direction = np.sign(((side - side.mean(1, keepdims=True))[:, :, None] * around).mean(1))
        step, moved, open_ = far / 2, at.copy(), np.ones(len(active), bool)
        for _ in range(how.shorter):
            rows = np.flatnonzero(open_)
            if not len(rows):
                break
            points = inside(active[rows], at[rows] + step[rows, None] * direction[rows], how.radius)
            beyond = flipped(active[rows], points[:, None])[:, 0]
            moved[rows[beyond]] = points[beyond]
            open_[rows[beyond]] = False
            step = step / 2
        gone = np.flatnonzero(~open_)
        if not len(gone):
            break
        nearer = back(active[gone], moved[gone])
        gain = far[gone] - np.abs(nearer - x[active[gone]]).max(1)
        better = gain > 0
        best[active[gone[better]]] = nearer[better]
        active = active[gone[gain > how.least]]
    return best, found, used


def attacked(rows: DataFrame, probabilities: Callable[[np.ndarray], np.ndarray], key: str, how: Search | None = None, at_once: int = 1024) -> DataFrame:
    """Adds y_pred, ``adversarial`` (null where none is found), ``distance`` (largest change) and ``scorings`` to rows with ``x``.

    A row whose ``x`` is null, empty, or has a null or what isn't finite, gets nulls; all others
    must be of one length. Repeated rows get the same point.
    """
    import pyarrow as pa

    how = how or Search()
    new = {"y_pred": ("int", pa.int32()), "adversarial": ("array<double>", pa.list_(pa.float64())), "distance": ("double", pa.float64()), "scorings": ("int", pa.int32())}

    def run(batches):
        for whole in batches:
            for i in range(0, whole.num_rows, at_once):
                b = whole.slice(i, at_once)
                values = b.column(b.schema.names.index("x")).to_pylist()
                ok = [k for k, v in enumerate(values) if v and None not in v and np.isfinite(v).all()]
                cells: dict[str, list] = {name: [None] * len(values) for name in new}
                if ok:
                    x = np.array([values[k] for k in ok], float)
                    hashed = b.column(b.schema.names.index("_key")).to_numpy()[ok]
                    classes = lambda p: probabilities(p).argmax(1)
                    points, found, used = nearest_flips(x, hashed, classes, how)
                    for j, (k, c) in enumerate(zip(ok, classes(x).tolist(), strict=True)):
                        far = float(np.abs(points[j] - x[j]).max()) if found[j] else None
                        for name, cell in zip(new, (c, points[j].tolist() if found[j] else None, far, int(used[j])), strict=True):
                            cells[name][k] = cell
                keep = [k for k, name in enumerate(b.schema.names) if name != "_key"]
                yield pa.RecordBatch.from_arrays([*(b.columns[k] for k in keep), *(pa.array(cells[name], kind) for name, (_, kind) in new.items())], names=[*(b.schema.names[k] for k in keep), *new])

    schema = rows.withColumns({name: F.lit(None).cast(kind) for name, (kind, _) in new.items()}).schema
    return rows.withColumn("_key", F.xxhash64(key)).mapInArrow(run, schema)


def robust_accuracy(attacks: DataFrame, label: str = "y") -> DataFrame:
    """(accuracy, robust_accuracy, flipped, mean_distance): of all rows with a prediction; robust are the right ones without a flip."""
    right = F.col("y_pred") == F.col(label)
    some = attacks.where(F.col("y_pred").isNotNull())
    share = lambda c: rounded(F.avg(c.cast("double")))
    return some.agg(share(right).alias("accuracy"), share(right & F.col("adversarial").isNull()).alias("robust_accuracy"), F.count("adversarial").alias("flipped"), rounded(F.avg("distance"), 6).alias("mean_distance"))


def hardened_rows(attacks: DataFrame, key: str, label: str = "y") -> DataFrame:
    """(key, x, label): the rows and, with their own labels, the points that flip those that are right; a training table with twice these keys."""
    own = attacks.select(key, "x", label)
    flips = attacks.where(F.col("adversarial").isNotNull() & (F.col("y_pred") == F.col(label)))
    return own.unionByName(flips.select(key, F.col("adversarial").alias("x"), label))
