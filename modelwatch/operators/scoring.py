"""A model build as one artifact, and a Transformer that scores rows with it from vector to log row.

The artifact is a folder of tables (nodes of all forests, calibration curves, group
thresholds, isolation trees) below a version of its own, and a manifest that alone makes a
version the served one. A build that dies leaves tables that nobody reads.

Scoring is one pass in Arrow: forests are arrays of nodes that a batch descends level by
level, curves are sorted arrays that a binary search reads. What tasks are sent has the size
of the model: trees * 2**(depth + 1) nodes, ``grid`` + 1 points a curve, a row a group.
"""

from __future__ import annotations

import json
import logging
from dataclasses import asdict, dataclass, field
from functools import reduce

import numpy as np
from pyspark import keyword_only
from pyspark.ml import Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from modelwatch.functions.numbers import argmax
from modelwatch.functions.quantiles import exact_quantiles
from modelwatch.operators import attribution, fairness, models
from modelwatch.operators.snapshot import content_hash, oversample, stratified_folds, stratified_split, version_id
from modelwatch.sources.shared import folder, publish, read_text, spread, stored

SCHEMA_VERSION = 1
WEIGHTS = (1.0, 0.5, 0.0, -0.5, -1.0)  # of the classes in an urgency
SEVERE = 1  # the milder of the severe classes


@dataclass
class Settings:
    """What a build is made with; the vector has ``flags`` first, then their count / 6, and the sex last."""

    flags: int
    classes: int = 5
    trees: int = 200
    leaf: int = 5
    depth: int = 15
    folds: int = 3
    grid: int = 10_000
    novelty_trees: int = 200
    novelty_sample: int = 256
    novelty_share: float = 0.99
    seed: int = 42


# -- scoring in arrays ------------------------------------------------------------------


@dataclass
class Grove:
    """A forest's nodes in arrays; a leaf is its own child."""

    feature: np.ndarray
    threshold: np.ndarray
    low: np.ndarray
    high: np.ndarray
    value: np.ndarray
    roots: np.ndarray

    @staticmethod
    def of(rows: list) -> Grove:
        """From node rows (tree, node, left, right, feature, threshold, stats)."""
        rows = sorted(rows, key=lambda r: (r["tree"], r["node"]))
        place = {(r["tree"], r["node"]): i for i, r in enumerate(rows)}
        child = lambda r, side: place[r["tree"], r[side]] if r[side] >= 0 else place[r["tree"], r["node"]]
        stats = np.array([r["stats"] for r in rows], float)
        return Grove(
            np.array([max(r["feature"], 0) for r in rows]), np.array([r["threshold"] if r["left"] >= 0 else np.inf for r in rows]),
            np.array([child(r, "left") for r in rows]), np.array([child(r, "right") for r in rows]), stats / stats.sum(1, keepdims=True),
            np.array([i for i, r in enumerate(rows) if r["node"] == 0]),
        )

    def __post_init__(self):
        cuts: dict[int, set[float]] = {}
        for f, t in zip(self.feature.tolist(), self.threshold.tolist(), strict=True):
            if np.isfinite(t):
                cuts.setdefault(f, set()).add(t)
        self.cells = attribution.Cells(cuts)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """[rows, classes]: the mean of the leaves' shares."""
        return self.cells.of(x, self._descended)

    def _descended(self, x: np.ndarray) -> np.ndarray:
        at, rows = np.tile(self.roots, (len(x), 1)), np.arange(len(x))[:, None]
        while True:
            below = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.low[at], self.high[at])
            if (below == at).all():
                return self.value[at].mean(1)
            at = below


@dataclass
class Model:
    """All that scoring needs."""

    settings: Settings
    served: Grove
    folds: list[Grove]
    curves: list[list[tuple[np.ndarray, np.ndarray]]]
    paths: attribution.Paths
    thresholds: dict[str, float]
    isolation: list
    novel: float
    names: list[str] = field(default_factory=list)

    def calibrated(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros((len(x), self.settings.classes))
        for grove, curves in zip(self.folds, self.curves, strict=True):
            raw = grove.probabilities(x)
            total += np.column_stack([np.interp(raw[:, c], *curve) for c, curve in enumerate(curves)])
        whole = total.sum(1, keepdims=True)
        return np.where(whole > 0, total / np.where(whole > 0, whole, 1), 1 / self.settings.classes)

    def blind(self, x: np.ndarray) -> np.ndarray:
        """Mean of the probabilities with the last entry at 0 and at 1."""
        sides = []
        for sex in (0.0, 1.0):
            side = x.copy()
            side[:, -1] = sex
            sides.append(self.calibrated(side))
        return (sides[0] + sides[1]) / 2

    def flips(self, x: np.ndarray, now: np.ndarray) -> tuple[list, list]:
        """For each row the flag whose toggling makes the next more severe, and the next milder, class likeliest; ties go to the lower flag."""
        n, flags = len(x), self.settings.flags
        moved = np.repeat(x, flags, 0)
        at = np.tile(np.arange(flags), n)
        moved[np.arange(len(moved)), at] = 1 - moved[np.arange(len(moved)), at]
        moved[:, flags] = np.minimum(moved[:, :flags].sum(1), 6) / 6
        p = self.blind(moved).reshape(n, flags, -1)
        out = []
        for step in (-1, 1):
            to = now + step
            ok = (to >= 0) & (to < p.shape[2])
            of = p[np.arange(n), :, np.where(ok, to, 0)]
            best = of.argmax(1)
            out.append([{"feature_index": int(b), "p": float(v)} if k else None for b, v, k in zip(best, of[np.arange(n), best], ok, strict=True)])
        return out[0], out[1]


# -- the build --------------------------------------------------------------------------


def build(rows: DataFrame, root: str, settings: Settings, names: list[str]) -> str:
    """Fits everything on (id, x, y, grp), writes it below ``root`` and serves it; the version's path.

    A test part of a quarter is held out: thresholds of groups and the bound of novelty come
    from it. The served forest sees every group in the same strength (``oversample``). The
    same rows and settings give the same version, which isn't built again if it is served.
    """
    spark = rows.sparkSession
    data = content_hash(rows.withColumn("_x", F.concat_ws(",", F.transform("x", lambda v: v.cast("string")))), ["id", "_x", "y", "grp"])
    version = data.select(version_id(F.col("sha256"), json.dumps([SCHEMA_VERSION, names, asdict(settings)], sort_keys=True)).alias("v")).first()["v"]
    served = read_text(spark, f"{root}/served.json")
    path = f"{root}/{version}"
    if served and json.loads(served)["version"] == version:
        return path
    split = stored(spread(stratified_split(rows.select("id", "x", F.col("y").cast("int").alias("y"), "grp"), "id", "y"), "id"), "split")
    train, test = split.where("part = 'train'"), split.where("part = 'test'")
    fit = lambda r: models.forest(r, trees=settings.trees, leaf=settings.leaf, depth=settings.depth, seed=settings.seed)[1]
    nodes, curves = [], []

    def saved(name: str, model) -> list:
        table = attribution.node_table(model, folder(spark, f"fit-{name}")).withColumn("model", F.lit(name))
        nodes.append(table)
        return table.collect()

    served_rows = saved("served", fit(stored(spread(oversample(train, "id", "grp"), "id", "copy"), "served")))
    dealt, folds = stored(spread(stratified_folds(train, "id", "y", settings.folds), "id"), "folds"), []
    for k in range(settings.folds):
        model = fit(dealt.where(F.col("fold") != k))
        folds.append(Grove.of(saved(f"fold{k}", model)))
        held = stored(scored_by(dealt.where(F.col("fold") == k), folds[-1].probabilities).select("proba", "y"), f"held{k}")
        curves.append([models.curve(held, c, settings.grid) for c in range(settings.classes)])
    width = len(names)
    trees = models.isolation_trees(train, "id", settings.novelty_trees, settings.novelty_sample, settings.seed)
    novel = stored(models.novelty(test, trees, settings.novelty_sample).select(F.lit("all").alias("g"), "novelty"), "novel")
    bound = exact_quantiles(novel, "g", "novelty", [settings.novelty_share]).first()
    model = Model(settings, Grove.of(served_rows), folds, [[tuple(map(np.array, c)) for c in cs] for cs in curves], attribution.Paths([], np.zeros(0), width), {}, trees, bound["quantiles"][0] if bound else 1.0, names)
    told = scored_by(test, model.blind).withColumns({"y_pred": argmax(F.col("proba")), "p_severe": F.get("proba", F.lit(0)) + F.get("proba", F.lit(1))})
    told = stored(told.drop("x"), "told")
    thresholds = fairness.opportunity_thresholds(told, label="y")
    accuracy = told.agg(F.avg((F.col("y_pred") == F.col("y")).cast("double")).alias("a")).first()["a"]

    reduce(DataFrame.unionByName, nodes).write.mode("overwrite").parquet(f"{path}/nodes")
    flat = [(k, c, xs, ys) for k, cs in enumerate(curves) for c, (xs, ys) in enumerate(cs)]
    spark.createDataFrame(flat, "fold int, class int, xs array<double>, ys array<double>").write.mode("overwrite").parquet(f"{path}/curves")
    thresholds.write.mode("overwrite").parquet(f"{path}/thresholds")
    spark.createDataFrame([(i, json.dumps(t)) for i, t in enumerate(trees)], "tree int, nodes string").write.mode("overwrite").parquet(f"{path}/isolation")
    publish(spark, f"{root}/served.json", json.dumps({"schema_version": SCHEMA_VERSION, "version": version, "names": names, "settings": asdict(settings), "novel": model.novel, "accuracy": accuracy, "rows": split.count()}))
    return path


def load(spark: SparkSession, root: str) -> Model:
    """The served model; FileNotFoundError if none is served, ValueError if it has another schema."""
    text = read_text(spark, f"{root}/served.json")
    if text is None:
        raise FileNotFoundError(f"no model is served at {root}")
    told = json.loads(text)
    if told["schema_version"] != SCHEMA_VERSION:
        raise ValueError(f"schema version {told['schema_version']}, not {SCHEMA_VERSION}")
    settings, path = Settings(**told["settings"]), f"{root}/{told['version']}"
    nodes = spark.read.parquet(f"{path}/nodes")
    by: dict[str, list] = {}
    for r in nodes.collect():
        by.setdefault(r["model"], []).append(r)
    curves: list[list] = [[None] * settings.classes for _ in range(settings.folds)]
    for r in spark.read.parquet(f"{path}/curves").collect():
        curves[r["fold"]][r["class"]] = (np.array(r["xs"]), np.array(r["ys"]))
    thresholds = {r["grp"]: r["threshold"] for r in spark.read.parquet(f"{path}/thresholds").collect()}
    trees = [json.loads(r["nodes"]) for r in spark.read.parquet(f"{path}/isolation").orderBy("tree").collect()]
    found = attribution.paths(nodes.where("model = 'served'"), len(told["names"]))
    return Model(settings, Grove.of(by["served"]), [Grove.of(by[f"fold{k}"]) for k in range(settings.folds)], curves, found, thresholds, trees, told["novel"], told["names"])


def scored_by(rows: DataFrame, score, at_once: int = 5000) -> DataFrame:
    """Adds ``proba`` by a function of [rows, features]; every ``x`` must be whole."""
    import pyarrow as pa

    def run(batches):
        for whole in batches:
            for i in range(0, whole.num_rows, at_once):
                b = whole.slice(i, at_once)
                p = score(np.array(b.column(b.schema.names.index("x")).to_pylist(), float)).tolist()
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(p, pa.list_(pa.float64()))], names=[*b.schema.names, "proba"])

    return rows.mapInArrow(run, rows.withColumn("proba", F.lit(None).cast("array<double>")).schema)


# -- the transformer --------------------------------------------------------------------

_SCORED = (
    "proba array<double>, y_pred int, final int, raised boolean, confidence double, p_severe double, evidence array<string>, "
    "explanation array<struct<feature: string, weight: double>>, up struct<feature_index: int, p: double>, down struct<feature_index: int, p: double>, novelty double, ood boolean"
)


class Triage(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Scores rows (x, grp) with the model served at ``root``, in one pass and without any action.

    Added are the blind calibrated ``proba``, ``y_pred``, ``final`` (raised to the milder
    severe class where the group's threshold is reached), ``confidence`` (of a raised row its
    severe probability), ``evidence`` (the three strongest flags that are set),
    ``explanation`` (six with signed weights), ``up`` and ``down`` (the flag that most helps a
    neighbouring class), ``novelty`` and ``ood``. A row whose ``x`` is null, short, long or not
    finite gets nulls and is ``ood``; a group without threshold is never raised.
    """

    root = Param(Params._dummy(), "root", "folder of the served model", typeConverter=TypeConverters.toString)
    rowsAtOnce = Param(Params._dummy(), "rowsAtOnce", "rows that are scored together", typeConverter=TypeConverters.toInt)

    @keyword_only
    def __init__(self, root: str | None = None, rowsAtOnce: int | None = None):
        super().__init__()
        self._setDefault(rowsAtOnce=5000)
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})
        self._model: Model | None = None

    def model(self) -> Model:
        """The model as it is served when it is first asked for."""
        if self._model is None:
            self._model = load(SparkSession.active(), self.getOrDefault("root"))
        return self._model

    def _transform(self, dataset: DataFrame) -> DataFrame:
        known, at_once = dataset.sparkSession.sparkContext.broadcast(self.model()), self.getOrDefault("rowsAtOnce")
        schema = StructType.fromDDL(_SCORED)
        out = StructType([*dataset.schema.fields, *schema.fields])

        def run(batches):
            import pyarrow as pa
            from pyspark.sql.pandas.types import to_arrow_schema

            kinds, model = to_arrow_schema(schema), known.value
            for whole in batches:
                for i in range(0, whole.num_rows, at_once):
                    b = whole.slice(i, at_once)
                    x, groups = (b.column(b.schema.names.index(c)).to_pylist() for c in ("x", "grp"))
                    cells = _scored(model, x, groups)
                    yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(cells[f.name], f.type) for f in kinds)], names=[*b.schema.names, *kinds.names])

        return dataset.mapInArrow(run, out)


def _scored(model: Model, x: list, groups: list) -> dict[str, list]:
    """The columns of _SCORED for a batch."""
    names = [f.split(":")[0] for f in ("proba", "y_pred", "final", "raised", "confidence", "p_severe", "evidence", "explanation", "up", "down", "novelty", "ood")]
    out: dict[str, list] = {n: [None] * len(x) for n in names}
    out["ood"] = [True] * len(x)
    ok = [i for i, v in enumerate(x) if v is not None and len(v) == model.paths.width and None not in v and np.isfinite(v).all()]
    if not ok:
        return out
    a = np.array([x[i] for i in ok], float)
    proba = model.blind(a)
    pred, severe = proba.argmax(1), proba[:, : SEVERE + 1].sum(1)
    bound = np.array([model.thresholds.get(groups[i], 1.0) for i in ok])
    raised = (pred > SEVERE) & (severe >= bound) & (bound < 1.0)
    urgency = attribution.explained(a, model.paths) @ np.array(WEIGHTS)
    most = np.abs(urgency).max(1)
    up, down = model.flips(a, pred)
    novelty = models.novelties(a, model.isolation, model.settings.novelty_sample)
    for j, i in enumerate(ok):
        order = [k for k in np.argsort(-np.abs(urgency[j, : model.settings.flags]), kind="stable").tolist() if a[j, k] > 0.5]
        strong = [k for k in order[:6] if abs(urgency[j, k]) > 1e-9]
        cells = (
            proba[j].tolist(), int(pred[j]), SEVERE if raised[j] else int(pred[j]), bool(raised[j]), float(severe[j] if raised[j] else proba[j, pred[j]]), float(severe[j]),
            [model.names[k] for k in order[:3]], [{"feature": model.names[k], "weight": round(float(urgency[j, k] / (most[j] or 1.0)), 3)} for k in strong], up[j], down[j], float(novelty[j]), bool(novelty[j] > model.novel),
        )
        for name, cell in zip(names, cells, strict=True):
            out[name][i] = cell
    return out


def log_rows(scored: DataFrame, key: str = "id") -> DataFrame:
    """The inference log's rows of scored ones: no vector and no text."""
    return scored.where(F.col("final").isNotNull()).select(F.col(key).cast("string").alias("case_id"), F.concat(F.lit("P"), (F.col("final") + 1).cast("string")).alias("pred_code"), F.round("confidence", 3).alias("confidence"), "grp", F.col("ood"))


def probe(triage: Triage, x: list[float], grp: str) -> dict | None:
    """One canned row through the transformer, as a candidate is tried before it serves; None, and a warning, if it fails."""
    spark = SparkSession.active()
    try:
        return triage.transform(spark.createDataFrame([(x, grp)], "x array<double>, grp string")).select("final", "confidence", "ood").first().asDict()
    except Exception as e:  # a probe must not stop what is served
        logging.getLogger(__name__).warning("shadow probe failed: %s", e)
        return None
