"""Queries of trained and probed models, and of a stream; no SQL says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from modelwatch.functions.numbers import rounded
from modelwatch.functions.quantiles import exact_quantiles
from modelwatch.operators import attack, attribution, contracts, explain, models, scoring, textfeat
from modelwatch.plans.carriers import CODES, LOGS, table
from modelwatch.sources.shared import checkpoints, folder, spread, stored
from modelwatch.streaming import labels, monitor

_FLAGS = 8
_FREQUENT = 100_000  # events of a case whose stream is dealt into parts


def _cases(spark: SparkSession, d: str) -> DataFrame:
    """(id, x, y) of parts: flags from their numbers, a count, a length, ages and sex; the class follows from the flags."""
    k = F.col("p_partkey")
    flags = [(F.pmod(F.xxhash64(F.lit(i), k), F.lit(3)) == 0).cast("double") for i in range(_FLAGS)]
    df = spread(table(spark, d, "part").select("p_partkey", "p_size"), "p_partkey", "p_size").select(k.alias("id"), F.array(*flags).alias("f"), (F.col("p_size") / 50.0).alias("len"), F.pmod(k, F.lit(4)).alias("age"), F.pmod(k, F.lit(2)).cast("double").alias("sex"))
    total = F.aggregate("f", F.lit(0.0), lambda s, v: s + v)
    ages = [(F.col("age") == i).cast("double") for i in range(4)]
    x = F.concat("f", F.array(F.least(total, F.lit(6.0)) / 6, F.least("len", F.lit(1.0)), *ages, F.col("sex")))
    y = F.when(F.col("f")[0] == 1, 0).when(F.col("f")[1] == 1, 1).when(F.col("f")[2] == 1, 2).when(F.col("age") == 3, 3).otherwise(4)
    return df.select("id", x.alias("x"), y.alias("y"))


def _scorer(rows: DataFrame) -> models.Scorer:
    return models.forest(rows, trees=20, depth=6)[0]


def model_predictions(spark, d):
    """Predictions of a sex-blind forest: (id, y, y_pred, confidence, p_severe)."""
    rows = _cases(spark, d)
    return models.predict(rows, models.sex_blind(_scorer(rows), "id")).select("id", "y", "y_pred", "confidence", "p_severe")


def calibrated_predictions(spark, d):
    rows = _cases(spark, d)
    calibrated = models.isotonic(rows, lambda r: models.forest(r, trees=5, depth=5)[0], "id")
    return models.predict(rows, calibrated).select("id", "y", "y_pred", "confidence")


def baseline_predictions(spark, d):
    """A forest that sees no demographics."""
    rows = _cases(spark, d)
    return models.predict(rows, models.forest(rows, trees=20, depth=6, weights=None, width=_FLAGS + 2)[0]).select("id", "y", "y_pred")


def counterfactuals(spark, d):
    rows = _cases(spark, d)
    return explain.best_flips(models.flips(rows, _scorer(rows), "id", _FLAGS), row="id")


def partial_dependence(spark, d):
    rows = _cases(spark, d)
    return models.partial_dependence(rows, _scorer(rows), 0)


def importances(spark, d):
    rows = _cases(spark, d)
    found = models.forest(rows, trees=20, depth=6)[1].featureImportances.toArray()
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(found)], "feature_index int, importance double").orderBy(F.col("importance").desc(), "feature_index")


def surrogate_weights(spark, d):
    """Local surrogates of the ten cases that come first by hash, as a report shows them."""
    rows = _cases(spark, d)
    ten = rows.orderBy(F.md5(F.col("id").cast("string"))).limit(10)
    return models.local_surrogate(ten, _scorer(rows), "id", _FLAGS, perturbations=200)


def surrogate_curve(spark, d):
    rows = _cases(spark, d)
    answered = models.predict(rows, _scorer(rows)).select("id", "x", "y_pred")
    half = F.pmod("id", F.lit(2)) == 0
    curve = models.surrogate_agreement(answered.where(half), answered.where(~half), lambda r: models.forest(r, label="y_pred", trees=10, depth=6)[0], "id", budgets=(100, 500))
    return spark.createDataFrame(curve, "budget int, agreement double")


def novelty(spark, d):
    """(id, novelty, ood): threshold at the 99th percentile of the scores of a held-out quarter; invalid vectors are out as well."""
    rows = _cases(spark, d)
    held = F.pmod(F.xxhash64(F.lit("held"), "id"), F.lit(4)) == 0
    trees = models.isolation_trees(rows.where(~held), "id")
    scored = stored(models.novelty(rows, trees), "novelty")
    bound = exact_quantiles(scored.where(held).select(F.lit("all").alias("g"), "novelty"), "g", "novelty", [0.99]).first()
    out = models.out_of_distribution(scored, textfeat.vector_valid(F.col("x"), _FLAGS), bound["quantiles"][0] if bound else 1.0)
    return out.select("id", rounded(F.col("novelty"), 6).alias("novelty"), "ood")


_NAMES = [*(f"flag_{i}" for i in range(_FLAGS)), "count", "length", *(f"age_{i}" for i in range(4)), "sex"]


def _attributed(spark, d):
    rows = _cases(spark, d)
    nodes = attribution.node_table(models.forest(rows, trees=20, depth=6)[1], folder(spark, "forest"))
    return attribution.long_form(attribution.attributed(rows, attribution.paths(nodes, len(_NAMES))), "id")


def tree_attributions(spark, d):
    """(id, feature_index, value, rank): the six features that move a part's urgency most, with its sign."""
    top = explain.top_contributions(_attributed(spark, d), row="id", feature="feature_index")
    return top.select("id", "feature_index", rounded(F.col("value"), 6).alias("value"), "rank")


def attribution_means(spark, d):
    """(feature_index, mean_abs): mean size of a feature's attributions over all parts and classes."""
    each = _attributed(spark, d).select("feature_index", F.explode("contributions").alias("value"))
    return explain.mean_attribution(each, feature="feature_index")


def _triage(spark, d):
    rows = _cases(spark, d).withColumn("grp", F.concat(F.lit("age"), F.array_position(F.slice("x", _FLAGS + 3, 4), 1.0).cast("string")))
    root = folder(spark, "artifact")
    scoring.build(rows, root, scoring.Settings(_FLAGS, trees=20, depth=6, novelty_trees=50), _NAMES)
    return scoring.Triage(root=root).transform(rows.select("id", "x", "grp"))


def triage_scores(spark, d):
    """Every part through a model that is built, published and loaded here: class, raise, evidence, counterfactual, novelty."""
    done = _triage(spark, d)
    return done.select("id", "grp", "y_pred", "final", "raised", rounded(F.col("confidence"), 3).alias("confidence"), F.array_join("evidence", ",").alias("evidence"), F.col("up.feature_index").alias("up"), F.col("down.feature_index").alias("down"), "ood")


def triage_log(spark, d):
    """The log rows of the same."""
    return scoring.log_rows(_triage(spark, d))


def _grove(spark, rows):
    return scoring.Grove.of(attribution.node_table(models.forest(rows, trees=20, depth=6)[1], folder(spark, "forest")).collect())


def _balances(spark, d):
    """(id, x, y) of customers: balance, nation and number in [0, 1]; the class is a band of the balance, an other one in some nations."""
    balance = F.least(F.greatest((F.col("c_acctbal") + 1000) / 11000.0, F.lit(0.0)), F.lit(1.0))
    band = F.least(F.floor(balance * 5), F.lit(4)).cast("int")
    y = F.when(F.col("c_nationkey") % 6 == 0, F.greatest(band - 1, F.lit(0))).otherwise(band)
    customers = spread(table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_acctbal"), "c_custkey", "c_nationkey", "c_acctbal")
    return customers.select(F.col("c_custkey").alias("id"), F.array(balance, F.col("c_nationkey") / 24.0, F.pmod("c_custkey", F.lit(100)) / 99.0).alias("x"), y.alias("y"))


def boundary_attack(spark, d):
    """(id, y, y_pred, found, distance): every customer's smallest change found, within 0.25 of each entry, that flips the forest's class."""
    rows = _balances(spark, d)
    out = attack.attacked(rows, _grove(spark, rows).probabilities, "id")
    return out.select("id", "y", "y_pred", F.col("adversarial").isNotNull().alias("found"), rounded(F.col("distance"), 6).alias("distance"), "scorings")


def robustness(spark, d):
    """(model, accuracy, robust_accuracy, flipped, mean_distance) of a forest, and of one that has learned from the points that flipped the first."""
    rows = _balances(spark, d)
    first = stored(attack.attacked(rows, _grove(spark, rows).probabilities, "id"), "attacked")
    more = attack.hardened_rows(first, "id")
    second = attack.attacked(rows, _grove(spark, more).probabilities, "id")
    return attack.robust_accuracy(first).withColumn("model", F.lit("baseline")).unionByName(attack.robust_accuracy(second).withColumn("model", F.lit("hardened")))


def trained_cross_validation(spark, d):
    """(metric, mean, std, folds): five forests, each judged on the fold that it didn't see, by ages; a tenth of the labels is moved by one."""
    checkpoints(spark)
    moved = F.pmod(F.xxhash64(F.lit("moved"), "id"), F.lit(10)) == 0
    rows = _cases(spark, d).withColumn("grp", F.pmod("id", F.lit(4))).withColumn("y", F.when(moved, (F.col("y") + 1) % 5).otherwise(F.col("y")))
    folds = models.cross_validated(rows, lambda r: models.forest(r, trees=20, depth=6)[0], "id").checkpoint()
    each = [explain.cross_validation(folds, m).select(F.lit(m).alias("metric"), "mean", "std", "folds") for m in ("accuracy", "red_flag_recall", "gap")]
    return each[0].unionByName(each[1]).unionByName(each[2])


def artifact_compatibility(spark, d):
    names = F.when(F.col("n_nationkey") % 4 != 0, F.array(F.lit("a"), F.lit("b")))
    rows = table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.when(F.col("n_nationkey") % 3 != 0, 5).otherwise(4).alias("schema_version"), names.alias("names"), F.array(F.lit("forest")).alias("estimators"), F.lit("f").alias("fingerprint"))
    return contracts.compatible(rows, 5, ["a", "b"]).select("id", "compatible", "reason")


def provenance(spark, d):
    """Where each nation's rows were worked on: commit, versions, and how many customers they have."""
    counts = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("id")).agg(F.count(F.lit(1)).alias("customers"))
    return counts.crossJoin(F.broadcast(contracts.provenance(spark)))  # one row


def stream_class_mix(spark, d):
    """Class mix by day of the events as a stream that ends with what is there now; windows that are still open are in it."""
    out = folder(spark, "stream")
    schema = table(spark, d, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events*.parquet").parquet(d)
    mix = monitor.class_mix(stream.select("ts", F.col("event_type").alias("acuity"), (F.col("value") / 500).alias("confidence")), window="1 day", late="1 hour")
    monitor.each_batch(mix, lambda b: b, f"{out}/rows", f"{out}/progress", "update").awaitTermination()
    return monitor.latest(spark.read.parquet(f"{out}/rows"), ["start", "acuity"])


def stream_labels(spark, d):
    """(case_id, seq, y_pred, y_true): predictions among the events and their case's latest label, as two streams with a keyed state."""
    out = folder(spark, "labels")
    stream = spark.readStream.schema(table(spark, d, "events").schema).option("pathGlobFilter", "events*.parquet").parquet(d)
    rows = stream.select(F.col("event_id").alias("seq"), F.col("user_id").cast("string").alias("case_id"), "event_type", "ts")
    log = rows.where("seq % 3 <> 0").withColumnRenamed("event_type", "pred_code")
    truth = rows.where("seq % 3 = 0").withColumn("label_code", F.when(F.col("seq") % 7 != 0, F.col("event_type")))
    users = table(spark, d, "events").where("user_id is not null").groupBy(F.col("user_id").cast("string").alias("u")).count()
    frequent = [r["u"] for r in users.where(F.col("count") > _FREQUENT).select("u").collect()]  # a case for _FREQUENT events at most
    monitor.each_batch(labels.labelled_facts(log, truth, CODES, frequent=frequent), lambda b: b, f"{out}/facts", f"{out}/progress").awaitTermination()
    return labels.current(spark.read.schema(labels.FACTS).parquet(f"{out}/facts"))


QUERIES = {f.__name__: f for f in (model_predictions, calibrated_predictions, baseline_predictions, counterfactuals, partial_dependence, importances, surrogate_weights, surrogate_curve, novelty, tree_attributions, attribution_means, triage_scores, triage_log, boundary_attack, robustness, trained_cross_validation, artifact_compatibility, provenance, stream_class_mix, stream_labels)}
SQL = {"artifact_compatibility": "SELECT n_nationkey AS id, n_nationkey % 3 <> 0 AND n_nationkey % 4 <> 0 AS compatible, CASE WHEN n_nationkey % 3 = 0 THEN 'schema version differs' WHEN n_nationkey % 4 = 0 THEN 'feature names differ' END AS reason FROM nation", "stream_labels": f"WITH {LOGS}, known AS (SELECT unnest([{', '.join(map(repr, CODES))}]) AS code, unnest(range({len(CODES)})) AS i), last AS (SELECT case_id, arg_max(i, seq) AS y_true FROM truth JOIN known ON label_code = code GROUP BY 1) SELECT case_id, seq, CAST(i AS INTEGER) AS y_pred, CAST(y_true AS INTEGER) AS y_true FROM log JOIN known ON pred_code = code JOIN last USING (case_id)"}
