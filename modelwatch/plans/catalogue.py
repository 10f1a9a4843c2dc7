"""Every registered query of the library's own operators and, where SQL can say it, the same for DuckDB."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from modelwatch.functions import matching
from modelwatch.functions.numbers import argmax, rounded
from modelwatch.operators import calibration, contracts, drift, explain, fairness, gates, joins, redaction, scanreport, snapshot, telemetry, textfeat
from modelwatch.plans import evidence, learned
from modelwatch.plans.carriers import CODES, LOGS, SCORED, logs, r, scored, table
from modelwatch.sources import logs as log_source
from modelwatch.sources import synth
from modelwatch.sources.shared import spread

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return register


def queries() -> dict[str, Query]:
    return _QUERIES | learned.QUERIES | evidence.QUERIES


def oracle_sql() -> dict[str, str]:
    return _SQL | learned.SQL | evidence.SQL


# -- fairness and safety ----------------------------------------------------------------

_HIT, _SEV_T, _SEV_P = "CAST(y_true = y_pred AS INTEGER)", "y_true <= 1", "y_pred <= 1"
_TPR = r(f"CAST(count(*) FILTER ({_SEV_P} AND {_SEV_T}) AS DOUBLE) / nullif(count(*) FILTER ({_SEV_T}), 0)")
_FPR = r(f"CAST(count(*) FILTER ({_SEV_P} AND y_true > 1) AS DOUBLE) / nullif(count(*) FILTER (y_true > 1), 0)")
_RATE = f"CAST(count(*) FILTER ({_SEV_P}) AS DOUBLE) / count(*)"
_ACC = r(f"CAST(sum({_HIT}) AS DOUBLE) / count(*)")
_BY_ACC = f"by_acc AS (SELECT grp, {_ACC} AS accuracy, count(*) AS n FROM scored GROUP BY grp)"
_BY_REC = f"by_rec AS (SELECT grp, {_TPR} AS recall, count(*) FILTER ({_SEV_T}) AS n_severe FROM scored GROUP BY grp)"


@_query(f"WITH {SCORED} SELECT {_ACC} AS accuracy, count(*) AS n FROM scored")
def accuracy(spark, d):
    return fairness.accuracy(scored(spark, d))


@_query(f"WITH {SCORED}, {_BY_ACC} SELECT * FROM by_acc")
def subgroup_accuracy(spark, d):
    return fairness.subgroup_accuracy(scored(spark, d))


@_query(f"WITH {SCORED}, {_BY_ACC} SELECT coalesce({r('max(accuracy) - min(accuracy)')}, 0.0) AS gap FROM by_acc")
def fairness_gap(spark, d):
    return fairness.gap(fairness.subgroup_accuracy(scored(spark, d)), "accuracy")


@_query(f"WITH {SCORED} SELECT coalesce({_TPR}, 1.0) AS red_flag_recall FROM scored")
def red_flag_recall(spark, d):
    return fairness.red_flag_recall(scored(spark, d))


@_query(f"WITH {SCORED}, {_BY_REC} SELECT * FROM by_rec")
def subgroup_red_flag_recall(spark, d):
    return fairness.subgroup_red_flag_recall(scored(spark, d))


@_query(f"WITH {SCORED} SELECT grp, {r(_RATE)} AS rate FROM scored GROUP BY grp")
def demographic_parity(spark, d):
    return fairness.demographic_parity(scored(spark, d))


@_query(f"WITH {SCORED} SELECT coalesce({r('max(rate) - min(rate)')}, 0.0) AS gap FROM (SELECT grp, {r(_RATE)} AS rate FROM scored GROUP BY grp)")
def statistical_parity_gap(spark, d):
    return fairness.gap(fairness.demographic_parity(scored(spark, d)), "rate")


@_query(f"WITH {SCORED} SELECT grp, {_TPR} AS tpr FROM scored WHERE {_SEV_T} GROUP BY grp")
def equal_opportunity(spark, d):
    return fairness.equal_opportunity(scored(spark, d))


@_query(f"WITH {SCORED} SELECT tpr_gap, fpr_gap, greatest(tpr_gap, fpr_gap) AS equalized_odds FROM (SELECT {r('max(t) - min(t)')} AS tpr_gap, {r('max(f) - min(f)')} AS fpr_gap FROM (SELECT {_TPR} AS t, {_FPR} AS f FROM scored GROUP BY grp))")
def equalized_odds(spark, d):
    return fairness.equalized_odds(scored(spark, d))


@_query(f"WITH {SCORED}, q AS (SELECT {r('hi - lo')} AS difference, {r('CASE WHEN hi = 0 THEN 1.0 ELSE lo / hi END')} AS ratio FROM (SELECT max(x) AS hi, min(x) AS lo FROM (SELECT {r(_RATE)} AS x FROM scored GROUP BY grp))) SELECT *, ratio >= 0.8 AS passes FROM q")
def disparate_impact(spark, d):
    return fairness.disparate_impact(scored(spark, d))


@_query(f"WITH {SCORED}, k AS (SELECT DISTINCT y_true AS c FROM scored UNION SELECT DISTINCT y_pred FROM scored) SELECT {r('avg(2.0 * tp / both_)')} AS macro_f1 FROM (SELECT c, count(*) FILTER (y_true = c AND y_pred = c) AS tp, count(*) FILTER (y_true = c) + count(*) FILTER (y_pred = c) AS both_ FROM k, scored GROUP BY c)")
def macro_f1(spark, d):
    return fairness.macro_f1(scored(spark, d))


@_query(f"WITH {SCORED}, {_BY_REC} SELECT coalesce(min(recall), 1.0) AS worst_recall FROM by_rec WHERE n_severe >= 20")
def worst_gated_recall(spark, d):
    return fairness.worst_gated_recall(fairness.subgroup_red_flag_recall(scored(spark, d)))


@_query(f"WITH {SCORED}, {_BY_REC} SELECT grp, recall, n_severe FROM by_rec WHERE n_severe >= 20 AND recall < 0.95")
def subgroup_shortfalls(spark, d):
    return fairness.shortfalls(fairness.subgroup_red_flag_recall(scored(spark, d)))


_THRESHOLDS = f"""sev AS (SELECT grp, y_pred <= 1 OR p_severe >= 1.0 AS now, CASE WHEN y_pred <= 1 OR p_severe >= 1.0 THEN 99 ELSE least(99, CAST(floor(p_severe * 100 + 1e-9) AS INTEGER)) END AS hit_at FROM scored WHERE y_true <= 1),
by_sev AS (SELECT grp, count(*) AS n, count(*) FILTER (now) AS hits FROM sev GROUP BY grp),
best AS (SELECT max(CAST(hits AS DOUBLE) / n) AS best FROM by_sev),
low AS (SELECT g.grp, coalesce(max(t.t), 30) / 100.0 AS threshold FROM by_sev g CROSS JOIN best
  LEFT JOIN (SELECT s.grp, t, count(*) FILTER (hit_at >= t) AS reached FROM sev s, range(30, 100) AS x(t) GROUP BY s.grp, t) t
    ON t.grp = g.grp AND CAST(t.reached AS DOUBLE) / g.n >= best.best - 1e-12
  WHERE CAST(g.hits AS DOUBLE) / g.n < best.best - 1e-12 GROUP BY g.grp),
thr AS (SELECT grp, coalesce(threshold, 1.0) AS threshold FROM (SELECT DISTINCT grp FROM scored) LEFT JOIN low USING (grp))"""


@_query(f"WITH {SCORED}, {_THRESHOLDS} SELECT grp, CAST(threshold AS DOUBLE) AS threshold FROM thr")
def threshold_search(spark, d):
    return fairness.opportunity_thresholds(scored(spark, d))


@_query(f"WITH {SCORED}, {_THRESHOLDS} SELECT s.row_id, y_pred, CASE WHEN y_pred > 1 AND p_severe >= coalesce(threshold, 1.0) THEN 1 ELSE y_pred END AS final FROM scored s LEFT JOIN thr USING (grp)")
def raise_only(spark, d):
    rows = scored(spark, d)
    return fairness.raise_only(rows, fairness.opportunity_thresholds(rows)).select("row_id", "y_pred", "final")


_PROBES = "probes AS (SELECT p_partkey AS probe, b AS band, s AS sex, CAST((p_size + p_partkey * 3 + b + CASE WHEN s = 'F' AND p_partkey % 10 = 0 THEN 1 ELSE 0 END) % 5 AS INTEGER) AS y_pred FROM part, range(4) AS x(b), (VALUES ('F'), ('M')) AS y(s))"


@_query(f"WITH {_PROBES} SELECT {r('avg(CAST(f.y_pred <> m.y_pred AS DOUBLE))')} AS flip_rate, {r('avg(abs(f.y_pred - m.y_pred))')} AS mean_delta, count(*) AS n FROM probes f JOIN probes m USING (probe, band) WHERE f.sex = 'F' AND m.sex = 'M'")
def sex_flips(spark, d):
    probes = spread(table(spark, d, "part").select("p_partkey", "p_size"), "p_partkey").select(F.col("p_partkey").alias("probe"), "p_size", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("band")).withColumn("sex", F.explode(F.array(F.lit("F"), F.lit("M"))))
    moved = F.when((F.col("sex") == "F") & (F.col("probe") % 10 == 0), 1).otherwise(0)
    rows = probes.withColumn("y_pred", ((F.col("p_size") + F.col("probe") * 3 + F.col("band") + moved) % 5).cast("int"))
    return fairness.sex_flips(rows, ["probe", "band"])


# -- calibration ------------------------------------------------------------------------


@_query(f"WITH {SCORED}, s AS (SELECT list_max(proba) AS conf, CAST(list_position(proba, list_max(proba)) - 1 = y_true AS DOUBLE) AS hit FROM scored), b AS (SELECT len(list_filter([0.1::DOUBLE, 0.2::DOUBLE, 0.3::DOUBLE, 0.4::DOUBLE, 0.5::DOUBLE, 0.6::DOUBLE, 0.7::DOUBLE, 0.8::DOUBLE, 0.9::DOUBLE], lambda e: conf > e)) AS bin, hit, conf FROM s) SELECT {r('sum(n * gap) / sum(n)')} AS ece FROM (SELECT count(*) AS n, abs(avg(hit) - avg(conf)) AS gap FROM b GROUP BY bin)")
def ece(spark, d):
    return calibration.expected_calibration_error(scored(spark, d))


@_query(f"WITH {SCORED} SELECT {r('avg(list_sum(list_transform(proba, lambda p, i: (p - CAST(i - 1 = y_true AS DOUBLE)) ** 2)))')} AS brier FROM scored")
def brier(spark, d):
    return calibration.brier(scored(spark, d))


@_query(f"WITH {SCORED} SELECT CASE WHEN list_max(proba) >= 0.70 THEN 'high' WHEN list_max(proba) >= 0.40 THEN 'moderate' ELSE 'low' END AS band, CAST(list_position(proba, list_max(proba)) - 1 AS INTEGER) AS top, count(*) AS n FROM scored GROUP BY ALL")
def confidence_bands(spark, d):
    rows = scored(spark, d)
    return rows.groupBy(calibration.confidence_band(F.array_max("proba")).alias("band"), argmax(F.col("proba")).alias("top")).agg(F.count(F.lit(1)).alias("n"))


# -- drift ------------------------------------------------------------------------------

_FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "is_open"]
_LONG = "long AS (SELECT f AS feature, CASE WHEN l_shipdate < TIMESTAMP '1998-01-01' THEN 'ref' ELSE 'cur' END AS side, v AS value FROM (SELECT l_shipdate, unnest(['l_quantity', 'l_extendedprice', 'l_discount', 'l_tax', 'is_open']) AS f, unnest([l_quantity, l_extendedprice, l_discount, l_tax, CAST(l_linestatus = 'O' AS DOUBLE)]) AS v FROM lineitem))"
_PSI = f"""{_LONG},
shape AS (SELECT feature, count(DISTINCT value) > 2 AS many, min(value) AS lo, max(value) AS hi,
  list_sort(list_distinct(list_transform(quantile_cont(value, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]), lambda q: {r('q', 6)}))) AS edges FROM long WHERE side = 'ref' GROUP BY feature),
binned AS (SELECT feature, side, many, CASE WHEN many THEN len(edges) - 1 WHEN lo = hi THEN 1 ELSE 2 END AS bins,
  CASE WHEN NOT many THEN CASE WHEN value = lo THEN 1 WHEN value = hi THEN 2 ELSE 3 END
       WHEN value BETWEEN edges[1] AND edges[-1] THEN greatest(least(len(list_filter(edges, lambda e: e <= value)), len(edges) - 1), 1) END AS bin
  FROM long JOIN shape USING (feature)),
cnt AS (SELECT feature, bin, max(bins) AS bins, count(*) FILTER (side = 'ref') AS e, count(*) FILTER (side = 'cur') AS a FROM binned WHERE bin IS NOT NULL GROUP BY feature, bin),
tot AS (SELECT feature, max(bins) AS bins, sum(e) AS ne, sum(a) AS na FROM cnt GROUP BY feature),
spine AS (SELECT feature, unnest(range(1, bins + 1)) AS bin FROM tot UNION SELECT feature, 3 FROM cnt WHERE bin = 3),
shares AS (SELECT feature, greatest(coalesce(e, 0) / greatest(ne, 1), 1e-6) AS e, greatest(coalesce(a, 0) / greatest(na, 1), 1e-6) AS a FROM spine JOIN tot USING (feature) LEFT JOIN cnt USING (feature, bin)),
psis AS (SELECT feature, {r('sum((a - e) * ln(a / e))', 6)} AS psi FROM shares GROUP BY feature)"""


def _psis(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").withColumn("is_open", (F.col("l_linestatus") == "O").cast("double"))
    side = F.when(F.col("l_shipdate") < F.lit("1998-01-01").cast("timestamp_ntz"), "ref").otherwise("cur")
    return drift.feature_psi(drift.long_form(rows, side, _FEATURES))


@_query(f"WITH {_PSI} SELECT feature, psi FROM psis")
def feature_psi(spark, d):
    return _psis(spark, d)


@_query(f"WITH {_PSI} SELECT max(psi) AS max_psi, {r('avg(psi)')} AS mean_psi, count(*) FILTER (psi >= 0.25) AS drifted, {r('avg(CAST(psi >= 0.25 AS DOUBLE))')} AS share, coalesce(string_agg(feature, ',' ORDER BY feature) FILTER (psi >= 0.25), '') AS features FROM psis")
def data_drift_detail(spark, d):
    return drift.drift_detail(_psis(spark, d))


_LEVELS = ["l_returnflag", "l_linenumber"]
_TESTS = f"""{_LONG},
seen AS (SELECT feature, value, count(*) FILTER (side = 'ref') AS r, count(*) FILTER (side = 'cur') AS c FROM long WHERE value IS NOT NULL AND NOT isnan(value) GROUP BY ALL),
steps AS (SELECT feature, sum(r) OVER w / sum(r) OVER (PARTITION BY feature) AS f, sum(c) OVER w / sum(c) OVER (PARTITION BY feature) AS g, sum(r) OVER (PARTITION BY feature) AS n, sum(c) OVER (PARTITION BY feature) AS m
  FROM seen WINDOW w AS (PARTITION BY feature ORDER BY value)),
ks AS (SELECT feature, max(abs(f - g)) AS d, any_value(n * m / (n + m)) AS e FROM steps GROUP BY feature),
lam AS (SELECT feature, d, (sqrt(e) + 0.12 + 0.11 / sqrt(e)) * d AS x FROM ks),
kp AS (SELECT feature, 'ks' AS test, d AS statistic, CASE WHEN x < 0.2 THEN 1.0 ELSE least(1.0, greatest(0.0, list_sum(list_transform(range(1, 101), lambda k: CASE WHEN k % 2 = 1 THEN 2.0 ELSE -2.0 END * exp(-2.0 * k * k * x * x))))) END AS p_value FROM lam),
lv AS (SELECT f AS feature, CASE WHEN l_shipdate < TIMESTAMP '1998-01-01' THEN 'ref' ELSE 'cur' END AS side, v AS value FROM (SELECT l_shipdate, unnest(['l_returnflag', 'l_linenumber']) AS f, unnest([l_returnflag, CAST(l_linenumber AS VARCHAR)]) AS v FROM lineitem)),
cl AS (SELECT feature, value, CAST(count(*) FILTER (side = 'ref') AS DOUBLE) AS r, CAST(count(*) FILTER (side = 'cur') AS DOUBLE) AS c FROM lv GROUP BY ALL),
ct AS (SELECT feature, sum(r) AS n, sum(c) AS m, count(*) - 1 AS df FROM cl GROUP BY feature),
cs AS (SELECT feature, any_value(df) AS df, sum((r - (r + c) * n / (n + m)) ** 2 / ((r + c) * n / (n + m)) + (c - (r + c) * m / (n + m)) ** 2 / ((r + c) * m / (n + m))) AS x FROM cl JOIN ct USING (feature) GROUP BY feature),
cp AS (SELECT feature, 'chi2' AS test, x AS statistic, least(1.0, list_sum(list_transform(range(0, df // 2), lambda i: exp(-x / 2) * (x / 2) ** i / CAST(factorial(CAST(i AS INTEGER)) AS DOUBLE)))) AS p_value FROM cs),
ps AS (FROM kp UNION ALL FROM cp),
holm AS (SELECT *, max(least(1.0, p_value * (k - i + 1))) OVER (ORDER BY i) AS adjusted FROM (SELECT *, row_number() OVER (ORDER BY p_value, feature) AS i, count(*) OVER () AS k FROM ps))"""


def _tests(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").withColumn("is_open", (F.col("l_linestatus") == "O").cast("double"))
    side = F.when(F.col("l_shipdate") < F.lit("1998-01-01").cast("timestamp_ntz"), "ref").otherwise("cur")
    return drift.column_drift(rows, side, _FEATURES, _LEVELS)


@_query(f"WITH {_TESTS} SELECT feature, test, {r('statistic', 6)} AS statistic, {r('p_value', 6)} AS p_value, {r('adjusted', 6)} AS adjusted, adjusted < 0.05 AS drifted FROM holm")
def column_drift(spark, d):
    return _tests(spark, d).select("feature", "test", *(rounded(F.col(c), 6).alias(c) for c in ("statistic", "p_value", "adjusted")), "drifted")


@_query(f"WITH {_TESTS} SELECT avg(CAST(adjusted < 0.05 AS DOUBLE)) >= 0.5 AS datasetDrift, {r('avg(CAST(adjusted < 0.05 AS DOUBLE))')} AS driftShare, count(*) FILTER (adjusted < 0.05) AS driftedColumns, count(*) AS columns FROM holm")
def dataset_drift(spark, d):
    return drift.dataset_drift(_tests(spark, d))


def _target_sql(label: str, name: str) -> str:
    return f"WITH {SCORED}, t AS (SELECT greatest(count(*) FILTER (side = 'ref'), 1) AS ne, greatest(count(*) FILTER (side = 'cur'), 1) AS na FROM scored), c AS (SELECT k, greatest(count(*) FILTER (side = 'ref' AND {label} = k) / max(ne), 1e-6) AS e, greatest(count(*) FILTER (side = 'cur' AND {label} = k) / max(na), 1e-6) AS a FROM range(5) AS x(k), scored, t GROUP BY k) SELECT {r('sum((a - e) * ln(a / e))', 6)} AS {name} FROM c"


@_query(_target_sql("y_true", "target_psi"))
def target_drift(spark, d):
    return drift.target_drift(scored(spark, d), label="y_true")


@_query(_target_sql("y_pred", "prediction_psi"))
def prediction_drift(spark, d):
    return drift.target_drift(scored(spark, d), label="y_pred", name="prediction_psi")


_CONCEPT = f"concept AS (SELECT {r(f'''avg(CASE WHEN side = 'ref' THEN CAST({_HIT} AS DOUBLE) END)''')} AS reference_accuracy, {r(f'''avg(CASE WHEN side = 'cur' THEN CAST({_HIT} AS DOUBLE) END)''')} AS current_accuracy FROM scored)"


@_query(f"WITH {SCORED}, {_CONCEPT} SELECT *, greatest(0.0, {r('reference_accuracy - current_accuracy')}) AS accuracy_drop FROM concept")
def concept_drift(spark, d):
    return drift.concept_drift(scored(spark, d))


# -- gates ------------------------------------------------------------------------------

_DRIFT_METRICS = """m AS (SELECT n_nationkey AS id, CASE WHEN n_nationkey % 5 = 4 THEN 'evidently' ELSE 'builtin' END AS backend, CASE WHEN n_nationkey % 7 <> 3 THEN n_nationkey * 0.02 END AS psi, n_nationkey * 0.03 AS share,
  CASE WHEN n_nationkey % 3 <> 0 THEN n_nationkey * 0.015 END AS target, 0.9 AS ref, CASE WHEN n_nationkey % 4 <> 1 THEN 0.9 - n_nationkey * 0.006 END AS cur FROM nation)"""


def _drift_rows(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("n_nationkey")
    lit = lambda f: k.cast("double") * f
    return table(spark, d, "nation").select(k.alias("id"), F.when(k % 5 == 4, "evidently").otherwise("builtin").alias("backend"), F.when(k % 7 != 3, lit(0.02)).alias("dataDriftPSI"), lit(0.03).alias("driftShare"), F.when(k % 3 != 0, lit(0.015)).alias("targetDriftPSI"), F.lit(0.9).alias("referenceAccuracy"), F.when(k % 4 != 1, 0.9 - lit(0.006)).alias("currentAccuracy"))


def _named(name: str, value: str) -> str:
    return f"{name} || '=' || coalesce(CAST({r(value)} AS VARCHAR), 'null')"


def _signal(name: str, value: str, bound: str) -> str:
    return f"{_named(name, value)} || ':' || CAST(coalesce({value} >= {bound}, false) AS VARCHAR)"


_DRIFT_GATE = f"""{_DRIFT_METRICS}, g AS (SELECT id, CASE WHEN backend = 'evidently' THEN share ELSE psi END AS v, CASE WHEN backend = 'evidently' THEN 0.5 ELSE 0.25 END AS b, CASE WHEN backend = 'evidently' THEN 'driftShare' ELSE 'dataDriftPSI' END AS n, target, ref - cur AS fell FROM m),
gate AS (SELECT id, v IS NULL OR coalesce(v >= b OR coalesce(target >= 0.25, false) OR coalesce(fell >= 0.1, false), false) AS breached,
  CASE WHEN v IS NULL THEN 'drift metric unavailable' WHEN v >= b THEN 'above threshold' ELSE 'below threshold' END AS reason,
  CASE WHEN v IS NULL THEN '' ELSE array_to_string([{_signal("n", "v", "b")}, {_signal("'targetDriftPSI'", "target", "0.25")}, {_signal("'accuracyDrop'", "fell", "0.1")}], ' ') END AS signals,
  CASE WHEN v IS NOT NULL THEN 'drift:' || CASE WHEN v >= b OR coalesce(target >= 0.25, false) OR coalesce(fell >= 0.1, false)
    THEN array_to_string(list_filter([CASE WHEN v >= b THEN {_named("n", "v")} END, CASE WHEN target >= 0.25 THEN {_named("'targetDriftPSI'", "target")} END, CASE WHEN fell >= 0.1 THEN {_named("'accuracyDrop'", "fell")} END], lambda x: x IS NOT NULL), ',') ELSE {_named("n", "v")} END END AS retrain_reason FROM g)"""


@_query(f"WITH {_DRIFT_GATE} SELECT id, breached, reason, signals FROM gate")
def drift_gate(spark, d):
    told = F.transform("signals", lambda s: F.concat(s["metric"], F.lit("="), F.coalesce(s["value"].cast("string"), F.lit("null")), F.lit(":"), s["breached"].cast("string")))
    return gates.drift_gate(_drift_rows(spark, d)).select("id", "breached", "reason", F.array_join(told, " ").alias("signals"))


@_query(f"WITH {_DRIFT_GATE} SELECT id, CASE WHEN reason = 'drift metric unavailable' THEN 'not_attempted' WHEN breached THEN 'triggered' ELSE 'not_needed' END AS retrain, retrain_reason FROM gate")
def retrain_decision(spark, d):
    out = gates.retrain_decision(gates.drift_gate(_drift_rows(spark, d)))
    return out.select("id", "retrain", "retrain_reason")


_AUDITS = "a AS (SELECT s_suppkey AS id, 0.7 + (s_suppkey % 10) * 0.03 AS accuracy, 0.9 + (s_suppkey % 7) * 0.015 AS recall, s_suppkey % 3 - 1 AS short, 0.2 + (s_suppkey % 5) * 0.05 AS before, 0.2 + (s_suppkey % 4) * 0.06 AS after, CASE WHEN s_suppkey % 11 <> 0 THEN 0.02 + (s_suppkey % 6) * 0.008 END AS ece, CASE WHEN s_suppkey % 13 <> 0 THEN 0.9 END AS agreement, 0.05 AS eo FROM supplier)"


@_query(f"""WITH {_AUDITS}, f AS (SELECT id, CASE WHEN accuracy < 0.75 THEN 'accuracy' WHEN recall < 0.95 THEN 'red_flag_recall' WHEN short <> 0 THEN 'subgroup_recall' WHEN after > before + 1e-9 THEN 'gap_widened' WHEN after > 0.35 THEN 'gap_ceiling'
 WHEN ece IS NULL OR ece > 0.05 THEN 'ece' WHEN agreement IS NULL OR agreement < 0.75 THEN 'agreement' WHEN eo > 0.1 THEN 'eo_gap' END AS failed FROM a) SELECT id, failed IS NULL AS passed, failed, CASE WHEN failed IS NULL THEN 'Staging' ELSE 'Development' END AS stage FROM f""")
def release_gate(spark, d):
    k = F.col("s_suppkey")
    step = lambda m, base, by: base + (k % m).cast("double") * by
    audits = table(spark, d, "supplier").select(k.alias("id"), step(10, 0.7, 0.03).alias("accuracy"), step(7, 0.9, 0.015).alias("red_flag_recall"), (k % 3 - 1).alias("shortfalls"), step(5, 0.2, 0.05).alias("gap_before"), step(4, 0.2, 0.06).alias("gap_after"), F.when(k % 11 != 0, step(6, 0.02, 0.008)).alias("ece"), F.when(k % 13 != 0, 0.9).alias("agreement"), F.lit(0.05).alias("eo_gap_after"))
    return gates.release_gate(audits, "id").withColumn("stage", gates.stage_for(F.col("passed")))


@_query(f"""WITH {_AUDITS} SELECT id, CASE WHEN accuracy >= 0.75 AND recall >= 0.95 THEN 'Staging' ELSE 'Development' END AS stage, CASE WHEN accuracy >= 0.75 AND recall >= 0.95 THEN 'passed' ELSE 'failed' END AS release_gate, printf('%.4f', accuracy) AS overall_accuracy, printf('%.4f', recall) AS red_flag_recall, CASE WHEN ece IS NOT NULL THEN printf('%.4f', ece) END AS calibration_ece, sha256(CAST(id AS VARCHAR)) AS model_sha256 FROM a""")
def version_tags(spark, d):
    k = F.col("s_suppkey")
    step = lambda m, base, by: base + (k % m).cast("double") * by
    rows = table(spark, d, "supplier").select(k.alias("id"), step(10, 0.7, 0.03).alias("accuracy"), step(7, 0.9, 0.015).alias("red_flag_recall"), F.when(k % 11 != 0, step(6, 0.02, 0.008)).alias("ece"), F.sha2(k.cast("string"), 256).alias("model_sha256"))
    return gates.version_tags(rows, (F.col("accuracy") >= 0.75) & (F.col("red_flag_recall") >= 0.95)).drop("accuracy", "ece")


@_query("SELECT p_partkey AS id, p_partkey % 3 <> 0 AND p_partkey % 5 <> 0 AS passed FROM part")
def pointer_gate(spark, d):
    k = F.col("p_partkey")
    rows = table(spark, d, "part").select(k.alias("id"), F.md5("p_name").alias("current"), F.when(k % 3 == 0, F.md5(F.concat("p_name", F.lit(" ")))).when(k % 5 != 0, F.md5("p_name")).alias("committed"))
    return gates.pointer_gate(rows).select("id", "passed")


@_query("SELECT o_custkey AS family, arg_max('m-' || CAST(o_orderkey AS VARCHAR), (o_orderdate, 'm-' || CAST(o_orderkey AS VARCHAR))) FILTER (o_orderkey % 3 <> 0 AND o_orderkey % 4 = 1) AS path FROM orders GROUP BY 1")
def newest_compatible(spark, d):
    k = F.col("o_orderkey")
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("family"), F.concat(F.lit("m-"), k.cast("string")).alias("path"), F.col("o_orderdate").alias("modified"), (k % 3 != 0).alias("compatible"), F.when(k % 4 < 2, k % 4 == 1).alias("intact"))
    return contracts.newest_compatible(rows)


@_query("SELECT n_nationkey AS id, m AS module, CASE m WHEN 'json' THEN 'available' ELSE 'not installed (' || m || ')' END AS status FROM (SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN 'json' ELSE 'no_such_backend_' || CAST(n_nationkey % 2 AS VARCHAR) END AS m FROM nation)")
def backend_status(spark, d):
    """Each nation's monitoring backend and whether it can be used."""
    module = F.when(F.col("n_nationkey") % 3 == 0, "json").otherwise(F.concat(F.lit("no_such_backend_"), (F.col("n_nationkey") % 2).cast("string")))
    wanted = table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), module.alias("module"))
    return wanted.join(contracts.backend_status(spark, ["json", "no_such_backend_0", "no_such_backend_1"]), "module").select("id", "module", "status")


_CANARY = "c AS (SELECT o_custkey AS ramp, o_orderkey AS step, CASE WHEN o_orderkey % 29 <> 0 THEN (o_orderkey % 101) / 9000.0 END AS err, CASE WHEN o_orderkey % 31 <> 0 THEN (o_orderkey % 103) / 5000.0 END AS tool FROM orders)"


@_query(f"WITH {_CANARY}, v AS (SELECT ramp, step, CASE WHEN err IS NULL OR tool IS NULL OR err > 0.01 OR tool > 0.02 THEN 'ABORT' ELSE 'PROCEED' END AS verdict FROM c) SELECT ramp, step, verdict FROM (SELECT *, coalesce(sum(CAST(verdict = 'ABORT' AS INTEGER)) OVER (PARTITION BY ramp ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM v) WHERE b = 0")
def canary_ramp(spark, d):
    k = F.col("o_orderkey")
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("ramp"), k.alias("step"), F.when(k % 29 != 0, (k % 101) / 9000.0).alias("errorRate"), F.when(k % 31 != 0, (k % 103) / 5000.0).alias("toolFailureRate"))
    return gates.canary_ramp(rows, "ramp").select("ramp", "step", "verdict")


@_query("SELECT p_partkey AS id, CASE WHEN p_partkey % 5 = 0 THEN true ELSE 0.9 + (p_partkey % 9) * 0.001 >= 0.902 - 0.005 AND 0.95 + (p_partkey % 4) * 0.002 >= 0.9601 - 0.005 END AS promoted FROM part")
def champion_challenger(spark, d):
    k = F.col("p_partkey")
    known = k % 5 != 0
    rows = table(spark, d, "part").select(k.alias("id"), (0.9 + (k % 9) * 0.001).alias("candidate_accuracy"), (0.95 + (k % 4) * 0.002).alias("candidate_recall"), F.when(known, 0.902).alias("champion_accuracy"), F.when(known, 0.9601).alias("champion_recall"))
    return gates.champion_challenger(rows).select("id", "promoted")


_JOBS = "jobs AS (SELECT o_custkey AS run, CAST(o_orderkey AS VARCHAR) AS name, CASE WHEN o_orderstatus = 'F' AND o_orderkey % 40 = 0 THEN 'failed' WHEN o_orderkey % 9 <> 0 THEN 'success' END AS status, o_orderkey % 80 = 0 AS allowed FROM orders)"


def _jobs(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select(F.col("o_custkey").alias("run"), k.cast("string").alias("name"), F.when((F.col("o_orderstatus") == "F") & (k % 40 == 0), "failed").when(k % 9 != 0, "success").alias("status"), (k % 80 == 0).alias("allow_failure"))


@_query(f"WITH {_JOBS}, g AS (SELECT run, count(name) AS total, count(*) FILTER (status = 'failed' AND NOT allowed) AS blocking, count(*) FILTER (status = 'failed' AND allowed) AS tolerated FROM jobs GROUP BY run) SELECT *, CASE WHEN total = 0 THEN 'UNKNOWN' WHEN blocking > 0 THEN 'FAILED' ELSE 'PASSED' END AS verdict FROM g")
def pipeline_digest(spark, d):
    return gates.pipeline_digest(_jobs(spark, d))


@_query(f"WITH {_JOBS} SELECT run, coalesce(status, 'unknown') AS status, count(*) AS n FROM jobs GROUP BY ALL")
def status_counts(spark, d):
    return gates.status_counts(_jobs(spark, d))


@_query("SELECT o_custkey AS run_id, arg_max(CAST(o_orderkey AS VARCHAR), o_orderkey) AS version FROM orders GROUP BY o_custkey")
def newest_version(spark, d):
    return gates.newest_version(table(spark, d, "orders").select(F.col("o_custkey").alias("run_id"), F.col("o_orderkey").cast("string").alias("version")))


# -- logs -------------------------------------------------------------------------------

_IDX = "list_position(['click', 'purchase', 'view', 'signup'], {}) - 1"
_LABELS = f"labels_ AS (SELECT case_id, arg_max({_IDX.format('label_code')}, seq) AS y_true FROM truth WHERE list_contains(['click', 'purchase', 'view', 'signup'], label_code) GROUP BY case_id)"
_JOINED = f"{LOGS}, {_LABELS}, joined AS (SELECT seq, case_id, CAST({_IDX.format('pred_code')} AS INTEGER) AS y_pred, CAST(y_true AS INTEGER) AS y_true, grp, age_provided FROM (SELECT * FROM log ORDER BY seq DESC LIMIT 5000) JOIN labels_ USING (case_id) WHERE list_contains(['click', 'purchase', 'view', 'signup'], pred_code))"


@_query(f"WITH {_JOINED} SELECT seq, case_id, y_pred, y_true FROM joined")
def labelled_join(spark, d):
    log, truth = logs(spark, d)
    return joins.labelled_join(log, truth, CODES).select("seq", "case_id", "y_pred", "y_true")


@_query(f"WITH {_JOINED}, g AS (SELECT {_ACC} AS a FROM joined GROUP BY grp) SELECT count(*) AS n, {_ACC} AS accuracy, coalesce({_TPR}, 1.0) AS red_flag_recall, (SELECT {r('max(a) - min(a)')} FROM g) AS gap, {r('CAST(count(*) FILTER (NOT age_provided) AS DOUBLE) / count(*)')} AS age_defaulted_share, CAST(NULL AS VARCHAR) AS note FROM joined")
def labelled_performance(spark, d):
    log, truth = logs(spark, d)
    return joins.labelled_performance(joins.labelled_join(log, truth, CODES))


@_query(f"WITH {LOGS} SELECT case_id, CAST(y AS INTEGER) AS y_true FROM (SELECT case_id, arg_max({_IDX.format('label_code')}, seq) AS y FROM truth WHERE list_contains(['click', 'purchase', 'view', 'signup'], label_code) GROUP BY case_id)")
def latest_label(spark, d):
    return joins.latest_label(logs(spark, d)[1], CODES)


@_query(f"WITH {LOGS} SELECT CAST(coalesce(nullif(list_position(['click', 'purchase', 'view', 'signup'], pred_code), 0) - 1, 2) AS INTEGER) AS y_pred, count(*) AS n FROM log GROUP BY 1")
def unknown_codes(spark, d):
    return logs(spark, d)[0].groupBy(joins.class_index(F.col("pred_code"), CODES, 2).alias("y_pred")).agg(F.count(F.lit(1)).alias("n"))


@_query("SELECT event_id AS seq, event_type FROM events ORDER BY event_id DESC LIMIT 5000")
def tail_n(spark, d):
    return log_source.tail(table(spark, d, "events").select(F.col("event_id").alias("seq"), "event_type"))


@_query("SELECT o_orderkey AS id, coalesce(nullif(o_orderpriority, '3-MEDIUM'), '') AS text FROM orders WHERE o_orderstatus = 'P'")
def pending_rows(spark, d):
    o = table(spark, d, "orders")
    store = o.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "P", "pending").otherwise("done").alias("status"), F.lit("").alias("normalised"), F.nullif("o_orderpriority", F.lit("3-MEDIUM")).alias("summary"))
    return log_source.pending(store).select("id", "text")


_RESCORE = f"{SCORED}, rs AS (SELECT CASE WHEN row_id % 6 <> 0 THEN y_true END AS b, y_pred AS a, CASE WHEN row_id % 10 = 0 THEN '  ' ELSE 'x' END AS text FROM scored)"


@_query(f"WITH {_RESCORE} SELECT count(*) FILTER (trim(text) <> '') AS scored, count(*) FILTER (trim(text) = '') AS failed, count(*) FILTER (trim(text) <> '' AND a < b) AS more_urgent, count(*) FILTER (trim(text) <> '' AND a > b) AS less_urgent, count(*) FILTER (trim(text) <> '' AND (b IS NULL OR a = b)) AS unchanged FROM rs")
def batch_rescore(spark, d):
    k = F.col("row_id")
    rows = scored(spark, d).select(F.when(k % 6 != 0, F.col("y_true")).alias("before"), F.col("y_pred").alias("after"), F.when(k % 10 == 0, "  ").otherwise("x").alias("text"))
    return joins.batch_rescore(rows)


@_query(f"WITH {SCORED} SELECT row_id, y_pred FROM scored WHERE y_pred < y_true")
def needs_review(spark, d):
    rows = scored(spark, d)
    return rows.where(joins.rescore_direction(F.col("y_true"), F.col("y_pred")) == "more_urgent").select("row_id", "y_pred").orderBy("y_pred", "row_id")


@_query("SELECT r_name AS name, CASE WHEN r_regionkey % 2 = 0 THEN 'purpose ' || r_name ELSE '-' END AS purpose, CASE WHEN r_regionkey < 3 THEN 'ok' ELSE 'not run' END AS status FROM region")
def jobs_with_defaults(spark, d):
    jobs = table(spark, d, "region").select(F.col("r_name").alias("name"), "r_regionkey")
    purposes = jobs.where("r_regionkey % 2 = 0").select("name", F.concat(F.lit("purpose "), "name").alias("purpose"))
    return joins.with_defaults(jobs.select("name"), purposes, jobs.where("r_regionkey < 3").select("name", F.lit("ok").alias("status")))


# -- snapshots --------------------------------------------------------------------------


@_query(f"WITH {SCORED} SELECT y_true, count(*) AS n FROM scored GROUP BY 1")
def label_balance(spark, d):
    return snapshot.balance(scored(spark, d), "y_true")


@_query(f"WITH {SCORED} SELECT grp, count(*) AS n FROM scored GROUP BY 1")
def subgroup_balance(spark, d):
    return snapshot.balance(scored(spark, d), "grp")


_STATS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@_query(" UNION ALL ".join(f"SELECT '{c}' AS feature, {r(f'min({c})', 6)} AS lo, {r(f'max({c})', 6)} AS hi, {r(f'avg({c})', 6)} AS mean, {r(f'stddev_pop({c})', 6)} AS std FROM lineitem" for c in _STATS))
def feature_statistics(spark, d):
    return snapshot.feature_statistics(table(spark, d, "lineitem"), _STATS)


_HASHED = """h AS (SELECT sha256(concat_ws('|', CAST(o_orderkey AS VARCHAR), CAST(o_custkey AS VARCHAR), o_orderpriority)) AS h FROM orders),
whole AS (SELECT sha256(concat_ws('|', """ + ", ".join(f"CAST(sum(CAST(('0x' || substr(h, {8 * i + 1}, 8)) AS BIGINT)) AS VARCHAR)" for i in range(8)) + """, CAST(count(*) AS VARCHAR))) AS sha256, count(*) AS n FROM h)"""
_HASH_COLUMNS = ["o_orderkey", "o_custkey", "o_orderpriority"]


@_query(f"WITH {_HASHED} SELECT sha256, n, left(sha256(sha256 || '|rf/200'), 12) AS version FROM whole")
def content_hash(spark, d):
    out = snapshot.content_hash(table(spark, d, "orders"), _HASH_COLUMNS)
    return out.withColumn("version", snapshot.version_id(F.col("sha256"), "rf/200"))


def _hashes(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """Content hashes of the orders: recorded, made again in another layout, with one row altered, without one row, and none."""
    orders = table(spark, d, "orders")
    key = F.col("o_orderkey")
    last = orders.agg(F.max("o_orderkey")).first()[0]
    made = {
        "recorded": orders,
        "again": orders.repartition(7, "o_custkey"),
        "altered": orders.withColumn("o_orderpriority", F.when(key == last, F.lit("x")).otherwise(F.col("o_orderpriority"))),
        "shorter": orders.where(key != last),
    }
    return {k: snapshot.content_hash(v, _HASH_COLUMNS) for k, v in made.items()} | {"none": spark.createDataFrame([], "sha256 string")}


_CASES = ("recorded", "again", "altered", "shorter", "none")


@_query("SELECT * FROM (VALUES ('recorded', true), ('again', true), ('altered', false), ('shorter', false), ('none', false)) AS t(kase, intact)")
def lineage(spark, d):
    h = _hashes(spark, d)
    return reduce(DataFrame.unionByName, [gates.lineage(h["recorded"], h[k], h["recorded"]).withColumn("kase", F.lit(k)) for k in _CASES])


@_query("SELECT * FROM (VALUES ('recorded', 'match'), ('again', 'match'), ('altered', 'mismatch'), ('shorter', 'mismatch'), ('none', 'no_baseline')) AS t(kase, status)")
def snapshot_reproducible(spark, d):
    h = _hashes(spark, d)
    return reduce(DataFrame.unionByName, [gates.reproducible(h[k], h["recorded"]).withColumn("kase", F.lit(k)) for k in _CASES])


@_query("""WITH v AS (SELECT l_discount AS a, l_tax AS b, l_quantity / 50.0 AS c, CAST(l_linenumber % 5 AS INTEGER) AS y FROM lineitem), c AS (SELECT y, count(*) AS n FROM v GROUP BY y)
SELECT 0 AS ord, 'finite' AS rule, (SELECT count(*) FILTER (a IS NULL OR b IS NULL OR c IS NULL) = 0 FROM v) AS passed UNION ALL SELECT 1, 'in_unit_range', (SELECT count(*) FILTER (NOT (a BETWEEN 0 AND 1 AND b BETWEEN 0 AND 1 AND c BETWEEN 0 AND 1)) = 0 FROM v)
UNION ALL SELECT 2, 'known_labels', (SELECT count(*) FILTER (y NOT BETWEEN 0 AND 4) = 0 FROM v) UNION ALL SELECT 3, 'class_rows', (SELECT min(n) >= 100 FROM c) UNION ALL SELECT 4, 'class_share', (SELECT max(n) <= 0.6 * sum(n) FROM c)""")
def data_validation(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_discount").alias("a"), F.col("l_tax").alias("b"), (F.col("l_quantity") / 50.0).alias("c"), (F.col("l_linenumber") % 5).cast("int").alias("y"))
    return snapshot.validation(rows, ["a", "b", "c"])


@_query("""WITH v AS (SELECT l_orderkey % 4 AS kase, CASE WHEN l_orderkey % 4 = 0 THEN l_quantity WHEN l_orderkey % 4 = 1 AND l_linenumber = 6 THEN NULL ELSE l_discount END AS a, CASE WHEN l_orderkey % 4 = 2 AND l_linenumber = 7 THEN 9 ELSE CAST(l_linenumber % 5 AS INTEGER) END AS y FROM lineitem),
n AS (SELECT kase, y, count(*) AS n FROM v GROUP BY ALL), c AS (SELECT kase, min(n) >= 100 AS enough, max(n) <= 0.6 * sum(n) AS even FROM n GROUP BY kase)
SELECT kase, failed_rule IS NULL AS passed, failed_rule FROM (SELECT kase, CASE WHEN count(*) FILTER (a IS NULL) > 0 THEN 'finite' WHEN count(*) FILTER (NOT a BETWEEN 0 AND 1) > 0 THEN 'in_unit_range' WHEN count(*) FILTER (y NOT BETWEEN 0 AND 4) > 0 THEN 'known_labels' WHEN NOT any_value(enough) THEN 'class_rows' WHEN NOT any_value(even) THEN 'class_share' END AS failed_rule FROM v JOIN c USING (kase) GROUP BY kase)""")
def data_validation_gate(spark, d):
    key, line = F.col("l_orderkey") % 4, F.col("l_linenumber")
    a = F.when(key == 0, F.col("l_quantity")).when((key == 1) & (line == 6), F.lit(None)).otherwise(F.col("l_discount"))
    rows = table(spark, d, "lineitem").select(key.alias("kase"), a.alias("a"), F.when((key == 2) & (line == 7), 9).otherwise((line % 5).cast("int")).alias("y"))
    return reduce(DataFrame.unionByName, [snapshot.first_failure(snapshot.validation(rows.where(F.col("kase") == k), ["a"])).withColumn("kase", F.lit(k).cast("long")) for k in range(4)])


def _rank_sql(seed: str) -> str:
    return f"{SCORED}, ranked AS (SELECT row_id, y_true, row_number() OVER (PARTITION BY y_true ORDER BY md5('{seed}:' || CAST(row_id AS VARCHAR)), row_id) - 1 AS rk, count(*) OVER (PARTITION BY y_true) AS n FROM scored)"


@_query(f"WITH {_rank_sql('split')} SELECT row_id, y_true, CASE WHEN rk < (n * 25 * 2 + 100) // 200 THEN 'test' ELSE 'train' END AS part FROM ranked")
def stratified_split(spark, d):
    return snapshot.stratified_split(scored(spark, d).select("row_id", "y_true"), "row_id", "y_true")


@_query(f"WITH {_rank_sql('fold')} SELECT row_id, y_true, CAST(rk % 5 AS INTEGER) AS fold FROM ranked")
def kfold_assign(spark, d):
    return snapshot.stratified_folds(scored(spark, d).select("row_id", "y_true"), "row_id", "y_true")


@_query(f"WITH {_rank_sql('over')}, m AS (SELECT max(n) AS most FROM ranked) SELECT row_id, y_true, CAST(unnest(range(0, 1 + greatest(0, CAST(ceil((most - n - rk) / n) AS INTEGER)))) AS INTEGER) AS copy FROM ranked, m")
def oversample_parity(spark, d):
    return snapshot.oversample(scored(spark, d).select("row_id", "y_true"), "row_id", "y_true")


@_query(f"WITH {SCORED} SELECT row_id FROM scored ORDER BY md5('sample:' || CAST(row_id AS VARCHAR)), row_id LIMIT 160")
def row_sample(spark, d):
    return snapshot.sample_rows(scored(spark, d).select("row_id"), "row_id", 160)


@_query(f"WITH {SCORED} SELECT row_id, CASE WHEN y_true <= 1 AND CAST(('0x' || left(md5('flip:' || CAST(row_id AS VARCHAR)), 7)) AS INTEGER) % 100 < 20 THEN 4 ELSE y_true END AS poisoned FROM scored")
def label_flips(spark, d):
    rows = scored(spark, d).select("row_id", F.col("y_true").alias("y"))
    return snapshot.flip_labels(rows, "row_id", 20).select("row_id", "poisoned")


@_query("SELECT l_orderkey AS k, 'a' AS side FROM lineitem WHERE l_quantity < 10 UNION ALL SELECT o_orderkey, 'b' FROM orders WHERE o_orderstatus = 'P'")
def union_all(spark, d):
    a = table(spark, d, "lineitem").where("l_quantity < 10").select(F.col("l_orderkey").alias("k"), F.lit("a").alias("side"))
    return a.unionByName(table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("k"), F.lit("b").alias("side")))


@_query(f"WITH {SCORED} SELECT DISTINCT grp FROM scored")
def group_list(spark, d):
    return scored(spark, d).select("grp").distinct().orderBy("grp")


# -- telemetry --------------------------------------------------------------------------

_TYPES = "(VALUES ('click'), ('error'), ('purchase'), ('signup'), ('view'), ('refund')) AS t(event_type)"


@_query(f"SELECT t.event_type, count(e.event_id) AS n FROM {_TYPES} LEFT JOIN events e USING (event_type) GROUP BY 1")
def counter_series(spark, d):
    spine = spark.createDataFrame([(x,) for x in ("click", "error", "purchase", "signup", "view", "refund")], "event_type string")
    return telemetry.counter(table(spark, d, "events"), ["event_type"], spine)


@_query("WITH b AS (SELECT unnest([10.0, 50.0, 100.0, 250.0, NULL]) AS le) SELECT event_type, CAST(le AS DOUBLE) AS le, count(value) FILTER (le IS NULL OR value <= le) AS n FROM events, b GROUP BY ALL")
def histogram_buckets(spark, d):
    return telemetry.histogram(table(spark, d, "events"), "value", [10.0, 50.0, 100.0, 250.0], ["event_type"])


@_query("SELECT user_id, arg_max(value, event_id) AS value FROM events GROUP BY 1")
def gauge_last(spark, d):
    return telemetry.gauge(table(spark, d, "events"), ["user_id"], "value", "event_id")


@_query("SELECT CASE WHEN event_type = 'error' THEN 'unknown' ELSE event_type END AS acuity, count(*) AS n, floor(avg(greatest(0.0, least(1.0, value / 100.0))) * 10000.0 + 0.5) / 10000.0 AS confidence FROM events GROUP BY 1")
def observed_predictions(spark, d):
    acuity, conf = telemetry.observed(F.when(F.col("event_type") == "error", F.lit("  ")).otherwise(F.col("event_type")), F.col("value") / 100.0)
    return table(spark, d, "events").select(acuity.alias("acuity"), conf.alias("c")).groupBy("acuity").agg(F.count(F.lit(1)).alias("n"), rounded(F.avg("c")).alias("confidence"))


@_query("SELECT event_type AS model, CAST(sum(greatest(event_id % 50 - 5, 0)) AS BIGINT) AS prompt, CAST(sum(event_id % 30) AS BIGINT) AS completion, floor(coalesce(sum(CASE WHEN event_id % 3 <> 0 THEN value END), 0.0) * 10000.0 + 0.5) / 10000.0 AS cost, count(*) FILTER (event_id % 3 <> 0) AS priced FROM events GROUP BY 1")
def token_usage(spark, d):
    k = F.col("event_id")
    calls = table(spark, d, "events").select(F.col("event_type").alias("model"), (k % 50 - 5).alias("prompt"), (k % 30).alias("completion"), F.when(k % 3 != 0, F.col("value")).alias("cost"))
    return telemetry.usage(calls)


@_query("SELECT event_type, event_type = 'error' AS failed, count(*) AS n, floor(avg(value) * 10000.0 + 0.5) / 10000.0 AS mean FROM events GROUP BY 1, 2")
def latency_by_outcome(spark, d):
    return telemetry.latency(table(spark, d, "events").withColumn("failed", F.col("event_type") == "error"), ["event_type", "failed"], "value")


@_query("SELECT event_type, CASE WHEN event_id % 5 = 0 THEN 'not_applicable' WHEN value > 50 THEN 'present' ELSE 'degraded' END AS state, count(*) AS n FROM events GROUP BY ALL")
def component_states(spark, d):
    rows = table(spark, d, "events").withColumn("ok", F.when(F.col("event_id") % 5 != 0, F.col("value") > 50))
    return telemetry.component_states(rows, "ok", "event_type")


# -- text -------------------------------------------------------------------------------

_CLAUSES = "cl AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[.,;:!?]'), lambda c: trim(c, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) <> '') AS c FROM documents)"


@_query(f"WITH {_CLAUSES} SELECT doc_id, CAST(len(c) AS INTEGER) AS n_clauses, coalesce(list_sum(list_transform(c, lambda x: len(regexp_extract_all(x, '[a-z'']+')))), 0)::INTEGER AS n_tokens FROM cl")
def clause_tokens(spark, d):
    c = matching.clauses(F.col("text"))
    total = F.aggregate(F.transform(c, lambda x: F.size(matching.tokens(x))), F.lit(0), lambda s, n: s + n)
    return table(spark, d, "documents").select("doc_id", F.size(c).alias("n_clauses"), total.alias("n_tokens"))


@_query("WITH s AS (SELECT conv_id, turn, string_split(text, '') AS l FROM conversations) SELECT conv_id, turn, array_to_string(list_filter(l, lambda x, i: i = 1 OR l[i - 1] <> x), '') AS collapsed FROM s")
def repeat_collapse(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", matching.collapse(F.col("text")).alias("collapsed"))


#: A small lexicon of frequent words of the provided texts; real ones come from the caller.
LEXICON = {"motion": ("tion was", "tion by", "attion"), "order": ("ering",), "self": ("that are", "that is"), "denial": ("not heat", "the heat")}
_TIER1 = """ph AS (SELECT * FROM (VALUES ('motion', 'tion was'), ('motion', 'tion by'), ('motion', 'attion'), ('order', 'ering'), ('self', 'that are'), ('self', 'that is'), ('denial', 'not heat'), ('denial', 'the heat')) AS t(category, phrase)),
ex AS (SELECT DISTINCT doc_id, unnest(c) AS c FROM cl),
pos AS (SELECT doc_id, category, phrase, c, unnest(list_filter(range(1, len(c) - len(phrase) + 2), lambda i: substr(c, i, len(phrase)) = phrase)) AS p FROM ex JOIN ph ON contains(c, phrase)),
bf AS (SELECT *, list_reverse(regexp_extract_all(substr(c, 1, p - 1), '[a-z'']+')) AS t, substr(c, p + len(phrase)) AS after FROM pos),
wn AS (SELECT *, t[1:least(3, coalesce(list_min(list_filter([list_position(t, 'and'), list_position(t, 'but')], lambda x: x > 0)) - 1, len(t)))] AS w FROM bf),
ok AS (SELECT doc_id, category FROM wn WHERE NOT coalesce(len(list_filter(w, lambda x: x IN ('no', 'not', 'without', 'denies', 'denied', 'deny', 'never', 'negative') OR ends_with(x, 'n''t'))) > 0
  AND NOT coalesce(w[1] IN ('stop', 'stopping', 'stopped'), false)
  AND NOT (list_contains(w, 'never') AND (contains(after, 'like this') OR contains(after, 'this bad') OR contains(after, 'so bad') OR contains(after, 'before') OR contains(after, 'as bad'))), false))"""


@_query(f"WITH {_CLAUSES}, {_TIER1} SELECT doc_id, coalesce(string_agg(DISTINCT category, ',' ORDER BY category), '') AS flags FROM documents LEFT JOIN ok USING (doc_id) GROUP BY doc_id")
def keyword_flags(spark, d):
    out = textfeat.category_flags(table(spark, d, "documents").select("doc_id", "text"), LEXICON, tiers=1)
    return out.select("doc_id", F.array_join("flags", ",").alias("flags"))


@_query()
def fuzzy_flags(spark, d):
    out = textfeat.category_flags(table(spark, d, "conversations").select("conv_id", "turn", "text"), LEXICON)
    return out.select("conv_id", "turn", F.array_join("flags", ",").alias("flags"))


@_query(f"WITH {_CLAUSES}, {_TIER1} SELECT floor(avg(CAST(doc_id NOT IN (SELECT doc_id FROM ok) AS DOUBLE)) * 10000.0 + 0.5) / 10000.0 AS zero_coverage_rate FROM documents")
def coverage_rate(spark, d):
    return textfeat.coverage_rate(textfeat.category_flags(table(spark, d, "documents").select("doc_id", "text"), LEXICON, tiers=1))


@_query(f"WITH {_CLAUSES}, {_TIER1}, f AS (SELECT doc_id, count(DISTINCT category) AS k FROM documents LEFT JOIN ok USING (doc_id) GROUP BY doc_id) SELECT doc_id, least(k, 6) / 6.0::DOUBLE AS symptom_count, least(len(lower(text)), 400) / 400.0::DOUBLE AS text_length, '40-64' AS age_band, 0.0::DOUBLE AS sex_female, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) >= 3 AND k = 0 AS uncovered FROM f JOIN documents USING (doc_id)")
def text_features(spark, d):
    flagged = textfeat.category_flags(table(spark, d, "documents").select("doc_id", "text"), LEXICON, tiers=1)
    out = textfeat.features(flagged).withColumn("uncovered", textfeat.uncovered(F.col("text"), F.col("flags")))
    return out.select("doc_id", "symptom_count", "text_length", "age_band", "sex_female", "uncovered")


# The three above are tier 1, as their SQL says; these are the whole matcher over the same documents.

@_query()
def fuzzy_document_flags(spark, d):
    out = textfeat.category_flags(table(spark, d, "documents").select("doc_id", "text"), LEXICON)
    return out.select("doc_id", F.array_join("flags", ",").alias("flags"))


@_query()
def fuzzy_coverage_rate(spark, d):
    return textfeat.coverage_rate(textfeat.category_flags(table(spark, d, "documents").select("doc_id", "text"), LEXICON))


@_query()
def fuzzy_text_features(spark, d):
    flagged = textfeat.category_flags(table(spark, d, "documents").select("doc_id", "text"), LEXICON)
    out = textfeat.features(flagged).withColumn("uncovered", textfeat.uncovered(F.col("text"), F.col("flags")))
    return out.select("doc_id", "symptom_count", "text_length", "age_band", "sex_female", "uncovered")


_EXACT = ["anti_histone", "stomach"]


@_query(f"""WITH k AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z'']+')) AS w FROM benchmark), t AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z'']+')) AS w FROM documents)
SELECT k.w AS keyword, t.w AS token FROM k JOIN t ON left(k.w, 3) = left(t.w, 3) WHERE k.w = t.w OR (len(t.w) >= {matching.FUZZY_LENGTH} AND t.w NOT IN ('anti_histone', 'stomach') AND ((len(k.w) >= {matching.PREFIX} AND len(t.w) >= {matching.PREFIX} AND left(k.w, {matching.PREFIX}) = left(t.w, {matching.PREFIX}))
 OR (len(t.w) >= {matching.EDIT_LENGTH} AND len(k.w) >= {matching.EDIT_PREFIX} AND left(k.w, {matching.EDIT_PREFIX}) = left(t.w, {matching.EDIT_PREFIX}) AND levenshtein(k.w, t.w) <= 1)))""")
def same_words(spark, d):
    """Which words of the documents count as a word of the benchmark; whatever is the same shares the first three letters."""
    words = lambda name: table(spark, d, name).select(F.explode(matching.tokens(F.lower("text"))).alias("w")).distinct()
    start = lambda c: F.left(F.col(c), F.lit(matching.EDIT_PREFIX))
    keywords = words("benchmark").select(F.col("w").alias("keyword"), start("w").alias("start"))
    tokens = words("documents").select(F.col("w").alias("token"), start("w").alias("start"))
    return keywords.join(tokens, "start").where(matching.same_word(F.col("keyword"), F.col("token"), _EXACT)).select("keyword", "token")


_VEC = "v AS (SELECT l_orderkey, l_linenumber, [CAST(l_linenumber % 2 AS DOUBLE), CAST(l_quantity > 25 AS DOUBLE), least(l_linenumber % 2 + CAST(l_quantity > 25 AS INTEGER), 6) / 6.0 + CASE WHEN l_tax > 0.07 THEN 0.1 ELSE 0 END, l_discount, CAST(l_linenumber % 4 = 0 AS DOUBLE), CAST(l_linenumber % 4 = 1 AS DOUBLE), CAST(l_linenumber % 4 = 2 AS DOUBLE), CAST(l_linenumber % 4 = 3 AS DOUBLE), CAST(l_returnflag = 'R' AS DOUBLE)] AS x, l_tax FROM lineitem)"


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    n, q = F.col("l_linenumber"), (F.col("l_quantity") > 25).cast("double")
    count = (n % 2 + q) / 6.0 + F.when(F.col("l_tax") > 0.07, 0.1).otherwise(0.0)
    ages = [(n % 4 == k).cast("double") for k in range(4)]
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_tax", F.array((n % 2).cast("double"), q, count, F.col("l_discount"), *ages, (F.col("l_returnflag") == "R").cast("double")).alias("x"))


@_query(f"WITH {_VEC} SELECT l_tax <= 0.07 AS valid, count(*) AS n FROM v GROUP BY 1")
def vector_validity(spark, d):
    return _vectors(spark, d).groupBy(textfeat.vector_valid(F.col("x"), 2).alias("valid")).agg(F.count(F.lit(1)).alias("n"))


@_query("SELECT ['0-17', '18-39', '40-64', '65+'][l_linenumber % 4 + 1] || ' · ' || CASE WHEN l_returnflag = 'R' THEN 'Female' ELSE 'Male' END AS grp, count(*) AS n FROM lineitem GROUP BY 1")
def subgroup_decode(spark, d):
    return _vectors(spark, d).groupBy(textfeat.group_of_vector(F.col("x"), 2).alias("grp")).agg(F.count(F.lit(1)).alias("n"))


@_query("SELECT p_partkey, CASE WHEN p_brand = 'Brand#1' THEN 'First brand' ELSE replace(p_name, '_', ' ') END AS label FROM part")
def display_labels(spark, d):
    return table(spark, d, "part").select("p_partkey", textfeat.label_of(F.when(F.col("p_brand") == "Brand#1", "Brand#1").otherwise(F.col("p_name")), {"Brand#1": "First brand"}).alias("label"))


# -- personal data ----------------------------------------------------------------------

# RE2 has no look-around: what stands before and after is matched and put back, twice, as neighbours share it.
_W, _D, _S = r"\p{L}\p{N}_", r"\p{Nd}", r"[\s\x0b\x1c-\x1f\x85\p{Z}]"
_SHAPES = {
    "NRIC": rf"(?i)(^|[^{_W}])[STFGM]{_D}{{7}}[A-Z]($|[^{_W}])",
    "PHONE": rf"(^|[^{_D}+-])(?:\+{_D}{{1,3}}(?:{_S}|-)?{_D}{{2,4}}(?:(?:{_S}|-)?{_D}{{2,4}}){{1,3}}|(?:\+?65(?:{_S}|-)?)?[3689]{_D}{{3}}(?:{_S}|-)?{_D}{{4}})($|[^{_D}-])",
    "MRN": rf"(^|[^{_W}]){_D}{{7,}}($|[^{_W}])",
}
#: An address begins and ends with a word character in the texts; the greedy tail gives back what isn't.
_MAIL = rf"(^|[^{_W}])([.+-]*)[{_W}][{_W}.+-]*@[{_W}-]+\.[{_W}.-]*[{_W}]"


def _masked(kind: str, text: str) -> str:
    if kind == "EMAIL":
        return f"regexp_replace({text}, '{_MAIL}', '\\1\\2[REDACTED_EMAIL]', 'g')"
    once = lambda t: f"regexp_replace({t}, '{_SHAPES[kind]}', '\\1[REDACTED_{kind}]\\2', 'g')"
    return once(once(text))


_REDACTED = f"""a AS (SELECT doc_id, text AS t0, {_masked('NRIC', 'text')} AS t1 FROM documents), b AS (SELECT *, {_masked('EMAIL', 't1')} AS t2 FROM a), c AS (SELECT *, {_masked('PHONE', 't2')} AS t3 FROM b), d AS (SELECT *, {_masked('MRN', 't3')} AS t4 FROM c)"""


@_query(f"WITH {_REDACTED} SELECT doc_id, t1 <> t0 AS nric, t2 <> t1 AS email, t3 <> t2 AS phone, t4 <> t3 AS mrn FROM d")
def redact_kinds(spark, d):
    out = redaction.redact(table(spark, d, "documents").select("doc_id", "text"))
    return out.select("doc_id", *[F.array_contains("kinds", k).alias(k.lower()) for k in redaction.KINDS])


@_query(f"WITH {_REDACTED} SELECT doc_id, sha256(t4) AS masked_sha256, array_to_string(list_filter([CASE WHEN t1 <> t0 THEN 'NRIC' END, CASE WHEN t2 <> t1 THEN 'EMAIL' END, CASE WHEN t3 <> t2 THEN 'PHONE' END, CASE WHEN t4 <> t3 THEN 'MRN' END], lambda x: x IS NOT NULL), ',') AS kinds FROM d")
def redact_mask(spark, d):
    return redaction.redact(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", F.sha2("masked", 256).alias("masked_sha256"), F.array_join("kinds", ",").alias("kinds"))


@_query("SELECT event_id, 'v' AS field, event_type AS value FROM events UNION ALL SELECT event_id, 'tags', 'u' || CAST(user_id AS VARCHAR) FROM events")
def json_string_leaves(spark, d):
    e = table(spark, d, "events")
    body = F.to_json(F.struct(F.col("event_type").alias("v"), F.col("value").alias("n"), F.struct(F.array(F.concat(F.lit("u"), F.col("user_id").cast("string"))).alias("tags")).alias("inner")))
    return redaction.json_strings(e.select("event_id", body.alias("body"))).select("event_id", "field", "value")


_NOTES = {0: ("mail u{}@example.org", "EMAIL", "mail [REDACTED_EMAIL]"), 1: ("card S{}A", "NRIC", "card [REDACTED_NRIC]"), 2: ("ring 9{}", "PHONE", "ring [REDACTED_PHONE]"), 3: ("file 111{}", "MRN", "file [REDACTED_MRN]")}


@_query(f"""WITH e AS (SELECT CAST(user_id AS VARCHAR) || CASE CAST(user_id % 3 AS INTEGER) WHEN 0 THEN '.json' WHEN 1 THEN '.jsonl' ELSE '.txt' END AS name, event_id % 5 AS k, user_id % 3 AS f FROM events)
SELECT name, CASE WHEN f < 2 THEN 'note' END AS field, ['EMAIL', 'NRIC', 'PHONE', 'MRN'][k + 1] AS kind, CASE WHEN f < 2 THEN '' ELSE 'plain ' END || ['{_NOTES[0][2]}', '{_NOTES[1][2]}', '{_NOTES[2][2]}', '{_NOTES[3][2]}'][k + 1] AS excerpt, count(*) AS n FROM e WHERE k < 4 GROUP BY ALL""")
def egress_scan(spark, d):
    """Documents of all three kinds, with one identifier of each kind and machine tokens that are none."""
    k, u = F.col("event_id"), F.col("user_id")
    seven = F.lpad(k.cast("string"), 7, "0")
    note = F.lit("nothing")
    for i, (shape, _, _) in _NOTES.items():
        head, tail = shape.split("{}")
        note = F.when(k % 5 == i, F.concat(F.lit(head), seven, F.lit(tail))).otherwise(note)
    body = F.to_json(F.struct(F.concat(F.lit("case_"), F.lpad(k.cast("string"), 10, "0")).alias("caseId"), F.lit("2024-01-01T00:00:00Z").alias("ts"), note.alias("note")))
    made = F.when(u % 3 == 2, F.concat(F.lit("plain "), note)).otherwise(body)
    name = F.concat(u.cast("string"), F.when(u % 3 == 0, ".json").when(u % 3 == 1, ".jsonl").otherwise(".txt"))
    found = redaction.scan_documents(table(spark, d, "events").select(name.alias("name"), made.alias("body")))
    return found.groupBy("name", "field", "kind", "excerpt").agg(F.count(F.lit(1)).alias("n"))


# -- reports ----------------------------------------------------------------------------

_SEV = ["CRITICAL", "HIGH", "MEDIUM", "LOW"]


def _reports(spark: SparkSession, d: str) -> DataFrame:
    """(scanner, shape, body): a static scanner's report a supplier, a web scanner's and an image scanner's a nation, made from their rows."""
    severity = lambda n, k: F.element_at(F.array(*map(F.lit, _SEV)), (n % k + 1).cast("int"))
    part = F.concat(F.lit("part "), (F.col("l_partkey") % 20).cast("string"))
    static = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.collect_list(F.struct(severity(F.col("l_linenumber"), 4).alias("issue_severity"), part.alias("issue_text"))).alias("results"))
    static = static.select(F.concat(F.lit("static-"), F.col("l_suppkey").cast("string")).alias("scanner"), F.lit("static").alias("shape"), F.to_json(F.struct("results")).alias("body"))
    c = table(spark, d, "customer")
    key = F.col("c_custkey")
    web = c.groupBy("c_nationkey").agg(F.array(F.struct(F.collect_list(F.struct(F.concat(F.initcap(severity(key, 4)), F.lit(" (Medium)")).alias("riskdesc"), F.col("c_mktsegment").alias("name"))).alias("alerts"))).alias("site"))
    web = web.select(F.concat(F.lit("web-"), F.col("c_nationkey").cast("string")).alias("scanner"), F.lit("web").alias("shape"), F.to_json(F.struct("site")).alias("body"))
    # Reports with LOW findings only are possible, and with none.
    image = c.groupBy("c_nationkey").agg(F.array(F.struct(F.filter(F.collect_list(F.when(key % 7 == 0, F.struct(F.when(F.col("c_nationkey") % 2 == 0, "LOW").otherwise(severity(key, 4)).alias("Severity"), F.concat(F.lit("V-"), (key % 9).cast("string")).alias("VulnerabilityID")))), lambda x: x.isNotNull() & (F.col("c_nationkey") % 5 != 0)).alias("Vulnerabilities"))).alias("Results"))
    image = image.select(F.concat(F.lit("image-"), F.col("c_nationkey").cast("string")).alias("scanner"), F.lit("image").alias("shape"), F.to_json(F.struct("Results")).alias("body"))
    return static.unionByName(web).unionByName(image)


_SEVERITY = "['CRITICAL', 'HIGH', 'MEDIUM', 'LOW']"
_FOUND = f"""found AS (SELECT 'static-' || CAST(l_suppkey AS VARCHAR) AS scanner, {_SEVERITY}[l_linenumber % 4 + 1] AS severity, 'part ' || CAST(l_partkey % 20 AS VARCHAR) AS finding FROM lineitem
 UNION ALL SELECT 'web-' || CAST(c_nationkey AS VARCHAR), {_SEVERITY}[c_custkey % 4 + 1], c_mktsegment FROM customer
 UNION ALL SELECT 'image-' || CAST(c_nationkey AS VARCHAR), CASE WHEN c_nationkey % 2 = 0 THEN 'LOW' ELSE {_SEVERITY}[c_custkey % 4 + 1] END, 'V-' || CAST(c_custkey % 9 AS VARCHAR) FROM customer WHERE c_custkey % 7 = 0 AND c_nationkey % 5 <> 0)"""


def _found(spark: SparkSession, d: str) -> DataFrame:
    reports = _reports(spark, d)
    parsed = reports.select("scanner", "shape", F.try_parse_json("body").alias("v"))
    return reduce(DataFrame.unionByName, [rows.withColumn("severity", scanreport.risk_word(F.col("severity"))) if shape == "web" else rows for shape in ("static", "web", "image") for rows in [scanreport.SHAPES[shape](parsed.where(F.col("shape") == shape).drop("shape"))]])


@_query(f"""WITH {_FOUND}, every AS (SELECT DISTINCT 'static-' || CAST(l_suppkey AS VARCHAR) AS scanner FROM lineitem UNION ALL SELECT DISTINCT k || CAST(c_nationkey AS VARCHAR) FROM customer, (VALUES ('web-'), ('image-')) AS t(k)),
s AS (SELECT scanner, count(finding) AS findings, count(*) FILTER (severity = 'CRITICAL') AS critical, count(*) FILTER (severity = 'HIGH') AS high, count(*) FILTER (severity = 'MEDIUM') AS medium, count(*) FILTER (severity = 'LOW') AS low FROM every LEFT JOIN found USING (scanner) GROUP BY scanner)
SELECT *, CASE WHEN scanner LIKE 'image-%' THEN CASE WHEN critical > 0 THEN 'BLOCKING' ELSE 'PASS' END WHEN findings = 0 THEN 'PASS' ELSE 'REVIEW' END AS verdict FROM s""")
def scan_summary(spark, d):
    images = [f"image-{r['n_nationkey']}" for r in table(spark, d, "nation").select("n_nationkey").collect()]  # 25 nations
    return scanreport.summary(_reports(spark, d), _found(spark, d), {s: "image" for s in images})


@_query(f"""WITH {_FOUND}, k AS (SELECT scanner, severity, finding, CAST(row_number() OVER (PARTITION BY scanner ORDER BY list_position({_SEVERITY}, severity), finding) AS INTEGER) AS rank, count(*) OVER (PARTITION BY scanner) AS n FROM (SELECT DISTINCT * FROM found))
SELECT scanner, severity, finding, rank, greatest(n - 12, 0) AS more FROM k WHERE rank <= 12""")
def finding_dedup(spark, d):
    return scanreport.notable(_found(spark, d).withColumn("seq", F.col("finding")), "seq", cap=12).select("scanner", "severity", "finding", "rank", "more")


@_query(f"WITH {_FOUND}, n AS (SELECT scanner, count(*) AS n FROM found GROUP BY scanner) SELECT floor((max(n) / 7.0 - min(n) / 7.0) * 1000 + 0.5) / 1000 AS spread FROM n")
def finding_spread(spark, d):
    return scanreport.spread(_found(spark, d).groupBy("scanner").agg((F.count(F.lit(1)) / 7.0).alias("n")), "n")


@_query("""WITH j AS (SELECT o_custkey % 20 AS k, CAST(o_orderkey AS VARCHAR) AS job, CASE WHEN o_orderkey % 11 = 0 THEN 'extra' ELSE ['build', 'test', 'deploy'][o_orderkey % 3 + 1] END AS stage FROM orders WHERE o_orderkey % 13 <> 0),
g AS (SELECT k, stage, list_sort(list('job-' || job)) AS jobs FROM j GROUP BY ALL), s AS (SELECT k, stage, position FROM (SELECT DISTINCT k FROM j), (VALUES ('build', 0), ('test', 1), ('deploy', 2), ('idle', 3)) AS t(stage, position))
SELECT 'p' || CAST(k AS VARCHAR) AS name, stage, position, array_to_string(coalesce(jobs, []), ',') AS jobs FROM s FULL JOIN g USING (k, stage)""")
def pipeline_model(spark, d):
    key = F.col("o_orderkey")
    stage = F.when(key % 11 == 0, "extra").otherwise(F.element_at(F.array(*map(F.lit, ("build", "test", "deploy"))), (key % 3 + 1).cast("int")))
    jobs = table(spark, d, "orders").where(key % 13 != 0).select((F.col("o_custkey") % 20).alias("k"), F.concat(F.lit('"job-'), key.cast("string"), F.lit('": {"stage": "'), stage, F.lit('"}')).alias("job"))
    body = F.concat(F.lit('{"stages": ["build", "test", "deploy", "idle"], "variables": {"a": 1}, "image": "x", '), F.array_join(F.collect_list("job"), ", "), F.lit("}"))
    docs = jobs.groupBy(F.concat(F.lit("p"), F.col("k").cast("string")).alias("name")).agg(body.alias("body"))
    broken = spark.createDataFrame([("broken", "{"), ("list", "[1]"), ("none", None)], "name string, body string")
    return scanreport.pipeline_model(docs.unionByName(broken)).select("name", "stage", "position", F.array_join("jobs", ",").alias("jobs"))


@_query("SELECT CAST(l_suppkey AS VARCHAR) AS scanner, CASE WHEN l_quantity >= 45 THEN CASE WHEN l_tax * 100 >= 7 THEN 'HIGH' WHEN l_tax * 100 >= 4 THEN 'MEDIUM' ELSE 'LOW' END WHEN l_linenumber % 2 = 0 THEN 'HIGH' ELSE 'MEDIUM' END AS severity, count(*) AS n FROM lineitem GROUP BY ALL")
def sarif_flatten(spark, d):
    score = F.when(F.col("l_quantity") >= 45, F.create_map(F.lit("security-severity"), (F.col("l_tax") * 100).cast("string")))
    result = F.struct(F.when(F.col("l_linenumber") % 2 == 0, "error").otherwise("warning").alias("level"), F.lit("rule").alias("ruleId"), score.alias("properties"))
    runs = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").cast("string").alias("scanner")).agg(F.array(F.struct(F.collect_list(result).alias("results"))).alias("runs"))
    reports = runs.select("scanner", F.try_parse_json(F.to_json(F.struct("runs"))).alias("v"))
    return scanreport.sarif(reports).groupBy("scanner", "severity").agg(F.count(F.lit(1)).alias("n"))


@_query("SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'P' THEN 'UNKNOWN' ELSE upper(substr(o_orderpriority, 3)) END AS risk, CASE WHEN o_orderpriority = '2-HIGH' AND o_orderstatus <> 'P' THEN 1 WHEN o_orderpriority = '5-LOW' AND o_orderstatus <> 'P' THEN 3 WHEN o_orderpriority = '3-MEDIUM' AND o_orderstatus <> 'P' THEN 2 ELSE 5 END AS rank FROM orders")
def risk_words(spark, d):
    text = F.when(F.col("o_orderstatus") == "P", F.lit(" (x)")).otherwise(F.concat(F.lower(F.substring("o_orderpriority", 3, 50)), F.lit(" (Medium)")))
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), scanreport.risk_word(text).alias("risk"))
    return rows.withColumn("rank", scanreport.severity_rank(F.col("risk")))


# -- explanations -----------------------------------------------------------------------

_ATTR = "attr AS (SELECT l_orderkey AS row_id, 'f' || CAST(l_linenumber AS VARCHAR) AS feature, any_value(l_discount - 0.05) AS a, any_value(l_tax - 0.04) AS b FROM lineitem GROUP BY 1, 2 HAVING count(*) = 1)"


def _attributions(spark: SparkSession, d: str) -> DataFrame:
    lines = spread(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_discount", "l_tax"), "l_orderkey", each=1 << 18)  # one shuffle serves all that goes by order
    li = lines.groupBy(F.col("l_orderkey").alias("row_id"), F.concat(F.lit("f"), F.col("l_linenumber").cast("string")).alias("feature"))
    return li.agg(F.count(F.lit(1)).alias("n"), F.first(F.col("l_discount") - 0.05).alias("a"), F.first(F.col("l_tax") - 0.04).alias("b")).where("n = 1").drop("n")


@_query(f"WITH {_ATTR} SELECT row_id, feature, a AS value, CAST(row_number() OVER (PARTITION BY row_id ORDER BY abs(a) DESC, feature) AS INTEGER) AS rank FROM attr WHERE abs(a) > 1e-9 QUALIFY rank <= 3")
def top_contributions(spark, d):
    return explain.top_contributions(_attributions(spark, d).select("row_id", "feature", F.col("a").alias("value")), k=3)


@_query(f"WITH {_ATTR} SELECT feature, floor(avg(abs(a)) * 1000000.0 + 0.5) / 1000000.0 AS mean_abs FROM attr GROUP BY 1 ORDER BY mean_abs DESC, feature LIMIT 3")
def top_features(spark, d):
    return explain.top_features(_attributions(spark, d).select("row_id", "feature", F.col("a").alias("value")), k=3)


@_query(f"""WITH {_ATTR}, k AS (SELECT *, rank() OVER (PARTITION BY row_id ORDER BY abs(a)) + (count(*) OVER (PARTITION BY row_id, abs(a)) - 1) / 2.0 AS ra, rank() OVER (PARTITION BY row_id ORDER BY abs(b)) + (count(*) OVER (PARTITION BY row_id, abs(b)) - 1) / 2.0 AS rb,
 row_number() OVER (PARTITION BY row_id ORDER BY abs(a) DESC, feature) AS ta, row_number() OVER (PARTITION BY row_id ORDER BY abs(b) DESC, feature) AS tb FROM attr),
g AS (SELECT row_id, count(*) FILTER (ta <= 3 AND tb <= 3) / 3.0 AS o, CASE WHEN min(ra) < max(ra) AND min(rb) < max(rb) THEN corr(ra, rb) END AS rho, avg(CAST(sign(a) = sign(b) AS DOUBLE)) AS s, max(CAST(ta = 1 AND tb = 1 AS DOUBLE)) AS t FROM k GROUP BY row_id)
SELECT {r('avg(o)')} AS overlap, {r('avg(rho)')} AS spearman, {r('avg(s)')} AS sign, {r('avg(t)')} AS top1 FROM g""")
def explanation_agreement(spark, d):
    return explain.agreement(_attributions(spark, d))


@_query(f"WITH {_rank_sql('fold')}, f AS (SELECT rk % 5 AS fold, avg(CAST(y_true = y_pred AS DOUBLE)) AS acc FROM (SELECT rk, scored.y_true, scored.y_pred FROM ranked JOIN scored ON scored.row_id = ranked.row_id) GROUP BY 1) SELECT {r('avg(acc)')} AS mean, {r('stddev_samp(acc)')} AS std, string_agg(CAST({r('acc')} AS VARCHAR), ',' ORDER BY fold) AS folds FROM f")
def cross_validation(spark, d):
    folds = snapshot.stratified_folds(scored(spark, d).select("row_id", "y_true", "y_pred"), "row_id", "y_true")
    by = folds.groupBy("fold").agg(F.avg((F.col("y_true") == F.col("y_pred")).cast("double")).alias("accuracy"))
    return explain.cross_validation(by, "accuracy").select("mean", "std", "folds")


@_query("SELECT l_orderkey AS row_id, l_returnflag AS direction, arg_max(l_linenumber, (l_discount, -l_linenumber)) AS feature_index, max(l_discount) AS p FROM lineitem GROUP BY 1, 2")
def best_flips(spark, d):
    return explain.best_flips(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("row_id"), F.col("l_returnflag").alias("direction"), F.col("l_discount").alias("p"), F.col("l_linenumber").alias("feature_index")))


@_query(f"WITH {SCORED} SELECT row_id, floor((proba[1] + 0.5 * proba[2] - 0.5 * proba[4] - proba[5]) * 1000000.0 + 0.5) / 1000000.0 AS urgency FROM scored")
def signed_urgency(spark, d):
    return scored(spark, d).select("row_id", rounded(explain.urgency(F.col("proba")), 6).alias("urgency"))


# -- synthetic cases --------------------------------------------------------------------

PROFILES = {0: [["collapse"]], 1: [["pain", "breath"]], 2: [["fever"], ["pain"]], 3: [["cough"]], 4: [["rash"]]}
PHRASES = {"collapse": ["collapsed"], "pain": ["bad pain", "sharp pain"], "breath": ["short of breath"], "fever": ["fever", "high temperature"], "cough": ["cough"], "rash": ["rash"]}


def _u(purpose: str) -> str:
    return f"CAST(('0x' || left(md5('42:{purpose}:' || CAST(id AS VARCHAR)), 7)) AS BIGINT) / 268435456.0"


def _steps(u: str, weights: tuple[float, ...]) -> str:
    cuts = [round(sum(weights[: i + 1]) / sum(weights), 10) for i in range(len(weights) - 1)]
    return "CASE " + " ".join(f"WHEN {u} < {c} THEN {i}" for i, c in enumerate(cuts)) + f" ELSE {len(cuts)} END"


def _map(of: dict) -> str:
    return "MAP {" + ", ".join(f"{k!r}: {v!r}" for k, v in of.items()) + "}"


def _cases_sql(prior: tuple[float, ...], extra: float) -> str:
    """``synth.cases`` of the parts' keys, texts included."""
    combos = {k: [list(c) for c in v] for k, v in PROFILES.items()}
    pools = {k: sorted({c for j in (k - 1, k, k + 1) for combo in PROFILES.get(j, []) for c in combo}) for k in PROFILES}
    pick = lambda xs, u: f"{xs}[1 + CAST(floor({u} * len({xs})) AS BIGINT)]"
    drawn = "CAST(('0x' || left(md5('42:phrase:' || CAST(id AS VARCHAR) || ':' || CAST(i - 1 AS VARCHAR)), 7)) AS BIGINT) / 268435456.0"
    return f"""WITH c AS (SELECT id, {_u('class')} AS u, {_u('band')} AS b, {_u('sex')} AS s, {_u('escalate')} AS e, {_u('combo')} AS co, {_u('extra')} AS ex, {_u('distractor')} AS di, {_u('vague')} AS va FROM (SELECT p_partkey AS id FROM part)),
k AS (SELECT *, {_steps('u', prior)} AS base, {list(synth.BANDS)}[1 + {_steps('b', synth.BAND_WEIGHTS)}] AS band, CASE WHEN s < 0.5 THEN 'Female' ELSE 'Male' END AS sex FROM c),
m AS (SELECT *, {_map(combos)}[base] AS cs, {_map(pools)}[base] AS ps FROM k),
x AS (SELECT *, list_concat({pick('cs', 'co')}, CASE WHEN ex < {extra} THEN [{pick('ps', 'di')}] ELSE [] END) AS chosen, {_map({k: list(v) for k, v in PHRASES.items()})} AS ph FROM m)
SELECT id, CAST(CASE WHEN band = '65+' AND base IN (2, 3) AND e < {synth.ESCALATED} THEN base - 1 ELSE base END AS INTEGER) AS y, band, sex,
  CASE WHEN va < {synth.VAGUE} THEN 'not feeling well' ELSE array_to_string(list_transform(chosen, lambda c, i: {pick('ph[c]', drawn)}), ' and ') END AS text, band || ' · ' || sex AS grp FROM x"""


@_query(_cases_sql(synth.PRIOR, synth.EXTRA))
def synthetic_cases(spark, d):
    """A case for every part: class, band, sex, text and group."""
    return synth.cases(spark, table(spark, d, "part").select(F.col("p_partkey").alias("id")), PROFILES, PHRASES)


@_query(_cases_sql(synth.SHIFTED, synth.EXTRA_SHIFTED))
def synthetic_shifted(spark, d):
    """The same from the shifted classes, with more distractors."""
    return synth.cases(spark, table(spark, d, "part").select(F.col("p_partkey").alias("id")), PROFILES, PHRASES, shift=True)


@_query("""SELECT CAST(k AS INTEGER) AS class, array_to_string(list_sort(list(DISTINCT c)), ',') AS pool
FROM (SELECT DISTINCT l_linenumber AS y, l_returnflag || l_linestatus || CAST(CAST(l_quantity AS INTEGER) % 7 + l_linenumber AS VARCHAR) AS c FROM lineitem) p, (SELECT DISTINCT l_linenumber AS k FROM lineitem) x WHERE abs(y - k) <= 1 GROUP BY k""")
def cooccurrence_pool(spark, d):
    """For each line number the flags, states and quantities that go with it or with its neighbours."""
    category = F.concat("l_returnflag", "l_linestatus", (F.col("l_quantity").cast("int") % 7 + F.col("l_linenumber")).cast("string"))
    rows = table(spark, d, "lineitem").select(F.col("l_linenumber").cast("int").alias("class"), category.alias("category"))
    return synth.distractors(rows).select("class", F.array_join("pool", ",").alias("pool"))