from modelwatch.operators import joins, scanreport, snapshot, telemetry
from modelwatch.sources import logs, synth
from pyspark.sql import functions as F

CODES = ["P1", "P2", "P3", "P4", "P5"]
LOG = "seq long, case_id string, pred_code string, grp string, age_provided boolean"


def test_labelled_join(rows):
    log = rows([(1, "a", "P2", "g", True), (2, "b", "P4", "g", True), (3, "c", "P1", "g", True)], LOG)
    truth = rows([(1, "a", "P2"), (2, "b", "P3"), (3, "x", "P1"), (4, "a", None), (5, "b", "??")], "seq long, case_id string, label_code string")
    got = joins.labelled_join(log, truth, CODES).orderBy("seq").collect()
    assert [(r["case_id"], r["y_pred"], r["y_true"]) for r in got] == [("a", 1, 1), ("b", 3, 2)]


def test_labelled_performance(rows):
    data = [(i, str(i), "P3" if i % 2 else "P1", "g" + str(i % 3), i >= 6) for i in range(24)]
    truth = rows([(i, str(i), "P4" if i in (1, 3) else c) for i, _, c, _, _ in data], "seq long, case_id string, label_code string")
    out = joins.labelled_performance(joins.labelled_join(rows(data, LOG), truth, CODES)).first()
    assert (out["n"], out["accuracy"], out["red_flag_recall"], out["age_defaulted_share"], out["note"]) == (24, 0.9167, 1.0, 0.25, None)
    few = joins.labelled_performance(joins.labelled_join(rows(data[:1], LOG), truth, CODES)).first()
    assert (few["n"], few["accuracy"]) == (1, None) and few["note"]


def test_json_lines_and_tail(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text('{"seq": 1, "acuity": "P1"}\n{"seq": 2, "acu\n\n{"seq": 3, "features": [0.5]}\n')
    df = logs.read_json_lines(spark, str(tmp_path / "log.jsonl"), logs.INFERENCE)
    assert df.count() == 3 and df.where("torn").count() == 1
    assert [r["seq"] for r in logs.tail(df, 1).collect()] == [3]


def test_hash_does_not_depend_on_partitions(spark):
    df = spark.range(500).withColumn("v", F.col("id") % 7)
    a, b = (snapshot.content_hash(x, ["id", "v"]).first() for x in (df, df.repartition(5, "v")))
    assert a == b and a["n"] == 500
    assert snapshot.content_hash(df.withColumn("v", F.col("v") + 1), ["id", "v"]).first()["sha256"] != a["sha256"]
    assert snapshot.content_hash(df.limit(0), ["id"]).first()["n"] == 0


def test_sampling(spark):
    df = spark.range(1000).withColumn("y", (F.col("id") % 10 < 3).cast("int"))
    split = {(r["y"], r["part"]): r["n"] for r in snapshot.stratified_split(df, "id", "y").groupBy("y", "part").agg(F.count("*").alias("n")).collect()}
    assert split == {(0, "test"): 175, (0, "train"): 525, (1, "test"): 75, (1, "train"): 225}
    over = snapshot.oversample(df, "id", "y")
    assert {r["y"]: r["count"] for r in over.groupBy("y").count().collect()} == {0: 700, 1: 700}
    assert over.where("copy = 0").count() == 1000


def test_usage_and_states(rows):
    calls = rows([("m", 5, -2, 0.5), ("m", 1, 4, None)], "model string, prompt int, completion int, cost double")
    assert telemetry.usage(calls).first().asDict() == {"model": "m", "prompt": 6, "completion": 4, "cost": 0.5, "priced": 1}


def test_scanner_shapes(rows):
    reports = rows(
        [
            ("sarif", '{"runs":[{"results":[{"level":"error","ruleId":"r","message":{"text":"m"}},{"properties":{"security-severity":"9.5"}}]}]}'),
            ("image", '{"Results":[{"Vulnerabilities":[{"Severity":"critical","VulnerabilityID":"V1"}]},{"Vulnerabilities":null}]}'),
            ("packages", '{"metadata":{"vulnerabilities":{"high":2,"low":0,"total":2}}}'),
            ("web", '{"site":[{"alerts":[{"riskdesc":"High (Medium)","name":"a"}]}]}'),
            ("broken", "{"),
            ("keys", '{"results":{"f":[{},{}],"g":[]}}'),
            ("live", '{"Verified":true,"DetectorName":"d"}\n\n{"Verified":false}\nno json'),
            ("libs", '[{"results":[{"vulnerabilities":[{"severity":"moderate","info":["u"]}]}]}]'),
            ("none", '{"results":[]}'),
        ],
        "scanner string, body string",
    )
    shapes = {"sarif": "sarif", "image": "image", "packages": "packages", "web": "web", "broken": "static", "keys": "keyed-secrets", "live": "verified-secrets", "libs": "libraries", "none": "static"}
    got = sorted((r["scanner"], r["severity"]) for r in scanreport.findings(reports, shapes).collect())
    assert got == [("image", "CRITICAL"), ("keys", "HIGH"), ("keys", "HIGH"), ("libs", "MODERATE"), ("live", "CRITICAL"), ("live", "HIGH"), ("packages", "HIGH"), ("packages", "HIGH"), ("sarif", "CRITICAL"), ("sarif", "HIGH"), ("web", "HIGH")]
    table = {r["scanner"]: (r["findings"], r["verdict"]) for r in scanreport.summary(reports, scanreport.findings(reports, shapes), shapes).collect()}
    assert table["image"] == (1, "BLOCKING") and table["broken"] == (0, "PASS") and table["live"] == (2, "BLOCKING") and table["libs"] == (1, "REVIEW") and table["none"] == (0, "PASS")
    assert "\\|" in scanreport.markdown(rows([("a|b",)], "c string"))


def test_synthetic_shares(spark):
    profiles = {k: [["a"], ["b", "a"]] for k in range(5)}
    df = synth.cases(spark, 6000, profiles, {"a": ["x", "y"], "b": ["z"]})
    shares = {r["band"]: r["count"] / 6000 for r in df.groupBy("band").count().collect()}
    assert all(abs(shares[b] - w) < 0.02 for b, w in zip(synth.BANDS, synth.BAND_WEIGHTS))
    assert df.where("text is null or text = ''").count() == 0
