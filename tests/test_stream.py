"""The class mix over a stream against a group-by of all its events."""

from pyspark.sql import functions as F

from modelwatch.functions.numbers import rounded
from modelwatch.operators import joins
from modelwatch.plans import learned
from modelwatch.plans.carriers import CODES, logs
from modelwatch.streaming import labels, monitor

DATA = "/root/testdata/sf0.001"


def _plain(df):
    return sorted(tuple(r) for r in df.select("start", "acuity", "n", "confidence").collect())


def _mix(events, length):
    by = events.groupBy(F.window(F.col("ts").cast("timestamp"), length).alias("w"), "acuity").agg(F.count(F.lit(1)).alias("n"), rounded(F.avg("confidence")).alias("confidence"))
    return by.select(F.col("w.start").alias("start"), "acuity", "n", "confidence")


def test_every_event_is_in_the_mix(spark):
    events = spark.read.parquet(f"{DATA}/events.parquet")
    got = learned.stream_class_mix(spark, DATA)
    want = _mix(events.select("ts", F.col("event_type").alias("acuity"), (F.col("value") / 500).alias("confidence")), "1 day")
    assert _plain(got) == _plain(want) and got.agg(F.sum("n")).first()[0] == events.count()


def test_last_state_of_a_window_over_batches(spark, rows, tmp_path):
    data = [("2024-01-01 00:05:00", "a", 0.5), ("2024-01-01 00:10:00", "b", 0.25), ("2024-01-01 00:40:00", "a", 1.0), ("2024-01-01 01:20:00", "a", 0.0)]
    events = rows(data, "ts string, acuity string, confidence double").withColumn("ts", F.to_timestamp("ts"))
    for start, end in ((0, 2), (2, 3), (3, 4)):
        rows(data[start:end], "ts string, acuity string, confidence double").withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    monitor.each_batch(monitor.class_mix(stream, late="2 hours"), lambda b: b, str(tmp_path / "out"), str(tmp_path / "progress"), "update").awaitTermination()
    written = spark.read.parquet(str(tmp_path / "out"))
    assert written.where("acuity = 'a' and hour(start) = 0").count() == 2
    assert _plain(monitor.latest(written, ["start", "acuity"])) == _plain(_mix(events, "1 hour"))


LOG = "seq long, case_id string, pred_code string, ts timestamp"
TRUTH = "seq long, case_id string, label_code string, ts timestamp"


def _feed(rows, folder, data, schema):
    for row in data:
        rows([row], schema.replace("timestamp", "string")).withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(folder)


def _run(spark, base, **options):
    read = lambda name, schema: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/{name}")
    facts = labels.labelled_facts(read("log", LOG), read("truth", TRUTH), ["a", "b"], **options)
    monitor.each_batch(facts, lambda b: b, f"{base}/facts", f"{base}/progress").awaitTermination()
    return spark.read.schema(labels.FACTS).parquet(f"{base}/facts")


def _joined(df):
    return sorted(tuple(r) for r in df.select("case_id", "seq", "y_pred", "y_true").collect())


def test_labels_in_any_order_and_after_a_restart(spark, rows, tmp_path):
    day = "2024-01-0{} 00:00:00".format
    log = [(1, "x", "a", day(1)), (2, "y", "b", day(1)), (3, "x", "b", day(2)), (4, "z", "a", day(2)), (5, None, "a", day(3)), (6, "x", "?", day(3)), (7, "y", None, day(3))]
    truth = [(9, "x", "b", day(1)), (8, "x", "a", day(2)), (10, "x", None, day(3)), (11, "y", "?", day(3)), (12, "y", "a", day(3)), (13, "w", "a", day(3))]
    want = _joined(joins.labelled_join(rows(log, LOG.replace("timestamp", "string")), rows(truth, TRUTH.replace("timestamp", "string")), ["a", "b"], limit=None))
    assert want == [("x", 1, 0, 1), ("x", 3, 1, 1), ("y", 2, 1, 0)]
    for order in (1, -1):
        base = str(tmp_path / f"order{order}")
        _feed(rows, f"{base}/log", log[::order][:4], LOG)
        _feed(rows, f"{base}/truth", truth[::order][:1], TRUTH)
        _run(spark, base, parts=2)
        _feed(rows, f"{base}/log", log[::order][4:], LOG)
        _feed(rows, f"{base}/truth", truth[::order][1:], TRUTH)
        facts = _run(spark, base, parts=2)  # goes on from its checkpoint
        assert _joined(labels.current(facts)) == want
        assert facts.where("seq is not null").groupBy("case_id", "seq").count().where("count > 1").count() == 0


def test_stream_of_labels_over_events(spark):
    log, truth = logs(spark, DATA)
    assert _joined(learned.stream_labels(spark, DATA)) == _joined(joins.labelled_join(log, truth, CODES, limit=None))


def test_only_frequent_cases_have_parts(spark, rows, tmp_path, monkeypatch):
    log = rows([(i, "x" if i % 2 else "y", "a") for i in range(40)], "seq long, case_id string, pred_code string")
    truth = rows([(2**53 + 1, "x", "b"), (50, "y", "a")], "seq long, case_id string, label_code string")
    both = [tuple(r) for r in labels.events(log, truth, ["a", "b"], 4, ["x"]).collect()]
    assert {r[0] for r in both if r[1] == "y"} == {0} and {r[0] for r in both if r[1] == "x"} == {0, 1, 2, 3}
    assert sorted(r[:4] for r in both if r[4]) == [(0, "x", 2**53 + 1, 1), (0, "y", 50, 0), (1, "x", 2**53 + 1, 1), (2, "x", 2**53 + 1, 1), (3, "x", 2**53 + 1, 1)]
    monkeypatch.setattr(learned, "_FREQUENT", 60)
    log, truth = logs(spark, DATA)
    assert _joined(learned.stream_labels(spark, DATA)) == _joined(joins.labelled_join(log, truth, CODES, limit=None))
