from modelwatch.operators import contracts, textfeat
from modelwatch.sources import artifacts
from pyspark.sql import functions as F

LEXICON = {"pain": ("bad pain",), "fever": ("fever",)}


def _vectors(df):
    return textfeat.vector(textfeat.features(textfeat.category_flags(df, LEXICON), age="age", sex="sex"), list(LEXICON))


def test_contract(spark):
    mark = contracts.fingerprint(spark, _vectors, {"v": 1})
    assert mark == contracts.fingerprint(spark, _vectors, {"v": 1}) != contracts.fingerprint(spark, _vectors, {"v": 2})
    good = {"names": ["a"], "fingerprint": mark}
    assert contracts.check_contract(good, ["a"], mark)["ok"]
    assert [contracts.check_contract(r, ["a"], mark)["reason"] for r in (None, {**good, "names": ["b"]}, {**good, "fingerprint": "x"})] == ["no contract was recorded", "feature names differ", "feature values differ"]


def test_sidecars(rows):
    import hashlib

    files = rows([("a", bytearray(b"x")), ("b", bytearray(b"y")), ("c", bytearray(b"z"))], "path string, content binary")
    side = rows([("a", hashlib.sha256(b"x").hexdigest() + "\n"), ("b", "0" * 64)], "path string, sha256 string").withColumn("sha256", F.regexp_replace("sha256", "\\s", ""))
    assert {r["path"]: r["intact"] for r in contracts.intact(files, side).collect()} == {"a": True, "b": False, "c": False}


def test_artifacts(spark, tmp_path):
    for d, body in (("one", "{broken"), ("two", '{"k": 1}')):
        (tmp_path / d).mkdir()
        (tmp_path / d / "r.json").write_text(body)
    (tmp_path / "two" / "l.jsonl").write_text('{"a": 1}\n\n[2]\n{"b"\n{"a": 3}')
    docs = artifacts.read_documents(spark, [str(tmp_path / "one"), str(tmp_path / "two")])
    found = artifacts.first_found(docs, [str(tmp_path / d).lstrip("/") for d in ("one", "two")])
    assert {r["name"]: r["body"] for r in found.where("name like '%.json'").collect()} == {"r.json": '{"k": 1}'}
    assert artifacts.json_rows(docs.where("name = 'l.jsonl'")).count() == 2
    rows = spark.range(50).select(F.col("id").cast("double").alias("f"), (F.col("id") % 5).alias("y"), F.lit("g").alias("g"))
    meta = artifacts.write_snapshot(rows, str(tmp_path / "snap"), ["f"], "y", "g").first()
    again, kept = artifacts.read_snapshot(spark, str(tmp_path / "snap"))
    assert meta["n"] == again.count() == 50 and kept.first() == meta


def test_source_choice(spark):
    assert [contracts.live_or_sample(spark.range(n), spark.range(1), w, 10)[0] for n, w in ((10, True), (9, True), (10, False))] == ["live", "sample", "sample"]


def test_newest_compatible(rows):
    data = [("a", "p1", 1, True, True), ("a", "p2", 3, True, None), ("a", "p3", 4, False, True), ("a", "p4", 2, True, True), ("a", "p5", 2, True, True), ("b", "q", 1, None, True)]
    df = rows(data, "family string, path string, modified int, compatible boolean, intact boolean")
    assert {r["family"]: r["path"] for r in contracts.newest_compatible(df).collect()} == {"a": "p5", "b": None}


def test_broken_backend(spark, tmp_path, monkeypatch):
    (tmp_path / "broken_backend_x.py").write_text("raise TypeError('bad layout')")
    (tmp_path / "needy_backend_x.py").write_text("import not_there_x")
    monkeypatch.syspath_prepend(str(tmp_path))
    got = {r["module"]: r["status"] for r in contracts.backend_status(spark, ["broken_backend_x", "needy_backend_x", "json"]).collect()}
    assert got == {"broken_backend_x": "failed to import (TypeError: bad layout)", "needy_backend_x": "not installed (not_there_x)", "json": "available"}


def test_reports_are_whole(rows):
    import pytest

    from modelwatch.operators import scanreport

    found = rows([("s", "LOW", "b", 1), ("s", "HIGH", "a|c", 2), ("s", "LOW", "b", 3), ("s", "LOW", "d", 4), ("t", "MODERATE", "e", 5)], "scanner string, severity string, finding string, seq int")
    got = sorted((r["scanner"], r["rank"], r["severity"], r["finding"], r["more"]) for r in scanreport.notable(found, "seq", cap=2).collect())
    assert got == [("s", 1, "HIGH", "a|c", 1), ("s", 2, "LOW", "b", 1), ("t", 1, "MODERATE", "e", 0)]
    assert len(scanreport.markdown(found).split("\n")) == 7 and "a\\|c" in scanreport.markdown(found)
    with pytest.raises(ValueError, match="more than 4 rows"):
        scanreport.markdown(found, most=4)
    pipelines = rows([("p", '{"stages": ["a", "b", "a"], "x": {"stage": "b"}, "y": {"stage": "c"}, "z": {"script": 1}, "w": 3}'), ("q", "{}"), ("r", "nonsense")], "name string, body string")
    got = sorted((r["name"], r["stage"], r["position"], r["jobs"]) for r in scanreport.pipeline_model(pipelines).collect())
    assert got == [("p", "a", 0, []), ("p", "b", 1, ["x"]), ("p", "c", None, ["y"])]


def _put(folder, name, body, sidecar, at):
    import os

    (folder / name).write_bytes(body)
    if sidecar is not None:
        (folder / f"{name}.sha256").write_text(sidecar)
    os.utime(folder / name, (at, at))


def test_newest_artifact_of_files(spark, tmp_path):
    import hashlib

    right = lambda b: hashlib.sha256(b).hexdigest().upper() + "  name\n"
    big = b"x" * 3_000_001  # three chunks
    (tmp_path / "deep").mkdir()
    _put(tmp_path, "forest-1.bin", b"one", right(b"one"), 100)
    _put(tmp_path / "deep", "forest-2.bin", big, right(big), 200)
    _put(tmp_path, "forest-3.bin", b"three", right(b"other"), 300)
    _put(tmp_path, "forest-4.bin", b"four", None, 400)
    _put(tmp_path, "forest-5.bin", b"five", "\n", 500)
    _put(tmp_path, "curve-1.bin", b"c", "0" * 64, 100)
    _put(tmp_path, "tie-1.bin", b"a", right(b"a"), 100)
    _put(tmp_path, "tie-2.bin", b"b", right(b"b"), 100)
    _put(tmp_path, "no family.bin", b"b", right(b"b"), 100)
    found = artifacts.artifact_files(spark, str(tmp_path), "*.bin", r"^([a-z]+)-\d+")
    assert found.count() == 8
    short = lambda df: sorted((r["path"].split("/")[-1].split(".")[0], r["verdict"]) for r in df.collect())
    assert short(artifacts.newest_artifact(found)) == [("curve-1", "digest differs"), ("forest-2", "loaded"), ("forest-3", "digest differs"), ("forest-4", "no sidecar"), ("forest-5", "no sidecar"), ("tie-2", "loaded")]
    judged = found.where("path not like '%tie-2%'").select("path", (~F.col("path").contains("forest-2")).alias("compatible"))
    assert short(artifacts.newest_artifact(found, judged)) == [("curve-1", "digest differs"), ("forest-1", "loaded"), ("forest-2", "incompatible"), ("forest-3", "digest differs"), ("forest-4", "no sidecar"), ("forest-5", "no sidecar"), ("tie-1", "loaded"), ("tie-2", "no contract")]
    assert len(artifacts.file_verdicts(found).where("verdict = 'intact'").collect()) == 4
    assert artifacts.newest_artifact(found.where("false")).count() == 0
