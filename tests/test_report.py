import threading
from collections import defaultdict

from modelwatch.operators import explain, models, report, scanreport
from modelwatch.sources.shared import checkpoints
from pyspark.sql import functions as F


def test_totals_and_groups(rows):
    df = rows([("a", 1, 2.0), ("a", None, 3.0), (None, 1, 5.0)], "g string, h int, v double")
    out = report.totals(df, ["g", "h"], {"n": F.count(F.lit(1)), "s": F.sum("v")})
    assert sorted(map(repr, map(tuple, out.collect()))) == sorted(map(repr, [("total", None, 3, 10.0), ("g", "a", 2, 5.0), ("g", None, 1, 5.0), ("h", "1", 2, 7.0), ("h", None, 1, 3.0)]))
    assert report.totals(df.where("false"), ["g"], {"n": F.count(F.lit(1))}).where("section = 'g'").count() == 0


def test_a_written_report_is_in_order(spark, rows, tmp_path):
    one = rows([(f"k{i:03d}", "x|y\nz") for i in range(500)], "key string, text string")
    both = report.table_lines(one, 2, "Second", ["key", "text"], ["key"]).unionByName(report.table_lines(one.limit(0), 1, "First", ["key"], ["key"]))
    report.write(both, str(tmp_path / "r"), parts=4)
    names = sorted(p for p in (tmp_path / "r").iterdir() if p.name.startswith("part-"))
    text = "".join(p.read_text() for p in names).split("\n")
    assert len(names) == 4 and text[:6] == ["## First", "", "| key |", "| --- |", "", "## Second"]
    assert text[9:509] == [f"| k{i:03d} | x\\|y z |" for i in range(500)]


def test_evidence(rows):
    made = rows(
        [
            ("load", '{"p95Ms": 120, "rps": 8.5, "failRatio": 0.0123, "requests": 77}'),
            ("slow", '{"p95Ms": 900, "breaches": ["p95 over 500", "too few"]}'),
            ("guard", '{"recall": 0.97, "falsePositiveRate": 0.02, "bypassRate": 0, "counts": {"cases": 40}, "verdict": "PASS"}'),
            ("held", '{"applicable": true, "live": ["A", "B"]}'),
            ("clean", '{"applicable": true, "live": [], "checked": ["x", "y", "z"]}'),
            ("prod", '{"applicable": false, "environment": "production"}'),
            ("broken", "{"),
            ("list", "[1]"),
            ("null", None),
        ],
        "name string, body string",
    )
    kinds = {"load": "load", "slow": "load", "guard": "guardrail", "held": "credentials", "clean": "credentials", "prod": "credentials", "broken": "load", "list": "guardrail", "null": "credentials", "missing": "guardrail"}
    got = {r["name"]: (r["detail"], r["verdict"]) for r in scanreport.evidence(made, rows(list(kinds.items()), "name string, kind string")).collect()}
    none = ("artifact absent", "not run")
    assert got == {
        "load": ("p95 120ms, 8.5 rps, 1.23% failed over 77 requests", "PASS"),
        "slow": ("p95 900ms, ? rps, 0.00% failed over 0 requests", "REVIEW - p95 over 500; too few"),
        "guard": ("recall 97% / false-pos 2% / injection bypass 0% over 40 labelled cases", "PASS"),
        "held": ("live credentials present: A, B", "FAIL"),
        "clean": ("3 agent-reachable credentials checked", "PASS"),
        "prod": ("not applicable in production", "not run"),
        "broken": none, "list": none, "null": none, "missing": none,
    }


def test_sarif_places(rows):
    body = '{"runs":[{"results":[{"ruleId":"r","message":{"text":" m "},"locations":[{"physicalLocation":{"artifactLocation":{"uri":"a/b.py"},"region":{"startLine":7}}}]},{"message":{"text":"n"},"locations":[{"physicalLocation":{"artifactLocation":{"uri":"c.py"}}}]},{"ruleId":"q"}]}]}'
    got = scanreport.findings(rows([("s", "sarif", body), ("t", "unheard", body)], "scanner string, shape string, body string"))
    assert sorted(r["finding"] for r in got.collect()) == ["q: ", "r: m (b.py:7)", "rule: n (c.py)"]


def test_folds_are_trained(spark, rows):
    checkpoints(spark)
    data = [(i, [float(i % 3)], (i * 7) % 5 if i % 4 else 0, "a" if i % 2 else "b") for i in range(200)]
    df = rows(data, "id int, x array<double>, y int, grp string")
    seen, running, most, lock = [], 0, [0], threading.Lock()

    def train(part):
        nonlocal running
        with lock:
            running += 1
            most[0] = max(most[0], running)
        counts = {tuple(r["x"]): r["y"] for r in part.groupBy("x").agg(F.mode("y", deterministic=True).alias("y")).collect()}
        ids = {r["id"] for r in part.select("id").collect()}
        with lock:
            running -= 1
            seen.append((ids, counts))
        answer = F.create_map(*[F.lit(v) for k, y in counts.items() for v in (k[0], y)])[F.col("x")[0]]
        return lambda rows: rows.withColumn("proba", F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: (i == answer).cast("double")))

    folds = models.cross_validated(df, train, "id", jobs=2).collect()
    assert most[0] <= 2 and len(seen) == 5
    want = []
    for ids, counts in seen:
        held = [(y, counts[tuple(x)], g) for i, x, y, g in data if i not in ids]
        groups, severe = defaultdict(list), [p <= 1 for y, p, _ in held if y <= 1]
        for y, p, g in held:
            groups[g].append(y == p)
        shares = [round(sum(v) / len(v), 4) for v in groups.values()]
        want.append((len(held), round(sum(y == p for y, p, _ in held) / len(held), 4), round(sum(severe) / len(severe), 4), round(max(shares) - min(shares), 4)))
    assert sorted((r["n"], r["accuracy"], r["red_flag_recall"], r["gap"]) for r in folds) == sorted(want)
    assert sum(r["n"] for r in folds) == 200
    out = explain.cross_validation(spark.createDataFrame(folds), "accuracy").first()
    assert abs(out["mean"] - sum(w[1] for w in want) / 5) < 1e-4 and len(out["folds"].split(",")) == 5
