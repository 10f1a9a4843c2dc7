"""Queries of archives, artifacts as files, load tests, scanner shapes and reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modelwatch.operators import loadtest, report, scanreport
from modelwatch.plans.carriers import table
from modelwatch.sources import archives, artifacts
from modelwatch.sources.shared import folder


def archived_orders(spark, d):
    """Orders written as archives of arrays and read back from them."""
    spark.dataSource.register(archives.ArrayArchive)
    at = folder(spark, "arrays")
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.array(F.col("o_totalprice").cast("double"), F.col("o_custkey").cast("double")).alias("x"), (F.col("o_orderstatus") == "F").alias("done"), F.col("o_orderpriority").alias("grp"))
    # Parts of about 65,536 rows, whatever the table's size.
    parts = int(1 + rows.count() // 65_536)
    rows.repartition(parts, "id").sortWithinPartitions("id").write.format("arrays").mode("overwrite").save(at)
    return spark.read.format("arrays").load(at).select("id", F.col("x")[0].alias("price"), F.col("x")[1].alias("customer"), "done", "grp")


def artifact_digests(spark, d):
    """(name, family, length, verdict, sha256): a file for each nation and segment, with its digest beside it, with another's, or with none."""
    at = folder(spark, "artifacts")
    k, segment = F.col("c_nationkey"), F.col("c_mktsegment")
    body = F.concat_ws("|", k.cast("string"), segment, F.col("n").cast("string"), F.col("last").cast("string"))
    kind = (k + F.length(segment)) % 3
    sidecar = F.when(kind == 0, F.concat(F.sha2(body, 256), F.lit("  artifact"))).when(kind == 1, F.sha2(F.concat(body, F.lit("!")), 256))
    rows = table(spark, d, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.count(F.lit(1)).alias("n"), F.max("c_custkey").alias("last"))
    made = rows.select(F.concat(F.lit("m"), k.cast("string"), F.lit("-"), segment, F.lit(".bin")).alias("name"), body.alias("body"), sidecar.alias("sidecar"))
    artifacts.write_artifacts(made, at).write.format("noop").mode("overwrite").save()
    found = artifacts.file_verdicts(artifacts.artifact_files(spark, at, "*.bin", r"^(m\d+)-"))
    return found.select(F.element_at(F.split("path", "/"), -1).alias("name"), "family", "length", "verdict", "sha256")


def _calls(spark, d) -> DataFrame:
    return table(spark, d, "events").select(F.date_trunc("day", "ts").alias("run"), F.col("event_type").alias("job"), (F.col("value") / 1000).alias("seconds"), (F.col("user_id") % 50 == 0).alias("failed"), "ts")


def load_test(spark, d):
    """Percentiles, rate and verdict of each job, from sketches and totals of its daily runs."""
    calls = _calls(spark, d)
    return loadtest.verdicts(loadtest.sketch(calls, ["run", "job"]), loadtest.merged_totals(loadtest.totals(calls, ["run", "job"]), ["job"]), ["job"], p95_ms=480, fail_ratio=0.015)


def load_sketches(spark, d):
    """(job, bucket, n): the sketches of all runs as one."""
    return loadtest.merged(loadtest.sketch(_calls(spark, d), ["run", "job"]), ["job"])


_SEV = ("CRITICAL", "HIGH", "MEDIUM", "LOW")


def _shape_reports(spark, d) -> DataFrame:
    """(scanner, shape, body): for every nation a report in each shape, with its customers as findings."""
    k = F.col("c_custkey")
    item = F.struct(F.element_at(F.array(*map(F.lit, _SEV)), (k % 4 + 1).cast("int")).alias("s"), F.col("c_mktsegment").alias("t"))
    by = table(spark, d, "customer").groupBy("c_nationkey").agg(F.collect_list(item).alias("items"))
    items = F.col("items")
    as_ = lambda **kw: F.transform(items, lambda x: F.struct(*[f(x).alias(n) for n, f in kw.items()]))
    sev, text = lambda x: x["s"], lambda x: x["t"]
    doc = lambda name, v: F.to_json(F.struct(v.alias(name)))
    wrap = lambda name, v: F.array(F.struct(v.alias(name)))
    lines = lambda v: F.array_join(F.transform(v, lambda x: F.to_json(x)), "\n")
    count = lambda s: F.size(F.filter(items, lambda x: x["s"] == s))
    level = lambda x: F.when(x["s"] == "HIGH", "error").when(x["s"] == "MEDIUM", "warning").otherwise("note")
    score = lambda x: F.when(x["s"] == "CRITICAL", F.create_map(F.lit("security-severity"), F.lit("9.1")))
    at = F.array(F.struct(F.struct(F.struct(F.lit("src/a.py").alias("uri")).alias("artifactLocation"), F.struct(F.lit(3).alias("startLine")).alias("region")).alias("physicalLocation")))
    bodies = {
        "sarif": doc("runs", wrap("results", as_(level=level, ruleId=text, message=lambda x: F.struct(F.lit("m").alias("text")), properties=score, locations=lambda x: at))),
        "secrets": F.to_json(as_(RuleID=text)),
        "keyed-secrets": doc("results", F.create_map(F.lit("file.env"), as_(type=text))),
        "static": doc("results", as_(issue_severity=sev, issue_text=text)),
        "semantic": doc("results", as_(extra=lambda x: F.struct(sev(x).alias("severity"), text(x).alias("message")))),
        "languages": doc("analysisVulnerabilities", as_(vulnerabilities=lambda x: F.struct(sev(x).alias("severity"), text(x).alias("details")))),
        "models": doc("issues", as_(severity=sev, description=text)),
        "image": doc("Results", wrap("Vulnerabilities", as_(Severity=sev, VulnerabilityID=text))),
        "dependencies": doc("dependencies", wrap("vulns", as_(id=text))),
        "libraries": F.to_json(wrap("results", wrap("vulnerabilities", as_(severity=sev, info=lambda x: F.array(text(x)))))),
        "packages": doc("metadata", F.struct(F.create_map(*[v for s in _SEV for v in (F.lit(s.lower()), count(s))], F.lit("total"), F.size(items)).alias("vulnerabilities"))),
        "ci": doc("vulnerabilities", as_(severity=lambda x: F.initcap(sev(x)), name=text)),
        "web": doc("site", wrap("alerts", as_(riskdesc=lambda x: F.concat(F.initcap(sev(x)), F.lit(" (Low)")), name=text))),
        "server": doc("vulnerabilities", as_(msg=text)),
        "lint": F.to_json(as_(level=lambda x: F.lower(sev(x)), message=text)),
        "templates": lines(as_(info=lambda x: F.struct(F.lower(sev(x)).alias("severity"), text(x).alias("name")))),
        "verified-secrets": lines(as_(Verified=lambda x: x["s"] == "CRITICAL", DetectorName=text)),
    }
    each = F.explode(F.array(*[F.struct(F.lit(s).alias("shape"), b.alias("body")) for s, b in bodies.items()])).alias("r")
    return by.select("c_nationkey", each).select(F.concat_ws("-", "r.shape", F.col("c_nationkey").cast("string")).alias("scanner"), "r.shape", "r.body")


def scan_shapes(spark, d):
    """(scanner, severity, finding, n) of reports in all shapes."""
    return scanreport.findings(_shape_reports(spark, d)).groupBy("scanner", "severity", "finding").agg(F.count(F.lit(1)).alias("n"))


def scan_verdicts(spark, d):
    """A row a scanner of each shape: findings by severity and its verdict."""
    reports = _shape_reports(spark, d)
    return scanreport.summary(reports, scanreport.findings(reports))


def evidence_rows(spark, d):
    """(name, kind, detail, verdict): gates and load tests of nations whose artifact is there, absent or broken."""
    k = F.col("n_nationkey")
    kinds = ("load", "guardrail", "credentials")
    of = table(spark, d, "nation").join(table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("n")), "n_nationkey", "left").na.fill(0)
    each = of.select(k.alias("k"), "n", F.explode(F.array(*map(F.lit, kinds))).alias("kind")).withColumn("name", F.concat_ws("-", "kind", F.col("k").cast("string")))
    n, odd = F.col("n"), F.col("k") % 2 == 1
    load = F.to_json(F.struct(n.alias("p95Ms"), F.lit(3.5).alias("rps"), (F.col("k") % 4 / 16).alias("failRatio"), n.alias("requests"), F.when(odd, F.array(F.lit("slow"), F.lit("failing"))).alias("breaches")))
    guard = F.to_json(F.struct((F.col("k") % 5 / 4).alias("recall"), F.lit(0.25).alias("falsePositiveRate"), F.struct(n.alias("cases")).alias("counts"), F.when(odd, "FAIL").otherwise("PASS").alias("verdict"), F.when(odd, F.array(F.lit("recall"))).alias("breaches")))
    creds = F.to_json(F.struct((F.col("k") % 3 != 0).alias("applicable"), F.lit("production").alias("environment"), F.when(odd, F.array(F.lit("A"), F.lit("B"))).alias("live"), F.array_repeat(F.lit("c"), n.cast("int")).alias("checked")))
    body = F.when(F.col("k") % 7 == 3, "{").when(F.col("kind") == "load", load).when(F.col("kind") == "guardrail", guard).otherwise(creds)
    return scanreport.evidence(each.where("k % 7 <> 5").select("name", body.alias("body")), each.select("name", "kind"))


def order_totals(spark, d):
    """(section, key, n, price): all orders, by status and by priority, in one pass."""
    rows = table(spark, d, "orders").select("o_orderstatus", "o_orderpriority", F.col("o_totalprice").cast("decimal(18,2)").alias("p"))
    return report.totals(rows, ["o_orderstatus", "o_orderpriority"], {"n": F.count(F.lit(1)), "price": F.sum("p").cast("double")})


def written_report(spark, d):
    """(line, n): the lines of a report of customers and of orders by nation, written as ordered parts and read back."""
    at = folder(spark, "report")
    nations = table(spark, d, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("customers"))
    lines = [report.table_lines(table(spark, d, "customer"), 2, "Customers", ["c_custkey", "c_name", "c_mktsegment"], ["c_custkey"]), report.table_lines(nations, 1, "Nations", ["c_nationkey", "customers"], ["c_nationkey"])]
    report.write(reduce(DataFrame.unionByName, lines), at)
    back = spark.read.text(at).withColumnRenamed("value", "line")
    return back.groupBy("line").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {f.__name__: f for f in (archived_orders, artifact_digests, load_test, load_sketches, scan_shapes, scan_verdicts, evidence_rows, order_totals, written_report)}

_X = "CAST(greatest(CAST(round(value / 1000 * 1000000) AS BIGINT), 0) AS BIGINT)"
_BUCKETS = f"""x AS (SELECT event_type AS job, {_X} AS x FROM events WHERE value IS NOT NULL), e AS (SELECT job, x, length(bin(x)) - 1 AS e FROM x),
b AS (SELECT job, CAST(CASE WHEN x < 64 THEN x ELSE (e - 5) * 64 + (x >> CAST(greatest(e - 6, 0) AS INTEGER)) - 64 END AS INTEGER) AS bucket, count(*) AS n FROM e GROUP BY ALL)"""
_P = "min(bucket) FILTER (seen * 100 >= whole * {0})"
_UP = "(CASE WHEN {0} < 128 THEN {0} ELSE ((({0} % 64 + 65) << CAST({0} // 64 - 1 AS INTEGER)) - 1) END) / 1000.0"
_S4 = "['CRITICAL', 'HIGH', 'MEDIUM', 'LOW'][c_custkey % 4 + 1]"
_SHAPES = ", ".join(f"('{s}')" for s in scanreport.SHAPES)
_FOUND = f"""found AS (SELECT shape, shape || '-' || CAST(c_nationkey AS VARCHAR) AS scanner,
 CASE WHEN shape IN ('secrets', 'keyed-secrets', 'dependencies') THEN 'HIGH' WHEN shape = 'server' THEN 'UNKNOWN' WHEN shape = 'verified-secrets' THEN CASE WHEN c_custkey % 4 = 0 THEN 'CRITICAL' ELSE 'HIGH' END ELSE {_S4} END AS severity,
 CASE shape WHEN 'sarif' THEN c_mktsegment || ': m (a.py:3)' WHEN 'keyed-secrets' THEN 'file.env' WHEN 'packages' THEN '' ELSE c_mktsegment END AS finding FROM customer, (VALUES {_SHAPES}) AS t(shape))"""
_BODY = "CAST(c_nationkey AS VARCHAR) || '|' || c_mktsegment || '|' || CAST(count(*) AS VARCHAR) || '|' || CAST(max(c_custkey) AS VARCHAR)"
SQL = {
    "archived_orders": "SELECT o_orderkey AS id, CAST(o_totalprice AS DOUBLE) AS price, CAST(o_custkey AS DOUBLE) AS customer, o_orderstatus = 'F' AS done, o_orderpriority AS grp FROM orders",
    "artifact_digests": f"WITH a AS (SELECT c_nationkey AS k, c_mktsegment AS s, {_BODY} AS body FROM customer GROUP BY 1, 2) SELECT 'm' || CAST(k AS VARCHAR) || '-' || s || '.bin' AS name, 'm' || CAST(k AS VARCHAR) AS family, CAST(strlen(body) AS BIGINT) AS length, ['intact', 'digest differs', 'no sidecar'][(k + length(s)) % 3 + 1] AS verdict, CASE WHEN (k + length(s)) % 3 < 2 THEN sha256(body) END AS sha256 FROM a",
    "load_sketches": f"WITH {_BUCKETS} SELECT * FROM b",
    "load_test": f"""WITH {_BUCKETS}, w AS (SELECT job, bucket, sum(n) OVER (PARTITION BY job ORDER BY bucket) AS seen, sum(n) OVER (PARTITION BY job) AS whole FROM b),
p AS (SELECT job, {_P.format(50)} AS b50, {_P.format(95)} AS b95, {_P.format(99)} AS b99 FROM w GROUP BY job),
runs AS (SELECT event_type AS job, date_trunc('day', ts) AS run, count(*) AS requests, count(*) FILTER (coalesce(user_id % 50 = 0, true)) AS failures, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000.0 AS took FROM events GROUP BY 1, 2),
t AS (SELECT job, CAST(sum(requests) AS BIGINT) AS requests, sum(failures) AS failures, sum(took) AS took FROM runs GROUP BY job),
o AS (SELECT job, requests, {_UP.format('b50')} AS p50_ms, {_UP.format('b95')} AS p95_ms, {_UP.format('b99')} AS p99_ms, CASE WHEN took > 0 THEN floor(requests / took * 10000 + 0.5) / 10000 END AS rps, floor(failures / requests * 1000000.0 + 0.5) / 1000000.0 AS fail_ratio FROM t LEFT JOIN p USING (job)),
v AS (SELECT *, array_to_string(list_filter([CASE WHEN p95_ms IS NULL THEN 'no latencies' WHEN p95_ms > 480 THEN 'p95' END, CASE WHEN fail_ratio > 0.015 THEN 'failures' END], lambda x: x IS NOT NULL), ',') AS breaches FROM o)
SELECT *, CASE WHEN breaches = '' THEN 'PASS' ELSE 'REVIEW' END AS verdict FROM v""",
    "scan_shapes": f"WITH {_FOUND} SELECT scanner, severity, finding, count(*) AS n FROM found GROUP BY ALL",
    "scan_verdicts": f"WITH {_FOUND}, s AS (SELECT shape, scanner, count(*) AS findings, {', '.join(f'''count(*) FILTER (severity = '{s}') AS {s.lower()}''' for s in _SEV)} FROM found GROUP BY ALL) SELECT scanner, findings, critical, high, medium, low, CASE WHEN shape IN ('image', 'verified-secrets') AND critical > 0 THEN 'BLOCKING' WHEN shape = 'image' THEN 'PASS' ELSE 'REVIEW' END AS verdict FROM s",
    "evidence_rows": """WITH c AS (SELECT n_nationkey AS k, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS n FROM nation), e AS (SELECT k, n, kind FROM c, (VALUES ('load'), ('guardrail'), ('credentials')) AS t(kind))
SELECT kind || '-' || CAST(k AS VARCHAR) AS name, kind, CASE WHEN k % 7 IN (3, 5) THEN 'artifact absent' WHEN kind = 'load' THEN 'p95 ' || CAST(n AS VARCHAR) || 'ms, 3.5 rps, ' || ['0.00', '6.25', '12.50', '18.75'][k % 4 + 1] || '% failed over ' || CAST(n AS VARCHAR) || ' requests'
 WHEN kind = 'guardrail' THEN 'recall ' || CAST(k % 5 * 25 AS VARCHAR) || '% / false-pos 25% / injection bypass 0% over ' || CAST(n AS VARCHAR) || ' labelled cases'
 WHEN k % 3 = 0 THEN 'not applicable in production' WHEN k % 2 = 1 THEN 'live credentials present: A, B' ELSE CAST(n AS VARCHAR) || ' agent-reachable credentials checked' END AS detail,
 CASE WHEN k % 7 IN (3, 5) THEN 'not run' WHEN kind = 'load' THEN CASE WHEN k % 2 = 1 THEN 'REVIEW - slow; failing' ELSE 'PASS' END WHEN kind = 'guardrail' THEN CASE WHEN k % 2 = 1 THEN 'FAIL - recall' ELSE 'PASS' END WHEN k % 3 = 0 THEN 'not run' WHEN k % 2 = 1 THEN 'FAIL' ELSE 'PASS' END AS verdict FROM e""",
    "order_totals": "SELECT CASE WHEN g = 3 THEN 'total' WHEN g = 1 THEN 'o_orderstatus' ELSE 'o_orderpriority' END AS section, CASE WHEN g = 1 THEN s WHEN g = 2 THEN p END AS key, n, price FROM (SELECT o_orderstatus AS s, o_orderpriority AS p, grouping(o_orderstatus, o_orderpriority) AS g, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS price FROM orders GROUP BY GROUPING SETS ((), (o_orderstatus), (o_orderpriority)))",
    "written_report": r"""WITH l AS (SELECT '| ' || CAST(c_custkey AS VARCHAR) || ' | ' || replace(replace(c_name, '|', '\|'), chr(10), ' ') || ' | ' || replace(replace(c_mktsegment, '|', '\|'), chr(10), ' ') || ' |' AS line FROM customer
 UNION ALL SELECT '| ' || CAST(c_nationkey AS VARCHAR) || ' | ' || CAST(count(*) AS VARCHAR) || ' |' FROM customer GROUP BY c_nationkey
 UNION ALL SELECT unnest(['## Customers', '', '| c_custkey | c_name | c_mktsegment |', '| --- | --- | --- |', '', '## Nations', '', '| c_nationkey | customers |', '| --- | --- |', ''])) SELECT line, count(*) AS n FROM l GROUP BY line""",
}
