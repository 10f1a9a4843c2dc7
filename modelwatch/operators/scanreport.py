"""Scanner reports: findings of JSON documents in many shapes, deduplicated and summed up.

A report is a row (scanner, body). A shape says how its findings are reached.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Severities from worst on.
SEVERITIES = ("CRITICAL", "HIGH", "MEDIUM", "LOW", "WARNING")
ALSO_MEDIUM = "MODERATE"
SARIF_LEVELS = {"error": "HIGH", "warning": "MEDIUM", "note": "LOW", "none": "LOW"}


def severity_rank(severity: Column) -> Column:
    """0 for CRITICAL to 4 for WARNING, 5 for others."""
    at = F.array_position(F.array(*map(F.lit, SEVERITIES)), F.when(severity == ALSO_MEDIUM, F.lit("MEDIUM")).otherwise(severity))
    return F.coalesce(F.nullif(at, F.lit(0)) - 1, F.lit(5)).cast("int")


def sarif_severity(level: Column, score: Column) -> Column:
    """By level; a CVSS score overrides it."""
    s = score.try_cast("double")
    by_level = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in SARIF_LEVELS.items() for x in kv]), F.lower(level)), F.lit("MEDIUM"))
    return F.when(s >= 9, "CRITICAL").when(s >= 7, "HIGH").when(s >= 4, "MEDIUM").when(s.isNotNull(), "LOW").otherwise(by_level)


def risk_word(text: Column) -> Column:
    """What stands before "(", in capitals; UNKNOWN if nothing does."""
    return F.coalesce(F.nullif(F.upper(F.trim(F.substring_index(F.coalesce(text, F.lit("")), "(", 1))), F.lit("")), F.lit("UNKNOWN"))


def _at(v: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, path, kind)


def _items(rows: DataFrame, path: str) -> DataFrame:
    """(scanner, v) for each item of the array at ``path``."""
    return rows.select("scanner", F.explode(_at(F.col("v"), path, "array<variant>")).alias("v"))


_FINDING = "scanner string, severity string, finding string"


def _finding(rows: DataFrame, severity: Column, text: Column) -> DataFrame:
    return rows.select("scanner", F.coalesce(F.upper(severity), F.lit("UNKNOWN")).alias("severity"), F.coalesce(text, F.lit("")).alias("finding"))


def sarif(rows: DataFrame) -> DataFrame:
    """runs[].results[] as "rule: message (file:line)"; the first location counts, without its folders."""
    results = _items(_items(rows, "$.runs"), "$.results")
    v = F.col("v")
    place = "$.locations[0].physicalLocation"
    file = F.nullif(F.element_at(F.split(_at(v, f"{place}.artifactLocation.uri"), "/"), -1), F.lit(""))
    line = F.nullif(_at(v, f"{place}.region.startLine", "int"), F.lit(0)).cast("string")
    where = F.coalesce(F.concat(F.lit(" ("), F.concat_ws(":", file, line), F.when(file.isNotNull(), ")")), F.lit(""))
    text = F.concat(F.coalesce(F.nullif(_at(v, "$.ruleId"), F.lit("")), F.lit("rule")), F.lit(": "), F.trim(F.coalesce(_at(v, "$.message.text"), F.lit(""))), where)
    return _finding(results, sarif_severity(_at(v, "$.level"), _at(v, '$.properties["security-severity"]')), text)


def findings_list(rows: DataFrame, items: tuple[str, ...], severity: str, text: str, fixed: str | None = None) -> DataFrame:
    """Findings at nested arrays ``items``, severity and text at paths of the innermost."""
    for path in items:
        rows = _items(rows, path)
    return _finding(rows, F.lit(fixed) if fixed else _at(F.col("v"), severity), _at(F.col("v"), text))


def counts_map(rows: DataFrame, path: str) -> DataFrame:
    """A map of severity to count, as that many findings without text; ``total`` is no severity."""
    cells = rows.select("scanner", F.explode(_at(F.col("v"), path, "map<string,int>")).alias("severity", "n")).where("severity <> 'total' and n > 0")
    return cells.select("scanner", F.upper("severity").alias("severity"), F.explode(F.array_repeat(F.lit(""), F.col("n"))).alias("finding"))


def keyed_arrays(rows: DataFrame, path: str) -> DataFrame:
    """A map of names to arrays of findings that have no severity."""
    cells = rows.select("scanner", F.explode(_at(F.col("v"), path, "map<string,array<variant>>")).alias("name", "found")).where("found is not null")
    return cells.select("scanner", F.lit("HIGH").alias("severity"), F.explode(F.array_repeat("name", F.size("found"))).alias("finding"))


# How each shape's findings are reached. The last two are JSON lines.
SHAPES = {
    "sarif": sarif,
    "secrets": lambda r: findings_list(r, ("$",), "$.none", "$.RuleID", "HIGH"),
    "keyed-secrets": lambda r: keyed_arrays(r, "$.results"),
    "static": lambda r: findings_list(r, ("$.results",), "$.issue_severity", "$.issue_text"),
    "semantic": lambda r: findings_list(r, ("$.results",), "$.extra.severity", "$.extra.message"),
    "languages": lambda r: findings_list(r, ("$.analysisVulnerabilities",), "$.vulnerabilities.severity", "$.vulnerabilities.details"),
    "models": lambda r: findings_list(r, ("$.issues",), "$.severity", "$.description"),
    "image": lambda r: findings_list(r, ("$.Results", "$.Vulnerabilities"), "$.Severity", "$.VulnerabilityID"),
    "dependencies": lambda r: findings_list(r, ("$.dependencies", "$.vulns"), "$.none", "$.id", "HIGH"),
    "libraries": lambda r: findings_list(r, ("$", "$.results", "$.vulnerabilities"), "$.severity", "$.info[0]"),
    "packages": lambda r: counts_map(r, "$.metadata.vulnerabilities"),
    "ci": lambda r: findings_list(r, ("$.vulnerabilities",), "$.severity", "$.name"),
    "web": lambda r: findings_list(r, ("$.site", "$.alerts"), "$.riskdesc", "$.name"),
    "server": lambda r: findings_list(r, ("$.vulnerabilities",), "$.none", "$.msg", "UNKNOWN"),
    "lint": lambda r: findings_list(r, ("$",), "$.level", "$.message"),
    "templates": lambda r: _finding(r, _at(F.col("v"), "$.info.severity"), _at(F.col("v"), "$.info.name")),
    "verified-secrets": lambda r: _finding(r, F.when(F.coalesce(_at(F.col("v"), "$.Verified", "boolean"), F.lit(False)), "CRITICAL").otherwise("HIGH"), _at(F.col("v"), "$.DetectorName")),
}
LINES = ("templates", "verified-secrets")
#: Shapes whose critical findings block; one of them passes with others.
BLOCKING = ("image", "verified-secrets")
TOLERANT = ("image",)


def _shaped(reports: DataFrame, shapes: dict[str, str] | None) -> DataFrame:
    """Reports with a ``shape``: their own column's, or that which ``shapes`` names for their scanner."""
    if shapes is None:
        return reports if "shape" in reports.columns else reports.withColumn("shape", F.lit(None).cast("string"))
    pairs = [F.lit(x) for pair in shapes.items() for x in pair]
    return reports.withColumn("shape", F.try_element_at(F.create_map(*pairs), F.col("scanner")) if pairs else F.lit(None).cast("string"))


def findings(reports: DataFrame, shapes: dict[str, str] | None = None) -> DataFrame:
    """_FINDING rows of (scanner, body) with a ``shape``, or with ``shapes`` by scanner.

    Bodies that don't parse have none, nor have reports of a shape that isn't in SHAPES.
    """
    of = _shaped(reports, shapes)
    out = None
    for shape in SHAPES if shapes is None else sorted(set(shapes.values())):
        mine = of.where(F.col("shape") == shape)
        if shape in LINES:
            lines = mine.select("scanner", F.explode(F.split("body", "\n")).alias("line")).select("scanner", F.try_parse_json("line").alias("v"))
            parsed = lines.where(F.schema_of_variant("v").startswith("OBJECT"))
        else:
            parsed = mine.select("scanner", F.try_parse_json("body").alias("v")).where("v is not null")
        rows = SHAPES[shape](parsed)
        if shape == "web":
            rows = rows.withColumn("severity", risk_word(F.col("severity")))
        out = rows if out is None else out.unionByName(rows)
    return out


def summary(reports: DataFrame, found: DataFrame, shapes: dict[str, str] | None = None) -> DataFrame:
    """(scanner, findings, critical, high, medium, low, verdict) of every scanner with a report, without findings too.

    PASS without findings, else REVIEW; BLOCKING where the scanner's shape blocks on
    critical findings. A tolerant shape passes with others. An absent report has no row.
    """
    by = found.groupBy("scanner").agg(F.count(F.lit(1)).alias("findings"), *[F.count_if(F.col("severity").isin(*([s, ALSO_MEDIUM] if s == "MEDIUM" else [s]))).alias(s.lower()) for s in SEVERITIES[:4]])
    all_ = _shaped(reports, shapes).groupBy("scanner").agg(F.coalesce(F.min("shape"), F.lit("")).alias("shape")).join(by, "scanner", "left").na.fill(0)
    blocks = F.col("shape").isin(*BLOCKING) & (F.col("critical") > 0)
    passes = (F.col("findings") == 0) | F.col("shape").isin(*TOLERANT)
    return all_.withColumn("verdict", F.when(blocks, "BLOCKING").when(passes, "PASS").otherwise("REVIEW")).drop("shape")


def _percent(share: Column) -> Column:
    return F.concat(F.round(F.coalesce(share, F.lit(0.0)) * 100).cast("long").cast("string"), F.lit("%"))


def evidence(artifacts: DataFrame, expected: DataFrame) -> DataFrame:
    """(name, kind, detail, verdict) for each row of ``expected`` (name, kind) from ``artifacts`` (name, body).

    Kinds: ``load`` (a load test's summary), ``guardrail`` (a scored gate) and ``credentials``
    (live credentials that an agent can reach). What is absent, doesn't parse or is no object
    was not run, which is no pass.
    """
    v, kind = F.col("v"), F.col("kind")
    text = lambda path, other="?": F.coalesce(_at(v, path), F.lit(other))
    listed = lambda path: F.coalesce(_at(v, path, "array<string>"), F.array().cast("array<string>"))
    number = lambda path: F.coalesce(_at(v, path, "double"), F.lit(0.0))
    breaches, live = listed("$.breaches"), listed("$.live")
    said = F.array_join(breaches, "; ")
    load = F.concat(F.lit("p95 "), text("$.p95Ms"), F.lit("ms, "), text("$.rps"), F.lit(" rps, "), F.format_string("%.2f%%", number("$.failRatio") * 100), F.lit(" failed over "), text("$.requests", "0"), F.lit(" requests"))
    guardrail = F.concat(F.lit("recall "), _percent(number("$.recall")), F.lit(" / false-pos "), _percent(number("$.falsePositiveRate")), F.lit(" / injection bypass "), _percent(number("$.bypassRate")), F.lit(" over "), text("$.counts.cases", "0"), F.lit(" labelled cases"))
    applies = F.coalesce(_at(v, "$.applicable", "boolean"), F.lit(False))
    credentials = F.when(~applies, F.concat(F.lit("not applicable in "), text("$.environment"))).when(F.size(live) > 0, F.concat(F.lit("live credentials present: "), F.array_join(live, ", "))).otherwise(F.concat(F.size(listed("$.checked")).cast("string"), F.lit(" agent-reachable credentials checked")))
    with_breaches = lambda word: F.when(F.size(breaches) > 0, F.concat(word, F.lit(" - "), said)).otherwise(word)
    absent = v.isNull()
    detail = F.when(absent, "artifact absent").when(kind == "load", load).when(kind == "guardrail", guardrail).when(kind == "credentials", credentials)
    verdict = (
        F.when(absent, "not run")
        .when(kind == "load", with_breaches(F.when(F.size(breaches) > 0, F.lit("REVIEW")).otherwise(F.lit("PASS"))))
        .when(kind == "guardrail", with_breaches(text("$.verdict")))
        .when(kind == "credentials", F.when(~applies, "not run").when(F.size(live) > 0, "FAIL").otherwise("PASS"))
    )
    parsed = artifacts.select("name", F.try_parse_json("body").alias("v")).where(F.schema_of_variant("v").startswith("OBJECT"))
    return expected.select("name", "kind").join(parsed, "name", "left").select("name", "kind", detail.alias("detail"), verdict.alias("verdict"))


def notable(found: DataFrame, seq: str, cap: int | None = None, width: int = 130) -> DataFrame:
    """First occurrence of each (severity, text start) by scanner, worst first; ``rank`` counts them from 1.

    With ``cap`` only that many rows of a scanner stay and ``more`` tells how many others there are.
    """
    start = F.left("finding", F.lit(width))
    one = found.groupBy("scanner", "severity", start.alias("finding")).agg(F.min(seq).alias("seq"))
    by = Window.partitionBy("scanner")
    ranked = one.withColumn("rank", F.row_number().over(by.orderBy(severity_rank(F.col("severity")), "seq"))).withColumn("more", F.greatest(F.count(F.lit(1)).over(by) - (cap or 0), F.lit(0)) if cap else F.lit(0).cast("long"))
    return ranked if cap is None else ranked.where(F.col("rank") <= cap)


def spread(by_group: DataFrame, value: str) -> DataFrame:
    """Largest less smallest value, three places."""
    return by_group.agg((F.floor((F.max(value) - F.min(value)) * 1000 + 0.5) / 1000).alias("spread"))


def markdown(rows: DataFrame, most: int = 1000) -> str:
    """A Markdown table of a frame of ``most`` rows at most; a larger one is an error, no row is left out."""
    escape = lambda x: str("" if x is None else x).replace("|", "\\|")
    lines = ["| " + " | ".join(rows.columns) + " |", "|" + " --- |" * len(rows.columns)]
    found = rows.limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"a table of more than {most} rows; narrow it first")
    return "\n".join(lines + ["| " + " | ".join(map(escape, r)) + " |" for r in found])


def pipeline_model(documents: DataFrame, name: str = "name", body: str = "body") -> DataFrame:
    """(name, stage, position, jobs) of pipeline configurations, JSON objects whose members with a ``stage`` are jobs.

    Stages come in the order of the document's ``stages``, those without jobs too; a stage
    that only a job names has no position. Bodies that don't parse have no row.
    """
    parsed = documents.select(name, F.try_parse_json(body).alias("v")).where(F.schema_of_variant("v").startswith("OBJECT"))
    listed = parsed.select(name, F.posexplode(_at(F.col("v"), "$.stages", "array<string>")).alias("position", "stage"))
    jobs = parsed.select(name, F.explode(_at(F.col("v"), "$", "map<string,variant>")).alias("job", "v"))
    jobs = jobs.select(name, "job", _at(F.col("v"), "$.stage").alias("stage")).where("stage is not null")
    both = listed.groupBy(name, "stage").agg(F.min("position").alias("position")).join(jobs.groupBy(name, "stage").agg(F.array_sort(F.collect_list("job")).alias("jobs")), [name, "stage"], "full")
    return both.select(name, "stage", "position", F.coalesce("jobs", F.array().cast("array<string>")).alias("jobs"))
