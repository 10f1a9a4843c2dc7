"""Personal data: masking in text and a scan of JSON string leaves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Word characters, digits, spaces and word edges are those of Unicode.
_W, _D, _S = r"\p{L}\p{N}_", r"\p{Nd}", r"[\s\x1c-\x1f\x85\p{Z}]"
_EDGE = rf"(?:(?<=[{_W}])(?![{_W}])|(?<![{_W}])(?=[{_W}]))"
# Identifier kinds in the order in which they are masked, and their shapes.
KINDS = {
    "NRIC": rf"(?iu){_EDGE}[STFGM]{_D}{{7}}[A-Z]{_EDGE}",
    "EMAIL": rf"{_EDGE}[{_W}.+-]+@[{_W}-]+\.[{_W}.-]+{_EDGE}",
    "PHONE": rf"(?<![{_D}+-])(?:\+{_D}{{1,3}}(?:{_S}|-)?{_D}{{2,4}}(?:(?:{_S}|-)?{_D}{{2,4}}){{1,3}}|(?:\+?65(?:{_S}|-)?)?[3689]{_D}{{3}}(?:{_S}|-)?{_D}{{4}})(?![{_D}-])",
    "MRN": rf"{_EDGE}{_D}{{7,}}{_EDGE}",
}
#: What a text with an identifier of a kind has in any case; cheap to look for.
_NEEDS = {"NRIC": rf"{_D}{{7}}", "EMAIL": "@", "PHONE": rf"{_D}{{2}}", "MRN": rf"{_D}{{7}}"}
OPAQUE = ("ts", "timestamp", "createdAt", "updatedAt", "caseId", "id", "sessionId", "escalationId", "modelVersion", "versionId", "schemaVersion", "dataSha256", "modelSha256", "sha256", "hash", "acuity", "modelAcuity", "clinicianAcuity", "agreement", "decision", "verdict", "status")
MACHINE = (
    r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:?\d{2})?\n?$",
    r"^[a-z]+_[0-9a-f]{8,32}\n?$",
    r"^[0-9a-f]{32,64}\n?$",
)
EXCERPT = 160


def redact(rows: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``masked`` and ``kinds``; each kind is looked for in what the kinds before it left. Null stays null.

    A kind has a projection of its own for the test and one for the mask, so that a
    pattern runs once over a text that has what its kind needs.
    """
    out, now = rows.withColumn("masked", F.col(text)), F.col("masked")
    hits = []
    for kind, shape in KINDS.items():
        hit = f"_hit_{kind}"
        hits.append(hit)
        out = out.withColumn(hit, now.rlike(_NEEDS[kind]) & now.rlike(shape))
        out = out.withColumn("masked", F.when(F.col(hit), F.regexp_replace(now, shape, f"[REDACTED_{kind}]")).otherwise(now))
    kinds = F.filter(F.array(*[F.when(F.col(hit), F.lit(kind)) for hit, kind in zip(hits, KINDS, strict=True)]), lambda k: k.isNotNull())
    return out.withColumn("kinds", kinds).drop(*hits)


def machine_token(value: Column, shapes: tuple[str, ...] = MACHINE, prefixes: tuple[str, ...] = ()) -> Column:
    """Whether a value is a time, an id or a digest; or a version ``prefix-`` and 12 hex digits, of the prefixes given."""
    out = F.lit(False)
    for shape in shapes:
        out = out | value.rlike(shape)
    for prefix in prefixes:
        out = out | (value.startswith(f"{prefix}-") & F.substring(value, len(prefix) + 2, 1 << 20).rlike(r"^[0-9a-f]{12}(?: \([a-z0-9/, ]+\))?\n?$"))
    return out


def mask_spans(text: Column, spans: Column) -> Column:
    """Replaces [start, end) spans by their [label], from right to left; spans: array of (start, end, label)."""
    ordered = F.reverse(F.array_sort(spans))
    return F.aggregate(ordered, text, lambda t, s: F.concat(F.left(t, s["start"]), F.lit("["), s["label"], F.lit("]"), F.substring(t, s["end"] + 1, F.length(t))))


def json_strings(rows: DataFrame, body: str = "body", line: str | None = None) -> DataFrame:
    """Rows' columns but ``body``, with (field, value) of each string leaf; list items inherit their key.

    Documents that don't parse have no leaf; or, with a ``line`` column, their lines
    without field, numbered from 1 where that column has 0. Any depth in one pass over Arrow batches:
    declared level by level, each level would read the documents again.
    """
    keep = [c for c in rows.columns if c != body]
    schema = rows.select(*keep, F.lit(None).cast("string").alias("field"), F.lit(None).cast("string").alias("value")).schema

    def run(batches):
        import json

        import pyarrow as pa

        for batch in batches:
            at, fields, values, moved = [], [], [], {}
            for i, text in enumerate(batch.column(body).to_pylist()):
                try:
                    stack = [(None, json.loads(text))] if text is not None else []
                except (ValueError, RecursionError):
                    for k, x in enumerate(text.split("\n") if line else []):
                        if not batch.column(line)[i].as_py():
                            moved[len(at)] = k + 1
                        at.append(i)
                        fields.append(None)
                        values.append(x)
                    continue
                while stack:
                    field, node = stack.pop()
                    if isinstance(node, dict):
                        stack.extend(node.items())
                    elif isinstance(node, list):
                        stack.extend((field, x) for x in node)
                    elif isinstance(node, str):
                        at.append(i)
                        fields.append(field)
                        values.append(node)
            own = batch.select(keep).take(pa.array(at, pa.int64())).columns
            if moved:
                k = keep.index(line)
                own[k] = pa.array([moved.get(j, x) for j, x in enumerate(own[k].to_pylist())], own[k].type)
            yield pa.RecordBatch.from_arrays([*own, pa.array(fields, pa.string()), pa.array(values, pa.string())], names=[*keep, "field", "value"])

    return rows.select(*keep, body).mapInArrow(run, schema)


def scan_values(leaves: DataFrame, prefixes: tuple[str, ...] = ()) -> DataFrame:
    """Findings (columns, kind, excerpt) among (field, value); machine tokens in opaque fields are passed over."""
    checked = leaves.where(~(F.coalesce(F.col("field").isin(*OPAQUE), F.lit(False)) & machine_token(F.col("value"), prefixes=prefixes)))
    found = redact(checked, "value")
    return found.select(*[c for c in leaves.columns if c != "value"], F.explode("kinds").alias("kind"), F.left("masked", F.lit(EXCERPT)).alias("excerpt"))


def scan_documents(documents: DataFrame, name: str = "name", body: str = "body", prefixes: tuple[str, ...] = ()) -> DataFrame:
    """Findings (name, line, field, kind, excerpt): .jsonl by line, .json whole, others and what doesn't parse by line."""
    whole = F.col(name).endswith(".json")
    one = documents.where(whole).select(name, F.lit(0).alias("line"), body)
    lines = documents.where(~F.coalesce(whole, F.lit(False))).select(name, F.posexplode(F.split(body, "\n")).alias("pos", body)).select(name, (F.col("pos") + 1).alias("line"), body)
    parsed = F.coalesce(F.col(name).endswith(".jsonl"), F.lit(False))
    plain = lines.where(~parsed).select(name, "line", F.lit(None).cast("string").alias("field"), F.col(body).alias("value"))
    return scan_values(json_strings(one.unionByName(lines.where(parsed)), body, "line").unionByName(plain), prefixes)


def egress_gate(findings: DataFrame, wanted: DataFrame, present: DataFrame, name: str = "name") -> DataFrame:
    """(verdict, findings, skipped): any finding fails; wanted files that are absent are named."""
    skipped = wanted.join(present.select(name).distinct(), name, "left_anti").agg(F.array_join(F.array_sort(F.collect_list(name)), ",").alias("skipped"))
    n = findings.agg(F.count(F.lit(1)).alias("findings"))
    return n.crossJoin(skipped).select(F.when(F.col("findings") > 0, "FAIL").otherwise("PASS").alias("verdict"), "findings", "skipped")  # one row each
