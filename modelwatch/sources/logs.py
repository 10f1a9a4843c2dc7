"""Log and queue sources: JSON lines with torn rows, and the order that files don't keep.

Spark reads have no line order, so every log carries a sequence column.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

INFERENCE = "seq long, ts string, caseId string, features array<double>, acuity string, confidence double, modelVersion string, ageProvided boolean"
TRUTH = "seq long, caseId string, modelAcuity string, clinicianAcuity string"
QUEUE = "caseId string, text string, acuity string, ageBand string, sex string"


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of JSON lines; ``torn`` marks lines that don't parse. Blank lines give no row."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.select(F.from_json("value", schema).alias("r"), F.try_parse_json("value").isNull().alias("torn")).select("r.*", "torn")


def tail(rows: DataFrame, n: int = 5000, seq: str = "seq") -> DataFrame:
    """The last ``n`` rows by sequence; torn ones count before they are dropped."""
    last = rows.orderBy(F.col(seq).desc()).limit(n)
    return last.where(~F.col("torn")).drop("torn") if "torn" in rows.columns else last


def write_json_lines(rows: DataFrame, path: str) -> None:
    """Appends rows as JSON lines. No size cap: the folder is rotated outside."""
    rows.write.mode("append").json(path)


def pending(store: DataFrame) -> DataFrame:
    """Pending rows of a store; text is the first of normalised and summary that isn't empty."""
    text = F.coalesce(F.nullif("normalised", F.lit("")), F.nullif("summary", F.lit("")), F.lit(""))
    return store.where(F.col("status") == "pending").withColumn("text", text)
