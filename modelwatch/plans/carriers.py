"""The provided tables in the roles that the operators need, in Spark and in SQL.

Labelled predictions come from orders and customers: the priority's digit is the class,
a rule on integer keys the prediction, market segment and status the group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row_id, y_true, y_pred, grp, proba, p_severe, side, age_provided)."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    j = o.join(c, o["o_custkey"] == c["c_custkey"]).select("o_orderkey", "o_custkey", "o_orderdate", (F.substring("o_orderpriority", 1, 1).cast("int") - 1).alias("y_true"), F.concat_ws(" · ", "c_mktsegment", "o_orderstatus").alias("grp"))
    key, cust, y = F.col("o_orderkey"), F.col("o_custkey"), F.col("y_true")
    pred = F.when((key * 7 + cust) % 10 < 7, y).otherwise(((y + key % 5) % 5).cast("int"))
    w = [1 + (key * (k + 3)) % 7 for k in range(5)]
    total = sum(w[1:], w[0])
    proba = F.array(*[x.cast("double") / total.cast("double") for x in w])
    return j.select(key.alias("row_id"), "y_true", pred.alias("y_pred"), "grp", proba.alias("proba"), ((w[0] + w[1]).cast("double") / total.cast("double")).alias("p_severe"), F.when(F.col("o_orderdate") < F.lit("1996-01-01").cast("timestamp_ntz"), "ref").otherwise("cur").alias("side"), (key % 4 != 0).alias("age_provided"))


_W = [f"(1 + (o_orderkey * {k + 3}) % 7)" for k in range(5)]
_T = "(" + " + ".join(_W) + ")"
SCORED = f"""scored AS (
  SELECT row_id, y_true, CASE WHEN (row_id * 7 + cust) % 10 < 7 THEN y_true ELSE CAST((y_true + row_id % 5) % 5 AS INTEGER) END AS y_pred, grp, proba, p_severe, side, row_id % 4 <> 0 AS age_provided
  FROM (SELECT o_orderkey AS row_id, o_custkey AS cust, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) - 1 AS y_true,
    c_mktsegment || ' · ' || o_orderstatus AS grp,
    [{", ".join(f"CAST({w} AS DOUBLE) / CAST({_T} AS DOUBLE)" for w in _W)}] AS proba,
    CAST({_W[0]} + {_W[1]} AS DOUBLE) / CAST({_T} AS DOUBLE) AS p_severe,
    CASE WHEN o_orderdate < TIMESTAMP '1996-01-01' THEN 'ref' ELSE 'cur' END AS side
    FROM orders JOIN customer ON o_custkey = c_custkey))"""


def r(x: str, places: int = 4) -> str:
    """``numbers.rounded`` in SQL."""
    return f"floor(({x}) * {10**places}.0 + 0.5) / {10**places}.0"


def logs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(inference log, ground truth) from events: codes are event types, cases are users; every third event is a label."""
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.col("user_id").cast("string").alias("case_id"), "event_type", "value")
    log = e.where("seq % 3 <> 0").select("seq", "case_id", F.col("event_type").alias("pred_code"), F.concat(F.lit("g"), (F.col("seq") % 5).cast("string")).alias("grp"), (F.col("seq") % 4 != 0).alias("age_provided"), "value")
    truth = e.where("seq % 3 = 0").select("seq", "case_id", F.when(F.col("seq") % 7 != 0, F.col("event_type")).alias("label_code"))
    return log, truth


LOGS = """log AS (SELECT event_id AS seq, CAST(user_id AS VARCHAR) AS case_id, event_type AS pred_code, 'g' || CAST(event_id % 5 AS VARCHAR) AS grp, event_id % 4 <> 0 AS age_provided, value FROM events WHERE event_id % 3 <> 0),
truth AS (SELECT event_id AS seq, CAST(user_id AS VARCHAR) AS case_id, CASE WHEN event_id % 7 <> 0 THEN event_type END AS label_code FROM events WHERE event_id % 3 = 0)"""
#: Four of the event types are codes; others are unknown.
CODES = ["click", "purchase", "view", "signup"]
