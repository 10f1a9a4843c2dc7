"""Chat formatting: logged snapshots of a growing conversation collapse to the longest one, which is rendered."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def turn_lists(turns: DataFrame) -> DataFrame:
    """(conv_id, turns, prefixes): turns in order with the rolling hash after each.

    Turns are ordered by (turn, role, text); nulls sort first and count as the empty
    string in hashes. The hash after turn k is SHA-256 of the hash after turn k-1,
    the role's length, the role and the text, so equal prefixes and no others
    share hashes. Rows without conv_id belong to no conversation and are left out; a turn row
    that repeats is one more turn. Turns that tie in number go by role and text. Other columns
    are dropped; an empty table gives an empty table. A conversation is one row, so its turns,
    however long, are in one task; prefixes cost its number of turns in hashes, not in texts.
    """
    none = F.lit("")
    turn = F.struct(F.col("turn"), F.coalesce("role", none).alias("role"), F.coalesce("text", none).alias("text"))
    step = lambda seen, t: F.concat(
        seen, F.array(F.sha2(F.concat(F.coalesce(F.try_element_at(seen, F.lit(-1)), none), F.lit(":"), F.length(t["role"]).cast("string"), F.lit(":"), t["role"], t["text"]), 256))
    )
    lists = turns.where(F.col("conv_id").isNotNull()).groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    return lists.withColumn("prefixes", F.aggregate("turns", F.array().cast("array<string>"), step))


def maximal_conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, turns, n_copies): conversations whose whole turn list is no proper prefix of another's.

    Of conversations with equal turn lists the one with the smallest conv_id stays and
    n_copies counts them. Both sides of the anti-join hold each hash once, so a
    conversation or a first turn that fills the log is one row of the join.
    """
    lists = turn_lists(turns)
    whole = F.element_at("prefixes", -1)
    unique = lists.groupBy(whole.alias("whole")).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_copies"))
    proper = lists.select(F.explode(F.slice("prefixes", F.lit(1), F.size("prefixes") - 1)).alias("whole")).distinct()
    kept = unique.join(proper, "whole", "left_anti").select("conv_id", "n_copies")
    return lists.select("conv_id", "turns").join(kept, "conv_id")


def render(conversations: DataFrame, opening: str = "<|", closing: str = "|>\n", end: str = "\n", escape: str = "") -> DataFrame:
    """Adds ``rendered``: each turn as opening, role, closing, text, end.

    escape: put after each opening mark that a role or a text has, so that neither can pass
    for a turn; without it they are rendered as they are.
    """
    own = (lambda c: F.replace(c, F.lit(opening), F.lit(opening + escape))) if escape else (lambda c: c)
    lines = F.transform("turns", lambda t: F.concat(F.lit(opening), own(t["role"]), F.lit(closing), own(t["text"]), F.lit(end)))
    return conversations.withColumn("rendered", F.array_join(lines, ""))


#: The same in DuckDB, over the view ``conversations``.
SQL = """
WITH c AS (
  SELECT conv_id, list(struct_pack(turn := turn, role := coalesce(role, ''), text := coalesce(text, ''))
                       ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS t
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), k AS (
  SELECT conv_id, t, list_transform(t, lambda x: struct_pack(r := x.role, s := x.text)) AS whole FROM c
), u AS (
  SELECT whole, min(conv_id) AS conv_id, count(*) AS n_copies FROM k GROUP BY whole
), p AS (
  SELECT DISTINCT list_slice(whole, 1, i) AS whole
  FROM (SELECT whole, unnest(range(1, len(whole))) AS i FROM u)
)
SELECT u.conv_id, CAST(len(u.whole) AS BIGINT) AS n_turns, CAST(u.n_copies AS BIGINT) AS n_copies,
       list_aggregate(list_transform(u.whole, lambda x: '<|' || x.r || '|>' || chr(10) || x.s || chr(10)), 'string_agg', '') AS rendered
FROM u WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.whole = u.whole)
"""


def query(spark, sf_dir: str) -> DataFrame:
    """One row per maximal conversation: conv_id, n_turns, n_copies, rendered."""
    kept = maximal_conversations(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return render(kept).select("conv_id", F.size("turns").cast("long").alias("n_turns"), "n_copies", "rendered")
