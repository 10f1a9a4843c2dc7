"""Reports: totals and groups of a table from one pass, and texts of many parts in order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOTAL = "total"


def totals(rows: DataFrame, groups: Sequence[str], values: dict[str, Column]) -> DataFrame:
    """(section, key, values): the aggregates ``values`` over all rows (section ``total``, null key) and by each of ``groups``, in one pass.

    A null key of a group is a row of its own, told from the total by its section. An empty
    table has no rows.
    """
    sets = [[], *[[F.col(g)] for g in groups]]
    out = rows.groupingSets(sets, *groups).agg(F.grouping_id(*groups).alias("_of"), *[v.alias(n) for n, v in values.items()])
    whole = (1 << len(groups)) - 1
    section, key = F.when(F.col("_of") == whole, TOTAL), F.lit(None).cast("string")
    for i, g in enumerate(groups):
        mine = F.col("_of") == whole - (1 << (len(groups) - 1 - i))
        section = section.when(mine, g)
        key = F.when(mine, F.col(g).cast("string")).otherwise(key)
    return out.select(section.alias("section"), key.alias("key"), *values)


def _cell(c: str) -> Column:
    return F.replace(F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))


def table_lines(rows: DataFrame, place: int, title: str, columns: Sequence[str], order: Sequence[str]) -> DataFrame:
    """(place, at, line): a section's Markdown, its title and heading first, then a line a row of ``rows``; ``at`` sorts by ``order``, as texts."""
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *map(_cell, columns)), F.lit(" |"))
    body = rows.select(F.lit(place).alias("place"), F.array(F.lit("1"), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in order]).alias("at"), line.alias("line"))
    head = [f"## {title}", "", "| " + " | ".join(columns) + " |", "|" + " --- |" * len(columns)]
    first = rows.sparkSession.createDataFrame([(place, ["0", str(i)], h) for i, h in enumerate(head)] + [(place, ["2"], "")], "place int, at array<string>, line string")
    return first.unionByName(body)


def write(lines: DataFrame, folder: str, parts: int = 8) -> None:
    """Writes (place, at, line) as text files whose names sort as the lines do: ranges of lines, each sorted where it is."""
    lines.repartitionByRange(parts, "place", "at").sortWithinPartitions("place", "at").select("line").write.mode("overwrite").text(folder)
