"""Exact quantiles by key in bounded memory.

Spark's exact percentile keeps every distinct value of a key in one task. Here a
mergeable sketch of each key brackets the sought ranks first, a second pass counts what
lies before and inside the brackets, and where few rows are inside, as in all but very
large tables, it also takes their values, which decide. Else the brackets are narrowed:
each pass counts, with map-side combination, equal bins of the intervals in which the
ranks still lie, and shrinks each to the smallest and largest value of one bin.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BINS = 128
FEW = 200_000  # rows in open intervals whose values are ranked directly
ACCURACY = 10_000  # of the sketch: its ranks are off by a share of 1 / ACCURACY at most
MARGIN = 3 / ACCURACY  # of a bracket, on each side


def exact_quantiles(rows: DataFrame, key: str, value: str, qs: Sequence[float], bins: int = BINS, few: int = FEW) -> DataFrame:
    """(key, quantiles) with linear interpolation; nulls and NaN don't count, keys without values have no row.

    The driver holds a few intervals a key and rank and, for one pass, ``bins`` counts of
    each; keys must be few, like features.
    """
    spark = rows.sparkSession
    data = rows.select(F.col(key).alias("k"), F.col(value).cast("double").alias("v")).where("v is not null and not isnan(v)")
    size, low, high, near = {}, {}, {}, {}
    probes = [x for q in qs for x in (max(0.0, q - MARGIN), min(1.0, q + MARGIN))]
    for r in data.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.percentile_approx("v", probes, ACCURACY).alias("p")).collect():
        size[r["k"]], low[r["k"]], high[r["k"]], near[r["k"]] = r["n"], r["lo"], r["hi"], r["p"]
    ranks = {k: sorted({i for q in qs for i in (int(q * (n - 1)), min(int(q * (n - 1)) + 1, n - 1))}) for k, n in size.items()}
    #: (key, rank) -> its value once known; open: (key, lo, hi) -> (rows before it, rows in it, its ranks).
    known: dict = {}
    open_ = {(k, low[k], high[k]): (0, size[k], rs) for k, rs in ranks.items()}

    def brackets(k) -> list[tuple[float, float]]:
        """Disjoint intervals that the sketch puts the ranks in, ascending."""
        pairs = sorted((low[k] if q - MARGIN <= 0 else lo, high[k] if q + MARGIN >= 1 else hi) for q, lo, hi in zip(qs, near[k][::2], near[k][1::2], strict=True))
        out = [pairs[0]]
        for lo, hi in pairs[1:]:
            out[-1:] = [(out[-1][0], max(out[-1][1], hi))] if lo <= out[-1][1] else [out[-1], (lo, hi)]
        return out

    def settle(entries: dict) -> dict:
        for (k, lo, hi), (_, _, rs) in list(entries.items()):
            if lo == hi:
                known.update({(k, r): lo for r in rs})
                del entries[(k, lo, hi)]
        return entries

    def inside(entries: dict) -> DataFrame:
        """(k, iv, v) of the rows in open intervals, which don't overlap."""
        spans: dict = {}
        for k, lo, hi in entries:
            spans.setdefault(k, []).append((lo, hi))
        table = spark.createDataFrame([(k, s) for k, s in spans.items()], f"k {dict(data.dtypes)['k']}, spans array<struct<lo:double,hi:double>>")
        hit = F.get(F.filter("spans", lambda s: F.col("v").between(s["lo"], s["hi"])), F.lit(0))
        return data.join(F.broadcast(table), "k").select("k", hit.alias("iv"), "v").where("iv is not null")  # a row a key

    def bracketed(entries: dict) -> dict:
        """The open intervals after a pass over the sketch's brackets; a rank outside these keeps its key's whole interval."""
        spans = {k: brackets(k) for k, _, _ in entries}
        table = spark.createDataFrame([(k, s) for k, s in spans.items()], f"k {dict(data.dtypes)['k']}, spans array<struct<lo:double,hi:double>>")
        rows = data.join(F.broadcast(table), "k").withColumn("b", F.size(F.filter("spans", lambda s: s["lo"] <= F.col("v"))))  # a row a key
        inside = (F.col("b") > 0) & (F.col("v") <= F.get("spans", F.col("b") - 1)["hi"])
        small = sum(size[k] * 2 * MARGIN * len(qs) for k in spans) <= few
        cell = F.when(inside, F.col("v") if small else F.lit(0.0)).alias("v")
        counted: dict = {}
        for r in rows.groupBy("k", "b", cell).agg(F.count(F.lit(1)).alias("n")).collect():  # few distinct values, or a row a bracket
            counted.setdefault(r["k"], {}).setdefault(r["b"], []).append((r["v"], r["n"]))
        out: dict = {}
        for k, own in spans.items():
            before, left = sum(n for _, n in counted[k].get(0, [])), set(ranks[k])
            for b, (lo, hi) in enumerate(own, 1):
                cells = counted[k].get(b, [])
                found = sorted(c for c in cells if c[0] is not None)
                n = sum(c[1] for c in found)
                if mine := [r for r in ranks[k] if before <= r < before + n]:
                    left -= set(mine)
                    if small:
                        at = before
                        for v, m in found:
                            known.update({(k, r): v for r in mine if at <= r < at + m})
                            at += m
                    else:
                        out[(k, lo, hi)] = (before, n, mine)
                before += sum(c[1] for c in cells)
            if left:
                out = {e: x for e, x in out.items() if e[0] != k} | {(k, low[k], high[k]): (0, size[k], ranks[k])}
        return out

    open_ = settle(open_)
    if open_ and sum(n for _, n, _ in open_.values()) > few:
        open_ = settle(bracketed(open_))
    while open_ and sum(n for _, n, _ in open_.values()) > few:
        at = F.least(F.floor((F.col("v") - F.col("iv.lo")) / (F.col("iv.hi") - F.col("iv.lo")) * bins).cast("int"), F.lit(bins - 1))
        counted: dict = {}
        for r in inside(open_).groupBy("k", "iv", at.alias("b")).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect():
            counted.setdefault((r["k"], r["iv"]["lo"], r["iv"]["hi"]), []).append((r["b"], r["n"], r["lo"], r["hi"]))
        narrower: dict = {}
        for entry, (before, _, rs) in open_.items():
            for _, n, lo, hi in sorted(counted[entry]):
                if own := [r for r in rs if before <= r < before + n]:
                    narrower[(entry[0], lo, hi)] = (before, n, own)
                before += n
        open_ = settle(narrower)
    if open_:
        values: dict = {}
        for r in inside(open_).groupBy("k", "iv", "v").agg(F.count(F.lit(1)).alias("n")).collect():  # FEW rows at most
            values.setdefault((r["k"], r["iv"]["lo"], r["iv"]["hi"]), []).append((r["v"], r["n"]))
        for entry, (before, _, rs) in open_.items():
            for v, n in sorted(values[entry]):
                known.update({(entry[0], r): v for r in rs if before <= r < before + n})
                before += n
    out = []
    for k, n in size.items():
        cells = []
        for q in qs:
            i = int(q * (n - 1))
            a, b = known[(k, i)], known[(k, min(i + 1, n - 1))]
            cells.append(a + (b - a) * (q * (n - 1) - i))
        out.append((k, cells))
    return spark.createDataFrame(out, f"k {dict(data.dtypes)['k']}, quantiles array<double>").withColumnRenamed("k", key)
