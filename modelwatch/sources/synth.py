"""A seeded case generator whose draws follow from hashes of the row number, so any partitioning gives the same rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Class priors, their shifted form, bands and their weights, rates.
PRIOR = (0.08, 0.12, 0.30, 0.32, 0.18)
SHIFTED = (0.16, 0.20, 0.30, 0.22, 0.12)
BANDS, BAND_WEIGHTS = ("0-17", "18-39", "40-64", "65+"), (0.30, 0.30, 0.28, 0.12)
VAGUE, EXTRA, EXTRA_SHIFTED, ESCALATED = 0.08, 0.15, 0.30, 0.85


def uniform(key: Column, purpose: str, seed: int) -> Column:
    """A draw in [0, 1) from the first seven hex digits of an MD5, which other engines have too."""
    digest = F.md5(F.concat(F.lit(f"{seed}:{purpose}:"), key.cast("string")))
    return F.conv(F.left(digest, F.lit(7)), 16, 10).cast("long") / float(1 << 28)


def categorical(u: Column, weights: Sequence[float]) -> Column:
    """0-based class of a draw by cumulative weights."""
    out, total = F.lit(len(weights) - 1), sum(weights)
    for i in range(len(weights) - 2, -1, -1):
        out = F.when(u < round(sum(weights[: i + 1]) / total, 10), i).otherwise(out)
    return out


def distractors(profiles: DataFrame) -> DataFrame:
    """(class, pool): sorted categories of the classes from one below to one above, from (class, category) rows."""
    near = F.explode(F.array(F.col("class") - 1, F.col("class"), F.col("class") + 1))
    pools = profiles.select(near.alias("class"), "category").groupBy("class").agg(F.array_sort(F.collect_set("category")).alias("pool"))
    return pools.join(profiles.select("class").distinct(), "class", "left_semi")


def cases(spark: SparkSession, n: int | DataFrame, profiles: Mapping[int, Sequence[Sequence[str]]], lexicon: Mapping[str, Sequence[str]], seed: int = 42, shift: bool = False, vague: str = "not feeling well") -> DataFrame:
    """(id, y, band, sex, text, grp): labelled texts of ``n`` cases, or one for each ``id`` of a table.

    profiles: class -> combinations of categories. A share of rows is vague, a share has
    one more category of a neighbouring class, and most of the oldest band's classes 2
    and 3 count as one class more severe.
    """
    u = lambda purpose: uniform(F.col("id"), purpose, seed)
    pick = lambda xs, purpose: F.element_at(xs, (F.floor(u(purpose) * F.size(xs)) + 1).cast("int"))
    literal = lambda v: F.array(*[literal(x) for x in v]) if isinstance(v, (list, tuple)) else F.lit(v)
    combos = F.create_map(*[x for k, v in profiles.items() for x in (F.lit(k), literal([list(c) for c in v]))])
    pools = F.create_map(*[x for k in profiles for x in (F.lit(k), literal(sorted({c for j in (k - 1, k, k + 1) for combo in profiles.get(j, []) for c in combo})))])
    phrases = F.create_map(*[x for k, v in lexicon.items() for x in (F.lit(k), literal(list(v)))])
    ids = n.select("id") if isinstance(n, DataFrame) else spark.range(n)
    rows = ids.withColumn("base", categorical(u("class"), SHIFTED if shift else PRIOR)).withColumn("band", F.element_at(literal(list(BANDS)), categorical(u("band"), BAND_WEIGHTS) + 1)).withColumn("sex", F.when(u("sex") < 0.5, "Female").otherwise("Male"))
    rows = rows.withColumn("chosen", F.concat(pick(F.element_at(combos, F.col("base")), "combo"), F.when(u("extra") < (EXTRA_SHIFTED if shift else EXTRA), F.array(pick(F.element_at(pools, F.col("base")), "distractor"))).otherwise(F.array().cast("array<string>"))))
    draw = lambda c, i: F.element_at(F.element_at(phrases, c), (F.floor(F.conv(F.left(F.md5(F.concat_ws(":", F.lit(seed), F.lit("phrase"), F.col("id"), i)), F.lit(7)), 16, 10).cast("long") / float(1 << 28) * F.size(F.element_at(phrases, c))) + 1).cast("int"))
    text = F.when(u("vague") < VAGUE, F.lit(vague)).otherwise(F.array_join(F.transform("chosen", draw), " and "))
    y = F.when((F.col("band") == "65+") & F.col("base").isin(2, 3) & (u("escalate") < ESCALATED), F.col("base") - 1).otherwise(F.col("base"))
    return rows.select("id", y.alias("y"), "band", "sex", text.alias("text"), F.concat_ws(" · ", "band", "sex").alias("grp"))
