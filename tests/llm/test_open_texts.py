"""Texts of near-dedup are not sent to all tasks by the size that their table has on disk."""

from modelwatch.llm import minhash
from modelwatch.llm.shared import Scratch
from pyspark.sql import functions as F


def test_texts_are_not_broadcast(spark):
    scratch = Scratch(spark)
    texts = scratch.save(spark.range(40).select(F.col("id").alias("doc_id"), F.repeat(F.lit("one two "), 1000).alias("text")), "texts")
    reps = scratch.save(spark.range(40).select(F.col("id").alias("rep"), F.lit(2).cast("long").alias("n_shingles"), F.lit(b"x").alias("sketch")), "reps")
    labelled = scratch.save(spark.range(30).select(F.lit(1).cast("long").alias("key"), F.col("id").alias("rep"), F.col("id").alias("comp")), "labelled")
    _, open_texts = minhash.still_open(labelled, reps, texts, scratch)
    near = labelled.select(F.col("key").alias("cell"), "rep", "comp")
    for joined in (near.join(open_texts.withColumnRenamed("doc_id", "rep"), "rep"), open_texts.join(near.withColumnRenamed("rep", "doc_id"), "doc_id")):
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan
        assert joined.count() == 30
    links = minhash.verified(spark.range(1, 30).select(F.col("id").alias("a"), F.lit(0).cast("long").alias("b")), open_texts, minhash.WIDTH)
    assert "Broadcast" not in links._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, links.collect())) == [(a, 0) for a in range(1, 30)]
    scratch.close()
