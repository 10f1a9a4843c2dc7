"""Near-dedup's roles are read in as many tasks as their rows need."""

from modelwatch.llm import minhash
from modelwatch.llm.shared import Scratch
from pyspark.sql import functions as F


def test_roles_are_read_as_their_rows_need(spark, monkeypatch):
    monkeypatch.setattr(minhash, "FOLLOWERS", 3)
    scratch = Scratch(spark)
    texts = scratch.save(spark.range(40).select(F.col("id").alias("doc_id"), F.repeat(F.lit("one two "), 9).alias("text")), "texts").hint("merge")
    pairs = [*((a, 0) for a in range(1, 30)), *((a, 30) for a in range(31, 33)), (34, 33)]
    frame = scratch.save(spark.createDataFrame(pairs, "a long, b long"), "pairs")
    links = minhash.verified(frame, texts, minhash.WIDTH)
    plan = links._jdf.queryExecution().executedPlan().toString()
    assert "ExistingRDD" not in plan and "Broadcast" not in plan  # a checkpoint is read by a task for each of its partitions
    assert sorted(map(tuple, links.collect())) == sorted(pairs)
    scratch.close()
