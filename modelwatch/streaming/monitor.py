"""Monitoring over a stream of predictions: class mix by event-time window, and labels that arrive later."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modelwatch.functions.numbers import rounded


def class_mix(stream: DataFrame, ts: str = "ts", code: str = "acuity", window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, code, n, confidence) by tumbling window; events later than ``late`` are left out."""
    timed = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    by = timed.groupBy(F.window(ts, window).alias("w"), code)
    return by.agg(F.count(F.lit(1)).alias("n"), rounded(F.avg("confidence")).alias("confidence")).select(F.col("w.start").alias("start"), code, "n", "confidence")


def each_batch(stream: DataFrame, step: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, mode: str = "append"):
    """Starts a query that appends ``step(batch)`` of every micro-batch; a batch that is run again replaces its own folder.

    mode: ``append`` has a window once the watermark has closed it, ``update`` its state after every batch, open or closed.
    """

    def write(batch: DataFrame, number: int) -> None:
        step(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(rows: DataFrame, keys: list[str], batch: str = "batch") -> DataFrame:
    """Of the rows that ``each_batch`` wrote in update mode the last one of each key."""
    values = [c for c in rows.columns if c not in (*keys, batch)]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), batch).alias("r")).select(*keys, "r.*")
