"""Balanced contiguous shards from global prefix sums of byte sizes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modelwatch.llm.shared import arrow_schema, checkpointed


def sized(documents: DataFrame, overhead: int = 16) -> DataFrame:
    """(doc_id, size, text_crc32): UTF-8 bytes of the text plus ``overhead``, and the bytes' CRC-32. Null text: no bytes."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return documents.select(F.col("doc_id"), (F.octet_length(text).cast("long") + overhead).alias("size"), F.crc32(F.encode(text, "utf-8")).alias("text_crc32"))


def assign_shards(rows: DataFrame, shards: int = 40) -> DataFrame:
    """(doc_id, size, text_crc32) in doc_id order, cut into ``shards`` contiguous runs of nearly equal bytes.

    The rows are range-partitioned and sorted once, on narrow columns only, and
    checkpointed so that the partitions stay as they are. Each partition's total
    goes to the driver (one row a partition); the exclusive prefix sums of these
    totals turn a running sum inside a partition into a global one. A row belongs
    to the shard in whose equal share of all bytes its middle lies, so each cut is
    the document boundary nearest to its target. ``slot`` counts the rows of a
    shard from 0.

    Rows with equal doc_id are ordered by checksum and size; rows equal in all of
    these are interchangeable. A null doc_id sorts first. One row wider than a share
    can leave shards empty. An empty table gives no rows. Only sizes travel, so long texts
    cost nothing here; other columns are dropped. Rows equal in all three columns meet in one
    range partition, as narrow rows.
    """
    keys = ["doc_id", "text_crc32", "size"]
    ordered = checkpointed(rows.select(*keys).repartitionByRange(*keys).sortWithinPartitions(*keys))
    totals = ordered.groupBy(F.spark_partition_id().alias("part")).agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows")).collect()
    before, byte_sum, row_sum = {}, 0, 0
    for r in sorted(totals, key=lambda r: r["part"]):
        before[r["part"]] = (byte_sum, row_sum)
        byte_sum, row_sum = byte_sum + r["bytes"], row_sum + r["rows"]
    total = byte_sum
    schema = "doc_id long, size long, text_crc32 long, shard int, row long"
    fields = arrow_schema(schema)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        bytes_at, row_at = before.get(TaskContext.get().partitionId(), (0, 0))
        for batch in batches:
            size = batch.column("size").to_numpy()
            ends = bytes_at + np.cumsum(size)
            shard = np.minimum((2 * ends - size) * shards // max(1, 2 * total), shards - 1)
            at = row_at + np.arange(len(size))
            if len(size):
                bytes_at, row_at = int(ends[-1]), row_at + len(size)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("size"), batch.column("text_crc32"), pa.array(shard.astype(np.int32)), pa.array(at)], schema=fields)

    placed = ordered.mapInArrow(place, schema)
    first = placed.groupBy("shard").agg(F.min("row").alias("first"))  # a row a shard
    return placed.join(F.broadcast(first), "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("row") - F.col("first")).alias("slot"))


def query(spark, sf_dir: str) -> DataFrame:
    """Every document's shard under the law ``bytes``."""
    placed = assign_shards(sized(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
