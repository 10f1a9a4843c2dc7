"""The folder that the driver and all executors share, files in it that appear whole or not at all, and tables in it."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession, name: str) -> str:
    """A new path below ``spark.checkpoint.dir``; where that is unset, a run in one process gets a folder of its own and a cluster an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        own = tempfile.mkdtemp(prefix="modelwatch-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        base = f"file://{own}"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def checkpoints(spark: SparkSession) -> None:
    """Sets the session's checkpoint folder if it has none."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder(spark, "checkpoints"))


def stored(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` as a table in the shared folder, worked out once; ``checkpoint()`` works rows out twice that no shuffle keeps."""
    path = folder(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def spread(rows: DataFrame, *keys: str, each: int = 32_768) -> DataFrame:
    """``rows`` dealt by a hash of ``keys`` into partitions of about ``each``, each in the order of ``keys``.

    A file is read by as few tasks as it has row groups; models and Python work on narrow
    rows need more. The rows are counted first. Tables of up to ``each`` rows stay as they are.
    """
    parts = -(-rows.count() // each)
    return rows if parts < 2 else rows.repartition(parts, *keys).sortWithinPartitions(*keys)


def _system(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file's text; None where there is none."""
    where, system = _system(spark, path)
    if not system.exists(where):
        return None
    stream = system.open(where)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def publish(spark: SparkSession, path: str, text: str) -> None:
    """Puts a small file in place by a rename: readers see the old one, none or the new one, never a part of it."""
    where, system = _system(spark, path)
    part, _ = _system(spark, f"{path}.{uuid.uuid4().hex}.part")
    stream = system.create(part, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    if not system.rename(part, where):  # some file systems don't rename over a file
        system.delete(where, False)
        if not system.rename(part, where):
            raise OSError(f"could not put {path} in place")
