"""Helpers that the operators share: the cluster's shared folder and Arrow mapping."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, as a URI with its file system's scheme.

    Where it is unset, a run in one process (tests) gets a folder of its own; on a cluster
    that is an error, as executors don't see one another's folders.
    """
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and context.getCheckpointDir() is None:
        if not re.fullmatch(r"local(\[[^]]*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        own = tempfile.mkdtemp(prefix="modelwatch-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        base = f"file://{own}"
    if base and context.getCheckpointDir() is None:
        context.setCheckpointDir(base)
    return qualified(spark, base or context.getCheckpointDir())


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with the scheme and host of the file system that Spark finds it in; a bare path is in the default one."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path.rstrip("/"))
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(at).toString()


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` behind a reliable checkpoint, which keeps its partitions and cuts its lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint(True)


class Scratch:
    """Tables in the shared folder that one run writes and reads again."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.base = f"{shared_dir(spark)}/modelwatch-{uuid.uuid4().hex}"
        self.names: list[str] = []
        atexit.register(self.close)  # what a query returns may be read until then

    def close(self) -> None:
        """Frees all tables; nothing read from them can be read after it."""
        atexit.unregister(self.close)
        with contextlib.suppress(Exception):  # the session may be gone
            self._delete(self.base)
        self.names = []

    def path(self, name: str) -> str:
        return f"{self.base}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """``df`` written as a table and read back; executors that are lost later don't lose it."""
        path = self.path(name)
        self.names.append(name)
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        """Frees a table that no later step reads."""
        self._delete(self.path(name))

    def _delete(self, path: str) -> None:
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)

    def keep(self, *names: str) -> None:
        """Frees all tables but these."""
        for name in self.names:
            if name not in names:
                self.drop(name)
        self.names = list(names)


def arrow_schema(schema: str | StructType) -> pa.Schema:
    """The Arrow schema of a Spark one."""
    kind = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    return to_arrow_schema(kind)


def plain(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """A string or binary column as one 64-bit-offset array without nulls (null counts as empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    big = pa.large_binary() if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else pa.large_string()
    if column.type != big:
        column = column.cast(big)
    if column.null_count:
        column = pc.fill_null(column, b"" if big == pa.large_binary() else "")
    return column


def slices(batch: pa.RecordBatch, column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """``batch`` in runs of rows whose ``column`` holds about ``limit`` bytes; a longer value comes alone."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start = held = 0
    for i, n in enumerate(sizes.tolist()):
        if i > start and held + n > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    yield batch.slice(start)


def trim() -> None:
    """Gives memory that is free back to the system: a worker lives on after its task, and its executor counts what it holds."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only the GNU library has it
        ctypes.CDLL(None).malloc_trim(0)


def arrow_map(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | list | None]], schema: str | StructType, column: str, limit: int = 2 << 20) -> DataFrame:
    """``df`` through ``make()(rows)``, a bounded number of text bytes at a time."""

    def run(batches):
        step = make()
        for batch in batches:
            for part in slices(batch, column, limit):
                if (out := step(part)) is not None:
                    yield from out if isinstance(out, list) else [out]
        trim()

    return df.mapInArrow(run, schema)


def text_bytes_list(column: pa.Array) -> list[bytes]:
    """Each text's UTF-8 bytes; null counts as empty."""
    return plain(column).cast(pa.large_binary()).to_pylist()
