"""Report artifacts and dataset snapshots as tables."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from modelwatch.operators import snapshot
from modelwatch.sources import files


def read_documents(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(name, path, body) of whole text files; ``body`` that is no JSON stays text."""
    df = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("body"))
    return df.select(F.element_at(F.split("path", "/"), -1).alias("name"), "path", "body")


def first_found(documents: DataFrame, folders: list[str]) -> DataFrame:
    """(name, body): of documents with one name that of the earliest folder which parses."""
    rank = F.array_position(F.array(*map(F.lit, folders)), F.regexp_replace("path", r"^file:/*|/[^/]*$", ""))
    good = documents.where(F.try_parse_json("body").isNotNull())
    return good.groupBy("name").agg(F.min_by("body", rank).alias("body"))


def json_rows(documents: DataFrame) -> DataFrame:
    """(name, line, v) of JSON-lines documents: objects only, blank and broken lines left out."""
    lines = documents.select("name", F.posexplode(F.split("body", "\n")).alias("line", "text"))
    parsed = lines.select("name", "line", F.try_parse_json("text").alias("v"))
    return parsed.where(F.schema_of_variant("v").startswith("OBJECT"))


def write_snapshot(rows: DataFrame, path: str, features: list[str], label: str, group: str) -> DataFrame:
    """Writes rows and a metadata row beside them: count, names, content hash. Returns the metadata."""
    rows.write.mode("overwrite").parquet(f"{path}/rows")
    kept = rows.sparkSession.read.parquet(f"{path}/rows")
    meta = snapshot.content_hash(kept, [*features, label, group]).withColumn("names", F.array(*map(F.lit, features)))
    meta.write.mode("overwrite").parquet(f"{path}/meta")
    return rows.sparkSession.read.parquet(f"{path}/meta")


def read_snapshot(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/rows"), spark.read.parquet(f"{path}/meta")


FILES = "family string, path string, modified timestamp, length bigint"


def artifact_files(spark: SparkSession, folder: str, pattern: str, family: str) -> DataFrame:
    """FILES of the files below a folder whose names match a glob; ``family`` is a pattern whose first group is the name's family.

    Only names, times and lengths are read, no content. Names without a family are left out.
    """
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    rows = found.select(F.regexp_extract(name, family, 1).alias("family"), "path", F.col("modificationTime").alias("modified"), "length")
    return rows.where("family <> ''")


def _sidecar(path: str) -> str | None:
    """The digest that a file's ``.sha256`` names: its first word, in lower case."""
    words = (files.small(f"{path}.sha256") or "").split()
    return words[0].lower() if words else None


def _verdict(path: str) -> tuple[str, str | None]:
    recorded = _sidecar(path)
    if recorded is None:
        return "no sidecar", None
    try:
        found = files.digest(path)
    except OSError:
        return "unreadable", None
    return ("intact" if found == recorded else "digest differs"), found


def file_verdicts(found: DataFrame) -> DataFrame:
    """Adds (verdict, sha256) to every row of FILES: intact, digest differs, no sidecar or unreadable.

    A file is read a megabyte at a time where its row is, so no cell holds one.
    """

    def judge(batches):
        import pyarrow as pa

        for b in batches:
            each = [_verdict(p) for p in b.column("path").to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([v for v, _ in each], pa.string()), pa.array([h for _, h in each], pa.string())], names=[*b.schema.names, "verdict", "sha256"])

    return found.mapInArrow(judge, found.withColumns({"verdict": F.lit(None).cast("string"), "sha256": F.lit(None).cast("string")}).schema)


def newest_artifact(found: DataFrame, contracts: DataFrame | None = None) -> DataFrame:
    """(family, path, verdict, sha256): each family's files newest first, up to the first that may be loaded.

    ``found``: FILES. ``contracts``: (path, compatible) as ``contracts.compatible`` judges
    them, one row a path; a file without one is refused. A file is loaded where it has its
    sidecar's digest, judged before anything else of it is used, and is compatible. What was
    refused before it has its reason; of equally new files the largest path counts. Older
    files are not opened. A family is a run of sorted rows, so a task holds one batch and
    one chunk of a file however many files a family has. A family with a null name has no row.
    """
    rows = found.where("family is not null").select("family", "path", "modified")
    rows = rows.withColumn("compatible", F.lit(True)) if contracts is None else rows.join(contracts.select("path", "compatible"), "path", "left")
    ordered = rows.select("family", "path", "modified", "compatible").repartition("family").sortWithinPartitions("family", F.desc("modified"), F.desc("path"))

    def walk(batches) -> Iterator:
        import pyarrow as pa

        done = None
        for b in batches:
            out = []
            for r in b.select(["family", "path", "compatible"]).to_pylist():
                if r["family"] == done:
                    continue
                verdict, found_digest = _verdict(r["path"])
                if verdict == "intact":
                    verdict = "no contract" if r["compatible"] is None else "loaded" if r["compatible"] else "incompatible"
                if verdict == "loaded":
                    done = r["family"]
                out.append((r["family"], r["path"], verdict, found_digest))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()) for c in zip(*out)], names=["family", "path", "verdict", "sha256"])

    return ordered.mapInArrow(walk, "family string, path string, verdict string, sha256 string")


def write_artifacts(rows: DataFrame, folder: str) -> DataFrame:
    """Writes (name, body, sidecar) as files ``name`` with the text ``body`` and, where it isn't null, ``name.sha256``; returns (name, length).

    Sidecars come first, so a file that is seen has its own. Run the returned frame once: an action on it writes.
    """

    def put(batches):
        import pyarrow as pa

        for b in batches:
            sizes = []
            for r in b.to_pylist():
                data = r["body"].encode()
                if r["sidecar"] is not None:
                    files.put(f"{folder}/{r['name']}.sha256", r["sidecar"].encode())
                files.put(f"{folder}/{r['name']}", data)
                sizes.append(len(data))
            yield pa.RecordBatch.from_arrays([b.column("name"), pa.array(sizes, pa.int64())], names=["name", "length"])

    return rows.select(F.col("name").cast("string"), F.coalesce("body", F.lit("")).alias("body"), "sidecar").mapInArrow(put, "name string, length bigint")
