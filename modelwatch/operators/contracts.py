"""Contracts of features and artifacts: fingerprints, compatibility, integrity, provenance."""

from __future__ import annotations

import hashlib
import json
import platform
import subprocess
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Probe sentences whose features a contract pins down; what they say doesn't matter, only that it stays.
PROBES = (("p1", "bad pain, no fever", "65+", "Female"), ("p2", "", None, None), ("p3", "not well and very tired!", "18-39", "Male"))


def fingerprint(spark: SparkSession, vectors: Callable[[DataFrame], DataFrame], config: dict, probes: Sequence[tuple] = PROBES) -> str:
    """SHA-256 over a configuration and the vectors ``x`` of the probes (id, text, age, sex)."""
    df = spark.createDataFrame(list(probes), "id string, text string, age string, sex string")
    got = [[r["id"], [round(v, 9) for v in r["x"]]] for r in vectors(df).select("id", "x").orderBy("id").collect()]  # a few probes
    return hashlib.sha256(json.dumps([config, got], sort_keys=True).encode()).hexdigest()


def check_contract(recorded: dict | None, names: Sequence[str], current: str) -> dict:
    """{ok, reason}: a missing record fails, then differing names, then a differing fingerprint."""
    if not recorded:
        return {"ok": False, "reason": "no contract was recorded"}
    if list(recorded.get("names", [])) != list(names):
        return {"ok": False, "reason": "feature names differ"}
    if recorded.get("fingerprint") != current:
        return {"ok": False, "reason": "feature values differ"}
    return {"ok": True, "reason": None}


def compatible(artifacts: DataFrame, schema_version: int, names: Sequence[str]) -> DataFrame:
    """Adds (compatible, reason) to rows (schema_version, names array, estimators array, fingerprint)."""
    reason = (
        F.when(F.coalesce(F.col("schema_version") != schema_version, F.lit(True)), "schema version differs")
        .when(F.coalesce(F.col("names") != F.array(*map(F.lit, names)), F.lit(True)), "feature names differ")
        .when(F.coalesce(F.size("estimators") < 1, F.lit(True)), "no estimators")
        .when(F.col("fingerprint").isNull(), "no contract was recorded")
    )
    return artifacts.withColumns({"compatible": reason.isNull(), "reason": reason})


def newest_compatible(artifacts: DataFrame, family: str = "family") -> DataFrame:
    """(family, path): of each family's artifacts, judged by ``compatible`` and ``intact``, the newest that may be loaded.

    Columns family, path, modified, compatible, intact. What isn't known to be intact is
    refused. Of equally new ones the largest path counts; families without any have a null path.
    """
    usable = F.coalesce(F.col("compatible") & F.col("intact"), F.lit(False))
    return artifacts.groupBy(family).agg(F.max(F.when(usable, F.struct("modified", "path"))).alias("m")).select(family, F.col("m.path").alias("path"))


def backend_status(spark: SparkSession, modules: Sequence[str]) -> DataFrame:
    """(module, status) of optional backends: available, not installed, or failed to import (what is there but broken), with the reason."""
    import importlib

    def status(name: str) -> str:
        try:
            importlib.import_module(name)
        except ModuleNotFoundError as e:
            return f"not installed ({e.name})"
        except Exception as e:  # anything can go wrong in a broken module
            return f"failed to import ({type(e).__name__}: {e})"
        return "available"

    return spark.createDataFrame([(m, status(m)) for m in modules], "module string, status string")


def intact(files: DataFrame, sidecars: DataFrame) -> DataFrame:
    """(path, intact): (path, content) against (path, sha256) of its sidecar; without a sidecar a file is not intact."""
    return files.select("path", F.sha2("content", 256).alias("_h")).join(sidecars.select("path", F.trim("sha256").alias("_s")), "path", "left").select("path", F.coalesce(F.col("_h") == F.col("_s"), F.lit(False)).alias("intact"))


def provenance(spark: SparkSession, folder: str = ".") -> DataFrame:
    """One row: commit, branch, dirty flag and versions; what can't be found is ``unknown``."""

    def git(*args: str) -> str:
        try:
            return subprocess.run(["git", "-C", folder, *args], capture_output=True, text=True, timeout=10, check=True).stdout.strip()
        except (OSError, subprocess.SubprocessError):
            return "unknown"

    status = git("status", "--porcelain")
    row = (git("rev-parse", "HEAD"), git("rev-parse", "--abbrev-ref", "HEAD"), "unknown" if status == "unknown" else str(bool(status)).lower(), platform.python_version(), platform.platform(), spark.version)
    return spark.createDataFrame([row], "commit string, branch string, dirty string, python string, platform string, spark string")


def live_or_sample(live: DataFrame, sample: DataFrame, wanted: bool, least: int = 200) -> tuple[str, DataFrame]:
    """The live rows if they are wanted and there are ``least`` of them, else the sample."""
    enough = wanted and live.limit(least).count() >= least
    return ("live", live) if enough else ("sample", sample)
