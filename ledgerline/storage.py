"""Where tables between jobs are written."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_ROOT = str(Path(__file__).resolve().parents[1])
_own_dir: str | None = None
_scopes: list[list[str]] = []


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path in the folder of spark.checkpoint.dir. Where that is unset, a local session gets a folder of its own; a cluster has none that all executors see."""
    global _own_dir
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        _own_dir = _own_dir or tempfile.mkdtemp(prefix="spark-shared-")
        root = f"file://{_own_dir}"
    path = f"{root.rstrip('/')}/ledgerline-{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append(path)
    return path


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Tables that are staged within are deleted at its end, so nothing that is still to be computed may read them then."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in map(spark._jvm.org.apache.hadoop.fs.Path, _scopes.pop()):
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stage(df: DataFrame, label: str, path: str | None = None) -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage ends here, lost executors cost no rework.

    Tables are named by application. They go at the end of the scope that they are made in, or when the application's
    checkpoint folder is cleared. path: where to write, if not to a new path of the innermost scope.
    """
    path = path or shared_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def workers_import_us(spark: SparkSession) -> None:
    """Let Python workers import this package when it is run from a checkout and not installed."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")).split(os.pathsep) if p]
    if _ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([_ROOT, *paths])
