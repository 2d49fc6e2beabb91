"""Intermediate tables in the folder that the cluster shares, and their removal."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_FALLBACK: dict[str, str] = {}
#: Folder of the innermost scope that is open in this thread or task; without one, tables go to the session's own folder.
_SCOPE: ContextVar[str | None] = ContextVar("scope", default=None)
_SESSIONS: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """Shared folder for intermediate tables: spark.checkpoint.dir, or a temporary folder where
    that is unset (single-machine sessions such as the tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if "root" not in _FALLBACK:
        _FALLBACK["root"] = tempfile.mkdtemp(prefix="corvane-")
    return _FALLBACK["root"]


def file_system(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def delete(spark: SparkSession, path: str) -> None:
    files, at = file_system(spark, path)
    files.delete(at, True)


def _session_folder(spark: SparkSession) -> str:
    """The session's folder; the driver's JVM deletes it as it ends."""
    key = f"{scratch_root(spark)}/corvane/{spark.sparkContext.applicationId}"
    if key not in _SESSIONS:
        _SESSIONS[key] = f"{key}-{uuid.uuid4().hex}"
        files, at = file_system(spark, _SESSIONS[key])
        files.mkdirs(at)
        files.deleteOnExit(at)
    return _SESSIONS[key]


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{_SCOPE.get() or _session_folder(spark)}/{uuid.uuid4().hex}/{name}"


@contextlib.contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Intermediate tables written inside are deleted at its end: what is kept must be written elsewhere before."""
    folder = scratch_path(spark, "scope")
    token = _SCOPE.set(folder)
    try:
        yield
    finally:
        _SCOPE.reset(token)
        delete(spark, folder)


def materialize(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write ``df`` to the shared scratch folder and return the reread table: lineage is cut, and
    what is read later survives the loss of any executor."""
    spark = df.sparkSession
    path = path or scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
