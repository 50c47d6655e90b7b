"""Intermediate tables in the folder that all executors share: they cut lineage and outlive lost executors."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_paths: list[tuple[SparkSession, str]] = []
_own: list[str] = []


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir or the context's; a folder of this machine's in local mode only (tests)."""
    told = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not told:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="roadloom-"))
        told = _own[0]
    return told.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """Writes df once and reads it back; deleted when the application ends."""
    spark = df.sparkSession
    path = f"{folder(spark)}/roadloom-table-{uuid.uuid4().hex}"
    if not _paths:
        atexit.register(_clean)
    _paths.append((spark, path))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _clean() -> None:
    for spark, path in _paths:
        with contextlib.suppress(Exception):  # the session may be gone
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
