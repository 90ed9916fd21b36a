"""Cutting lineage: intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Removes a query's shuffle files when it ends: what was written can be read again without them.
CLEAN_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where none is named, a temporary one on a local
    master; on a cluster that is an error, since executors would write to disks of their own."""
    sc = spark.sparkContext
    at = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not at:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="shared-"))
        at = sc.getCheckpointDir()
    return at.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


_folders: dict[str, tuple[SparkSession, str]] = {}


def _forget() -> None:
    for spark, path in _folders.values():
        with contextlib.suppress(Exception):  # the session may have ended, and the folder with it
            _delete(spark, path)


def table_path(spark: SparkSession, kind: str = "table") -> str:
    """A new path in this application's part of the shared folder, which goes when the program ends."""
    app = spark.sparkContext.applicationId
    folder = f"{shared_dir(spark)}/tables-{app}"
    if not _folders:
        atexit.register(_forget)
    _folders.setdefault(app, (spark, folder))
    return f"{folder}/{kind}-{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Write `df` to the shared folder and read it back: later plans start there, lost executors cost nothing."""
    spark = df.sparkSession
    path, before = table_path(spark), spark.conf.get(CLEAN_SHUFFLES, None)
    spark.conf.set(CLEAN_SHUFFLES, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEAN_SHUFFLES, before) if before is not None else spark.conf.unset(CLEAN_SHUFFLES)
    return spark.read.schema(df.schema).parquet(path)


def measured(df: DataFrame, **figures: Column) -> tuple[DataFrame, dict]:
    """The same, with the number of rows (`rows`) and other aggregates, taken while it is written."""
    seen = Observation()
    written = materialize(df.observe(seen, F.count("*").alias("rows"), *[c.alias(n) for n, c in figures.items()]))
    return written, seen.get


def release(df: DataFrame) -> None:
    """Delete a materialized table that nothing reads any more."""
    for f in {re.sub(r"/[^/]*$", "", f) for f in df.inputFiles()}:
        _delete(df.sparkSession, f)
