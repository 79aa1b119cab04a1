"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Bytes of a table for each part it is spread into, at least.
SPREAD_BYTES = 256 << 10

_made: list[str] = []
_own: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: ``spark.checkpoint.dir``. Where it is unset, a local folder serves a
    session that runs in one process; on a cluster no folder of one machine can, so that is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share: intermediate tables go there")
    # The setting cannot be changed in a running session, so the folder made for it is remembered here.
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="lodeworks-")
    return _own[app]


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{scratch_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


@contextmanager
def shuffles_dropped(spark: SparkSession):
    """Spark deletes the shuffle files of what runs within when it ends: nothing reads them after a table is written."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def stored(df: DataFrame, name: str, partition_by: list[str] | None = None, compression: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again: cuts lineage, survives lost executors."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    writer = df.write if compression is None else df.write.option("compression", compression)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    with shuffles_dropped(spark):
        writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """A table just read over all cores, where it has fewer parts than there are and ``SPREAD_BYTES`` for each more.

    For work that costs far more than a row's way through a shuffle, on tables of few row groups; a table of enough
    parts stays as it lies, and so does one too small to be worth it.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    parts = min(2 * cores, size // SPREAD_BYTES)
    return df.repartition(parts) if df.rdd.getNumPartitions() < min(cores, parts) else df


def for_pairs(df: DataFrame) -> DataFrame:
    """A table whose rows all meet each of many queries, in two parts a core at most: what leaves a task is the best of its
    part for every query, whatever the part's size."""
    return df.coalesce(2 * df.sparkSession.sparkContext.defaultParallelism)


def drop_path(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    if path in _made:
        _made.remove(path)


def discard(df: DataFrame) -> None:
    """Delete a ``stored`` table that no lazy result still reads."""
    files = df.inputFiles()
    for path in [p for p in _made if any(os.path.basename(p) in f for f in files[:1])]:
        drop_path(df.sparkSession, path)


def release_scratch(spark: SparkSession) -> None:
    """Delete every scratch table made so far; call it when the results that read them were consumed."""
    for path in list(_made):
        drop_path(spark, path)
