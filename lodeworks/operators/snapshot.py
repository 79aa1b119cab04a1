"""Snapshot differences and incremental replacement by content hash."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def snapshot_diff(previous: DataFrame, current: DataFrame) -> DataFrame:
    """``(path, status)`` of two manifests ``(path, hash)``: added, changed, deleted or unchanged."""
    p, c = previous.select("path", F.col("hash").alias("_was")), current.select("path", F.col("hash").alias("_is"))
    status = (
        F.when(F.col("_was").isNull(), "added").when(F.col("_is").isNull(), "deleted").when(F.col("_was") != F.col("_is"), "changed").otherwise("unchanged")
    )
    return p.join(c, "path", "full_outer").select("path", status.alias("status"))


def remove_paths(chunks: DataFrame, paths: DataFrame) -> DataFrame:
    """Chunks of other paths; Spark broadcasts the paths where they are small enough."""
    return chunks.join(paths.select("path").distinct(), "path", "left_anti")


def replace_paths(chunks: DataFrame, stale: DataFrame, fresh: DataFrame) -> DataFrame:
    """Chunks with those of ``stale(path)`` gone and ``fresh`` added."""
    return remove_paths(chunks, stale).unionByName(fresh)


def distinct_paths(chunks: DataFrame) -> DataFrame:
    return chunks.select("path").distinct()
