"""Shared pieces of the training-data operators: scratch tables, byte helpers, components."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..scratch import discard, drop_path, new_path, release_scratch, scratch_dir, shuffles_dropped, spread, stored

__all__ = ["SPACE", "connected_components", "discard", "drop_run", "fresh", "new_path", "ordered_buckets", "read", "release_scratch", "scratch_dir", "sorted_run", "stored"]

#: Characters that separate words in every operator here: space and \x09-\x0D.
SPACE = " \t\n\x0b\f\r"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{table}.parquet"))


def fresh(name: str, taken: list[str]) -> str:
    """``name``, with underscores added until no column of ``taken`` bears it in any case."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name += "_"
    return name


@contextmanager
def ordered_buckets(spark: SparkSession):
    """Plans made within take a bucket of one file as sorted, as it was written."""
    key = "spark.sql.legacy.bucketedTableScan.outputOrdering"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def sorted_run(df: DataFrame, key: str, buckets: int, name: str) -> DataFrame:
    """Write ``df`` to the shared folder as a table bucketed and sorted by ``key``, one file a bucket where ``df`` is dealt
    out by it into ``buckets``, and read it again in its order. ``drop_run`` deletes it."""
    spark, path, table = df.sparkSession, new_path(df.sparkSession, name), f"{name}_{uuid.uuid4().hex}"
    with ordered_buckets(spark), shuffles_dropped(spark):
        df.write.format("parquet").bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(table)
    out = spark.table(table).sortWithinPartitions(key)
    out.run_table, out.run_path = table, path
    return out


def drop_run(run: DataFrame) -> None:
    run.sparkSession.sql(f"DROP TABLE IF EXISTS {run.run_table}")
    drop_path(run.sparkSession, run.run_path)


def connected_components(edges: DataFrame, name: str = "components", max_rounds: int = 60) -> DataFrame:
    """Smallest reachable node for every node of ``edges(src, dst)``: rows ``(node, component)``.

    Alternating large-star and small-star steps over edge tables in the shared folder. Each step is one
    aggregation (smallest neighbour, partial sums before the shuffle) and one equi-join that adaptive
    execution may split, so a hub with a third of all edges is not gathered in one task.
    The driver sees two numbers a round. Nodes without edges do not appear.
    """
    spark = edges.sparkSession
    current = stored(
        edges.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct(),
        f"{name}-edges",
    )
    before = None
    for _ in range(max_rounds):
        # Large star: every neighbour above u links to the smallest of u's neighbourhood.
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = (
            both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        )
        large = stored(large, f"{name}-large")
        # Small star: every neighbour below u, and u itself, links to the smallest of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        small = stored(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), f"{name}-small")
        mark = small.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long")), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        discard(large)
        discard(current)
        current = small
        if mark == before:
            break
        before = mark
    else:
        raise RuntimeError("components did not settle")
    roots = current.select(F.col("v").alias("node")).distinct()
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        roots.select("node", F.col("node").alias("component"))
    )
