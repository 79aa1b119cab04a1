"""Reciprocal rank fusion and second-stage re-ranking."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.text import tokenize

RRF_K = 60
RERANK_CHARS = 1600


def ranked(hits: DataFrame, key: str, *by: Column) -> DataFrame:
    """``hits`` with ``rank`` from 1. Hits are a top-k list; where there is an item_id, each item has its own."""
    scope = ["item_id"] if "item_id" in hits.columns else []
    return hits.withColumn("rank", F.row_number().over(W.partitionBy(*scope).orderBy(*by, key)))


def rrf(lists: Sequence[DataFrame], key: str, k: int = RRF_K) -> DataFrame:
    """``([item_id,] key, score, fused_rank)`` of several ``([item_id,] key, rank)`` lists.

    The score sums 1 / (k + rank). Ties are in the order in which the lists would have shown the keys: first by
    the first list that has them, then by the rank there.
    """
    scope = ["item_id"] if "item_id" in lists[0].columns else []
    merged = None
    for i, one in enumerate(lists):
        part = one.select(*scope, key, F.col("rank").cast("long").alias("rank"), F.lit(i).alias("list"))
        merged = part if merged is None else merged.unionByName(part)
    fused = merged.groupBy(*scope, key).agg(
        F.sum(F.lit(1.0) / (F.lit(k) + F.col("rank"))).alias("score"), F.min(F.struct("list", "rank")).alias("seen")
    )
    order = W.partitionBy(*scope).orderBy(F.desc(F.round("score", 12)), "seen", key)
    return fused.withColumn("fused_rank", F.row_number().over(order)).drop("seen")


def pools(k: int, rerank: bool) -> tuple[int, int]:
    """First-stage depth and re-ranking pool of a retrieval."""
    pool = max(5 * k, 30)
    return max(4 * k, 20, pool if rerank else 0), pool


def evaluation_pools(k: int, rerank: bool) -> tuple[int, int]:
    """The same for an evaluation, which looks less deep."""
    pool = max(3 * k, 30)
    return max(4 * k, 20, pool if rerank else 0), pool


def token_overlap(query: Column, text: Column) -> Column:
    """How many different tokens query and text share: the built-in re-ranker."""
    return F.size(F.array_intersect(tokenize(query), tokenize(text))).cast("double")


def rerank(candidates: DataFrame, key: str, score: Column, pool: int, k: int) -> DataFrame:
    """Of ``candidates(…, fused_rank)``, the first ``pool`` rescored, the best k kept; ties by fused rank."""
    scope = ["item_id"] if "item_id" in candidates.columns else []
    first = candidates.where(F.col("fused_rank") <= pool).withColumn("score", score)
    order = W.partitionBy(*scope).orderBy(F.desc("score"), "fused_rank", key)
    return first.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def rerank_with(candidates: DataFrame, text: str, query: str, model: Callable[[str, list[str]], Sequence[float]], pool: int, k: int, key: str) -> DataFrame:
    """The same with a Python model over (query, texts): at most ``pool`` rows reach it, in Arrow batches."""
    first = candidates.where(F.col("fused_rank") <= pool).withColumn("_seen", F.substring(text, 1, RERANK_CHARS))
    names = [c for c in candidates.columns if c != "score"]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            score = [float(x) for x in model(query, b.column(len(names)).to_pylist())] if b.num_rows else []
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], pa.array(score, pa.float64())], names=[*names, "score"])

    kinds = dict(first.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in names) + ", score double"
    scored = first.select(*names, "_seen").mapInArrow(run, schema)
    order = W.orderBy(F.desc("score"), "fused_rank", key)
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def rerank_batch(candidates: DataFrame, text: str, model: Callable[[str, list[str]], Sequence[float]], pool: int, k: int, key: str) -> DataFrame:
    """The same for many queries: ``candidates(item_id, query, key, fused_rank, …)``, each item's pool at once in one task."""
    kinds = dict(candidates.dtypes)
    first = candidates.where(F.col("fused_rank") <= pool).select("item_id", "query", key, "fused_rank", F.substring(text, 1, RERANK_CHARS).alias("_seen"))

    def run(table: pa.Table) -> pa.Table:
        score = [float(x) for x in model(table["query"][0].as_py(), table["_seen"].to_pylist())]
        return table.drop_columns(["query", "_seen"]).append_column("score", pa.array(score, pa.float64()))

    scored = first.groupBy("item_id").applyInArrow(run, f"item_id {kinds['item_id']}, {key} {kinds[key]}, fused_rank {kinds['fused_rank']}, score double")
    order = W.partitionBy("item_id").orderBy(F.desc("score"), "fused_rank", key)
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
