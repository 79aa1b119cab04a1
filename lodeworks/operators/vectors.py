"""Exact nearest neighbours by cosine over unit vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.vectors import dot
from ..scratch import for_pairs
from .best import QUERIES, ROWS, Best

#: Queries that one task holds.
BLOCK = 8192


def topk(vectors: DataFrame, key: str, column: str, query: list[float], k: int) -> DataFrame:
    """``(key, score)`` of the k vectors nearest to one query; only k rows leave a task. Null vectors are passed over."""
    q = F.array(*[F.lit(float(x)) for x in query])
    # Null scores come last; dropped behind the limit, where the test does not work out a computed vector again.
    best = vectors.select(key, dot(F.col(column), q).alias("score")).orderBy(F.desc_nulls_last(F.round("score", 9)), key).limit(k)
    return best.where("score is not null")


def batch_topk(vectors: DataFrame, key: str, column: str, queries: DataFrame, k: int) -> DataFrame:
    """``(query_id, key, score, rank)`` of the k vectors nearest to each of ``queries(query_id, vector)``.

    The queries go to the tasks in blocks of ``BLOCK``; a task keeps its k best of each over matrix products of some
    hundred queries and vectors, so what is shuffled is k rows a query and task, not a row a pair. Null vectors are
    passed over.
    """
    spark, out = vectors.sparkSession, None
    queries = queries.where("vector is not null")
    n = queries.count()
    blocks = max(1, -(-n // BLOCK))
    part = F.pmod(F.xxhash64("query_id"), F.lit(blocks))
    kinds = vectors.select(key).dtypes[0][1], queries.select("query_id").dtypes[0][1]
    rows_of = for_pairs(vectors.select(key, column))
    for b in range(blocks):
        rows = queries.where(part == b).select("query_id", "vector").toArrow().combine_chunks()
        if not rows.num_rows:
            continue
        held = spark.sparkContext.broadcast((rows["query_id"].combine_chunks(), _matrix(rows["vector"].combine_chunks())))

        def nearest(it: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            ids, q = held.value
            best = Best(len(q), k)
            for batch in it:
                batch = batch.filter(batch.column(1).is_valid())
                if not batch.num_rows:
                    continue
                x, keys = _matrix(batch.column(1)), batch.column(0).to_numpy(zero_copy_only=False)
                for at in range(0, len(x), ROWS):
                    some = np.ascontiguousarray(x[at : at + ROWS].T)
                    for first in range(0, len(q), QUERIES):
                        best.add(first, q[first : first + QUERIES] @ some, keys[at : at + ROWS])
            yield from best.batches(ids, ["query_id", key, "score", "_place"])

        found = rows_of.mapInArrow(nearest, f"query_id {kinds[1]}, {key} {kinds[0]}, score double, _place double")
        out = found if out is None else out.unionByName(found)
    if out is None:
        empty = vectors.select(key).crossJoin(queries.select("query_id")).limit(0)
        out = empty.select("query_id", key, F.lit(0.0).alias("score"), F.lit(0.0).alias("_place"))
    # Rounded in the task: what ties there ties here.
    order = W.partitionBy("query_id").orderBy(F.desc("_place"), key)
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("_place")


def _matrix(vectors: pa.Array) -> np.ndarray:
    if len(pc.unique(pc.list_value_length(vectors))) > 1:
        raise ValueError("vectors of different lengths")
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1)
