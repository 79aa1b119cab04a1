"""Nearest neighbours through an inverted file: vectors dealt into lists by their nearest centroid, a few lists probed.

Centroids, and how many lists a query has to probe, come from a bounded sample; every vector is dealt and every probed one
is scored exactly. ``operators.vectors`` is the exact search that it is measured against.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.vectors import dot
from ..scratch import new_path, shuffles_dropped

#: Vectors that centroids and the number of probes are fitted on, at most: those of the least hashes of their keys.
SAMPLE = 20_000
#: Of the sample, so many are asked for, to find out how many lists a query has to probe.
ASKED = 400
#: Lists, at most: their centroids go to every task.
MOST_LISTS = 4096
ROUNDS = 12


@dataclass
class Inverted:
    """Vectors in folders by list: ``table(list, key, vector)``; the centroids; and the probes that reach the aim."""

    table: DataFrame
    key: str
    centroids: np.ndarray
    probes: int
    recall: float

    def lists(self, vectors: np.ndarray, probes: int | None = None) -> np.ndarray:
        """For each unit vector, the lists of the nearest centroids, the nearest first."""
        return np.argsort(-(vectors @ self.centroids.T), 1, kind="stable")[:, : probes or self.probes]


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.array(column.to_pylist(), np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def centroids_of(x: np.ndarray, lists: int, rounds: int = ROUNDS, seed: int = 3) -> np.ndarray:
    """Spherical k-means of unit vectors; a list that loses all its vectors takes one that lies farthest from its own."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), lists, replace=False)]
    for _ in range(rounds):
        near = x @ c.T
        at = near.argmax(1)
        sums = np.zeros_like(c)
        np.add.at(sums, at, x)
        empty = np.flatnonzero(np.bincount(at, minlength=lists) == 0)
        sums[empty] = x[np.argsort(near[np.arange(len(x)), at])[: len(empty)]]
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(norm > 0, sums / np.where(norm > 0, norm, 1), c)
    return c


def probes_for(x: np.ndarray, c: np.ndarray, k: int, aim: float, asked: int = ASKED) -> tuple[int, float]:
    """The fewest lists to probe for ``aim`` of the ``k`` nearest of the sample ``x``, and the share that they have."""
    home, step = (x @ c.T).argmax(1), max(1, len(x) // asked)
    q = x[::step]
    nearest = np.argsort(-(q @ x.T), 1, kind="stable")[:, :k]
    # The place of each neighbour's list in its query's order of lists.
    place = np.argsort(np.argsort(-(q @ c.T), 1, kind="stable"), 1, kind="stable")
    depth = np.take_along_axis(place, home[nearest], 1).ravel()
    share = np.cumsum(np.bincount(depth, minlength=len(c))) / len(depth)
    probes = int(np.searchsorted(share, aim)) + 1
    return min(probes, len(c)), float(share[min(probes, len(c)) - 1])


def build(vectors: DataFrame, key: str, column: str, k: int = 10, aim: float = 0.95, lists: int | None = None, sample: int = SAMPLE) -> Inverted:
    """Deal ``vectors(key, column)`` of unit vectors into lists, about the square root of their number.

    Null vectors are left out. Lists are written in ranges of list and key, so that a list of many equal vectors is many
    files and tasks; a probe reads the folders of its lists.
    """
    spark, rows = vectors.sparkSession, vectors.where(F.col(column).isNotNull()).select(key, column)
    kinds, n = dict(rows.dtypes), rows.count()
    lists = max(1, min(lists or round(n**0.5), MOST_LISTS, n or 1))
    held = _matrix(rows.orderBy(F.xxhash64(key), key).limit(sample).toArrow()[column]) if n else np.zeros((0, 1))
    c = centroids_of(held, min(lists, len(held))) if n else np.zeros((1, 1))
    probes, recall = probes_for(held, c, k, aim) if n else (1, 1.0)
    sent = spark.sparkContext.broadcast(c)

    def deal(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            home = (_matrix(b.column(1)) @ sent.value.T).argmax(1).astype(np.int32) if b.num_rows else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(home)], names=[*b.schema.names, "list"])

    path = new_path(spark, "vector-lists")
    dealt = rows.withColumnRenamed(column, "vector").mapInArrow(deal, f"`{key}` {kinds[key]}, vector {kinds[column]}, list int")
    with shuffles_dropped(spark):
        dealt.repartitionByRange("list", F.xxhash64(key)).sortWithinPartitions("list").write.partitionBy("list").parquet(path)
    return Inverted(spark.read.schema(dealt.schema).parquet(path), key, c, probes, recall)


def topk(index: Inverted, query: list[float], k: int, probes: int | None = None) -> DataFrame:
    """``(key, score)`` of the k nearest to one query among its lists; only their folders are read."""
    wanted = [int(i) for i in index.lists(np.array([query]), probes)[0]]
    near = index.table.where(F.col("list").isin(wanted))
    q = F.array(*[F.lit(float(x)) for x in query])
    return near.select(index.key, dot(F.col("vector"), q).alias("score")).orderBy(F.desc(F.round("score", 9)), index.key).limit(k)


def batch_topk(index: Inverted, queries: DataFrame, k: int, probes: int | None = None) -> DataFrame:
    """``(query_id, key, score, rank)`` for ``queries(query_id, vector)``: each query meets the vectors of its lists.

    Queries are dealt to their lists in blocks of rows, and each block is a matrix product with each batch of its list, so
    a list of very many vectors is many tasks, each with its own k best; what is shuffled then is k rows a query and task.
    """
    spark, key = queries.sparkSession, index.key
    asked, me = dict(queries.dtypes), spark.sparkContext.broadcast(index.centroids)
    p = probes or index.probes

    def choose(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            near = np.argsort(-(_matrix(b.column(1)) @ me.value.T), 1, kind="stable")[:, :p] if b.num_rows else np.zeros((0, p), int)
            at = pa.array(np.repeat(np.arange(b.num_rows), near.shape[1]))
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(near.ravel().astype(np.int32))], names=["query_id", "vector", "list"])

    rows = queries.where("vector is not null").select("query_id", "vector")
    dealt = rows.mapInArrow(choose, f"query_id {asked['query_id']}, vector {asked['vector']}, list int")
    # Of a list and piece of its vectors, all its queries: pieces keep a long list from being one group.
    pieces = index.table.groupBy("list").agg(F.ceil(F.count("*") / PIECE).cast("int").alias("pieces"))
    asking = dealt.join(pieces, "list").withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))).drop("pieces")
    held = index.table.join(pieces, "list").withColumn("piece", F.pmod(F.xxhash64(key), F.col("pieces")).cast("int")).drop("pieces")
    schema = f"query_id {asked['query_id']}, `{key}` {dict(index.table.dtypes)[key]}, score double, place double"
    names = ["query_id", key, "score", "place"]

    def meet(group: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        out = [pa.table({"query_id": left["query_id"].slice(0, 0), key: right[key].slice(0, 0), "score": pa.array([], pa.float64()), "place": pa.array([], pa.float64())})]
        if right.num_rows and left.num_rows:
            x, ids = _matrix(right["vector"]), right[key].to_numpy()
            for start in range(0, left.num_rows, ROWS):
                some = left.slice(start, ROWS)
                score = _matrix(some["vector"]) @ x.T
                order = np.lexsort((np.tile(ids, (len(score), 1)), -np.round(score, 9)))[:, :k]
                best = np.take_along_axis(score, order, 1).ravel()
                at = pa.array(np.repeat(np.arange(some.num_rows), order.shape[1]))
                out.append(pa.table({"query_id": some["query_id"].take(at), key: right[key].take(pa.array(order.ravel())), "score": best, "place": np.round(best, 9)}))
        return pa.concat_tables(out).select(names)

    met = asking.groupBy("list", "piece").cogroup(held.groupBy("list", "piece")).applyInArrow(meet, schema)
    order = W.partitionBy("query_id").orderBy(F.desc("place"), key)
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("place")


#: Vectors of a list that meet its queries in one group.
PIECE = 20_000
#: Queries of a list that are multiplied at once.
ROWS = 512


def recall(found: DataFrame, exact: DataFrame, key: str) -> float:
    """The share of ``exact(query_id, key)`` that ``found`` has."""
    both = exact.select("query_id", key).join(found.select("query_id", key).withColumn("_hit", F.lit(1)), ["query_id", key], "left")
    return both.agg(F.coalesce(F.avg(F.coalesce("_hit", F.lit(0))), F.lit(1.0))).first()[0]
