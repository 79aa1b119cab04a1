"""Retrieval: first stage, fusion, re-ranking, expansion along calls."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.models import Embedder, HashEmbedder
from ..functions.text import lexical_text
from ..operators import fusion, graph, lexical, vectors
from ..scratch import stored
from ..sources.store import Store

MODES = ("hybrid", "vector", "lexical")


def first_stage(chunks: DataFrame, query: str, query_vector: list[float] | None, mode: str, depth: int, store: Store | None = None) -> DataFrame:
    """``(chunk_id, score, fused_rank)`` of the ``depth`` best chunks in one mode: by the posting blocks of a store, where given."""
    if mode not in MODES:
        raise ValueError(f"mode is one of {', '.join(MODES)}")
    lists = {}
    if mode != "lexical":
        lists["vector"] = vectors.topk(chunks, "chunk_id", "embedding", query_vector, depth)
    if mode != "vector":
        lists["lexical"] = _lexical(chunks, query, depth, store)
    return _combined(lists, mode)


def _lexical(chunks: DataFrame, query: str, depth: int, store: Store | None = None) -> DataFrame:
    if store is not None:
        return store.bm25(query, depth)[0]
    return lexical.topk(chunks, "chunk_id", lexical_text(F.col("path"), F.col("symbol"), F.col("text")), query, depth)


def _combined(lists: dict[str, DataFrame], mode: str) -> DataFrame:
    by = F.desc(F.round("score", 9))
    found = [fusion.ranked(lists[name], "chunk_id", by) for name in ("vector", "lexical") if mode in (name, "hybrid")]
    return found[0].withColumnRenamed("rank", "fused_rank") if len(found) == 1 else fusion.rrf(found, "chunk_id")


def first_stages(chunks: DataFrame, query: str, query_vector: list[float], depth: int, store: Store | None = None) -> dict[str, DataFrame]:
    """The ``first_stage`` in each mode: chunks are scored once for each kind of list, and the lists, of ``depth`` rows, are kept."""
    lists = {"vector": vectors.topk(chunks, "chunk_id", "embedding", query_vector, depth), "lexical": _lexical(chunks, query, depth, store)}
    lists = {name: stored(found, f"first-{name}") for name, found in lists.items()}
    return {mode: _combined(lists, mode) for mode in MODES}


def retrieve(
    spark: SparkSession,
    store: Store,
    query: str,
    k: int = 8,
    mode: str = "hybrid",
    embedder: Embedder | None = None,
    reranker: Callable[[str, list[str]], Sequence[float]] | None = None,
    expand: bool = False,
) -> DataFrame:
    """``(rank, score, path, lang, start_line, end_line, symbol, text)`` of the best chunks.

    The ranking carries ids and scores only; attributes are joined to the few that remain. With ``expand``, up to
    six chunks that the best hits call follow, at score 0.
    """
    chunks = store.require("chunks")
    embedder = embedder or HashEmbedder()
    depth, pool = fusion.pools(k, reranker is not None)
    vector = embedder.query(spark, query) if mode != "lexical" else None
    best = first_stage(chunks, query, vector, mode, depth, store)
    columns = ["rank", "score", "path", "lang", "start_line", "end_line", "symbol", "text"]
    if reranker is None:
        best = best.where(F.col("fused_rank") <= k).withColumnRenamed("fused_rank", "rank")
        hits = chunks.join(F.broadcast(best), "chunk_id")
    else:
        candidates = chunks.drop("embedding", "dl").join(F.broadcast(best.where(F.col("fused_rank") <= pool).drop("score")), "chunk_id")
        candidates = candidates.withColumn("_doc", lexical_text(F.col("path"), F.col("symbol"), F.col("text"))).withColumn("score", F.lit(0.0))
        hits = fusion.rerank_with(candidates, "_doc", query, reranker, pool, k, "chunk_id")
    hits = hits.select(*columns)
    symbols, calls = store.read("symbols"), store.read("calls")
    if expand and symbols is not None and calls is not None:
        more = graph.expand_hits(hits, symbols, graph.linked(calls, symbols), chunks.drop("embedding", "lang", "dl"))
        langs = chunks.select("path", "lang").distinct()
        more = more.join(langs, "path").select(
            (F.col("place") + k).alias("rank"), F.lit(0.0).alias("score"), "path", "lang", "start_line", "end_line", "symbol", "text"
        )
        hits = hits.unionByName(more)
    return hits.orderBy("rank")
