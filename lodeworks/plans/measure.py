"""Retrieval quality: all queries of a mode as one plan, and the comparison of prefix schemes."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.models import Embedder, HashEmbedder
from ..functions.text import lexical_text
from ..operators import evaluate, fusion, lexical, vectors
from ..scratch import stored
from .index import build_index
from .service import Service


def report(service: Service, items: DataFrame, k: int) -> DataFrame:
    """Metrics of every mode over ``items(item_id, query, gold_…)``; with a re-ranker, of hybrid+rerank, too."""
    spark, store, embedder = service.spark, service.store, service.embedder or HashEmbedder()
    chunks, items = store.require("chunks"), stored(items, "eval-items")
    depth, pool = fusion.evaluation_pools(k, service.reranker is not None)
    lex = lexical.batch_topk(store.require("postings").drop("dl"), chunks.select("chunk_id", "dl"), items, "chunk_id", depth)
    asked = embedder.add(items.select(F.col("item_id").alias("query_id"), "query"), "query", "vector")
    vec = vectors.batch_topk(chunks, "chunk_id", "embedding", asked, depth).withColumnRenamed("query_id", "item_id")
    ids = ["item_id", "chunk_id", "rank"]
    vec, lex = stored(vec.select(*ids), "eval-vector"), stored(lex.select(*ids), "eval-lexical")
    fused = fusion.rrf([vec, lex], "chunk_id")
    found = {"vector": vec, "lexical": lex, "hybrid": fused.withColumnRenamed("fused_rank", "rank")}
    if service.reranker is not None:
        candidates = fused.join(items.select("item_id", "query"), "item_id").join(chunks.drop("embedding", "dl"), "chunk_id")
        candidates = candidates.withColumn("_doc", lexical_text(F.col("path"), F.col("symbol"), F.col("text")))
        found["hybrid+rerank"] = fusion.rerank_batch(candidates, "_doc", service.reranker, pool, k, "chunk_id")
    hits = None
    for mode, rows in found.items():
        part = rows.select(F.lit(mode).alias("mode"), *ids)
        hits = part if hits is None else hits.unionByName(part)
    placed = hits.join(chunks.select("chunk_id", "path", "start_line", "end_line"), "chunk_id")
    modes = spark.createDataFrame([(m,) for m in found], "mode string")
    return evaluate.metrics(evaluate.first_match(placed, items), modes, items, k)


def calibration(
    service: Service, embedder: Callable[[str], Embedder], prefixes: Sequence[str], items: Callable[[], DataFrame], k: int, gate_mode: str
) -> dict:
    """Every prefix scheme's report, the scheme with the best vector MRR, and floors two standard errors under it."""
    spark, reports = service.spark, []
    for prefix in prefixes:
        service.embedder = embedder(prefix)
        began = time.time()
        build_index(spark, service.repo, service.embedder, full=True)
        indexed, asked = time.time(), items()
        rows = [r.asDict() for r in report(service, asked, k).collect()]
        hand = asked.agg(F.count_if(F.col("source") == "curated")).first()[0]
        reports.append({
            "repo": service.repo, "prefix": prefix, "k": k, "modes": {r["mode"]: r for r in rows}, "curated_items": hand,
            "index_seconds": round(indexed - began, 1), "eval_seconds": round(time.time() - indexed, 1),
        })
    placed = [(r["repo"], i, r["prefix"], r["modes"]["vector"]["mrr"]) for i, r in enumerate(reports)]
    best = evaluate.best_prefix(spark.createDataFrame(placed, "repo string, place int, prefix string, mrr double")).first()
    gated = next(r for r in reports if r["prefix"] == best["prefix"])["modes"].get(gate_mode)
    floors = {}
    if gated:
        one = spark.createDataFrame([(gated["recall_at_k"], gated["mrr"], gated["n"])], "r double, m double, n long")
        low = one.select(evaluate.floor(F.col("r"), F.col("n")).alias("r"), evaluate.floor(F.col("m"), F.col("n")).alias("m")).first()
        floors = {f"recall@{k}": round(low["r"], 2), "mrr": round(low["m"], 2)}
    return {"reports": reports, "best_prefix": best["prefix"], "gate_mode": gate_mode, "floors": floors}
