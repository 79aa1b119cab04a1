"""Retrieval evaluation: datasets, recall and reciprocal rank, gates, floors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.text import identifier_words
from .spans import overlap

# Names that tell nothing about what a callable does.
DULL_NAMES = ["__init__", "main", "new", "default"]
DULL_IN_SCAFFOLD = ["__init__", "main"]


def first_match(hits: DataFrame, items: DataFrame) -> DataFrame:
    """``(mode, item_id, rank)``: of ``hits(mode, item_id, rank, path, start_line, end_line)``, the first on the gold span."""
    gold = items.select("item_id", F.col("gold_path").alias("path"), "gold_start", "gold_end")
    met = hits.join(gold, ["item_id", "path"]).where(
        overlap(F.col("start_line"), F.col("end_line"), F.col("gold_start"), F.col("gold_end"))
    )
    return met.groupBy("mode", "item_id").agg(F.min("rank").alias("rank"))


def metrics(matches: DataFrame, modes: DataFrame, items: DataFrame, k: int) -> DataFrame:
    """``(mode, n, recall_at_1, recall_at_k, mrr)`` over all items; an item without a match in the first k counts 0."""
    n = items.agg(F.count("*").alias("n"))
    hit = matches.where(F.col("rank") <= k).groupBy("mode").agg(
        F.count_if(F.col("rank") == 1).alias("one"), F.count("*").alias("any"), F.sum(1.0 / F.col("rank")).alias("rr")
    )
    share = lambda c: F.when(F.col("n") > 0, F.coalesce(F.col(c), F.lit(0)) / F.col("n")).otherwise(0.0)
    return (
        modes.join(hit, "mode", "left")
        .crossJoin(F.broadcast(n))
        .select("mode", "n", share("one").alias("recall_at_1"), share("any").alias("recall_at_k"), share("rr").alias("mrr"))
    )


def name_dataset(symbols: DataFrame, max_items: int | None = 200, min_words: int = 2, seed: int = 0) -> DataFrame:
    """Queries from callable names: ``(query, gold_path, gold_start, gold_end)``, in a hashed order, up to max_items."""
    named = symbols.where((F.col("kind") == "callable") & ~F.lower("name").isin(DULL_NAMES)).withColumn("w", identifier_words(F.col("name")))
    letters = F.aggregate("w", F.lit(0), lambda n, x: n + F.length(x))
    kept = named.where((F.size("w") >= min_words) & (letters >= 6))
    out = kept.select(
        F.array_join("w", " ").alias("query"),
        F.col("path").alias("gold_path"),
        F.col("start_line").alias("gold_start"),
        F.col("end_line").alias("gold_end"),
        F.md5(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string"))).alias("_o"),
    )
    return (out.orderBy("_o").limit(max_items) if max_items is not None else out).drop("_o")


def scaffold(symbols: DataFrame, max_items: int = 30, min_lines: int = 4) -> DataFrame:
    """Template rows of the longer callables, one file after the other: ``(place, query, path, start_line, end_line, symbol)``.

    Files take turns in the order of their longest callable; a callable that repeats another's name and lines is
    passed over.
    """
    size = F.col("end_line") - F.col("start_line")
    cands = symbols.where((F.col("kind") == "callable") & (size >= min_lines) & ~F.lower("name").isin(DULL_IN_SCAFFOLD)).withColumn("size", size)
    longest = cands.groupBy("path").agg(F.min(F.struct((-F.col("size")).alias("s"), "id")).alias("file"))
    turns = cands.join(longest, "path").withColumn("turn", F.row_number().over(W.partitionBy("path").orderBy(F.desc("size"), "id")))
    once = turns.groupBy("name", "start_line", "end_line").agg(
        F.min(F.struct("turn", "file", "path", "qualified")).alias("f")
    )
    first = once.orderBy("f.turn", "f.file").limit(max_items)
    return first.select(
        F.row_number().over(W.orderBy("f.turn", "f.file")).alias("place"),
        F.concat(F.lit("TODO: ask about "), "f.qualified").alias("query"),
        F.col("f.path").alias("path"),
        "start_line",
        "end_line",
        F.col("f.qualified").alias("symbol"),
    )


def floor(p: Column, n: Column) -> Column:
    """A metric's value less two binomial standard errors, 0 at least; no margin without items."""
    margin = F.when(n > 0, 2 * F.sqrt(F.greatest(p * (1 - p), F.lit(1e-9)) / n)).otherwise(0.0)
    return F.greatest(p - margin, F.lit(0.0))


def gate(report: DataFrame, floors: DataFrame) -> DataFrame:
    """``(mode, metric, value, floor, passed)`` of ``floors(mode, metric, floor)``; what the report lacks does not pass."""
    long = report.unpivot(["mode"], ["recall_at_1", "recall_at_k", "mrr"], "metric", "value")
    return floors.join(long, ["mode", "metric"], "left").select(
        "mode", "metric", "value", "floor", F.coalesce(F.col("value") >= F.col("floor"), F.lit(False)).alias("passed")
    )


def parse_floors(spec: str) -> dict[str, float]:
    """``"mrr=0.3,recall@10=0.6"`` as a mapping."""
    return {k.strip(): float(v) for k, _, v in (p.partition("=") for p in spec.split(",") if p.strip())}


def best_prefix(reports: DataFrame) -> DataFrame:
    """Of ``reports(repo, place, prefix, mrr)``, each repo's prefix of the highest mrr, first on ties."""
    return reports.groupBy("repo").agg(F.min(F.struct((-F.col("mrr")).alias("m"), "place", "prefix")).alias("b")).select(
        "repo", F.col("b.prefix").alias("prefix"), (-F.col("b.m")).alias("mrr")
    )
