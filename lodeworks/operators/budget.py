"""Response texts that keep to a number of characters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.text import locator

CHUNK_CHARS, CONTEXT_CHARS = 1800, 6000


def blocks(hits: DataFrame, header_chars: int, chunk_chars: int = CHUNK_CHARS, context_chars: int = CONTEXT_CHARS) -> DataFrame:
    """``hits(rank, path, start_line, end_line, symbol, text)``, a ranked list of k rows, with ``block`` and ``shown``.

    Texts beyond ``chunk_chars`` are cut with a mark. Blocks are shown in order of rank until the first that would
    overflow ``context_chars``; what follows it is not shown even if it would fit.
    """
    at = locator(F.col("path"), F.col("start_line"), F.col("end_line"))
    full = locator(F.col("path"), F.col("start_line"), F.col("end_line"), F.col("symbol"))
    text = F.when(
        F.length("text") > chunk_chars,
        F.concat(F.substring("text", 1, chunk_chars), F.lit("\n... [truncated — read "), full, F.lit(" for the rest]")),
    ).otherwise(F.col("text"))
    block = F.concat(F.lit("\n\n--- "), at, F.lit("  ("), "symbol", F.lit(") ---\n"), text)
    used = F.sum(F.length("block")).over(W.orderBy("rank").rowsBetween(W.unboundedPreceding, W.currentRow))
    return hits.withColumn("block", block).withColumn("shown", used + header_chars <= context_chars)


def context(hits: DataFrame) -> DataFrame:
    """All hits as one text for a language model, best first: a single row ``context``."""
    one = F.concat(
        F.lit("--- "), locator(F.col("path"), F.col("start_line"), F.col("end_line"), F.col("symbol")),
        F.format_string("  [score=%.3f] ---\n", F.col("score")), "text",
    )
    ordered = F.array_sort(F.collect_list(F.struct("rank", one.alias("b"))))
    return hits.agg(F.array_join(F.transform(ordered, lambda x: x["b"]), "\n\n").alias("context"))
