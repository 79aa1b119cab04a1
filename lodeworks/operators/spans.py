"""Interval joins over line spans: overlap, innermost, enclosing.

Lines of a path are cut into bins of 1, 4, 16, … lines. A span is the union of a few whole bins of each level it has room
for (``cover``); a line lies in one bin of every level (``bins_at``). So a span holds a line if, and only if, one bin of its cover
is one of the line's, and it starts in a range if one bin of the range's cover is one of its start's. What is asked of a bin
(its smallest span, its first chunks) is worked out once a bin, by an aggregate with partial results, and then met by
as many rows a question as there are bins in it: rows grow with spans and questions, each times the logarithm of
the lines, and never with their pairs, in however large a file. Equal spans are brought down to those that can be an answer, and
equal questions to one, before either is put into bins.

Rows in bins take many times the bytes that Spark reckons from the files they come from, so their joins are merge joins by
hint: no side of them is broadcast.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window as W, functions as F

#: Highest level of bins; longer spans take several of its bins.
LEVELS = 10


def overlap(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Whether two spans with inclusive ends share a line."""
    return ~((a_end < b_start) | (a_start > b_end))


def bins_at(line: str) -> Column:
    """The bin of every level that holds a line: ``array<struct<level, bin>>``."""
    return F.expr(f"transform(sequence(0, {LEVELS}), k -> struct(k AS level, shiftright({line}, 2 * k) AS bin))")


def cover(start: str, end: str) -> Column:
    """The fewest whole bins whose union is the span, none for an empty one.

    Of a level, the bins from l to r that the levels below have left over: those up to the next multiple of four, and those
    from the last one, are taken, the rest are the next level's.
    """
    level = "struct(k AS k, shiftright({s} + shiftleft(1, 2 * k) - 1, 2 * k) AS l, shiftright({e} + 1, 2 * k) AS r)"
    taken = (
        "CASE WHEN x.l >= x.r THEN array() "
        f"WHEN x.k = {LEVELS} OR shiftright(x.l + 3, 2) >= shiftright(x.r, 2) THEN sequence(x.l, x.r - 1) "
        "ELSE concat(CASE WHEN x.l % 4 = 0 THEN array() ELSE sequence(x.l, shiftleft(shiftright(x.l + 3, 2), 2) - 1) END, "
        "CASE WHEN x.r % 4 = 0 THEN array() ELSE sequence(shiftleft(shiftright(x.r, 2), 2), x.r - 1) END) END"
    )
    # A level is open as long as no level below has taken all.
    opened = f"filter(transform(sequence(0, {LEVELS}), k -> {level}), x -> x.l < x.r AND (x.k = 0 OR shiftright(shiftright({{s}} + shiftleft(1, 2 * (x.k - 1)) - 1, 2 * (x.k - 1)) + 3, 2) < shiftright(shiftright({{e}} + 1, 2 * (x.k - 1)), 2)))"
    return F.expr(f"flatten(transform({opened}, x -> transform({taken}, b -> struct(x.k AS level, b AS bin))))".replace("{s}", start).replace("{e}", end))


def covers(spans: DataFrame, value: Column, best: Callable[[Column], Column], start: str = "start_line", end: str = "end_line") -> DataFrame:
    """``(path, level, bin, value)``: the ``best`` value of the spans whose cover has the bin."""
    rows = spans.select("path", value.alias("value"), F.inline(cover(start, end)))
    return rows.groupBy("path", "level", "bin").agg(best("value").alias("value"))


def starts(spans: DataFrame, value: Column, best: Callable[[Column], Column], start: str = "start_line") -> DataFrame:
    """``(path, level, bin, value)``: the ``best`` value of the spans that start in the bin."""
    rows = spans.select("path", value.alias("value"), F.inline(bins_at(start)))
    return rows.groupBy("path", "level", "bin").agg(best("value").alias("value"))


def stabbed(points: DataFrame, bins: DataFrame, at: str) -> DataFrame:
    """``points`` with the value of every bin of ``covers`` that holds their line ``at``."""
    return points.select("*", F.inline(bins_at(at))).join(bins.hint("merge"), ["path", "level", "bin"]).drop("level", "bin")


def begun(ranges: DataFrame, bins: DataFrame, start: str, end: str) -> DataFrame:
    """``ranges`` with the value of every bin of ``starts`` in the cover of their lines from ``start`` to ``end``."""
    return ranges.select("*", F.inline(cover(start, end))).join(bins.hint("merge"), ["path", "level", "bin"]).drop("level", "bin")


def smallest(symbols: DataFrame) -> Column:
    """What orders symbols around a line: the size, then the place in the file where it is known, then the id."""
    place = F.col("ordinal").cast("long") if "ordinal" in symbols.columns else F.lit(0).cast("long")
    return F.struct((F.col("end_line") - F.col("start_line")).alias("size"), place.alias("place"), F.col("id").alias("symbol_id"))


def one_a_span(symbols: DataFrame) -> DataFrame:
    """Of the symbols with the same lines of a path, the one that comes first around each of these lines."""
    span = ["path", "start_line", "end_line"]
    if "ordinal" not in symbols.columns:
        return symbols.groupBy(*span).agg(F.min("id").alias("id"))
    return symbols.groupBy(*span).agg(F.min(F.struct("ordinal", "id")).alias("_f")).select(*span, "_f.ordinal", "_f.id")


def innermost(targets: DataFrame, symbols: DataFrame, keys: list[str]) -> DataFrame:
    """For each row of ``targets(*keys, path, start, end)``, the smallest symbol it overlaps, the first on ties.

    Rows: ``(*keys, path, start, end, symbol_id)``; targets that overlap none are left out. A symbol that overlaps a range
    holds its first line, or starts in what follows.
    """
    symbols, span = one_a_span(symbols), ["path", "start", "end"]
    value = smallest(symbols)
    asked = targets.select(*span).distinct()
    around = stabbed(asked, covers(symbols, value, F.min), "start")
    after = begun(asked, starts(symbols, value, F.min), "start + 1", "end")
    met = around.unionByName(after).groupBy(*span).agg(F.min("value").alias("_s")).select(*span, F.col("_s.symbol_id").alias("symbol_id"))
    if not keys:
        return met
    return targets.select(*keys, *span).distinct().join(met.hint("merge"), span).select(*keys, *span, "symbol_id")


def enclosing(points: DataFrame, symbols: DataFrame, keys: list[str]) -> DataFrame:
    """For each of ``points(*keys, path, at)``, the smallest symbol with ``start_line <= at <= end_line``, or -1."""
    symbols = one_a_span(symbols)
    rows = points.select(*keys, "path", "at").distinct()
    met = stabbed(rows.select("path", "at").distinct(), covers(symbols, smallest(symbols), F.min), "at")
    met = met.groupBy("path", "at").agg(F.min("value").alias("_s"))
    found = rows.join(met.hint("merge"), ["path", "at"], "left")
    return found.select(*keys, "path", "at", F.coalesce("_s.symbol_id", F.lit(-1)).alias("symbol_id"))


def chunks_in_span(spans: DataFrame, chunks: DataFrame, key: str, limit: int) -> DataFrame:
    """The first ``limit`` chunks, by start line, end line and chunk_id, that overlap each of ``spans(key, path, start, end)``.

    A bin keeps its first ``limit`` chunks; attributes are joined to those that remain.
    """
    place = F.struct(F.col("start_line").alias("c_start"), F.col("end_line").alias("c_end"), "chunk_id")
    first = lambda v: F.slice(F.array_sort(F.collect_list(v)), 1, limit)

    def cut(rows: DataFrame, within: list[str], *by: str) -> DataFrame:
        """The first ``limit`` rows within each value of some columns: ranked, and cut while they are sorted."""
        order = W.partitionBy(*within).orderBy(*by)
        return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)

    def of(rows: DataFrame) -> DataFrame:
        """A bin's first chunks, without its others in one array."""
        return cut(rows, ["path", "level", "bin"], "value").groupBy("path", "level", "bin").agg(first("value").alias("value"))

    span = ["path", "start", "end"]
    able = cut(chunks.select("path", "start_line", "end_line", "chunk_id"), ["path", "start_line", "end_line"], "chunk_id").drop("rank")
    covered = of(able.select("path", place.alias("value"), F.inline(cover("start_line", "end_line"))))
    started = of(able.select("path", place.alias("value"), F.inline(bins_at("start_line"))))
    asked = spans.select(*span).distinct()
    met = stabbed(asked, covered, "start").unionByName(begun(asked, started, "start + 1", "end"))
    near = cut(met.select(*span, F.inline("value")), span, "c_start", "c_end", "chunk_id").drop("rank")
    near = cut(spans.join(near.hint("merge"), span), [key], "c_start", "c_end", "chunk_id")
    return near.join(chunks.drop("path", "start_line", "end_line").hint("merge"), "chunk_id")
