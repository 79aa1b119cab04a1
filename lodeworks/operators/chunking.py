"""Line windows and definition splitting: the parser-free chunker, in built-in functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.text import let, lines

MAX_LINES, WINDOW, OVERLAP = 120, 80, 15

# Lines that begin a definition, for Python and for everything else.
PYTHON_DEF = r"(?U)^\s*(?:async\s+)?(?:def|class)\s+\w+"
BRACE_DEF = (
    r"(?U)^\s*(?:"
    r"(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s+\w+"
    r"|(?:export\s+)?(?:abstract\s+)?class\s+\w+"
    r"|(?:pub\s+)?(?:async\s+)?fn\s+\w+"
    r"|(?:pub\s+)?(?:struct|enum|trait|impl)\s+\w+"
    r"|(?:public|private|protected|internal|static|\s)+[\w<>\[\]]+\s+\w+\s*\("
    r"|(?:const|let|var)\s+\w+\s*=\s*(?:async\s*)?\([^)]*\)\s*=>"
    r"|func\s+\w+"
    r")"
)
# How a block is named after its first line.
NAMED = r"(?U)(def|class|fn|function|struct|enum|trait|impl|func)\s+(\w+)"
CALLED = r"(?U)(\w+)\s*\("
PREAMBLE, BLOCK, WHOLE, PART = "<module-preamble>", "<block>", "<window>", " (part)"


def windows(files: DataFrame, size: int = WINDOW, overlap: int = OVERLAP) -> DataFrame:
    """``files`` (with an array column ``lines``) exploded to ``start_line, end_line, text`` of sliding windows.

    A window starts at every step while lines are left, so the last may lie within the one before.
    """
    step = max(1, size - overlap)
    n = F.size("lines")
    out = files.where(n > 0).select("*", F.explode(F.sequence(F.lit(0), n - 1, F.lit(step))).alias("_at"))
    return out.select(
        *[c for c in files.columns if c != "lines"],
        (F.col("_at") + 1).alias("start_line"),
        F.least(F.col("_at") + size, n).alias("end_line"),
        F.array_join(F.slice("lines", F.col("_at") + 1, F.lit(size)), "\n").alias("text"),
    )


def symbol_name(line: Column) -> Column:
    """The name a block gets from its first line."""
    keyword, name = F.regexp_extract(line, NAMED, 1), F.regexp_extract(line, NAMED, 2)
    called = F.regexp_extract(line, CALLED, 1)
    return F.when(name != "", F.concat(keyword, F.lit(" "), name)).when(called != "", called).otherwise(BLOCK)


def definition_blocks(files: DataFrame, pattern: Column) -> DataFrame:
    """``files`` (with ``lines``) exploded to ``start_line, end_line, symbol`` of blocks between definition lines.

    What stands before the first definition is a preamble. Files without definitions yield nothing. Boundaries
    are found inside the row, so nothing is shuffled.
    """
    at = F.filter(F.transform("lines", lambda x, i: F.when(F.regexp_like(x, pattern), i)), lambda i: i.isNotNull())
    found = files.withColumn("_defs", at).where(F.size("_defs") > 0)
    starts = F.when(F.get("_defs", F.lit(0)) > 0, F.concat(F.array(F.lit(0)), "_defs")).otherwise(F.col("_defs"))
    found = found.withColumn("_starts", starts).select("*", F.posexplode("_starts").alias("_k", "_at"))
    end = F.coalesce(F.get("_starts", F.col("_k") + 1), F.size("lines"))
    preamble = (F.col("_k") == 0) & (F.get("_defs", F.lit(0)) > 0)
    return found.select(
        *files.columns,
        (F.col("_at") + 1).alias("start_line"),
        end.alias("end_line"),
        F.when(preamble, PREAMBLE).otherwise(symbol_name(F.get("lines", F.col("_at")))).alias("symbol"),
    )


def heuristic_chunks(files: DataFrame, python_pattern: str = PYTHON_DEF, brace_pattern: str = BRACE_DEF) -> DataFrame:
    """Chunks of ``files(path, lang, content)`` without a parser: ``(path, lang, start_line, end_line, symbol, text)``.

    Blocks between definitions; blocks of over 120 lines as windows named "… (part)"; files without definitions as
    windows; blank pieces are dropped. All pieces of a file are cut within its row, from lines split and matched once, so what
    is made of a file follows its length, not its length times its blocks.
    """
    pattern = F.when(F.col("lang") == "python", python_pattern).otherwise(brace_pattern)

    def piece(all_: Column, at: Column, end: Column, symbol: Column) -> Column:
        text = F.array_join(F.slice(all_, at + 1, end - at), "\n")
        return F.struct((at + 1).alias("start_line"), end.alias("end_line"), symbol.alias("symbol"), text.alias("text"))

    def cut(all_: Column, at: Column, end: Column, symbol: Column) -> Column:
        starts = F.sequence(at, end - 1, F.lit(WINDOW - OVERLAP))
        return F.transform(starts, lambda i: piece(all_, i, F.least(i + WINDOW, end), symbol))

    def blocks(all_: Column, defs: Column, starts: Column) -> Column:
        def block(at: Column, k: Column) -> Column:
            end = F.coalesce(F.get(starts, k + 1), F.size(all_))
            named = F.when((k == 0) & (F.get(defs, F.lit(0)) > 0), PREAMBLE).otherwise(symbol_name(F.get(all_, at)))
            whole = lambda b: F.array(piece(all_, at, b["end"], b["symbol"]))
            parts = lambda b: cut(all_, at, b["end"], F.concat(b["symbol"], F.lit(PART)))
            return let(F.struct(end.alias("end"), named.alias("symbol")), lambda b: F.when(b["end"] - at > MAX_LINES, parts(b)).otherwise(whole(b)))

        return F.flatten(F.transform(starts, block))

    def pieces(all_: Column) -> Column:
        found = F.filter(F.transform(all_, lambda x, i: F.when(F.regexp_like(x, pattern), i)), lambda i: i.isNotNull())
        begun = lambda d: F.when(F.get(d, F.lit(0)) > 0, F.concat(F.array(F.lit(0)), d)).otherwise(d)
        some = lambda d: let(begun(d), lambda starts: blocks(all_, d, starts))
        split = let(found, lambda d: F.when(F.size(d) > 0, some(d)).otherwise(cut(all_, F.lit(0), F.size(all_), F.lit(WHOLE))))
        return F.when(F.size(all_) > 0, split)

    return files.select("path", "lang", F.inline(let(lines(F.col("content")), pieces))).where(F.col("text").rlike(r"\S"))
