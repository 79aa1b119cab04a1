"""Definitions, chunks and calls of source files, by the standard parser for Python and by braces elsewhere.

A file is parsed once: ``extracted`` gives all three as arrays of one row, which an index keeps for files that stay
as they are.
"""

from __future__ import annotations

import ast
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from ..operators.chunking import MAX_LINES, OVERLAP, WINDOW, heuristic_chunks
from ..scratch import stored
from . import braces
from .braces import BRACED, Definition

CHUNK = "array<struct<start_line: int, end_line: int, symbol: string, text: string>>"
DEFINITION = "array<struct<qualified: string, kind: string, start_line: int, end_line: int>>"
CALL = "array<struct<callee: string, line: int, caller: int>>"
#: Characters of files that are parsed before their rows are handed on; a larger file goes by itself.
TOGETHER = 1 << 20
_ROW = {
    "chunks": pa.list_(pa.struct([("start_line", pa.int32()), ("end_line", pa.int32()), ("symbol", pa.string()), ("text", pa.string())])),
    "definitions": pa.list_(pa.struct([("qualified", pa.string()), ("kind", pa.string()), ("start_line", pa.int32()), ("end_line", pa.int32())])),
    "calls": pa.list_(pa.struct([("callee", pa.string()), ("line", pa.int32()), ("caller", pa.int32())])),
}


def python_definitions(tree: ast.Module) -> list[Definition]:
    found: list[Definition] = []

    def first_inside(node: ast.AST) -> int | None:
        starts = [c for c in ast.walk(node) if c is not node and isinstance(c, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef))]
        return min((min([c.lineno, *(d.lineno for d in c.decorator_list)]) for c in starts), default=None)

    def visit(node: ast.AST, scope: tuple[str, ...], nested: bool) -> None:
        for c in ast.iter_child_nodes(node):
            if isinstance(c, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                kind = "container" if isinstance(c, ast.ClassDef) else "callable"
                top = min([c.lineno, *(d.lineno for d in c.decorator_list)])
                found.append(Definition(".".join((*scope, c.name)), kind, c.lineno, c.end_lineno or c.lineno, top, first_inside(c), nested))
                visit(c, (*scope, c.name), nested or kind == "callable")
            else:
                visit(c, scope, nested)

    visit(tree, (), False)
    return found


def python_calls(tree: ast.Module) -> list[tuple[str, int, int]]:
    """``(name, line, column)`` of every call, by the rightmost name of what is called."""
    found = []
    for node in ast.walk(tree):
        if isinstance(node, ast.Call):
            f = node.func
            name = f.id if isinstance(f, ast.Name) else f.attr if isinstance(f, ast.Attribute) else None
            if name:
                found.append((name, node.lineno, node.col_offset))
    return sorted(found, key=lambda x: (x[1], x[2]))


def innermost(definitions: list[Definition], lines: list[int]) -> list[int]:
    """For each line, the smallest definition around it (of equals the first), -1 outside all."""
    edges = sorted({1, *(d.start for d in definitions), *(d.end + 1 for d in definitions)})
    owner = [-1] * len(edges)
    # Larger ones first, so that smaller ones paint over them; of equals the first paints last.
    for i in sorted(range(len(definitions)), key=lambda i: (definitions[i].start - definitions[i].end, -i)):
        d = definitions[i]
        for k in range(bisect_right(edges, d.start) - 1, bisect_right(edges, d.end)):
            owner[k] = i
    return [owner[bisect_right(edges, n) - 1] for n in lines]


def supported(lang: str) -> bool:
    """Whether files of a language are read by syntax; others are chunked by their lines."""
    return lang == "python" or lang in BRACED


def parse(lang: str, text: str) -> tuple[list[Definition], list[tuple[str, int, int]]] | None:
    """Definitions and calls ``(name, line, definition or -1)`` of one file, or None where it cannot be parsed."""
    if not supported(lang):
        return None
    if lang == "python":
        try:
            tree = ast.parse(text)
        except (SyntaxError, ValueError, RecursionError):
            return None
        found, calls = python_definitions(tree), python_calls(tree)
        return found, [(name, line, by) for (name, line, _), by in zip(calls, innermost(found, [c[1] for c in calls]))]
    parsed = braces.parse(lang, text)
    return parsed.definitions, parsed.calls


def file_chunks(definitions: list[Definition], text: str) -> list[tuple[int, int, str, str]]:
    """``(start, end, symbol, text)``: callables whole, headers of containers, and what lies loose between them."""
    if not definitions:
        return []
    rows = text.splitlines()
    out: list[tuple[int, int, str, str]] = []
    taken = [False] * (len(rows) + 2)

    def put(start: int, end: int, symbol: str) -> None:
        whole = rows[start - 1 : end]
        step = WINDOW - OVERLAP if len(whole) > MAX_LINES else len(whole) or 1
        size = WINDOW if len(whole) > MAX_LINES else len(whole)
        for at in range(0, len(whole), step):
            part = whole[at : at + size]
            if "".join(part).strip():
                name = symbol + (" (part)" if len(whole) > MAX_LINES else "")
                out.append((start + at, start + at + len(part) - 1, name, "\n".join(part)))

    for d in definitions:
        if d.nested:
            continue
        if "." not in d.qualified:
            taken[d.top : d.end + 1] = [True] * (d.end + 1 - d.top)
        if d.kind == "container":
            put(d.top, d.inner - 1 if d.inner else d.end, f"{d.qualified} (decl)")
        else:
            put(d.top, d.end, d.qualified)
    start = None
    for n in range(1, len(rows) + 2):
        loose = n <= len(rows) and not taken[n]
        if loose and start is None and rows[n - 1].strip():
            start = n
        elif not loose and start is not None:
            end = n - 1
            while not rows[end - 1].strip():
                end -= 1
            put(start, end, "<module>")
            start = None
    return sorted(out, key=lambda x: x[:2])


def extract(lang: str, text: str) -> tuple[list, list, list]:
    """Chunks, definitions and calls of one file; calls name their definition by its place among those given."""
    found, calls = parse(lang, text) or ([], [])
    place, symbols = {-1: -1}, []
    for i, d in enumerate(found):
        if d.graph:
            place[i] = len(symbols)
            symbols.append(d)
    return (
        [dict(zip(("start_line", "end_line", "symbol", "text"), c)) for c in file_chunks(found, text)],
        [{"qualified": d.qualified, "kind": d.kind, "start_line": d.start, "end_line": d.end} for d in symbols],
        [{"callee": name, "line": line, "caller": place[by]} for name, line, by in calls],
    )


def extracted(files: DataFrame) -> DataFrame:
    """``(path, lang, chunks, definitions, calls)``: one row, and one parse, a file of ``files(path, lang, content)``."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            size = np.cumsum(pc.fill_null(pc.binary_length(b.column(2)), 0).to_numpy()) // TOGETHER
            cuts = [0, *(np.flatnonzero(size[1:] != size[:-1]) + 1).tolist(), b.num_rows] if b.num_rows else []
            for at, until in zip(cuts, cuts[1:]):
                part = b.slice(at, until - at)
                made = [extract(lang.as_py(), text.as_py() or "") for lang, text in zip(part.column(1), part.column(2))]
                columns = [pa.array([m[k] for m in made], kind) for k, kind in enumerate(_ROW.values())]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *columns], names=["path", "lang", *_ROW])

    schema = f"path string, lang string, chunks {CHUNK}, definitions {DEFINITION}, calls {CALL}"
    return files.select("path", "lang", "content").mapInArrow(run, schema)


def chunks_of(rows: DataFrame, files: DataFrame) -> DataFrame:
    """Chunks of extracted ``rows``; of ``files`` without any, by lines and openings."""
    by_syntax = rows.select("path", "lang", F.explode("chunks").alias("c")).select("path", "lang", "c.*")
    plain = rows.where(F.size("chunks") == 0).select("path")
    return by_syntax.unionByName(heuristic_chunks(files.join(plain, "path", "left_semi")))


def chunks(files: DataFrame) -> DataFrame:
    """Chunks of ``files(path, lang, content)``: by syntax where a file has definitions, by lines otherwise."""
    return chunks_of(extracted(files), files)


def definitions(rows: DataFrame) -> DataFrame:
    """``(path, lang, ordinal, qualified, kind, start_line, end_line)`` of extracted ``rows``."""
    return rows.select("path", "lang", F.posexplode("definitions").alias("ordinal", "d")).select("path", "lang", "ordinal", "d.*")


def call_sites(rows: DataFrame) -> DataFrame:
    """Calls with the ordinal of the innermost definition around them in their file, -1 outside all."""
    return rows.select("path", "lang", F.posexplode("calls").alias("ordinal", "c")).select("path", "lang", "ordinal", "c.*")


def symbols_and_calls(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Symbols and calls of ``files(path, lang, content)``, each parsed once."""
    return graph_of(stored(extracted(files), "extracted"))


def graph_of(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Symbols and calls of ``operators.graph`` from extracted ``rows``.

    An id is a hash of the path and the place in the file, so it is told by the file alone: other files may come and go,
    and nothing is numbered across them. ``ordinal`` keeps the order within the file.
    """

    def symbol_id(ordinal: Column) -> Column:
        return F.xxhash64("path", ordinal.cast("int")).bitwiseAND(F.lit((1 << 63) - 1))

    symbols = definitions(rows).select(
        symbol_id(F.col("ordinal")).alias("id"),
        F.element_at(F.split("qualified", "\\."), -1).alias("name"),
        "qualified",
        "kind",
        "path",
        "start_line",
        "end_line",
        "lang",
        "ordinal",
    )
    calls = call_sites(rows).select(
        F.xxhash64("path", "ordinal").alias("call_id"),
        F.when(F.col("caller") >= 0, symbol_id(F.col("caller"))).otherwise(-1).cast("long").alias("caller_id"),
        "callee",
        "path",
        "line",
        "lang",
    )
    return symbols, calls
