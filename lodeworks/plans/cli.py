"""The command line: index, search, ask, defs, callers, callees, impact, tests, eval, calibrate, serve."""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.models import HashEmbedder, load_reranker, named_answerer, named_embedder, named_reranker
from ..functions.text import PREFIXES, locator
from ..operators import evaluate
from ..sources import git
from ..sources.files import curated_items
from ..sources.store import NotIndexed
from . import measure, server
from .index import NoSources, build_index
from .retrieve import MODES
from .service import Service


class Refused(RuntimeError):
    """An answer cannot be given; the message says why, and code is the exit code."""

    def __init__(self, message: str, code: int = 1) -> None:
        super().__init__(message)
        self.code = code


_COUNT = {"type": int}
_FLAG = {"action": "store_true"}
_DIFF = {"--diff": {"nargs": "?", "const": "", "default": None, "metavar": "REV"}, "--staged": _FLAG, "--json": _FLAG}
_HITS = {"-k": _COUNT | {"default": 8}, "--mode": {"choices": MODES, "default": "hybrid"}, "--no-rerank": _FLAG, "--rerank-model": {}, "--json": _FLAG}
#: Verb: help, positional arguments after the tree, options.
VERBS: dict[str, tuple[str, list[str], dict[str, dict]]] = {
    "index": ("build or refresh the index", [], {"--full": _FLAG, "--no-graph": _FLAG, "--batch": _COUNT | {"default": 64}, "--json": _FLAG}),
    "search": ("find code", ["query"], _HITS),
    "ask": ("find code and what it calls, and answer from it", ["query"], _HITS | {"--no-expand": _FLAG, "--answer-model": {}}),
    "defs": ("where a symbol is defined", ["symbol"], {"--json": _FLAG}),
    "callers": ("what calls a symbol", ["symbol"], {"--json": _FLAG}),
    "callees": ("what a symbol calls", ["symbol"], {"--json": _FLAG}),
    "impact": ("what a change of a symbol or a diff reaches", ["symbol?"], {"--depth": _COUNT | {"default": 3}} | _DIFF),
    "tests": ("which tests reach a symbol or a diff", ["symbol?"], {"--depth": _COUNT | {"default": 4}} | _DIFF),
    "eval": ("measure retrieval quality", [], {
        "--kind": {"choices": ("name", "curated", "both"), "default": "name"}, "--curated": {}, "--max-items": _COUNT | {"default": 200},
        "-k": _COUNT | {"default": 10}, "--rerank": _FLAG, "--rerank-model": {}, "--scaffold": _FLAG, "--fail-under": {"default": ""},
        "--check-mode": {}, "--json": _FLAG,
    }),
    "calibrate": ("compare prefix schemes and suggest floors for the gate", [], {
        "--curated": {}, "--prefixes": {"default": "bge,e5,none"}, "-k": _COUNT | {"default": 10}, "--max-items": _COUNT | {"default": 200},
        "--rerank": _FLAG, "--rerank-model": {}, "--gate-mode": {"default": "hybrid"}, "--out": {"default": "calibration.json"},
    }),
    "serve": ("answer tools over standard input and output", [], {"--rerank-model": {}}),
}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lodeworks", description="Questions about a source tree.")
    p.add_argument("--model", help="embedder: hash (built in) or module:function, which returns a model over lists of texts")
    p.add_argument("--prefix", choices=tuple(PREFIXES), help="what a model's queries and passages are prefixed with; a change indexes anew")
    sub = p.add_subparsers(dest="verb", required=True)
    for verb, (text, positional, options) in VERBS.items():
        v = sub.add_parser(verb, help=text)
        v.add_argument("repo")
        for name in positional:
            v.add_argument(name.rstrip("?"), **({"nargs": "?"} if name.endswith("?") else {}))
        for flag, how in options.items():
            v.add_argument(flag, **how)
    return p


def _show(rows: DataFrame, as_json: bool, line: Callable) -> None:
    """A report on the terminal: JSON rows, or one line a row."""
    for text in rows.toJSON().toLocalIterator() if as_json else map(line, rows.toLocalIterator()):
        print(text)


# Verbs -----------------------------------------------------------------------


def index(s: Service, args) -> int:
    done = build_index(s.spark, s.repo, s.embedder, full=args.full, graph=not args.no_graph, progress=lambda m: print(m, file=sys.stderr))
    print(json.dumps(done))
    return 0


def search(s: Service, args) -> int:
    expand = args.verb == "ask" and not args.no_expand
    if args.verb == "ask" and not args.json:
        print(s.answer(args.query, args.k, expand, named_answerer(args.answer_model), args.mode))
        return 0
    at = locator(F.col("path"), F.col("start_line"), F.col("end_line"), F.col("symbol"))
    rows = s.search(args.query, args.k, args.mode, expand).withColumn("score", F.round("score", 6)).withColumn("locator", at)
    _show(rows, args.json, lambda r: f"{r['rank']}  {r['score']:.6f}  {r['locator']}")
    return 0


def _several(found: DataFrame, name: str) -> None:
    """Say so where a name means more than one definition: results are those of all."""
    rows = found.select("qualified", "path", "start_line", "end_line").orderBy("path", "start_line").collect()
    if len(rows) > 1:
        print(f"{name} names {len(rows)} definitions; results are for all of them, a qualified name narrows them:", file=sys.stderr)
        for r in rows:
            print(f"  {r['qualified']}  {r['path']}:{r['start_line']}-{r['end_line']}", file=sys.stderr)


def symbols(s: Service, args) -> int:
    found = s.definitions(args.symbol)
    if args.verb == "defs":
        _show(found.orderBy("path", "start_line"), args.json, lambda r: f"{r['qualified']}  {r['path']}:{r['start_line']}-{r['end_line']}")
        return 0
    _several(found, args.symbol)
    if args.verb == "callers":
        _show(s.callers(args.symbol), args.json, lambda r: f"{r['caller']}  {r['path']}:{r['line']}")
        return 0
    inside, outside = s.callees(args.symbol)
    names = inside.select("qualified", "path", F.lit(False).alias("external"))
    rows = names.unionByName(outside.select(F.col("callee").alias("qualified"), F.lit(None).cast("string").alias("path"), F.lit(True).alias("external")))
    _show(rows, args.json, lambda r: r["qualified"] + ("  (external)" if r["external"] else f"  {r['path']}"))
    return 0


def _pieces(nodes: DataFrame) -> Iterator[str]:
    """The JSON of impacted nodes, one at a time."""
    columns = ["symbol_id", "qualified", "path", F.col("call_line").alias("line"), "depth", "uncertain", "is_test", "chain"]
    first = True
    for text in nodes.orderBy("depth", "path", "call_line", "node_key").select(*columns).toJSON().toLocalIterator():
        yield text if first else ", " + text
        first = False


def _counts(nodes: DataFrame) -> dict:
    r = nodes.agg(F.count_if("uncertain").alias("u"), F.coalesce(F.max("truncated"), F.lit(False)).alias("t")).first()
    return {"truncated": bool(r["t"]), "uncertain_count": r["u"]}


def _print_object(head: dict, nodes: DataFrame) -> None:
    """One JSON object a line; its list is written as it comes, however long."""
    sys.stdout.write(json.dumps(head)[:-1] + ', "impacted": [')
    for piece in _pieces(nodes):
        sys.stdout.write(piece)
    sys.stdout.write("]}\n")


def reach(s: Service, args) -> int:
    if (args.symbol is None) == (args.diff is None):
        raise Refused("name a symbol or give --diff", 2)
    only_tests = args.verb == "tests"
    narrow = lambda rows: rows.where("is_test") if only_tests else rows
    if args.diff is not None and not args.json:
        text = s.impact_of_changes(args.diff, args.depth, args.staged)
        if text.startswith(("The index is older", "git:")):
            raise Refused(text)
        print(text)
        return 0
    if args.diff is not None:
        found = s.diff_impact(args.diff or None, args.staged, args.depth)
        if not found["stale"].isEmpty():
            raise Refused("the index is older than changed files")
        listed = lambda rows, column: [r[0] for r in rows.select(column).distinct().orderBy(column).collect()]
        head = {
            "changed": listed(found["changed"], "path"), "unmapped": listed(found["unmapped"], "path"), "max_depth": args.depth,
            "symbols": [r.asDict() for r in found["symbols"].orderBy("path", "start_line").collect()], "tests": listed(found["tests"], "test"),
        }
        nodes = narrow(found["nodes"])
        _print_object(head | _counts(nodes), nodes)
        return 0
    roots = s.definitions(args.symbol)
    _several(roots, args.symbol)
    nodes = s.impact(args.symbol, args.depth)
    if args.json:
        for root in roots.drop("lang").orderBy("path", "start_line").collect():
            mine = nodes.where(F.col("root_id") == root["id"])
            _print_object({"symbol": root.asDict(), "max_depth": args.depth} | _counts(mine), narrow(mine))
        return 0
    _show(narrow(nodes).orderBy("depth", "path", "call_line"), False, lambda r: f"{r['depth']}  " + " -> ".join(r["chain"]))
    return 0


def items(s: Service, args) -> DataFrame:
    """The questions of an evaluation: generated from names, written by hand, or both."""
    named = lambda: evaluate.name_dataset(s.store.require("symbols"), args.max_items).withColumn("source", F.lit("name"))
    written = lambda: curated_items(s.spark, args.curated) if args.curated else None
    kind = getattr(args, "kind", "both")
    wanted = [named] * (kind != "curated" or not args.curated) + [written] * bool(args.curated)
    out = None
    for part in (make() for make in wanted):
        out = part if out is None else out.unionByName(part)
    return out.withColumn("item_id", F.xxhash64("query", "gold_path", "gold_start", "gold_end"))


def evaluation(s: Service, args) -> int:
    if args.scaffold:
        rows = evaluate.scaffold(s.store.require("symbols"), args.max_items)
        _show(rows.orderBy("place").drop("place"), True, str)
        return 0
    report = measure.report(s, items(s, args), args.k)
    rows = [r.asDict() for r in report.orderBy("mode").collect()]
    if args.json:
        print(json.dumps(rows))
    else:
        table = [("mode", "recall@1", f"recall@{args.k}", "mrr"), *((r["mode"], *(f"{r[m]:.3f}" for m in ("recall_at_1", "recall_at_k", "mrr"))) for r in rows)]
        for row in table:
            print("  ".join([row[0].ljust(14), *(x.rjust(10) for x in row[1:])]))
    return _gated(s, args, report, {r["mode"] for r in rows})


def _gated(s: Service, args, report: DataFrame, modes: set[str]) -> int:
    """0 where the report holds every floor, 1 where not, 2 where it has no such mode or metric."""
    floors = evaluate.parse_floors(args.fail_under)
    if not floors:
        return 0
    mode = args.check_mode or ("hybrid+rerank" if "hybrid+rerank" in modes else "hybrid")
    columns = {"recall@1": "recall_at_1", f"recall@{args.k}": "recall_at_k", "mrr": "mrr"}
    if mode not in modes or floors.keys() - columns.keys():
        raise Refused("unknown mode or metric", 2)
    wanted = s.spark.createDataFrame([(mode, columns[m], v) for m, v in floors.items()], "mode string, metric string, floor double")
    failed = evaluate.gate(report, wanted).where("not passed").orderBy("metric").collect()
    for r in failed:
        print(f"{mode} {r['metric']} is {r['value']:.3f}, under {r['floor']}", file=sys.stderr)
    return int(bool(failed))


def calibrate(s: Service, args) -> int:
    """Evaluate each prefix scheme on an index of its own, name the best, suggest floors, and write all of it."""
    schemes = [p.strip() for p in args.prefixes.split(",") if p.strip()]
    if unknown := [p for p in schemes if p not in PREFIXES]:
        raise Refused(f"unknown prefix {', '.join(unknown)}", 2)
    found = measure.calibration(s, lambda prefix: named_embedder(args.model, prefix), schemes, lambda: items(s, args), args.k, args.gate_mode)
    with open(args.out, "w") as out:
        json.dump(found, out, indent=1)
    print(json.dumps({"best_prefix": found["best_prefix"], "floors": found["floors"]}))
    return 0


def serve(s: Service, args) -> int:
    server.serve(s, sys.stdin, sys.stdout)
    return 0


_RUN = {
    "index": index, "search": search, "ask": search, "defs": symbols, "callers": symbols, "callees": symbols, "impact": reach, "tests": reach,
    "eval": evaluation, "calibrate": calibrate, "serve": serve,
}


def run(spark: SparkSession, argv: list[str]) -> int:
    args = parser().parse_args(argv)
    say = lambda m: print(m, file=sys.stderr)
    embedder = named_embedder(args.model, args.prefix, getattr(args, "batch", 64))
    wanted = getattr(args, "rerank_model", None)
    if getattr(args, "rerank", False):
        wanted = wanted or "overlap"
    skipped = getattr(args, "no_rerank", False)
    reranker = load_reranker(lambda: named_reranker(wanted), say) if wanted and not skipped else None
    service = Service(spark, args.repo, None if isinstance(embedder, HashEmbedder) else embedder, reranker)
    try:
        return _RUN[args.verb](service, args)
    except (NotIndexed, NoSources, git.GitError) as e:
        say(e)
        return 1
    except Refused as e:
        say(e)
        return e.code


def main() -> int:
    spark = SparkSession.builder.appName("lodeworks").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return run(spark, sys.argv[1:])


if __name__ == "__main__":
    sys.exit(main())
