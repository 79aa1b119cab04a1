"""The tool surface: questions about one indexed tree, answered as text within a budget."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.models import Embedder
from ..operators import budget, diff, graph, traverse
from ..sources import git
from ..sources.files import language, named_files
from ..sources.store import Store
from .index import NoSources, build_index, index_dir
from .retrieve import retrieve

INSTRUCTIONS = (
    "Answer from the given code chunks alone and cite path:start-end for every claim. "
    "Chunks marked as called by another were added because that one calls them. "
    "Say so if the chunks do not hold the answer."
)


def clamp(k: int, low: int = 1, high: int = 15) -> int:
    return max(low, min(int(k), high))


class Service:
    """All tools over one tree. Each refreshes the index first; nothing is reread if nothing changed."""

    def __init__(self, spark: SparkSession, repo: str, embedder: Embedder | None = None, reranker: Callable[[str, list[str]], Sequence[float]] | None = None) -> None:
        self.spark, self.repo, self.embedder, self.reranker = spark, repo, embedder, reranker
        self.store = Store(spark, index_dir(repo))

    # State -------------------------------------------------------------------

    def refresh(self) -> str | None:
        """Bring the index up to date; what went wrong, if something did."""
        try:
            build_index(self.spark, self.repo, self.embedder)
        except NoSources as e:
            return str(e)
        return None

    def graph(self) -> tuple[DataFrame, DataFrame]:
        """Symbols, and calls linked to them by name."""
        symbols = self.store.require("symbols")
        return symbols, graph.linked(self.store.require("calls"), symbols)

    # Results as DataFrames -------------------------------------------------------

    def search(self, query: str, k: int = 8, mode: str = "hybrid", expand: bool = False) -> DataFrame:
        return retrieve(self.spark, self.store, query, k, mode, self.embedder, self.reranker, expand)

    def definitions(self, name: str) -> DataFrame:
        return graph.find(self.store.require("symbols"), name)

    def callers(self, name: str) -> DataFrame:
        symbols, calls = self.graph()
        sites = graph.callers(calls, symbols, graph.find(symbols, name))
        by = symbols.select(F.col("id").alias("caller_id"), F.col("qualified").alias("caller"))
        return sites.join(by, "caller_id", "left").withColumn("caller", F.coalesce("caller", F.lit("<module>"))).orderBy("path", "line")

    def callees(self, name: str) -> tuple[DataFrame, DataFrame]:
        """Called symbols, and names that no symbol bears."""
        symbols, calls = self.graph()
        found = graph.find(symbols, name)
        inside = symbols.join(graph.callees(calls, symbols, found).select(F.col("target").alias("id")).distinct(), "id", "left_semi")
        return inside.orderBy("path", "start_line"), graph.external_callees(calls, found).orderBy("callee")

    def impact(self, name: str, depth: int = 3) -> DataFrame:
        symbols, calls = self.graph()
        return traverse.impact(graph.find(symbols, name), symbols, calls, depth)

    def tests(self, name: str, depth: int = 4) -> DataFrame:
        symbols, calls = self.graph()
        return traverse.tests_for(graph.find(symbols, name), symbols, calls, depth)

    def diff_impact(self, rev: str | None = None, staged: bool = False, depth: int = 3) -> dict[str, DataFrame]:
        """What a diff reaches: changed, stale, unmapped, symbols, nodes and tests. Stale files make the rest doubtful."""
        changed = git.changes(self.spark, self.repo, rev, staged)
        symbols, calls = self.graph()
        indexable = changed.where(language(F.col("path")).isNotNull())
        # A diff's files are named by the driver already.
        disk = named_files(self.spark, self.repo, [r["path"] for r in indexable.select("path").distinct().collect()]).select("path", "hash")
        hit = diff.changed_symbols(changed, symbols)
        nodes = traverse.impact(hit, symbols, calls, depth)
        return {
            "changed": changed,
            "stale": diff.stale_files(indexable, disk, self.store.require("manifest")),
            "unmapped": diff.unmapped_changes(changed, symbols),
            "symbols": hit,
            "nodes": nodes,
            "tests": diff.tests_to_run(nodes),
        }

    # Answers as text: lists are whole and counts are theirs; only chunks of code are held to a budget ---------

    def _hits_text(self, hits: DataFrame, header: str) -> str:
        rows = budget.blocks(hits, len(header)).orderBy("rank").collect()  # a ranked list of k
        if not rows:
            return f"{header}\nNo code found. Try other words, or a symbol's name."
        shown = [r["block"] for r in rows if r["shown"]]
        end = "" if len(shown) == len(rows) else f"\n\n[budget reached: {len(rows)} hits, the first {len(shown)} shown]"
        return header + "".join(shown) + end

    def search_code(self, query: str, k: int = 6) -> str:
        wrong = self.refresh()
        return wrong or self._hits_text(self.search(query, clamp(k)), f"Results for {query!r}:")

    def ask_codebase(self, question: str, k: int = 6) -> str:
        wrong = self.refresh()
        return wrong or self._hits_text(self.search(question, clamp(k), expand=True), f"Context for {question!r}:\n{INSTRUCTIONS}")

    def answer(self, question: str, k: int = 8, expand: bool = True, model: Callable[[str, str], str] | None = None, mode: str = "hybrid") -> str:
        """A model's answer from (instructions, prompt), or the retrieved context where there is no model."""
        hits = self.search(question, k, mode, expand)
        if hits.isEmpty():
            return "No relevant code found."
        context = budget.context(hits).first()[0]
        if model is None:
            return "No model configured; retrieved chunks:\n\n" + context
        return model(INSTRUCTIONS, f"Question: {question}\n\nCode chunks:\n\n{context}")

    @staticmethod
    def _names(rows: DataFrame) -> list[str]:
        return [f"{r['qualified']}  {r['path']}:{r['start_line']}-{r['end_line']}" for r in rows.collect()]

    def get_definition(self, name: str) -> str:
        wrong = self.refresh()
        return wrong or "\n".join(self._names(self.definitions(name).orderBy("path", "start_line"))) or f"No symbol {name!r}."

    def find_callers(self, name: str) -> str:
        wrong = self.refresh()
        if wrong:
            return wrong
        rows = self.callers(name).collect()
        return f"{len(rows)} call sites of {name}:\n" + "\n".join(f"{r['caller']}  {r['path']}:{r['line']}" for r in rows)

    def find_callees(self, name: str) -> str:
        wrong = self.refresh()
        if wrong:
            return wrong
        inside, outside = self.callees(name)
        names = [r["callee"] for r in outside.collect()]
        return "\n".join([f"{name} calls:", *self._names(inside), "external: " + (", ".join(names) or "none")])

    @staticmethod
    def _nodes_text(nodes: DataFrame, title: str) -> str:
        rows = nodes.orderBy("depth", "path", "call_line", "node_key").collect()
        if not rows:
            return f"{title}: nothing found."
        out = [f"{title}: {len(rows)} found, {sum(r['uncertain'] for r in rows)} uncertain" + (", cut off by depth" if any(r["truncated"] for r in rows) else "")]
        for r in rows:
            marks = " [test]" * r["is_test"] + " [uncertain]" * r["uncertain"]
            out.append(f"{r['depth']}  {r['qualified']}  {r['path']}:{r['call_line']}{marks}\n   " + " -> ".join(r["chain"]))
        return "\n".join(out)

    def analyze_impact(self, name: str, depth: int = 3) -> str:
        return self.refresh() or self._nodes_text(self.impact(name, depth), f"Impact of {name}")

    def find_tests(self, name: str, depth: int = 4) -> str:
        return self.refresh() or self._nodes_text(self.tests(name, depth), f"Tests reaching {name}")

    def impact_of_changes(self, rev: str = "", depth: int = 3, staged: bool = False) -> str:
        """The impact of a diff. The index is not refreshed first: a stale one is what the guard is to notice."""
        try:
            found = self.diff_impact(rev or None, staged, depth)
        except git.GitError as e:
            return f"git: {e}"
        paths = lambda key: [r["path"] for r in found[key].select("path").distinct().orderBy("path").collect()]
        stale = paths("stale")
        if stale:
            return "The index is older than these changed files; index again first: " + ", ".join(stale)
        tests = [r["test"] for r in found["tests"].orderBy("test").collect()]
        return "\n".join(
            [
                "Changed: " + (", ".join(paths("changed")) or "nothing"),
                "Changed but not covered by any symbol: " + (", ".join(paths("unmapped")) or "none"),
                "Symbols:",
                *self._names(found["symbols"].orderBy("path", "start_line")),
                self._nodes_text(found["nodes"], "Impact"),
                "Tests to run: " + (", ".join(tests) or "none"),
            ]
        )
