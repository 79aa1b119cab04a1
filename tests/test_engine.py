import json
import os
import subprocess

import pytest
from pyspark.sql import functions as F

from lodeworks.functions.models import HashEmbedder, ModelEmbedder, load_reranker
from lodeworks.plans import cli
from lodeworks.plans.index import NoSources, build_index, index_dir
from lodeworks.plans.retrieve import retrieve
from lodeworks.plans.service import Service
from lodeworks.sources import files, git, syntax
from lodeworks.sources.store import NotIndexed, Store
from lodeworks.streaming.refresh import watch

TREE = {
    "core/keys.py": "import os\n\nLIMIT = 3\n\ndef mint_key(user):\n    return seal(user)\n\n\ndef seal(text):\n    return str(text)\n",
    "svc/door.py": "from core.keys import mint_key\n\n\nclass Door:\n    \"\"\"Lets people in.\"\"\"\n\n    @staticmethod\n    def enter(user):\n        return mint_key(user)\n\n    def leave(self):\n        def inner():\n            return audit()\n        return inner()\n",
    "api.py": "from svc.door import Door\n\n\ndef handle_visit(request):\n    return Door().enter(request)\n",
    "tests/test_api.py": "from api import handle_visit\n\n\ndef test_visit():\n    assert handle_visit(1)\n",
    "web/app.js": "export function drawPage(a) {\n  return render(a);\n}\nclass View {\n  show(x) {\n    return drawPage(x);\n  }\n}\nconst later = (q) => {\n  drawPage(q);\n};\n",
    "notes.md": "# Notes\n\nHow the door works.\n",
    "build/out.py": "def skipped():\n    pass\n",
    "logo.png": "binary",
    "core/__init__.py": "VERSION = 1\n",
    "gen/app.py": "def generated():\n    pass\n",
    "lib/tool.min.js": "function x(){}\n",
}


def write(root, tree):
    for name, text in tree.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)


@pytest.fixture()
def repo(tmp_path):
    root = tmp_path / "build" / "repo"  # a skipped name above the root does not matter
    root.mkdir(parents=True)
    write(root, TREE)
    (root / files.IGNORE_FILE).write_text("# generated\ngen/\n*.min.js\n")
    return root


def paths(df):
    return sorted(r.path for r in df.select("path").distinct().collect())


def test_source_files(spark, repo):
    (repo / "bad.txt").write_bytes(b"ok \xff\xfe end\n")
    (repo / "huge.txt").write_text("x" * 1_000_001)
    found = files.source_files(spark, str(repo))
    assert paths(found) == ["api.py", "bad.txt", "core/__init__.py", "core/keys.py", "notes.md", "svc/door.py", "tests/test_api.py", "web/app.js"]
    rows = {r.path: r for r in found.collect()}
    assert rows["bad.txt"].content == "ok  end\n" and rows["web/app.js"].lang == "javascript"


@pytest.mark.parametrize(
    "pattern, path, hit",
    [
        ("dist/", "a/dist/x.py", True), ("dist/", "dist", False), ("dist", "a/dist", True), ("*.min.js", "a/b.min.js", True),
        ("*.min.js", "a/b.js", False), ("public/js/", "public/js/x.js", True), ("public/js/", "a/public/js/x.js", False),
        ("**/vendor/**", "a/vendor/b.c", True), ("a/*.py", "a/b/c.py", True), ("t[ab].py", "ta.py", True), ("t?.py", "t/x.py", False), ("/", "a", False),
    ],
)
def test_ignore_patterns(spark, pattern, path, hit):
    assert spark.range(1).select(files.ignored(F.lit(path), [pattern]).alias("x")).first()[0] is hit


def test_syntax_chunks_symbols_calls(spark, repo):
    found = files.source_files(spark, str(repo))
    got = {(r.path, r.start_line, r.end_line, r.symbol) for r in syntax.chunks(found).collect()}
    assert {
        ("core/keys.py", 1, 3, "<module>"), ("core/keys.py", 5, 6, "mint_key"), ("svc/door.py", 4, 6, "Door (decl)"), ("svc/door.py", 7, 9, "Door.enter"),
        ("svc/door.py", 11, 14, "Door.leave"), ("web/app.js", 1, 3, "drawPage"), ("web/app.js", 4, 4, "View (decl)"), ("web/app.js", 5, 7, "View.show"),
        ("web/app.js", 9, 11, "later"), ("notes.md", 1, 3, "<window>"),
    } <= got
    symbols, calls = syntax.symbols_and_calls(found)
    names = {r.qualified: r for r in symbols.collect()}
    assert {"Door", "Door.enter", "Door.leave", "Door.leave.inner", "mint_key", "View.show"} <= names.keys()
    assert names["Door"].kind == "container" and (names["Door.enter"].start_line, names["Door.enter"].end_line) == (8, 9)
    by_id = {r.id: q for q, r in names.items()} | {-1: None}
    assert {(by_id[r.caller_id], r.callee, r.line) for r in calls.collect()} >= {
        ("mint_key", "seal", 6), ("Door.enter", "mint_key", 9), ("handle_visit", "Door", 5), ("handle_visit", "enter", 5),
        ("Door.leave.inner", "audit", 13), ("Door.leave", "inner", 14), ("View.show", "drawPage", 6),
    }
    broken = spark.createDataFrame([("x.py", "python", "def a(:\n  pass\n")], "path string, lang string, content string")
    assert [r.symbol for r in syntax.chunks(broken).collect()] == ["def a"]


def test_incremental_equals_full(spark, repo):
    first = build_index(spark, str(repo))
    assert first["added"] == 7 and first["embedded"] > 0
    assert build_index(spark, str(repo)) == {"added": 0, "changed": 0, "deleted": 0, "embedded": 0}
    (repo / "core/keys.py").write_text(TREE["core/keys.py"].replace("3", "4"))
    (repo / "notes.md").unlink()
    (repo / "more.py").write_text("def added_later():\n    return 1\n")
    again = build_index(spark, str(repo))
    assert (again["added"], again["changed"], again["deleted"]) == (1, 1, 1) and 0 < again["embedded"] < first["embedded"]
    store = Store(spark, index_dir(str(repo)))
    cols = ["path", "start_line", "end_line", "symbol", "text", "embedding"]
    grown = sorted(map(str, store.require("chunks").select(cols).collect()))
    build_index(spark, str(repo), full=True)
    assert grown == sorted(map(str, store.require("chunks").select(cols).collect()))
    model = ModelEmbedder("flat", lambda: lambda texts: [[float(len(t)), 1.0] for t in texts], "none")
    assert build_index(spark, str(repo), model)["embedded"] == len(grown)
    assert len(store.require("chunks").first().embedding) == 2


def test_errors(spark, tmp_path):
    (tmp_path / "x.bin").write_text("no source")
    with pytest.raises(NoSources):
        build_index(spark, str(tmp_path))
    with pytest.raises(NotIndexed):
        Store(spark, index_dir(str(tmp_path))).require("chunks")
    assert load_reranker(lambda: 1 / 0) is None


def test_retrieval_modes_rerank_expand(spark, repo):
    build_index(spark, str(repo))
    store = Store(spark, index_dir(str(repo)))
    for mode in ("hybrid", "vector", "lexical"):
        hits = retrieve(spark, store, "mint key user", 3, mode).collect()
        assert (mode == "vector" or "mint_key" in [h.symbol for h in hits]) and [h.rank for h in hits] == list(range(1, len(hits) + 1))
    prefer = lambda q, docs: [float("Door.leave" in d) for d in docs]
    assert retrieve(spark, store, "door enter leave", 2, reranker=prefer).first().symbol == "Door.leave"
    with pytest.raises(ValueError):
        retrieve(spark, store, "x", mode="other")
    hits = retrieve(spark, store, "handle visit request", 1, "lexical", expand=True).collect()
    assert hits[0].symbol == "handle_visit" and {"Door (decl)  ← called by handle_visit", "Door.enter  ← called by handle_visit"} <= {h.symbol for h in hits[1:]}


def test_service_and_command_line(spark, repo, capsys):
    root = str(repo)
    s = Service(spark, root)
    assert "mint_key" in s.search_code("mint key") and "no such" not in s.get_definition("enter")
    assert "Door.enter  svc/door.py:9" in s.find_callers("mint_key")
    assert "external: none" not in s.find_callees("seal") and "str" in s.find_callees("seal")
    assert "handle_visit -> Door.enter -> mint_key" in s.analyze_impact("mint_key")
    assert "test_visit -> handle_visit -> Door.enter -> mint_key" in s.find_tests("mint_key")
    assert s.answer("mint key").startswith("No model configured")
    assert s.answer("mint key", model=lambda system, prompt: prompt[:8]) == "Question"
    assert len(s.ask_codebase("door")) < 7000
    assert "git:" in s.impact_of_changes()
    assert cli.run(spark, ["search", root, "seal text", "--json", "-k", "2", "--mode", "lexical"]) == 0
    first = json.loads(capsys.readouterr().out.splitlines()[0])
    assert first["locator"] == "core/keys.py:9-10 (seal)"
    for argv in (["index", root], ["defs", root, "enter"], ["callers", root, "mint_key"], ["callees", root, "seal"], ["impact", root, "mint_key"], ["tests", root, "mint_key", "--json"], ["ask", root, "door"]):
        assert cli.run(spark, argv) == 0 and capsys.readouterr().out
    assert cli.run(spark, ["impact", root]) == 2
    (repo / "set.jsonl").write_text('# mine\n\n{"query": "who mints keys", "path": "core/keys.py", "start_line": 5, "end_line": 6, "_symbol": "x"}\n')
    assert cli.run(spark, ["eval", root, "--kind", "both", "--curated", str(repo / "set.jsonl"), "--json", "--fail-under", "mrr=0.1", "--check-mode", "lexical"]) == 0
    report = {r["mode"]: r for r in json.loads(capsys.readouterr().out.splitlines()[-1])}
    assert report["lexical"]["recall_at_k"] >= 0.5 and report["hybrid"]["n"] == 5
    assert cli.run(spark, ["eval", root, "--fail-under", "mrr=1.01"]) == 1 and cli.run(spark, ["eval", root, "--fail-under", "nonsense=1"]) == 2
    capsys.readouterr()
    assert cli.run(spark, ["eval", root, "--scaffold"]) == 0
    assert all("TODO" in json.loads(x)["query"] for x in capsys.readouterr().out.splitlines())


def test_diff_impact(spark, repo):
    run = lambda *a: subprocess.run(["git", "-C", str(repo), "-c", "user.name=t", "-c", "user.email=t@example.com", *a], check=True, capture_output=True)
    (repo / ".gitignore").write_text(files.INDEX_DIR + "/\n")
    (repo / "config.ini").write_text("a=1\n")
    run("init", "-q")
    run("add", "-A")
    run("commit", "-qm", "first")
    assert git.is_repository(str(repo))
    build_index(spark, str(repo))
    (repo / "core/keys.py").write_text(TREE["core/keys.py"].replace("return seal(user)", "return seal(user + 1)"))
    s = Service(spark, str(repo))
    assert paths(s.diff_impact()["stale"]) == ["core/keys.py"]
    assert "index again first" in s.impact_of_changes()
    build_index(spark, str(repo))
    (repo / "config.ini").write_text("a=2\n")
    (repo / "fresh.py").write_text("def brand_new():\n    return 1\n")
    build_index(spark, str(repo))
    found = s.diff_impact(depth=3)
    assert paths(found["stale"]) == [] and paths(found["unmapped"]) == ["config.ini"]
    assert sorted(r.qualified for r in found["symbols"].collect()) == ["brand_new", "mint_key"]
    assert [r.test for r in found["tests"].collect()] == ["tests/test_api.py::test_visit"]
    assert paths(s.diff_impact("HEAD")["changed"]) == ["config.ini", "core/keys.py"]
    assert "Tests to run: tests/test_api.py::test_visit" in s.impact_of_changes()


def test_streaming_refresh(spark, repo, tmp_path):
    q = watch(spark, str(repo), str(tmp_path / "ck"), once=True)
    q.awaitTermination(120)
    assert Store(spark, index_dir(str(repo))).require("chunks").count() > 5
    assert HashEmbedder().fingerprint() == Store(spark, index_dir(str(repo))).pointer()["fingerprint"]


DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables")
def test_catalogue_against_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    from lodeworks import catalogue

    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM read_parquet('{DATA}/{name}')")

    def norm(v):
        if isinstance(v, float):
            return repr(round(v, 6) + 0.0)
        return "[" + ",".join(map(norm, v)) + "]" if isinstance(v, (list, tuple)) else str(v)

    for name, f in catalogue.QUERIES.items():
        df = f(spark, DATA)
        if name not in catalogue.ORACLES:
            assert name == "vector_ivf_topk" and df.count() == 100
            continue
        cols = sorted(df.columns)
        got = sorted("|".join(norm(r[c]) for c in cols) for r in df.collect())
        cur = con.execute(catalogue.ORACLES[name])
        have = [d[0] for d in cur.description]
        assert sorted(have) == cols, name
        want = sorted("|".join(norm(dict(zip(have, r))[c]) for c in cols) for r in cur.fetchall())
        assert got == want, name


class Listed(Service):
    """A service over given results."""

    def __init__(self, **found):
        self.found = found

    def refresh(self):
        return None

    def callers(self, name):
        return self.found["callers"]

    def callees(self, name):
        return self.found["symbols"], self.found["outside"]

    def diff_impact(self, rev=None, staged=False, depth=3):
        return self.found


def test_answers_list_everything_and_count_it(spark):
    n = 450
    rows = spark.range(n).select(F.format_string("n%03d", "id").alias("x"), F.col("id").cast("int").alias("line"))
    symbols = rows.select(F.col("x").alias("qualified"), F.concat("x", F.lit(".py")).alias("path"), F.lit(1).alias("start_line"), F.lit(2).alias("end_line"))
    last = F.col("line") == n - 1
    nodes = rows.select(
        F.lit(1).alias("depth"), F.concat("x", F.lit(".py")).alias("path"), F.col("line").alias("call_line"), F.col("x").alias("node_key"),
        F.col("x").alias("qualified"), last.alias("uncertain"), last.alias("truncated"), F.lit(True).alias("is_test"), F.array("x").alias("chain"),
    )
    files_ = symbols.select("path")
    found = {"callers": rows.select(F.col("x").alias("caller"), F.col("x").alias("path"), "line"), "symbols": symbols, "outside": rows.select(F.col("x").alias("callee"))}
    found |= {"changed": files_, "unmapped": files_, "stale": files_.limit(0), "nodes": nodes, "tests": rows.select(F.concat(F.lit("t::"), "x").alias("test"))}
    s = Listed(**found)
    callers = s.find_callers("hub").splitlines()
    assert callers[0].startswith(f"{n} call sites") and len(callers) == n + 1
    callees = s.find_callees("hub").splitlines()
    assert len(callees) == n + 2 and callees[-1].count("n") >= n and "n449" in callees[-1]
    text = s.impact_of_changes()
    assert f"Impact: {n} found, 1 uncertain, cut off by depth" in text
    lines = {x.split(":")[0]: x for x in text.splitlines()}
    assert lines["Tests to run"].count("t::") == n and lines["Changed"].count(".py") == n and lines["Changed but not covered by any symbol"].count(".py") == n
    s.found["stale"] = files_
    assert s.impact_of_changes().count(".py") == n
