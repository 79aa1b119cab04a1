import random
from collections import deque

from pyspark.sql import functions as F

from lodeworks.operators import budget, diff, graph, snapshot, spans, traverse

SYMBOLS = "id long, name string, qualified string, kind string, path string, start_line int, end_line int"
CALLS = "call_id long, caller_id long, callee string, path string, line int"


def plain_impact(symbols, edges, root, depth):
    """A queue over edges in the order of (call, target)."""
    seen, out, frontier = {("sym", root)}, [], deque([(root, False, [symbols[root]])])
    for d in range(1, depth + 1):
        following = deque()
        for node, doubt, chain in frontier:
            if node < 0:
                continue
            for call, caller, path, target, ambiguous in edges:
                if target != node:
                    continue
                key = ("sym", caller) if caller >= 0 else ("mod", path)
                if key in seen:
                    continue
                seen.add(key)
                name = symbols[caller] if caller >= 0 else f"<module {path}>"
                out.append((f"{key[0]}:{key[1]}", d, ambiguous or doubt, [name, *chain]))
                following.append((caller, ambiguous or doubt, [name, *chain]))
        frontier = following
    return out, bool(frontier)


def test_impact_is_a_breadth_first_search(spark):
    rng = random.Random(4)
    for trial in range(6):
        n = rng.randrange(4, 14)
        symbols = [(i, f"s{rng.randrange(5)}", f"q{i}", "callable", f"p{i % 3}", 1, 2) for i in range(n)]
        calls = [(k, rng.randrange(-1, n), f"s{rng.randrange(6)}", f"p{rng.randrange(3)}", k) for k in range(3 * n)]
        s, c = spark.createDataFrame(symbols, SYMBOLS), spark.createDataFrame(calls, CALLS)
        resolved = graph.resolve_calls(c, s)
        plain = []
        for k, caller, name, path, line in calls:
            ids = [x[0] for x in symbols if x[1] == name]
            here = [i for i in ids if symbols[i][4] == path]
            plain.append((k, caller, path, here or ids))
        assert {r.call_id: r.resolved for r in resolved.collect()} == {k: ids for k, _, _, ids in plain}
        edges = sorted((k, caller, path, t, len(ids) > 1) for k, caller, path, ids in plain for t in ids)
        roots, depth = [0, n - 1], rng.randrange(1, 5)
        found = traverse.impact(spark.createDataFrame([(r,) for r in roots], "id long"), s, graph.linked(c, s), depth).collect()
        for root in set(roots):
            want, cut = plain_impact([x[2] for x in symbols], [(k, c_, p, t, a) for k, c_, p, t, a in edges], root, depth)
            got = sorted((r.node_key, r.depth, r.uncertain, r.chain) for r in found if r.root_id == root)
            assert got == sorted(want), trial
            assert all(r.truncated == cut for r in found if r.root_id == root)


def small(spark):
    symbols = [
        (0, "mint", "mint", "callable", "core.py", 1, 4),
        (1, "Login", "Login", "container", "svc.py", 1, 20),
        (2, "enter", "Login.enter", "callable", "svc.py", 3, 8),
        (3, "serve", "serve", "callable", "api.py", 1, 5),
        (4, "test_serve", "test_serve", "callable", "tests/test_api.py", 1, 5),
        (5, "save", "save", "callable", "a.py", 1, 2),
        (6, "save", "save", "callable", "b.py", 1, 2),
    ]
    calls = [(0, 2, "mint", "svc.py", 5), (1, 3, "enter", "api.py", 2), (2, 4, "serve", "tests/test_api.py", 2), (3, 3, "print", "api.py", 3), (4, -1, "serve", "main.py", 1), (5, 3, "save", "api.py", 4), (6, 5, "save", "a.py", 2)]
    s, c = spark.createDataFrame(symbols, SYMBOLS), spark.createDataFrame(calls, CALLS)
    r = graph.resolve_calls(c, s)
    return s, r, graph.linked(c, s)


def test_lookups(spark):
    s, r, e = small(spark)
    assert {x.id: x.resolved for x in r.select("call_id", "resolved").withColumnRenamed("call_id", "id").collect()} == {0: [0], 1: [2], 2: [3], 3: [], 4: [3], 5: [5, 6], 6: [5]}
    assert [x.id for x in graph.find(s, "enter").collect()] == [2] == [x.id for x in graph.find(s, "Login.enter").collect()]
    assert sorted(x.id for x in graph.find(s, "save").collect()) == [5, 6]
    assert [(x.caller_id, x.path, x.line) for x in graph.callers(e, s, graph.find(s, "mint")).collect()] == [(2, "svc.py", 5)]
    assert sorted(x.target for x in graph.callees(e, s, graph.find(s, "serve")).collect()) == [2, 5, 6]
    assert [x.callee for x in graph.external_callees(e, graph.find(s, "serve")).collect()] == ["print"]
    deg = {x.id: (x.fan_in, x.call_sites, x.fan_out) for x in graph.degrees(s, e).collect()}
    assert deg[3] == (2, 2, 3) and deg[0] == (1, 1, 0) and deg[5] == (2, 2, 1)
    tests = traverse.tests_for(graph.find(s, "mint"), s, e).collect()
    assert [(t.qualified, t.depth, t.chain) for t in tests] == [("test_serve", 3, ["test_serve", "serve", "Login.enter", "mint"])]
    nodes = traverse.impact(graph.find(s, "mint"), s, e, 3)
    assert {x.node_key for x in nodes.collect()} == {"sym:2", "sym:3", "sym:4", "mod:main.py"}
    assert [x.test for x in diff.tests_to_run(nodes).collect()] == ["tests/test_api.py::test_serve"]
    assert traverse.impact(graph.find(s, "Login"), s, e, 3).count() == 0


def test_linked_calls_are_the_pairs(spark):
    """Callers, callees, degrees and sites over linked calls are those of the pairs written out, and no pair is made."""
    rng = random.Random(11)
    symbols = [(i, f"s{rng.randrange(6)}", f"q{i}", "callable", f"p{rng.randrange(4)}", 1, 2) for i in range(40)]
    calls = [(k, c, f"s{rng.randrange(8)}", f"p{rng.randrange(5)}" if c < 0 else symbols[c][4], k) for k in range(200) for c in [rng.randrange(-4, 40) if rng.random() < 0.9 else -1]]
    calls = [(k, max(c, -1), n, p, line) for k, c, n, p, line in calls]
    s, c = spark.createDataFrame(symbols, SYMBOLS), spark.createDataFrame(calls, CALLS)
    links = graph.linked(c, s)
    pairs = [r for r in graph.edges(graph.resolve_calls(c, s)).collect()]
    assert links.count() == len(calls) < len(pairs)
    for root in (0, 17):
        one = spark.createDataFrame([(root,)], "id long")
        assert {(x.caller_id, x.path, x.line, x.target) for x in graph.callers(links, s, one).collect()} == {(e.caller_id, e.path, e.line, root) for e in pairs if e.target == root}
        assert {x.target for x in graph.callees(links, s, one).collect()} == {e.target for e in pairs if e.caller_id == root}
    for x in graph.degrees(s, links).collect():
        into = [e for e in pairs if e.target == x.id]
        assert (x.fan_in, x.call_sites) == (len({e.caller_id for e in into}), len(into))
        assert x.fan_out == len({e.target for e in pairs if e.caller_id == x.id})


def test_a_common_name_makes_no_pairs(spark):
    """3,000 calls of a name with 2,000 symbols: the search moves rows in proportion to the calls and symbols."""
    s = spark.range(2000).select("id", F.lit("get").alias("name"), F.concat(F.lit("q"), "id").alias("qualified"), F.lit("callable").alias("kind"), F.concat(F.lit("p"), "id").alias("path"), F.lit(1).alias("start_line"), F.lit(2).alias("end_line"))
    c = spark.range(3000).select(F.col("id").alias("call_id"), (F.col("id") % 2000).alias("caller_id"), F.lit("get").alias("callee"), F.concat(F.lit("x"), F.col("id") % 50).alias("path"), F.lit(1).alias("line"))
    links = graph.linked(c, s).cache()
    met = graph.reaching(links, s, [], F.col("id"))
    assert met.count() == 3000
    found = traverse.impact(s.where("id < 30").select("id"), s, links, 2)
    assert found.groupBy("root_id").count().where("count <> 1999").isEmpty() and found.where("not uncertain").isEmpty()


def test_calls_of_a_node_are_one_row_before_known_nodes_are_left_out(spark, monkeypatch):
    """An anti-join with the known nodes goes beneath the aggregate, where it shuffles every call once for each root."""
    s, c, plans = small(spark)[0], spark.range(90).select(F.col("id").alias("call_id"), (F.col("id") % 3).alias("caller_id"), F.lit("mint").alias("callee"), F.lit("api.py").alias("path"), F.lit(1).alias("line")), {}
    keep = traverse.stored
    monkeypatch.setattr(traverse, "stored", lambda df, name: plans.update({name: df._jdf.queryExecution().optimizedPlan().toString()}) or keep(df, name))
    found = traverse.impact(graph.find(s, "mint"), s, graph.linked(c, s), 2, chains=False)
    assert {r.node_key for r in found.collect()} == {"sym:1", "sym:2"} and found.where("chain is not null").isEmpty()
    assert all("LeftAnti" not in plans[f"impact-{d}"] for d in (1, 2))


def test_diff_parsing_and_mapping(spark):
    s, _, _ = small(spark)
    text = "diff --git a/svc.py b/svc.py\n--- a/svc.py\n+++ b/svc.py\n@@ -4 +4,2 @@ class\n+x\n+y\n@@ -9,2 +10,0 @@\n-z\ndiff --git a/conf.ini b/conf.ini\n+++ b/conf.ini\n@@ -1 +1 @@\n+@@ -1 +1 @@ not a header\ndiff --git a/gone b/gone\n+++ /dev/null\n@@ -1 +0,0 @@\n-q\n"
    h = diff.hunks(spark.createDataFrame([(1, text)], "diff_id int, text string"))
    assert sorted(map(tuple, h.select("path", "start", "end", "deletion_only").collect()), key=str) == [("conf.ini", 1, 1, 0), ("svc.py", 4, 5, 0), ("svc.py", None, None, 1)]
    assert [x.qualified for x in diff.changed_symbols(h, s).collect()] == ["Login.enter"]
    assert [x.path for x in diff.unmapped_changes(h, s).collect()] == ["conf.ini"]
    only = spark.createDataFrame([("svc.py", None, None, 1), ("api.py", 50, 60, 0)], "path string, start int, end int, deletion_only int")
    assert [x.path for x in diff.unmapped_changes(only, s).collect()] == ["api.py"]
    disk = spark.createDataFrame([("svc.py", "1"), ("new.py", "2"), ("api.py", "3")], "path string, hash string")
    known = spark.createDataFrame([("svc.py", "0"), ("api.py", "3")], "path string, hash string")
    asked = spark.createDataFrame([("svc.py",), ("new.py",), ("api.py",), ("gone.py",)], "path string")
    assert sorted(x.path for x in diff.stale_files(asked, disk, known).collect()) == ["new.py", "svc.py"]


def test_snapshots(spark):
    a = spark.createDataFrame([("x", "1"), ("y", "1"), ("z", "1")], "path string, hash string")
    b = spark.createDataFrame([("x", "1"), ("y", "2"), ("w", "1")], "path string, hash string")
    assert {r.path: r.status for r in snapshot.snapshot_diff(a, b).collect()} == {"x": "unchanged", "y": "changed", "z": "deleted", "w": "added"}
    assert snapshot.snapshot_diff(a.limit(0), b).where("status <> 'added'").count() == 0
    assert sorted(r.path for r in snapshot.remove_paths(a, b).collect()) == ["z"]


def test_budget(spark):
    rows = [(i, 1.0, f"f{i}.py", 1, 9, "s", "x" * n) for i, n in enumerate([5000, 1000, 2900, 10], 1)]
    df = spark.createDataFrame(rows, "rank int, score double, path string, start_line int, end_line int, symbol string, text string")
    got = budget.blocks(df, 10).orderBy("rank").collect()
    assert [r.shown for r in got] == [True, True, True, True] and "[truncated — read f1.py:1-9 (s) for the rest]" in got[0].block
    got = budget.blocks(df, 10, context_chars=3000).orderBy("rank").collect()
    assert [r.shown for r in got] == [True, True, False, False]
    assert budget.context(df).first()[0].startswith("--- f1.py:1-9 (s)  [score=1.000] ---\nxxx")


def random_spans(rng, n, paths=3, deep=400):
    out = []
    for i in range(n):
        a = rng.randrange(1, deep)
        out.append((i, f"n{i}", f"q{i}", "callable", f"p{rng.randrange(paths)}", a, a + rng.choice([0, 0, 1, 3, 10, 70, 400, 5000])))
    return out


def test_interval_joins_against_every_pair(spark):
    rng = random.Random(5)
    rows = random_spans(rng, 250)
    s = spark.createDataFrame(rows, SYMBOLS)
    asked = [(i, f"p{rng.randrange(4)}", a, a + rng.choice([0, 0, 2, 16, 300])) for i in range(120) for a in [rng.randrange(1, 6000 if i % 9 == 0 else 420)]]
    asked += [(500, "p0", 3_000_000, 3_000_001), (501, "p1", 1, 5_000_000)]
    t = spark.createDataFrame(asked, "k int, path string, start int, end int")
    over = {k: [r for r in rows if r[4] == p and not (r[6] < a or r[5] > b)] for k, p, a, b in asked}
    want = {k: min((r[6] - r[5], r[0]) for r in v)[1] for k, v in over.items() if v}
    assert {r.k: r.symbol_id for r in spans.innermost(t, s, ["k"]).collect()} == want
    points = t.select("k", "path", F.col("start").alias("at"))
    inside = {k: min(((r[6] - r[5], r[0]) for r in rows if r[4] == p and r[5] <= a <= r[6]), default=(0, -1))[1] for k, p, a, _ in asked}
    assert {r.k: r.symbol_id for r in spans.enclosing(points, s, ["k"]).collect()} == inside
    chunks = s.select(F.col("id").alias("chunk_id"), "path", "start_line", "end_line", F.col("name").alias("text"))
    first = {(k, n + 1): (r[0], r[1]) for k, v in over.items() for n, r in enumerate(sorted(v, key=lambda r: (r[5], r[6], r[0]))[:3])}
    assert {(r.k, r.rank): (r.chunk_id, r.text) for r in spans.chunks_in_span(t, chunks, "k", 3).collect()} == first
    # Equal sizes in one file: the first of the file, where its order is given.
    twins = spark.createDataFrame([(9, "p", 1, 2, 0), (4, "p", 1, 2, 1)], "id long, path string, start_line int, end_line int, ordinal int")
    one = spark.createDataFrame([(1, "p", 2, 2)], "k int, path string, start int, end int")
    assert spans.innermost(one, twins, ["k"]).first().symbol_id == 9 and spans.innermost(one, twins.drop("ordinal"), ["k"]).first().symbol_id == 4


def test_joined_rows_stay_linear_in_one_large_file(spark):
    """100,000 symbols of one path, half of them around every point: rows that meet grow with the points, not with the pairs."""
    n, m = 100_000, 5_000
    wide = F.col("id") % 2 == 0
    s = spark.range(n).select(
        "id", F.lit("p").alias("path"), F.when(wide, 1 + F.col("id") % 999).otherwise(F.col("id") * 3).cast("int").alias("start_line"),
        F.when(wide, 400_000 + F.col("id") % 777).otherwise(F.col("id") * 3 + 2).cast("int").alias("end_line"),
    )
    points = spark.range(m).select(F.col("id").alias("k"), F.lit("p").alias("path"), (F.col("id") * 59 + 1000).cast("int").alias("at"))
    assert spans.enclosing(points, s, ["k"]).where("symbol_id < 0").isEmpty()
    met = spans.stabbed(points.select("k", "path", "at"), spans.covers(s, spans.smallest(s), F.min), "at")
    assert met.count() <= m * (spans.LEVELS + 1)
    ranges = points.select("k", "path", F.col("at").alias("start"), (F.col("at") + 40).alias("end"))
    assert spans.innermost(ranges, s, ["k"]).count() == m


def test_questions_and_bins_are_not_broadcast(spark):
    """Rows in bins are many times what their files are, so no side of their joins is sent to every task; equal questions and
    equal spans are one each before they are put into bins."""
    s = spark.range(4000).select(
        "id", F.lit("p").alias("path"), (F.col("id") % 5 * 7).cast("int").alias("start_line"), (F.col("id") % 5 * 7 + 3).cast("int").alias("end_line"), F.lit("t").alias("text")
    )
    ranges = s.select(F.col("id").alias("k"), "path", F.col("start_line").alias("start"), F.col("end_line").alias("end"))
    found = {
        "innermost": spans.innermost(ranges, s, ["k"]),
        "enclosing": spans.enclosing(ranges.select("k", "path", F.col("start").alias("at")), s, ["k"]),
        "chunks": spans.chunks_in_span(ranges, s.withColumnRenamed("id", "chunk_id"), "k", 2),
    }
    for name, df in found.items():
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString(), name
    assert {(r.k % 5, r.symbol_id) for r in found["innermost"].collect()} == {(i, i) for i in range(5)} == {(r.k % 5, r.symbol_id) for r in found["enclosing"].collect()}
    assert {(r.k % 5, r.rank, r.chunk_id) for r in found["chunks"].collect()} == {(i, n, i + 5 * n - 5) for i in range(5) for n in (1, 2)}
    assert spans.one_a_span(s).count() == 5
    # One key with two spans: ranked over both.
    two = spark.createDataFrame([(1, "p", 7, 8), (1, "p", 0, 1)], "k int, path string, start int, end int")
    got = spans.chunks_in_span(two, s.withColumnRenamed("id", "chunk_id"), "k", 3).collect()
    assert sorted((r.rank, r.chunk_id) for r in got) == [(1, 0), (2, 5), (3, 10)]


def test_what_is_told_of_candidates_is_worked_out_once_a_name(spark):
    """Calls carry the number and digest of their candidates, not the candidates; pairs of callers and symbols are not shuffled."""
    s = spark.range(300).select("id", F.concat(F.lit("s"), F.col("id") % 3).alias("name"), F.lit("q").alias("qualified"), F.concat(F.lit("p"), F.col("id") % 4).alias("path"))
    # One id under two names.
    s = s.unionByName(s.where("id = 0").withColumn("name", F.lit("s1")))
    c = spark.range(90).select(F.col("id").alias("call_id"), (F.col("id") % 7).alias("caller_id"), F.concat(F.lit("s"), F.col("id") % 4).alias("callee"), F.concat(F.lit("p"), F.col("id") % 5).alias("path"), F.lit(1).alias("line"))
    whole = {r.call_id: r.resolved for r in graph.resolve_calls(c, s).collect()}
    told = graph.resolve_calls(c, s, told=lambda ids: F.struct(F.size(ids).alias("n"), F.array_join(ids.cast("array<string>"), ",").alias("all")))
    assert {r.call_id: (r.resolved.n, r.resolved["all"]) for r in told.collect()} == {k: (len(v), ",".join(map(str, v))) for k, v in whole.items()}
    sources = spark.createDataFrame([(1,), (3,), (6,)], "id long")
    found = graph.callees(graph.linked(c, s), s, sources).collect()
    want = {(r.caller_id, t) for r in c.collect() if r.caller_id in (1, 3, 6) for t in whole[r.call_id]}
    assert len(found) == len(want) and {(r.caller_id, r.target) for r in found} == want
    pairs = {(r.caller_id, r.target): r.call_id for r in graph.out_of(graph.linked(c, s), s, sources).groupBy("caller_id", "target").agg(F.min("call_id").alias("call_id")).collect()}
    least = {}
    for r in c.collect():
        for t in whole[r.call_id] if r.caller_id in (1, 3, 6) else []:
            least[r.caller_id, t] = min(least.get((r.caller_id, t), r.call_id), r.call_id)
    assert pairs == least
