import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lodeworks.functions import text as T, vectors as V
from lodeworks.operators import chunking, evaluate, fusion, lexical, vectors
from lodeworks.plans import retrieve

GOLDEN = {
    "refreshToken": ["refreshtoken", "refresh", "token"],
    "refresh_token": ["refresh", "token"],
    "getHTTPResponse": ["gethttpresponse", "get", "http", "response"],
    "abc123": ["abc123", "abc", "123"],
    "Refresh": ["refresh"],
    "": [],
    "é-Ü": [],
}


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def test_tokenizer(spark):
    rng = random.Random(2)
    samples = dict(GOLDEN)
    for _ in range(300):
        w = "".join(rng.choice("aBcDEfG12_ é") for _ in range(rng.randrange(14)))
        samples[w] = lexical.query_terms(w)
    df = spark.createDataFrame([(w,) for w in samples], "w string")
    for r in df.select("w", T.tokenize(F.col("w")).alias("t")).collect():
        assert r.t == samples[r.w] == lexical.query_terms(r.w)


def test_test_paths(spark):
    want = {"tests/test_auth.py": True, "src/foo.test.ts": True, "pkg/thing_test.go": True, "src/latest_news.py": False, "src/Latest.java": True, "a\\Spec\\b.py": True, "x.py": False}
    df = spark.createDataFrame([(p,) for p in want], "p string")
    assert {r.p: r.t for r in df.select("p", T.is_test_path(F.col("p")).alias("t")).collect()} == want
    names = {"testimony": True, "a.TestB": True, "tests.x": True, "mod.tests": True, "contest": False}
    df = spark.createDataFrame([(p,) for p in names], "p string")
    assert {r.p: r.t for r in df.select("p", T.looks_like_test(F.col("p")).alias("t")).collect()} == names


@pytest.mark.parametrize("text", ["", "a", "a\n", "a\r\nb\n\nc", "x\x0by\x0cz", "p q\x85r\n\n", "\n"])
def test_lines_are_splitlines(spark, text):
    got = one(spark, T.lines(F.lit(text)))
    assert got == text.splitlines()


def plain_bm25(docs, query):
    toks = {i: lexical.query_terms(d) for i, d in docs.items()}
    avg = sum(map(len, toks.values())) / len(toks)
    out = {}
    for i, t in toks.items():
        tf, s = Counter(t), 0.0
        for q in lexical.query_terms(query):
            df = sum(q in x for x in toks.values())
            if tf[q]:
                s += math.log(1 + (len(docs) - df + 0.5) / (df + 0.5)) * tf[q] * 2.5 / (tf[q] + 1.5 * (0.25 + 0.75 * len(t) / avg))
        if s:
            out[i] = round(s, 6)
    return out


def test_bm25_in_one_pass_and_over_postings(spark):
    docs = {1: "def renew_session(key): return makeToken(key)", 2: "def bill(card, sum): charge the card twice", 3: "the readme of the tool", 4: "", 5: "makeToken makeToken Token"}
    df = spark.createDataFrame(list(docs.items()), "id long, body string")
    for q in ("makeToken", "charge the card", "token token the", "nothing here", ""):
        want = plain_bm25(docs, q) if q else {}
        got = {r.id: round(r.score, 6) for r in lexical.topk(df, "id", F.col("body"), q, 10).collect()}
        assert got == want
        postings = lexical.term_frequencies(df, "id", F.col("body"))
        lengths = lexical.document_lengths(df, "id", F.col("body"))
        items = spark.createDataFrame([(7, q)], "item_id long, query string")
        batch = lexical.batch_topk(postings, lengths, items, "id", 10).collect()
        assert {r.id: round(r.score, 6) for r in batch} == want


def test_rrf(spark):
    lists = [[5, 1, 2], [3, 5, 4]]
    dfs = [spark.createDataFrame([(x, i + 1) for i, x in enumerate(one_list)], "id long, rank int") for one_list in lists]
    got = [(r.id, round(r.score, 9)) for r in fusion.rrf(dfs, "id").orderBy("fused_rank").collect()]
    assert got == [(5, 0.032522475), (3, 0.016393443), (1, 0.016129032), (2, 0.015873016), (4, 0.015873016)]


def test_rerank_native_and_with_a_model(spark):
    rows = [(1, "alpha beta", 1), (2, "beta gamma delta", 2), (3, "gamma delta alpha", 3), (4, "gamma delta", 4)]
    df = spark.createDataFrame(rows, "id long, body string, fused_rank int")
    score = fusion.token_overlap(F.lit("gamma delta"), F.col("body"))
    got = [r.id for r in fusion.rerank(df, "id", score, 3, 2).orderBy("rank").collect()]
    assert got == [2, 3]
    model = lambda q, docs: [len(set(q.split()) & set(d.split())) for d in docs]
    scored = df.withColumn("score", F.lit(0.0))
    got = fusion.rerank_with(scored, "body", "gamma delta", model, 3, 2, "id").orderBy("rank").collect()
    assert [(r.id, r.score) for r in got] == [(2, 2.0), (3, 2.0)]


def test_vectors(spark):
    assert one(spark, V.normalized(F.array(F.lit(3.0), F.lit(4.0)))) == [0.6, 0.8]
    assert one(spark, V.normalized(F.array(F.lit(0.0), F.lit(0.0)))) == [0.0, 0.0]
    import hashlib

    words = "refresh token Refresh_card".lower().replace("_", " ").split()
    want = [0.0] * 256
    for w in words:
        want[int(hashlib.md5(w.encode()).hexdigest(), 16) % 256] += 1
    n = math.sqrt(sum(x * x for x in want))
    assert one(spark, V.hash_embedding(F.lit("refresh token Refresh_card"))) == pytest.approx([x / n for x in want])
    df = spark.createDataFrame([(i, [math.cos(i), math.sin(i)]) for i in range(30)], "id long, v array<double>")
    best = [r.id for r in vectors.topk(df, "id", "v", [1.0, 0.0], 3).collect()]
    assert best == [0, 25, 19]
    q = df.where("id < 2").select(F.col("id").alias("query_id"), F.col("v").alias("vector"))
    got = vectors.batch_topk(df.repartition(5), "id", "v", q, 3).orderBy("query_id", "rank").collect()
    assert [r.id for r in got] == [0, 25, 19, 1, 26, 20]
    assert vectors.batch_topk(df, "id", "v", q.limit(0), 3).count() == 0


WINDOWS = {0: [], 1: [(1, 1)], 65: [(1, 65)], 66: [(1, 66), (66, 66)], 80: [(1, 80), (66, 80)], 121: [(1, 80), (66, 121)], 131: [(1, 80), (66, 131), (131, 131)], 200: [(1, 80), (66, 145), (131, 200), (196, 200)]}


def test_windows(spark):
    df = spark.createDataFrame([(n, [str(i) for i in range(n)]) for n in WINDOWS], "n int, lines array<string>")
    got = {n: [] for n in WINDOWS}
    for r in chunking.windows(df).orderBy("n", "start_line").collect():
        got[r.n].append((r.start_line, r.end_line))
        assert r.text.split("\n") == [str(i) for i in range(r.start_line - 1, r.end_line)]
    assert got == WINDOWS


def test_heuristic_chunks(spark):
    py = "import os\n\ndef one(a):\n    return a\n\nclass Two:\n    def three(self):\n        pass\n"
    js = "export async function go(x) {\n}\nconst f = (a) => a\npublic static int sum(int a) {\n}\n"
    long = "def big():\n" + "    x = 1\n" * 150
    files = [("a.py", "python", py), ("b.js", "javascript", js), ("c.py", "python", long), ("d.txt", "text", "one\ntwo\n"), ("e.txt", "text", " \n\n")]
    rows = chunking.heuristic_chunks(spark.createDataFrame(files, "path string, lang string, content string")).collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r.path, r.start_line)):
        got.setdefault(r.path, []).append((r.start_line, r.end_line, r.symbol))
    assert got["a.py"] == [(1, 2, "<module-preamble>"), (3, 5, "def one"), (6, 6, "class Two"), (7, 8, "def three")]
    assert got["b.js"] == [(1, 2, "function go"), (3, 3, "<block>"), (4, 5, "sum")]
    assert got["c.py"] == [(1, 80, "def big (part)"), (66, 145, "def big (part)"), (131, 151, "def big (part)")]
    assert got["d.txt"] == [(1, 2, "<window>")] and "e.txt" not in got


def test_gate_and_floor(spark):
    report = spark.createDataFrame([("hybrid", 10, 0.5, 0.8, 0.6)], "mode string, n long, recall_at_1 double, recall_at_k double, mrr double")
    floors = spark.createDataFrame([("hybrid", "mrr", 0.6), ("hybrid", "recall_at_k", 0.9), ("vector", "mrr", 0.1)], "mode string, metric string, floor double")
    assert sorted((r.mode, r.metric, r.passed) for r in evaluate.gate(report, floors).collect()) == [("hybrid", "mrr", True), ("hybrid", "recall_at_k", False), ("vector", "mrr", False)]
    assert evaluate.parse_floors("recall@10=0.6, mrr=0.35,") == {"recall@10": 0.6, "mrr": 0.35}
    got = report.select(evaluate.floor(F.lit(0.7), F.lit(82)).alias("a"), evaluate.floor(F.lit(0.7), F.lit(0)).alias("b")).first()
    assert got.a == pytest.approx(0.7 - 2 * math.sqrt(0.21 / 82)) and got.b == 0.7
    runs = spark.createDataFrame([("r", 1, "bge", 0.4), ("r", 0, "none", 0.4), ("s", 0, "e5", 0.2)], "repo string, place int, prefix string, mrr double")
    assert {r.repo: r.prefix for r in evaluate.best_prefix(runs).collect()} == {"r": "none", "s": "e5"}


def test_null_vectors_are_passed_over(spark):
    from lodeworks.operators import vectors

    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 1.0])], "id int, v array<double>")
    assert [r.id for r in vectors.topk(rows, "id", "v", [1.0, 0.1], 3).collect()] == [1, 3]
    asked = spark.createDataFrame([(7, [0.0, 1.0]), (8, None)], "query_id int, vector array<double>")
    assert [(r.query_id, r.id) for r in vectors.batch_topk(rows, "id", "v", asked, 3).orderBy("rank").collect()] == [(7, 3), (7, 1)]


def test_token_counts_are_those_of_the_tokens(spark):
    from lodeworks.functions import text as T

    texts = ["parseHTTPResponse of the HTTP 42 ab12 x_y parse", "", "the THE The tHe", "K\u212a \x01the\x01 aB\x01", "no such thing"]
    terms = ["the", "http", "parse", "12", "b", "42", "parsehttpresponse"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string")
    got = rows.select("id", T.tokenize(F.col("t")).alias("tokens"), T.token_counts(F.col("t"), terms).alias("c")).collect()
    for r in got:
        assert r.c["dl"] == len(r.tokens) and [r.c[f"t{i}"] for i in range(len(terms))] == [r.tokens.count(x) for x in terms], texts[r.id]


def test_equal_scores_are_ordered_by_key(spark):
    """Scores that differ in their last digits only tie, on both sides of a task's cut."""
    rows = [(i, "door key " + " ".join(f"w{(i * 7 + j) % 5}" for j in range(6))) for i in range(40)]
    docs = spark.createDataFrame(rows, "chunk_id long, text string").repartition(7)
    assert [r.chunk_id for r in lexical.topk(docs, "chunk_id", F.col("text"), "door key", 5).collect()] == [0, 1, 2, 3, 4]
    near = spark.createDataFrame([(i, [1.0, (7 - i) * 1e-11]) for i in range(8)], "vec_id long, v array<double>").coalesce(1)
    asked = spark.createDataFrame([(1, [0.7, 0.7])], "query_id long, vector array<double>")
    assert [r.vec_id for r in vectors.batch_topk(near, "vec_id", "v", asked, 3).orderBy("rank").collect()] == [0, 1, 2]
    assert [r.vec_id for r in vectors.topk(near, "vec_id", "v", [0.7, 0.7], 3).collect()] == [0, 1, 2]


def test_posting_blocks_are_passed_over(spark):
    """20,000 texts with a common term, a few with a rare one: same ids and scores, and few blocks of the common term are opened."""
    rows = spark.range(20_000).select(
        F.xxhash64("id").alias("chunk_id"),
        F.concat(F.lit("common "), F.when(F.col("id") % 1000 == 7, "rare ").otherwise(""), F.expr("repeat('pad ', int(id % 5))")).alias("body"),
    )
    postings = lexical.inverted(rows, "chunk_id", F.col("body"))
    lengths = lexical.lengths_of(postings, rows, "chunk_id")
    blocks = lexical.blocked(postings.join(lengths, "chunk_id"), "chunk_id", lexical.cell_bits(20_000)).cache()
    assert blocks.agg(F.max("n")).first()[0] < 2 * lexical.CELL
    dfs = {r.term: r.df for r in postings.groupBy("term").agg(F.count("*").alias("df")).collect()}
    avg = lengths.agg(F.avg("dl")).first()[0]
    for query in ("common rare", "rare rare common nothing", "common", "pad common", "absent"):
        found, read = lexical.blocks_topk(blocks, dfs, 20_000, avg, "chunk_id", query, 10, ["cell"])
        want = lexical.topk(rows, "chunk_id", F.col("body"), query, 10)
        assert [(r.chunk_id, round(r.score, 8)) for r in found.collect()] == [(r.chunk_id, round(r.score, 8)) for r in want.collect()], query
        if query == "common rare":
            assert read.where("term = 'common'").agg(F.sum("n")).first()[0] < 20_000 / 3
            assert read.agg(F.sum("n")).first()[0] < dfs["common"]


def test_pieces_of_a_file_are_cut_within_its_row(spark):
    """No row holds a whole file's lines beside one of its blocks: of 300 definitions, rows carry what they are cut to."""
    body = "".join(f"function f{i}(x) {{\n  step;\n}}\n" for i in range(300))
    found = chunking.heuristic_chunks(spark.createDataFrame([("a.php", "php", "<?php\n" + body), ("b.php", "php", None), ("c.php", "php", " \n")], "path string, lang string, content string"))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate") == 1 and "Union" not in plan
    rows = sorted((r.start_line, r.end_line, r.symbol, r.text) for r in found.collect())
    assert rows[0] == (1, 1, "<module-preamble>", "<?php")
    assert rows[1:] == [(3 * i + 2, 3 * i + 4, f"function f{i}", f"function f{i}(x) {{\n  step;\n}}") for i in range(300)]


def test_blocks_straight_from_texts_are_those_of_postings(spark):
    rng = random.Random(9)
    texts = [(i, " ".join(f"w{rng.randrange(40)} camelCase{rng.randrange(3)}" for _ in range(rng.randrange(30)))) for i in range(600)] + [(600, "")]
    rows = spark.createDataFrame(texts, "chunk_id long, body string").repartition(4)
    bits = lexical.cell_bits(len(texts))
    postings = lexical.inverted(rows, "chunk_id", F.col("body"))
    lengths = lexical.lengths_of(postings, rows, "chunk_id")
    want = lexical.blocked(postings.join(lengths, "chunk_id"), "chunk_id", bits)
    got = lexical.blocked_texts(rows, "chunk_id", F.col("body"), bits)
    assert got.columns == want.columns and got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty() and got.count() > 40
    # One shuffle by key, of texts.
    assert got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("Exchange hashpartitioning") == 1
    tokens, dfs = lexical.statistics(got, ["w1", "camelcase0", "none"])
    assert tokens == lengths.agg(F.sum("dl")).first()[0] and dfs == {t: postings.where(F.col("term") == t).count() for t in ("w1", "camelcase0")}


def test_stages_of_all_modes_score_the_chunks_once(spark, monkeypatch):
    rng = random.Random(10)
    rows = [(i, f"a/{i}", "f", " ".join(f"w{rng.randrange(30)}" for _ in range(20))) for i in range(60)]
    chunks = spark.createDataFrame(rows, "chunk_id long, path string, symbol string, text string").withColumn("embedding", V.hash_embedding(F.col("text")))
    vector = list(spark.range(1).select(V.hash_embedding(F.lit("w1 w2"))).first()[0])
    listed = lambda df: sorted((r.fused_rank, r.chunk_id) for r in df.collect())
    want = {mode: listed(retrieve.first_stage(chunks, "w1 w2", vector, mode, 10)) for mode in retrieve.MODES}
    seen = []
    for module in (lexical, vectors):
        monkeypatch.setattr(module, "topk", lambda *a, _keep=module.topk, _name=module.__name__: seen.append(_name) or _keep(*a))
    found = retrieve.first_stages(chunks, "w1 w2", vector, 10)
    assert {mode: listed(df) for mode, df in found.items()} == want and len(seen) == 2
