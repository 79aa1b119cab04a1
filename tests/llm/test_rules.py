import os
import re
from collections import Counter

import pytest

from lodeworks.llm import rules
from lodeworks.llm.queries import OP8_BASE_SQL, op8_quality_rules

DATA = "/root/testdata/sf0.01"

LABELS = "doc_id long, quality int, toxic int, text string"


def plain(text):
    t = text or ""
    words = [x for x in re.split("[\x20\x09-\x0d]+", t) if x]
    c, covered = Counter(zip(words, words[1:], words[2:])), set()
    for i in range(len(words) - 2):
        if c[tuple(words[i : i + 3])] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in t.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    n, rep = len(words), len(covered)
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), rep, n < 50 or 100 * rep > 50 * n)


def test_statistics_against_brute_force(spark, odd, odd_documents):
    more = [(500, "a a a a a a a"), (501, "a b c a b c x"), (502, "a b c d e f a b c q d e f"), (503, " ".join(["w"] * 5000)), (504, "x y\nx y\n\nx y "), (505, "ab c x abc x a bc x")]
    docs = odd.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    none = spark.createDataFrame([], LABELS)
    got = Counter(tuple(r) for r in rules.judge(docs, none).collect())
    want = Counter((i, *s, not s[-1]) for i, t, *_ in [*odd_documents, *[(i, t) for i, t in more]] for s in [plain(t)])
    assert got == want


def test_learned_list_separates_and_reads_well(spark):
    good = [(i, " ".join(f"word{i:03}x{k:02}" for k in range(80)), 1) for i in range(150)]
    loud = [(200 + i, " ".join(f"WORD{i:03}x{k:02}!!" for k in range(80)), 0) for i in range(60)]
    marked = [(300 + i, " ".join(f"word{i:03}x{k:02}" + "##" * (k % 2) for k in range(80)), 0) for i in range(60)]
    rows = good + loud + marked
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q, 0, None) for i, _, q in rows if i % 3] + [(9999, 1, 0, None), (None, 0, 0, None), (1, None, 0, None)], LABELS)
    learned = rules.learn(docs, labels)
    assert 1 <= len(learned.rules) <= 4 and "reject if" in str(learned)
    kept = {r.doc_id: r.kept for r in rules.judge(docs, labels).collect()}
    wrong = [i for i, _, q in rows if kept[i] != bool(q)]
    assert len(wrong) <= 0.02 * len(rows), (str(learned), wrong)
    assert "Python" not in rules.judge(docs, labels, learned=learned)._jdf.queryExecution().toString()


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables")
def test_query_against_sql_and_the_list_read_plainly(spark):
    import duckdb

    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    rows = op8_quality_rules(spark, DATA).collect()
    held = duckdb.connect()
    held.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{DATA}/documents.parquet')")
    found = held.execute(OP8_BASE_SQL)
    at = [[d[0] for d in found.description].index(n) for n in names]
    assert sorted(tuple(r[n] for n in names) for r in rows) == sorted(tuple(r[i] for i in at) for r in found.fetchall())
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    learned = rules.learn(docs, labels)
    features = [f"f_{k}" for k in rules.FEATURES]
    stats = {r.doc_id: r.asDict() for r in rules.with_features(rules.statistics(docs)).select("doc_id", *features).collect()}
    holds = lambda r, c: r[c[0]] <= c[2] if c[1] == "<=" else r[c[0]] > c[2]
    for r in rows:
        rejected = any(all(holds(stats[r.doc_id], c) for c in rule) for rule in learned.rules)
        assert r.kept == (not r.base_failed and not rejected)


def test_empty(nothing, spark):
    assert rules.judge(nothing, spark.createDataFrame([], LABELS)).count() == 0
