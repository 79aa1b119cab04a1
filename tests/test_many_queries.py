import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodeworks.functions import vectors as V
from lodeworks.operators import best, lexical, vectors


def shuffled_rows(spark, run):
    """What ``run`` returns, and how many rows its stages wrote to shuffles."""
    gateway = spark.sparkContext._gateway

    def stages():
        store = spark.sparkContext._jsc.sc().statusStore()
        found = store.stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), None)
        return {found.apply(i).stageId(): found.apply(i).shuffleWriteRecords() for i in range(found.size())}

    before = stages()
    out = run()
    return out, sum(n for i, n in stages().items() if i not in before)


def plain_bm25(docs, asked):
    toks = {i: lexical.query_terms(t) for i, t in docs.items()}
    avg, df, out = sum(map(len, toks.values())) / len(toks), Counter(x for t in toks.values() for x in set(t)), {}
    for j, query in asked.items():
        scores = {}
        for i, t in toks.items():
            for q in set(lexical.query_terms(query)) & set(t):
                w = math.log(1 + (len(docs) - df[q] + 0.5) / (df[q] + 0.5)) * t.count(q) * 2.5 / (t.count(q) + 1.5 * (0.25 + 0.75 * len(t) / avg))
                scores[i] = scores.get(i, 0.0) + lexical.query_terms(query).count(q) * w
        out[j] = sorted(scores, key=lambda i: (-round(scores[i], 9), i))
    return out


def test_pairs_of_queries_and_texts_are_not_rows(spark):
    """A word that all texts and all queries have makes no row a pair, in either form of the lexical search."""
    docs = {i: f"the door{i % 40} and key{i % 7} the " + "x " * (i % 11) for i in range(600)}
    asked = {j: f"the key{j % 7} door{j}" for j in range(100)} | {100: "", 101: "nosuchword", 102: "the the key1 key1 and andThe"}
    d = spark.createDataFrame(list(docs.items()), "id long, body string").repartition(3)
    q = spark.createDataFrame(list(asked.items()), "item_id int, query string")
    want = {j: ids[:5] for j, ids in plain_bm25(docs, asked).items() if ids}
    assert len(want) == 101
    postings, lengths = lexical.term_frequencies(d, "id", F.col("body")), lexical.document_lengths(d, "id", F.col("body"))
    from_postings, rows = shuffled_rows(spark, lambda: lexical.batch_topk(postings, lengths, q, "id", 5).collect())
    assert rows < 600 * 100 / 2
    texts = lexical.counted(d, "id", F.col("body")).localCheckpoint()
    from_texts = lexical.counted_topk(texts, q, "id", 5).collect()
    for found in (from_postings, from_texts):
        got = {}
        for r in sorted(found, key=lambda r: (r.item_id, r.rank)):
            got.setdefault(r.item_id, []).append(r.id)
        assert got == want
    assert lexical.counted_topk(texts, q.limit(0), "id", 5).count() == 0
    assert lexical.counted_topk(texts.limit(0), q, "id", 5).count() == 0


def test_blocks_of_queries_give_the_same(spark, monkeypatch):
    docs = [(i, " ".join(f"w{(i * j) % 13}" for j in range(1, 9))) for i in range(50)]
    d = spark.createDataFrame(docs, "id long, body string")
    q = spark.createDataFrame([(j, f"w{j % 13} w{j % 5}") for j in range(30)], "item_id long, query string")
    texts = lexical.counted(d, "id", F.col("body")).localCheckpoint()
    whole = sorted(lexical.counted_topk(texts, q, "id", 4).collect())
    e = spark.createDataFrame([(i, [math.sin(i), math.cos(i)]) for i in range(50)], "id long, v array<double>")
    asked = e.select(F.col("id").alias("query_id"), F.col("v").alias("vector"))
    near = sorted(vectors.batch_topk(e, "id", "v", asked, 4).collect())
    monkeypatch.setattr(lexical, "BLOCK", 7)
    monkeypatch.setattr(vectors, "BLOCK", 7)
    assert sorted(lexical.counted_topk(texts, q, "id", 4).collect()) == whole
    assert sorted(vectors.batch_topk(e, "id", "v", asked, 4).collect()) == near and len(near) == 200


def test_tokens_are_counted_in_their_row(spark):
    texts = ["parseHTTPResponse of the HTTP 42 ab12 x_y parse", "", None, "the THE The tHe", "  ", "é ñ"] * 100
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, body string").repartition(3)
    got = {r.id: (r.dl, sorted(zip(r.terms, r.tfs))) for r in lexical.counted(d, "id", F.col("body")).collect()}
    for i, t in enumerate(texts):
        words = lexical.query_terms(t or "")
        assert got[i] == (None if t is None else len(words), sorted((w, words.count(w)) for w in set(words)))


@pytest.mark.parametrize("kind", ["long", "string"])
def test_best_of_blocks(kind):
    rng = np.random.default_rng(5)
    for trial in range(20):
        n, m, k, step = 5, int(rng.integers(1, 400)), int(rng.integers(1, 20)), int(rng.integers(1, 150))
        scores = np.round(rng.normal(size=(n, m)), int(rng.integers(0, 3))) + rng.choice([0, 1e-11], size=(n, m))
        if trial % 4 == 0:
            for odd in (np.nan, np.inf, -np.inf):
                scores[rng.random((n, m)) < 0.1] = odd
        keys = rng.permutation(m)
        if kind == "string":
            keys = np.array([f"k{x:04d}" for x in keys], object)
        found = best.Best(n, k)
        for at in range(0, m, step):
            for first in range(0, n, 2):
                found.add(first, scores[first : first + 2, at : at + step], keys[at : at + step])
            if trial % 2:
                found._settle()
        got = {}
        for b in found.batches(best.pa.array(range(n)), ["q", "k", "s", "p"]):
            for q, key in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                got.setdefault(q, []).append(key)
        place = np.round(scores, 9)
        for q in range(n):
            order = sorted(range(m), key=lambda i: (not math.isnan(place[q, i]), 0 if math.isnan(place[q, i]) else -place[q, i], keys[i]))
            assert got[q] == [keys[i] for i in order[:k]]


def test_words_are_hashed_as_the_column_does(spark):
    texts = ["refresh token Refresh_card", "", None, " \n ", "É é_É x ÇA", "a b " * 500, "_"] * 50
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, t string").repartition(3)
    got = V.hash_embeddings(d, "id", F.col("t"), "v").join(d, "id").select("v", V.hash_embedding(F.col("t")).alias("w")).collect()
    assert len(got) == len(texts) and all(r.v == r.w for r in got)
