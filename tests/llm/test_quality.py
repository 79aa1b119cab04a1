import os
import random

import numpy as np
import pytest

from lodeworks.llm import quality

DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept string"
LABELS = "doc_id long, quality int, toxic int"


def corpus(n, seed):
    rng = random.Random(seed)
    vocabulary = [f"w{rng.randrange(10**6)}" for _ in range(300)]
    rows, labels = [], []
    for i in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(20, 120))]
        bad, toxic = rng.random() < 0.25, rng.random() < 0.15
        if bad:
            words = [w + "$$$" for w in words]
        if toxic:
            words[rng.randrange(len(words))] = rng.choice(["Vile,", "vile", "scoundrel."])
        source = "farm" if bad and rng.random() < 0.8 else rng.choice(["news", "blog"])
        rows.append((i, " ".join(words), "en", source, len(words), "x"))
        labels.append((i, int(not bad), int(toxic)))
    return rows, labels


def test_held_out_accuracy_and_both_views(spark):
    rows, labels = corpus(900, 1)
    docs = spark.createDataFrame(rows, DOCS)
    seen = spark.createDataFrame(labels[:500], LABELS)
    got = {r.doc_id: r for r in quality.scored(docs, seen).collect()}
    truth = {i: bool(q) and not t for i, q, t in labels}
    held = range(500, 900)
    assert np.mean([got[i].kept == truth[i] for i in held]) >= 0.95
    assert np.mean([got[i].kept for i in held if truth[i]]) >= 0.97
    assert np.mean([got[i].content_score for i in held if truth[i]]) > 0.8
    farm = [got[i].metadata_score for i in held if rows[i][3] == "farm"]
    assert np.mean(farm) < np.mean([got[i].metadata_score for i in held if rows[i][3] != "farm"])
    kept = quality.good_only(docs, seen)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.kept}


def test_odd_rows(spark, odd, odd_documents, nothing):
    labels = spark.createDataFrame([(i, i % 2, None) for i in range(60)] + [(None, 1, 1), (3, None, None), (4, 1, 0)], LABELS)
    rows = quality.scored(odd, labels).collect()
    assert len(rows) == len(odd_documents) and all(0 <= r.quality_score <= 1 for r in rows)
    assert quality.scored(odd.drop("lang", "source", "n_chars"), labels).count() == len(odd_documents)
    none = spark.createDataFrame([], LABELS)
    assert all(r.kept and r.quality_score is None for r in quality.scored(odd, none).collect())
    assert quality.good_only(odd, none).count() == len(odd_documents)
    assert quality.scored(nothing, labels).count() == 0


def test_logistic_regression_finds_the_optimum():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 3))
    y = (x @ [1.5, -2.0, 0.0] + 0.3 + rng.logistic(size=400) > 0).astype(float)
    w, b = quality.fit_logistic(x, y, np.ones(400), 1e-3, 2000)
    p = 1 / (1 + np.exp(-(x @ w + b)))
    assert np.abs(x.T @ (p - y) / 400 + 1e-3 * w).max() < 1e-4 and abs((p - y).mean()) < 1e-4


def plain_best(docs, seen, model, taken, most):
    """The surest of all unlabelled rows, one by one."""
    import pyarrow as pa

    rows = {}
    for i, text, lang, source, n, _ in docs:
        if i not in seen:
            one = quality.encoded(pa.RecordBatch.from_pylist([{"text": text.encode(), "lang": lang, "source": source, "n_chars": n}]), 0, model)
            rows[one["sig"][0].as_py()] = one
    chosen = {}
    for v in (0, 1):
        for label in (1.0, 0.0):
            ranked = []
            for sig, one in rows.items():
                p = round(float(model.sure(quality.Rows.of(one), v)[0]), 9)
                sure = p if label else round(1 - p, 9)
                if sig not in taken and sure >= quality.CONFIDENT:
                    ranked.append((-sure, sig))
            for sure, sig in sorted(ranked)[:most]:
                if sig not in chosen or (sure, v) < chosen[sig][:2]:
                    chosen[sig] = (sure, v, label)
    made = [{**rows[s].to_pylist()[0], "view": v, "label": label, "sure": -sure} for s, (sure, v, label) in chosen.items()]
    return pa.Table.from_pylist(made, pa.schema([*quality._FEATURES.items(), ("view", pa.int32()), ("label", pa.float64()), ("sure", pa.float64())]))


def test_rounds_against_brute_force(spark, monkeypatch):
    rows, labels = corpus(700, 5)
    rows += [(9000 + i, rows[600][1], "en", rows[600][3], rows[600][4], "copy") for i in range(40)]  # copies count once
    docs, seen = spark.createDataFrame(rows, DOCS).repartition(6), spark.createDataFrame(labels[:350], LABELS)
    real, args = quality.Model.train, []
    monkeypatch.setattr(quality.Model, "train", lambda self, r, y, best, rounds=3: args.append((r, y)) or real(self, r, y, best, rounds))
    model, features = quality.co_trained(quality._with_columns(docs), seen, taught=25)
    x, y = args[0]
    plain = real(quality.Model(model.columns, model.names), x, y, lambda m, taken: plain_best(rows, set(range(350)), m, taken, 25))
    assert sorted(plain.exchanged) == sorted(model.exchanged) and {v for _, v, *_ in model.exchanged} == {0, 1}
    assert len({s for _, _, s, *_ in model.exchanged}) == len(model.exchanged)
    for v in (0, 1):
        assert np.allclose(plain.views[v].w, model.views[v].w)
    assert model.report["held out, after"] >= 0.9 and model.both[0] > 0
    # Scores of all rows by dense features.
    table = features.toArrow()
    scores = model.score(quality.Rows.of(table))
    for v in (0, 1):
        view, (a, b) = model.views[v], model.scaled[v]
        dense = quality.Rows.of(table).dense(v, len((model.columns, model.names)[v]))
        assert np.allclose(scores[v], quality.sigmoid(a * ((dense - view.mean) / view.scale @ view.w + view.b) + b))


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no driver tables")
def test_both_views_give_and_take_on_the_drivers_tables(spark):
    read = lambda t: spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet")
    model, _ = quality.co_trained(quality._with_columns(read("documents")), read("labels"))
    assert {(v, kept) for _, v, _, _, kept in model.exchanged} >= {(0, True), (1, True)}
    assert min(model.both) > 0 and model.report["held out, after"] >= 0.99
