import random

import pytest

from lodeworks.llm import decontamination as dc


def plain_distance(pattern, text):
    """Least edit distance of the pattern to any substring."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, c in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (p != c)))
        row = new
    return min(row)


def test_myers_against_the_table():
    rng = random.Random(1)
    for _ in range(300):
        p = "".join(rng.choice("abc") for _ in range(rng.randint(1, 90)))
        t = "".join(rng.choice("abc") for _ in range(rng.randint(1, 60)))
        assert min(dc.distances(dc.masks(p), len(p), t)) == min(plain_distance(p, t), len(p))


def edited(rng, text, edits):
    out = list(text)
    for _ in range(edits):
        k, how = rng.randrange(len(out)), rng.randrange(3)
        out[k : k + (how != 0)] = [rng.choice("xyz")] if how < 2 else []
    return "".join(out)


def make(rng):
    words = "the of and erst honing blen tisher ath onre edin lyst thes".split()
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, text(rng.randint(3, 40))) for i in range(25)] + [(90, None), (91, " \n"), (92, "of"), (70, "repeated item of the benchmark"), (70, "repeated item of the benchmark")]
    docs = []
    for d in range(80):
        t = text(rng.randint(5, 150))
        if d % 2:
            item = rng.choice(items[:25])[1]
            piece = edited(rng, item, rng.randrange(int(len(item) * 0.16) + 1)).upper().replace(" ", rng.choice([" ", "\n ", "  "]))
            t = f"{t} {piece} {text(3)}"
        docs.append((d, t))
    return items, docs + [(300, None), (301, ""), (None, "a repeated  ITEM of the benchmark here"), (5, docs[5][1])]


def test_against_brute_force(spark):
    items, docs = make(random.Random(3))
    d = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, item_id string")
    b = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, doc_id int")
    want = []
    for i, t in docs:
        for k, p in items:
            p, n = dc.normal(p), dc.normal(t)
            if p and n and (x := plain_distance(p, n)) <= int(len(p) * dc.ERROR_RATE):
                want.append((i, k, x))
    for block in (dc.BLOCK_CHARS, 400):
        got = dc.contaminated(d, b, block_chars=block).collect()
        assert sorted(((r.doc_id, r.item_id, r.distance) for r in got), key=str) == sorted(want, key=str)
        texts = {}
        for i, t in docs:
            texts.setdefault(i, []).append(dc.normal(t))
        by_id = dict(items)
        for r in got:
            assert r.distance == min(plain_distance(dc.normal(by_id[r.item_id]), t[r.start : r.end]) for t in texts[r.doc_id])
        clean = dc.decontaminated(d, b, block_chars=block)
        assert clean.columns == d.columns
        hit = {(i, k is not None) for i, k, _ in want}
        assert sorted((str(r.doc_id) for r in clean.collect())) == sorted(str(i) for i, _ in docs if (i, True) not in hit)


@pytest.mark.parametrize("docs, items", [(0, 1), (1, 0), (0, 0)])
def test_empty(spark, docs, items):
    d = spark.createDataFrame([(1, "some text of the benchmark")] * docs, "doc_id long, text string")
    b = spark.createDataFrame([(1, "some text of the benchmark")] * items, "item_id long, text string")
    assert dc.contaminated(d, b).count() == 0 and dc.decontaminated(d, b).count() == docs
