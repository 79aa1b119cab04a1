import os
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from lodeworks.llm import simhash_wide as wide
from lodeworks.llm.common import read

SCHEMA = "doc_id long, text string, fp string, v int, own string"


def shingles(text, width=5):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split(r"[ \t-\r]+", low) if w]
    return frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))) if words else frozenset()


def similar_pairs(texts, least):
    """All pairs of ids whose different shingle sets have ``least`` in common or more, by an inverted index."""
    sets = {i: shingles(t) for i, t in texts.items()}
    by = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            by[x].append(i)
    shared = Counter()
    for ids in by.values():
        for k, a in enumerate(ids):
            for b in ids[k + 1 :]:
                shared[min(a, b), max(a, b)] += 1
    return {p: n / (len(sets[p[0]]) + len(sets[p[1]]) - n) for p, n in shared.items() if n / (len(sets[p[0]]) + len(sets[p[1]]) - n) >= least}


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "f", 1, "o") for i, t in rows], SCHEMA).repartition(3)


def test_planted_near_copies_go_and_clean_texts_stay(spark):
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows, goes, stays = [], [], []
    for i in range(150):
        words = [rng.choice(vocabulary) for _ in range(rng.choice([60, 200, 500]))]
        rows.append((10 * i, " ".join(words)))
        stays.append(10 * i)
        near = list(words)
        for _ in range(max(1, len(near) // 120)):
            near[rng.randrange(len(near))] = "changed"
        rows.append((10 * i + 1, "  ".join(near).upper()))
        goes.append(10 * i + 1)
        half = words[: len(words) // 2] + [rng.choice(vocabulary) for _ in range(len(words) // 2)]
        rows.append((10 * i + 2, " ".join(half)))
        stays.append(10 * i + 2)
    kept = {r.doc_id for r in wide.keep_one(frame(spark, rows)).collect()}
    assert kept >= set(stays)
    texts = dict(rows)
    pairs = [(i - 1, i) for i in goes if len(shingles(texts[i - 1]) & shingles(texts[i])) >= 0.8 * len(shingles(texts[i - 1]) | shingles(texts[i]))]
    assert len(pairs) > 50 and sum(i not in kept for _, i in pairs) >= 0.9 * len(pairs)


def test_a_crowd_of_near_copies_is_one_group(spark):
    rng = random.Random(7)
    base = [f"w{rng.randrange(500)}" for _ in range(400)]
    rows = []
    for i in range(400):
        words = list(base)
        words[rng.randrange(400)] = f"own{i}"
        rows.append((i, " ".join(words)))
    for dense in (8, 10_000):
        assert [r.doc_id for r in wide.keep_one(frame(spark, rows), dense=dense).collect()] == [0]


def test_a_crowded_key_loses_no_link_whoever_its_leaders_are(spark):
    """Unlike fingerprints under one value of a segment, ten pairs of near ones among them that meet nowhere else."""
    rng = np.random.default_rng(8)
    bits = rng.integers(0, 2, (300, wide.BITS), dtype=np.uint8)
    bits[:, : wide.SEGMENT] = bits[0, : wide.SEGMENT]
    for i in range(10):
        bits[2 * i + 1] = bits[2 * i]
        for s in range(1, wide.SEGMENTS):
            bits[2 * i + 1, wide.SEGMENT * s + rng.permutation(wide.SEGMENT)[:3]] ^= 1
    bits[0, 5] ^= 1
    fp = np.packbits(bits, axis=1, bitorder="little").view("<i8")
    cut = bits[:, : wide.SEGMENT * wide.SEGMENTS].reshape(-1, wide.SEGMENTS, wide.SEGMENT) @ (1 << np.arange(wide.SEGMENT, dtype=np.int64))
    rows = [(i, a.tolist(), b.tolist()) for i, (a, b) in enumerate(zip(fp, cut))]
    vertices = spark.createDataFrame(rows, "v long, fp array<long>, segments array<long>").repartition(3)
    for dense in (8, 10_000):
        assert {(r.src, r.dst) for r in wide.links(vertices, 82, dense).collect()} == {(2 * i, 2 * i + 1) for i in range(10)}


def test_odd_rows(spark, odd, odd_documents, nothing):
    kept = wide.keep_one(odd)
    assert kept.columns == odd.columns and wide.keep_one(nothing).count() == 0 and wide.keep_one(nothing).columns == nothing.columns
    found = kept.collect()
    assert sum(r.doc_id is None for r in found) == sum(i is None for i, *_ in odd_documents)
    blank = [r.doc_id for r in found if r.doc_id is not None and not (r.text or "").strip(" \t\n\x0b")]
    assert len(blank) == 1 and 103 in {r.doc_id for r in found}
    text, other = "one two three four five six", "nothing at all like it, this one stays on"
    rows = [(1, text), (5, text), (5, other), (5, text), (1, text), (6, None), (7, ""), (None, text)]
    kept = wide.keep_one(frame(spark, rows)).collect()
    assert sorted((r.doc_id or -1, r.text) for r in kept if r.text) == [(-1, text), (1, text), (1, text), (5, other)]
    assert [r.doc_id for r in kept if not r.text] == [6]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no driver tables")
def test_recall_and_precision_on_documents(spark):
    docs = read(spark, "/root/testdata/sf0.01", "documents")
    texts = {r.doc_id: r.text for r in docs.collect()}
    kept = {r.doc_id for r in wide.keep_one(docs).collect()}
    pairs = similar_pairs(texts, 0.6)
    near = [p for p, j in pairs.items() if j >= 0.8]
    assert len(near) > 20 and sum(b not in kept for _, b in near) >= 0.9 * len(near)
    linked = {b for _, b in pairs}
    blank = sorted(i for i, t in texts.items() if not shingles(t))[1:]
    assert set(texts) - kept <= linked | set(blank)
