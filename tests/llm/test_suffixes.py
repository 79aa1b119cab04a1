import os
import random

import numpy as np
import pytest

from lodeworks.llm import suffixes


def test_transform_and_prefixes_against_sorted_suffixes():
    rng = random.Random(1)
    for _ in range(60):
        strings = [bytes(rng.choice(b"abz\x00\xff") for _ in range(rng.randint(0, 14))) for _ in range(rng.randint(1, 12))]
        bwt, lcp = suffixes.column_transform(strings, 99)
        order = sorted((tuple(s[i:]), k, i) for k, s in enumerate(strings) for i in range(len(s) + 1))
        code = {c: j + 1 for j, c in enumerate(sorted({c for s in strings for c in s}))}
        assert bwt.tolist() == [code[strings[k][i - 1]] if i else 0 for _, k, i in order]
        want = [0] + [len(os.path.commonprefix([a[0], b[0]])) for a, b in zip(order, order[1:])]
        assert lcp.tolist() == want


def test_window_lows():
    rng = random.Random(2)
    for _ in range(40):
        n = rng.choice([3, 4, 5])
        strings = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 14))) for _ in range(rng.randint(1, 12))]
        lows = np.array([rng.randint(0, 20) for _ in strings])
        for s, got in zip(strings, suffixes.window_lows(strings, lows, n)):
            assert got.tolist() == [min(x for t, x in zip(strings, lows) if s[i : i + n] in t) for i in range(len(s) - n + 1)]


def plain(rows):
    first, out = {}, []
    texts = sorted(((i, (t or "").encode()) for i, t in rows), key=lambda r: (r[0] is None, 0 if r[0] is None else r[0]))
    for i, x in texts:
        if i is not None:
            for k in range(len(x) - 49):
                first.setdefault(x[k : k + 50], i)
    for i, x in texts:
        gone = bytearray(len(x))
        if i is not None:
            for k in range(len(x) - 49):
                if first[x[k : k + 50]] < i:
                    gone[k : k + 50] = b"\1" * 50
        spans = sum(gone[k] and not (k and gone[k - 1]) for k in range(len(x)))
        out.append((i, len(x), sum(gone), spans, bytes(c for c, g in zip(x, gone) if not g)))
    return sorted(out, key=str)


@pytest.mark.parametrize("crowded", [suffixes.CROWDED, 3])
def test_against_brute_force(spark, odd, odd_documents, nothing, crowded, monkeypatch):
    monkeypatch.setattr(suffixes, "CROWDED", crowded)
    rng = random.Random(3)
    text = lambda n: "".join(rng.choice("abcdé \n") for _ in range(n))
    shared = [text(n) for n in (49, 50, 51, 120, 400)]
    rows = [(i, t) for i, t, *_ in odd_documents]
    for d in range(60):
        parts = [text(rng.randrange(90)) for _ in range(3)]
        rows.append((1000 + d, parts[0] + rng.choice(shared) + parts[1] + rng.choice(shared)[rng.randrange(30) :] + parts[2]))
    rows += [(2000, "ab" * 300), (2001, "x" + "ab" * 200), (2002, "z" * 500), (2003, rows[-4][1]), (1, "other text, same id: " + shared[3]), (None, shared[4])]
    df = spark.createDataFrame([(i, t, "c") for i, t in rows], "doc_id long, text string, low string").repartition(4)
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffixes.remove_repeats(df).collect()]
    assert sorted(got, key=str) == plain(rows)
    assert suffixes.remove_repeats(nothing).count() == 0


@pytest.mark.parametrize("hot_windows", [suffixes.HOT_WINDOWS, 0])
def test_hot_passages_and_ids_of_any_type(spark, monkeypatch, hot_windows):
    """Anchors of very many texts met before the shuffle, windows of very many strings, ids that are strings."""
    for name, value in {"PAIRS": 64, "CROWDED": 3, "HOT_WINDOW": 2, "HOT_WINDOWS": hot_windows}.items():
        monkeypatch.setattr(suffixes, name, value)
    rng = random.Random(6)
    text = lambda n: "".join(rng.choice("abcdefg \n") for _ in range(n))
    hot, warm = text(140), text(70)
    rows = [(f"id{rng.randrange(10**6)}", text(rng.randrange(60)) + hot[rng.randrange(40) :] + text(rng.randrange(60))) for _ in range(80)]
    rows += [(f"no{i}", text(50) + warm + text(30)) for i in range(2)] + [("a", text(200)), ("b", rows[5][1]), (None, hot), ("c", None), ("d", "")]
    df = spark.createDataFrame(rows, "doc_id string, text string").repartition(3)
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffixes.remove_repeats(df).collect()]
    want = plain([(i, t) for i, t in rows if i is not None]) + [(None, len(hot), 0, 0, hot.encode())]
    assert sorted(got, key=str) == sorted(want, key=str) and sum(r[2] for r in got) > 5000


def test_shared_pairs_in_any_pieces():
    rng = random.Random(4)
    for _ in range(50):
        pairs = [(rng.randrange(12), rng.randrange(6)) for _ in range(rng.randrange(60))]
        found, state, at = set(), suffixes.SharedPairs(), 0
        while at < len(pairs):
            step = rng.randint(1, 9)
            part, at = pairs[at : at + step], at + step
            h, d = state.add(np.array([x for x, _ in part]), np.array([y for _, y in part]))
            found |= set(zip(h.tolist(), d.tolist()))
        texts = {}
        for x, y in pairs:
            texts.setdefault(x, set()).add(y)
        assert found == {(x, y) for x, y in pairs if len(texts[x]) > 1}
