import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from lodeworks.llm import prefix_trie as P

SCHEMA = "conv_id long, turn long, role string, text string, depth int, lcp string"


def brute(rows):
    """The trie by its definition: every prefix of every rebuilt conversation."""
    md5 = lambda r, t: hashlib.md5(f"{len(r)}:{r}{t}".encode()).digest()
    convs = defaultdict(list)
    for c, n, r, t, *_ in rows:
        if c is not None:
            convs[c].append((n is not None, n or 0, md5(r or "", t or ""), (r or "", t or "")))
    own = {c: [x[3] for x in sorted(v, key=lambda x: (x[0], x[1], __import__("base64").b64encode(x[2])))] for c, v in convs.items()}
    full = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        full[c] = own.get(c - c % 5, [])[:h] + v[h:]
    members = defaultdict(list)
    for c, v in full.items():
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
    kids = defaultdict(list)
    for node in members:
        if node:
            kids[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[k] for k in kids[node]) or 1
        saved[node] = sum(saved[k] for k in kids[node]) + ((len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0)
    out = []
    for node, who in members.items():
        ends = ",".join(map(str, sorted(c for c in who if len(full[c]) == len(node))))
        parent = min(members[node[:-1]]) if node else None
        out.append((min(who), len(node), parent, len(who), len(kids[node]), leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return Counter(out)


def check(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = Counter((r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in P.trie(df).collect())
    want = brute(rows)
    assert got == want, (list((got - want).items())[:3], list((want - got).items())[:3])


def made(rng, n, deep=9, kinds=3):
    rows = []
    for c in range(n):
        for t in range(rng.randrange(deep)):
            rows.append((c * rng.choice([1, 1, 3]), t, rng.choice(["user", "assistant"]) if t % 4 == 3 else "user", "é" * rng.randrange(kinds), 1, "x"))
    return rows


@pytest.mark.parametrize(("seed", "block", "run"), [(2, 4, 256), (3, 3, 2), (5, 8, 2)])
def test_random_conversations(spark, monkeypatch, seed, block, run):
    """Small blocks make all levels of block minima work, short runs all levels of names."""
    monkeypatch.setattr(P, "BLOCK", block)
    monkeypatch.setattr(P, "RUN", run)
    rng = random.Random(seed)
    check(spark, made(rng, 60, 9 if seed < 5 else 30))


def test_one_conversation_copies_and_odd_rows(spark, monkeypatch):
    check(spark, [(7, 1, "user", "hi", 1, "x")])
    monkeypatch.setattr(P, "BLOCK", 8)
    rng = random.Random(9)
    copies = [(5 * c, t, "user", f"turn {t}", 1, "x") for c in range(40) for t in range(6)]
    odd = [(None, 1, "user", "no id", 1, "x"), (3, None, None, None, None, None), (3, None, "user", "two nulls", 1, "x"), (3, 2, "user", "", 1, "x"), (3, 2, "user", "", 1, "x")]
    odd += [(4, -5, "user", "x" * 200_000, 1, "x"), ((1 << 62) + 1, 1, "user", "turn 0", 1, "x"), ((1 << 62) + 3, 1, "user", "turn 0", 1, "x"), (-7, 0, "user", "turn 0", 1, "x")]
    rows = copies + odd + made(rng, 30)
    # SQL's remainder: -7 % 5 is -2.
    check(spark, [r for r in rows if r[0] != -7])
    assert P.trie(spark.createDataFrame([], SCHEMA)).count() == 0


def test_one_conversation_holds_most_turns(spark, monkeypatch):
    monkeypatch.setattr(P, "RUN", 16)
    rows = [(c, t, "user", "a" if c != 10 or t != 450 else "b", 1, "x") for c in (0, 10, 20) for t in range(600)] + [(5, t, "user", "a", 1, "x") for t in range(3)]
    check(spark, rows)


def test_stacks_and_minima():
    rng = np.random.default_rng(3)
    v = rng.integers(0, 6, 200)
    want = [max((j for j in range(i) if v[j] < v[i]), default=-1) for i in range(200)]
    assert P._stack(v).tolist() == want
    keys, at, below = np.arange(200) * 3 + 7, rng.integers(0, 700, 300), rng.integers(0, 8, 300)
    side = np.array(["left", "right"], object)[rng.integers(0, 2, 300)]
    for a, b, s, hit in zip(at, below, side, P._sided(keys, v, at, below, side)):
        near = [int(k) for k, x in zip(keys, v) if x < b and (k < a if s == "left" else k > a)]
        assert hit == ((near[-1] if s == "left" else near[0]) if near else None)
    low = rng.integers(0, 200, 300)
    high = np.minimum(199, low + rng.integers(0, 150, 300))
    assert P._minima(v, low, high).tolist() == [v[a : b + 1].min() for a, b in zip(low, high)]
