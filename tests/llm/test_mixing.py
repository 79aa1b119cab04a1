import hashlib
import math
import re
from collections import Counter, defaultdict

from lodeworks.llm import mixing

WORD = re.compile(r"[^ \t-\r]+")


def brute_targets(sizes):
    """Shares by weight, stopped and shared again until none is above."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, stopped = sum(sizes.values()), {}
    while True:
        left = [s for s in names if s not in stopped]
        share = total - sum(stopped.values())
        now = {s: share * weight[s] / sum(weight[x] for x in left) for s in left}
        above = {s: 3 * sizes[s] for s in left if now[s] > 3 * sizes[s]}
        if not above:
            return {s: float(v) for s, v in (stopped | now).items()}
        stopped |= above


def brute(rows):
    """rows(doc_id, text, source, quality): taken words of each, by the definition."""
    size = lambda t: len(WORD.findall(t or ""))
    sizes = Counter()
    for _, t, s, _ in rows:
        sizes[s] += size(t)
    target = brute_targets(sizes)
    by = defaultdict(list)
    for i, t, s, q in rows:
        name = str(i) if i is not None else "none:" + hashlib.md5((t or "").encode()).hexdigest()
        u = (int(hashlib.md5(f"23:{name}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        by[s].append((-math.log(u) / q, size(t), i))
    out = []
    for s, docs in by.items():
        epochs = int(target[s] // sizes[s]) if sizes[s] else 0
        rest, before = target[s] - epochs * sizes[s], 0
        for _, n, i in sorted(docs, key=lambda d: (d[0], d[2] is None, d[2] or 0, d[1])):
            out.append((i, n, sizes[s], round(target[s], 6), n * (epochs + (2 * before + n <= 2 * rest)), s))
            before += n
    return Counter(out)


def found(df):
    rows = df.collect()
    return Counter((r.doc_id, r.size, r.source_size, round(r.target, 6), r.taken, r.source) for r in rows), rows


def test_odd_rows_against_brute_force(odd, odd_documents):
    got, rows = found(mixing.mix(odd))
    assert got == brute([(r[0], r[1], r[3], 1.0) for r in odd_documents])
    assert all(r.taken <= 3 * r.size for r in rows)
    assert found(mixing.mix(odd.repartition(2), cells=3))[0] == got


def test_targets_stop_and_are_shared_again(spark):
    sizes = {"a": 10, "b": 5000, "c": 700, "d": 1, "e": 0, "é": 90, "z": 3000, None: 12}
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(df).collect()}
    want = brute_targets(sizes)
    assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 for s in want)
    assert got["a"] == 30 and got["e"] == 0 and abs(sum(got.values()) - sum(sizes.values())) < 1e-6


def test_weights_order_documents_and_copies_spread(spark):
    rows = [(i, "w " * (i % 9 + 1), "s%d" % (i % 4 // 3), 4.0 if i % 2 else 0.25) for i in range(4000)]
    rows += [(None, "the same words", "s0", None)] * 500
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, _w double")
    weights = spark.createDataFrame([(i, q) for i, _, _, q in rows if i is not None] + [(9999, 3.0), (None, 5.0)], "doc_id long, weight double")
    got, out = found(mixing.mix(df, weights))
    assert got == brute([(i, t, s, q or 1.0) for i, t, s, q in rows])
    of = {}
    for r in out:
        of.setdefault(r.source, []).append(r)
    for part in of.values():
        assert abs(sum(r.taken for r in part) - part[0].target) <= 5
    # s1 has even and odd ids; a fraction of it is taken, and the better documents more often.
    extra = [(r.doc_id % 2, r.taken > r.size * r.epochs) for r in out if r.source == "s0" and r.doc_id is not None]
    share = lambda odd: sum(x for o, x in extra if o == odd) / max(1, sum(o == odd for o, _ in extra))
    assert share(1) > share(0) or not any(x for _, x in extra)


def test_labels_give_weights(spark):
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 1), (2, 1, 0), (3, None, 0), (4, 0, None), (None, 1, 0)], "doc_id long, quality int, toxic int")
    assert {r.doc_id: r.weight for r in mixing.label_weights(labels).collect()} == {1: 2.0, 2: 1.25, 4: 0.5}
    odd = spark.createDataFrame([(0, float("nan")), (1, -1.0), (2, None), (3, 1e9)], "doc_id long, weight double")
    docs = spark.createDataFrame([(i, "a b", "s") for i in range(5)], "doc_id long, text string, source string")
    keys, plain = ({r.doc_id: r.key for r in mixing.mix(docs, w).collect()} for w in (odd, None))
    assert all(abs(keys[i] * (16 if i == 3 else 1) - plain[i]) < 1e-12 for i in range(5))


def test_empty(nothing, spark):
    assert mixing.mix(nothing).count() == 0
    blank = spark.createDataFrame([(1, None, None), (2, " ", "s")], "doc_id long, text string, source string")
    assert {(r.doc_id, r.target, r.taken) for r in mixing.mix(blank).collect()} == {(1, 0.0, 0), (2, 0.0, 0)}
