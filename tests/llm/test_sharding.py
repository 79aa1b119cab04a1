import zlib
from collections import Counter

from lodeworks.llm import sharding


def test_law_slots_and_mixture(odd, odd_documents):
    rows = sharding.interleave(odd, shards=5).collect()
    assert len(rows) == len(odd_documents)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter(
        (i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in odd_documents
    )
    counts = Counter(r.shard for r in rows)
    assert set(counts) == set(range(5)) and max(counts.values()) - min(counts.values()) <= 1
    for s, n in counts.items():
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(n))
    assert {(r.law, r.grown_shard) for r in rows} == {("rows", None)}


def test_every_shard_has_the_mixture(spark):
    rows = [(i, "t", "big" if i % 3 else "mid" if i % 2 else "rare") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    shard = {r.doc_id: r.shard for r in sharding.interleave(df).collect()}
    source = {i: s for i, _, s in rows}
    seen = Counter((shard[i], source[i]) for i in source)
    for s, n in Counter(source.values()).items():
        assert all(abs(seen[k, s] - n / 16) <= 1.5 for k in range(16))
    # The order is the definition: fractional ranks of a seeded order within each source.
    import hashlib

    by = {}
    for i, s in sorted(source.items(), key=lambda x: hashlib.md5(f"17:{x[0]}".encode()).hexdigest()):
        by.setdefault(s, []).append(i)
    order = sorted(((2 * r + 1) / (2 * len(ids)), "s" + s, i) for s, ids in by.items() for r, i in enumerate(ids))
    want = {i: at * 16 // 3000 for at, (_, _, i) in enumerate(order)}
    assert shard == want


def test_empty(nothing):
    assert sharding.interleave(nothing).count() == 0
