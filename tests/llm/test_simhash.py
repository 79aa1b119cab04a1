import itertools
import os
import random

import pytest
import xxhash

from lodeworks.llm import simhash
from lodeworks.llm.common import connected_components

SCHEMA = "doc_id long, text string, fp string, node int"


def plain_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", low) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def plain_components(ids, fps):
    root = {i: i for i in range(len(ids))}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(ids)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= 3:
            root[find(i)] = find(j)
    low = {}
    for i, d in enumerate(ids):
        if d is not None:
            low[find(i)] = min(d, low.get(find(i), d))
    return [low.get(find(i)) for i in range(len(ids))]


def check(spark, rows, **options):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA)
    got = sorted(map(tuple, simhash.near_duplicates(df, **options).collect()), key=str)
    fps = [plain_fingerprint(t) for _, t in rows]
    comps = plain_components([i for i, _ in rows], fps)
    want = sorted(((i, f - (1 << 64) if f >> 63 else f, c) for (i, _), f, c in zip(rows, fps, comps)), key=str)
    assert got == want


def words(rng, n):
    return [rng.choice("alpha beta gamma delta Éta of the ÀB x1 Zed".split()) + str(rng.randrange(30)) for _ in range(n)]


def test_against_brute_force(spark):
    rng, rows = random.Random(3), []
    for i in range(60):
        base = words(rng, rng.choice([0, 1, 2, 3, 40, 300]))
        rows.append((2 * i, " ".join(base)))
        if base:
            near = list(base)
            near[rng.randrange(len(near))] = "other"
            rows.append((2 * i + 1, rng.choice([" ", "\n", "\t "]).join(near)))
    rows += [(500, None), (501, ""), (502, " \n\x0b"), (None, None), (None, "only one of these"), (7, rows[3][1]), (7, rows[3][1])]
    rows.append((900, " ".join(words(rng, 70_000))))
    check(spark, rows)


def test_empty_table(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_links_connect_what_brute_force_connects(spark):
    rng = random.Random(5)
    fps = {rng.getrandbits(64) for _ in range(50)}
    for f in list(fps)[:20]:
        fps |= {f ^ sum(1 << b for b in rng.sample(range(64), k)) for k in (1, 2, 3, 3, 4)}
    hub = rng.getrandbits(64)
    fps |= {hub ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 5))) for _ in range(150)}
    fps |= {hub ^ x for x in rng.sample(range(1 << 12), 100)}
    fps = sorted(fps)
    want = {frozenset((a, b)) for a, b in itertools.combinations(fps, 2) if (a ^ b).bit_count() <= 3}
    df = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    for dense in (4, 64, 10_000):
        got = {frozenset((r.src % (1 << 64), r.dst % (1 << 64))) for r in simhash.links(df, dense=dense).collect()}
        assert got == want, dense


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)]
    found = dict(map(tuple, connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()))
    assert found == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)}


def test_xxh64_as_sql():
    import duckdb

    from lodeworks.llm.hash_sql import xxh64

    rng = random.Random(9)
    texts = ["".join(rng.choice("ab cé漢\n") for _ in range(n)) for n in [*range(0, 40), 63, 64, 65, 96, 200]]
    held = duckdb.connect()
    held.execute("CREATE TABLE t (s VARCHAR)")
    held.executemany("INSERT INTO t VALUES (?)", [[x] for x in texts])
    for seed in (0, 42):
        got = dict(held.execute(f"WITH {xxh64('t', 's', seed)} SELECT s, h FROM hashed").fetchall())
        assert got == {x: xxhash.xxh64_intdigest(x.encode(), seed=seed) for x in texts}


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no driver tables")
def test_query_against_sql(spark):
    import duckdb

    from lodeworks.llm.queries import OP4_SQL, op4_simhash_near_dedup

    held = duckdb.connect()
    held.execute("CREATE VIEW documents AS SELECT * FROM read_parquet('/root/testdata/sf0.001/documents.parquet')")
    want = held.execute(f"SELECT doc_id, fingerprint, component_id FROM ({OP4_SQL})").fetchall()
    got = op4_simhash_near_dedup(spark, "/root/testdata/sf0.001").select("doc_id", "fingerprint", "component_id").collect()
    assert sorted(map(tuple, got)) == sorted(want)
