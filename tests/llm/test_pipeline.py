import os
import re

import pytest

import corpus_pipeline
from lodeworks.llm import quality
from lodeworks.llm.common import read, release_scratch
from tests.llm.test_decontamination import plain_distance
from tests.llm.test_lines import plain as plain_lines
from tests.llm.test_simhash_wide import shingles, similar_pairs

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables")
def test_stages_against_brute_force(spark):
    docs, columns = read(spark, DATA, "documents"), read(spark, DATA, "documents").columns
    (n1, classify), (n2, dedup), (n3, near), (n4, clean), (n5, pack) = corpus_pipeline.STAGES
    one = classify(spark, docs, DATA)
    verdict = {r.doc_id: r.kept for r in quality.scored(docs, read(spark, DATA, "labels")).collect()}
    first = {r.doc_id: r.text for r in one.collect()}
    assert one.columns == columns and set(first) == {i for i, k in verdict.items() if k} and len(first) > 100
    two = dedup(spark, one, DATA)
    second = {r.doc_id: r.text for r in two.collect()}
    assert two.columns == columns and sorted(second.items(), key=str) == sorted([(i, t) for i, t, *_ in plain_lines(list(first.items()), 10)], key=str)
    assert all(r.n_chars == len(r.text) for r in two.collect())
    three = near(spark, two, DATA)
    stayed, pairs = {r.doc_id for r in three.collect()}, similar_pairs(second, 0.6)
    assert three.columns == columns and stayed <= set(second)
    near = [b for (_, b), j in pairs.items() if j >= 0.8]
    assert sum(b not in stayed for b in near) >= 0.9 * len(near) and near
    blank = sorted(i for i, t in second.items() if not shingles(t))[1:]
    assert set(second) - stayed <= {b for _, b in pairs} | set(blank)
    four = clean(spark, three, DATA)
    third, left = {r.doc_id: r.text for r in three.collect()}, {r.doc_id for r in four.collect()}
    norm = lambda t: " ".join((t or "").lower().split())
    items = [norm(r.text) for r in read(spark, DATA, "benchmark").collect()]
    for i, t in third.items():
        exact = any(p in norm(t) for p in items)
        assert not (exact and i in left)
        if i not in left:
            assert min(plain_distance(p, norm(t)) / len(p) for p in items) <= 0.1
    assert four.columns == columns and len(left) > 50
    rows = pack(spark, four, DATA).collect()
    assert {r.doc_id for r in rows} == left
    whole = corpus_pipeline.run(spark, DATA).collect()
    key = lambda r: (r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
    assert sorted(map(key, whole)) == sorted(map(key, rows))
    release_scratch(spark)


def test_names():
    assert [re.sub(r"\W", "", n.lower())[:6] for n, _ in corpus_pipeline.STAGES] == ["qualit", "linede", "simhas", "benchm", "bestfi"]


@pytest.fixture()
def tables(spark, tmp_path):
    """A folder with few labels and a benchmark with null, empty and repeated items."""
    item = "the quick brown fox jumps over one very lazy dog again and again until evening"
    spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    items = [(1, item), (2, None), (3, ""), (4, item)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path), item


def test_every_stage_on_odd_rows_and_empty_tables(spark, odd, odd_documents, nothing, tables):
    folder, item = tables
    clash = "doc_id long, text string, lang string, source string, n_chars int, kept string, fp int, _own string, h int, _n_lines int, shard string"
    rows = [(i, t, lang, source, 7, "k", 1, "o", 2, 3, "s") for i, t, lang, source, *_ in odd_documents]
    rows += [(5000 + i, f"shared line\nown words number {i} of a text like no other {i * 7919}", "en", "a", None, "k", 1, "o", 2, 3, "s") for i in range(12)]
    rows += [(6000, f"before {item} after", "en", "a", 1, "k", 1, "o", 2, 3, "s"), (6000, "another text under the same id, of its own", "en", "a", 1, "k", 1, "o", 2, 3, "s")]
    docs = spark.createDataFrame(rows, clash).repartition(4)
    empty = spark.createDataFrame([], clash)
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, empty, folder).count() == 0 and stage(spark, empty, folder).columns == docs.columns, name
        out = stage(spark, kept, folder)
        assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes), name
        found = out.collect()
        if name == "line dedup":
            assert len(found) == kept.count() and not any("shared line" in (r.text or "") for r in found)
            assert all(r.n_chars == len(r.text) for r in found)
        if name == "benchmark decontamination":
            assert [r.text for r in found if r.doc_id == 6000] == ["another text under the same id, of its own"]
        assert {r.kept for r in found} <= {"k"} and all(r.shard == "s" for r in found)
        kept = spark.createDataFrame(found, docs.schema)
    last = corpus_pipeline.STAGES[-1][1]
    pieces = last(spark, kept, folder).collect()
    assert len({(r.doc_id, r.ids_crc32) for r in pieces}) >= len({r.doc_id for r in kept.collect()})
    assert last(spark, empty, folder).count() == 0
    release_scratch(spark)
