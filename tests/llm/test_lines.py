from collections import Counter

import pytest
from pyspark.sql import functions as F

from lodeworks.llm import lines
from lodeworks.llm.common import ordered_buckets, stored
from lodeworks.llm.queries import OP7_SQL

SPACE = " \t\n\x0b\f\r"


def key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(SPACE))


def plain(rows, threshold):
    seen = Counter(k for _, t in rows for k in {key(x) for x in (t or "").split("\n")} if k)
    out = []
    for i, t in rows:
        parts = (t or "").split("\n")
        kept = [x for x in parts if seen[key(x)] < threshold or not key(x)]
        out.append((i, "\n".join(kept), len(parts), len(parts) - len(kept)))
    return sorted(out, key=str)


@pytest.mark.parametrize("broadcast", [lines.BROADCAST_KEYS, 0])
@pytest.mark.parametrize("batches", [1, 3, 9])
def test_against_brute_force(spark, odd, odd_documents, broadcast, batches):
    rows = [(i, t) for i, t, *_ in odd_documents]
    extra = [(1000 + i, f"\tShared LINE é \r\nown {i}\n\nshared line É\n shared line é") for i in range(12)]
    df = odd.select("doc_id", "text", "h").unionByName(spark.createDataFrame([(i, t, "x") for i, t in extra], "doc_id long, text string, h string"))
    got = lines.drop_frequent_lines(df, threshold=6, batches=batches, fanout=2, broadcast_keys=broadcast)
    assert got.columns == ["doc_id", "text", "h", "_n_lines", "_n_dropped"]
    found = sorted(((r.doc_id, r.text, r._n_lines, r._n_dropped) for r in got.collect()), key=str)
    assert found == plain(rows + extra, 6)
    assert any(n for *_, n in found)


def test_settled_hashes_are_left_out_and_runs_stay_sorted(spark):
    runs = lines.LineRuns(spark, threshold=3, fanout=2)
    make = lambda *rows: spark.createDataFrame([(bytes([k]), n) for k, n in rows], "h binary, n long")
    runs.add(make((1, 3), (2, 1)))
    runs.add(make((1, 5), (2, 1), (3, 1)))
    assert [len(x) for x in runs.levels] == [0, 1]
    merged = runs.levels[1][0].collect()
    assert {bytes(r.h)[0]: r.n for r in merged} == {1: 3, 2: 2, 3: 1}  # the settled 1 was not counted again
    runs.add(make((2, 1)))
    assert sorted(bytes(r.h)[0] for r in runs.frequent().collect()) == [1, 2]
    parts = merged and runs.levels[1][0].withColumn("p", F.spark_partition_id()).collect()
    for p in {r.p for r in parts}:
        hs = [bytes(r.h) for r in parts if r.p == p]
        assert hs == sorted(hs)


def test_batches_meet_runs_as_they_lie_through_three_levels(spark):
    runs, want = lines.LineRuns(spark, threshold=5, fanout=2), Counter()
    make = lambda rows: spark.createDataFrame([(b"%03d" % k, n) for k, n in rows], "h binary, n long")
    for batch in range(9):
        rows = [(k, 1 + (k + batch) % 2) for k in range(batch, 120, 1 + batch % 3)]
        for k, n in rows:
            want[k] += n
        runs.add(make(rows))
    assert [len(x) for x in runs.levels] == [1, 0, 0, 1] and runs.compactions == 7
    with ordered_buckets(spark):
        plan = runs.unsettled(stored(make([(1, 1)]), "batch"))._jdf.queryExecution().executedPlan().toString()
        # The batch alone is dealt out and sorted; both runs are read bucket by bucket, as sorted.
        assert plan.count("SortMergeJoin") == 2 and plan.count("Exchange") == 1 and plan.count("Sort [") == 1 and plan.count("Bucketed: true") == 2
        merged = runs.frequent()
        plan = merged._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan and "Sort [" not in plan
        assert {int(bytes(r.h)) for r in merged.collect()} == {k for k, n in want.items() if n >= 5}
    runs.drop()


def test_rows_of_one_doc_id_are_one_document(spark):
    import duckdb

    rows = [(7, "same\nown")] * 10 + [(None, f"bare\nx{i}") for i in range(10)] + [(100 + i, f"many\nown {i}") for i in range(10)] + [(100, "many\nmany\nsame")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r.doc_id, r.text, r._n_lines, r._n_dropped) for r in lines.drop_frequent_lines(docs).collect()]
    assert sorted(got, key=str) == sorted(
        [(7, "same\nown", 2, 0)] * 10 + [(None, f"x{i}", 2, 1) for i in range(10)] + [(100 + i, f"own {i}", 2, 1) for i in range(10)] + [(100, "same", 3, 2)], key=str
    )
    held = duckdb.connect()
    held.register("documents", docs.where("doc_id is not null").toArrow())
    plainly = {r[0]: r[1:3] for r in held.execute(OP7_SQL).fetchall()}
    total = {}
    for i, _, n, lost in got:
        if i is not None:
            total[i] = (total.get(i, (0, 0))[0] + n, total.get(i, (0, 0))[1] + lost)
    assert total == plainly


@pytest.mark.parametrize("broadcast", [lines.BROADCAST_KEYS, 0])
def test_clashing_columns(spark, broadcast):
    rows = [(i, f"same\nown {i}", i, "g", 7, 8) for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _id long, _gone string, _n_lines int, _N_dropped int")
    got = lines.drop_frequent_lines(df, broadcast_keys=broadcast)
    assert got.columns == [*df.columns, "_n_lines_", "_n_dropped_"]
    assert sorted(map(tuple, got.collect())) == [(i, f"own {i}", i, "g", 7, 8, 2, 1) for i in range(12)]


def test_ten_thousand_rows_without_an_id_are_many_groups(spark):
    """On the join path a text is the key, so no array holds the hashes of all rows without a doc_id."""
    rows = [(None, f"line {i % 1500}\nown {i}") for i in range(10_000)] + [(5, f"line {i}\nfive {i}") for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    out = lines.drop_frequent_lines(docs, threshold=6, broadcast_keys=0)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "doc_id" not in plan.split("Join LeftOuter")[1].split("\n")[0]
    found = out.collect()
    assert len(found) == len(rows) and all(r.text == r.text.split("\n")[-1] and r._n_dropped == 1 for r in found)


@pytest.mark.parametrize("bucket_rows", [5, lines.BUCKET_ROWS])
def test_buckets_follow_the_input(spark, bucket_rows):
    docs = spark.createDataFrame([(i, f"common {i % 4}\nown {i}") for i in range(60)], "doc_id long, text string")
    runs = lines.LineRuns(spark, 10, rows=64, bucket_rows=bucket_rows)
    assert runs.buckets == (13 if bucket_rows == 5 else 4)
    assert lines.frequent_lines(docs, bucket_rows=bucket_rows).count() == 4


def test_a_failure_leaves_no_runs_behind(spark, monkeypatch):
    def fail(self):
        raise RuntimeError("lost")

    monkeypatch.setattr(lines.LineRuns, "frequent", fail)
    before = {t.name for t in spark.catalog.listTables()}
    with pytest.raises(RuntimeError, match="lost"):
        lines.frequent_lines(spark.createDataFrame([(1, "a\nb")], "doc_id long, text string"))
    assert {t.name for t in spark.catalog.listTables()} == before


def test_empty(nothing):
    assert lines.drop_frequent_lines(nothing).count() == 0
