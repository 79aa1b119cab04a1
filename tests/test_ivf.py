import numpy as np
import pytest
from pyspark.sql import functions as F

from lodeworks.operators import ivf, vectors


def unit(v):
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def frame(spark, v, first=0):
    return spark.createDataFrame([(first + i, [float(c) for c in x]) for i, x in enumerate(v)], "vec_id long, v array<double>").repartition(3)


def clustered(rng, n, d=16, groups=40):
    return unit(rng.standard_normal((groups, d))[rng.integers(0, groups, n)] * 4 + rng.standard_normal((n, d)))


@pytest.mark.parametrize("kind", ["clustered", "isotropic", "copies"])
def test_recall_against_the_exact_search(spark, kind, monkeypatch):
    monkeypatch.setattr(ivf, "PIECE", 200)
    rng = np.random.default_rng(4)
    v = clustered(rng, 2000) if kind != "isotropic" else unit(rng.standard_normal((2000, 16)))
    if kind == "copies":
        v[:700] = v[0]
    df = frame(spark, v).unionByName(spark.createDataFrame([(9000, None)], "vec_id long, v array<double>"))
    index = ivf.build(df, "vec_id", "v")
    assert index.table.count() == 2000 and 1 <= index.probes <= len(index.centroids)
    asked = df.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("v").alias("vector"))
    exact = vectors.batch_topk(df, "vec_id", "v", asked, 10)
    found = ivf.batch_topk(index, asked, 10)
    assert found.where("query_id is null or rank > 10").isEmpty()
    assert ivf.recall(found, exact, "vec_id") >= 0.9
    # With all lists probed it is the exact search.
    whole = ivf.batch_topk(index, asked, 10, probes=len(index.centroids))
    rows = lambda x: sorted((r.query_id, r.rank, r.vec_id, round(r.score, 9)) for r in x.collect())
    assert rows(whole) == rows(exact)
    if kind == "clustered":
        assert index.probes <= len(index.centroids) / 4


def test_one_query_reads_its_lists_only(spark):
    rng = np.random.default_rng(8)
    v = clustered(rng, 1500)
    df = frame(spark, v)
    index = ivf.build(df, "vec_id", "v")
    one = ivf.topk(index, list(v[5]), 10)
    wanted = set(index.lists(v[5:6])[0].tolist())
    assert {f.split("list=")[1].split("/")[0] for f in one.inputFiles()} >= set()
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "list" in plan.split("PartitionFilters")[1].split("]")[0]
    exact = [r.vec_id for r in vectors.topk(df, "vec_id", "v", list(v[5]), 10).collect()]
    got = [r.vec_id for r in one.collect()]
    assert got[0] == 5 and len(set(got) & set(exact)) >= 8 and len(wanted) == index.probes


def test_few_vectors_and_none(spark):
    one = ivf.build(frame(spark, np.array([[1.0, 0.0]])), "vec_id", "v")
    asked = spark.createDataFrame([(1, [0.6, 0.8]), (2, None)], "query_id long, vector array<double>")
    assert [(r.query_id, r.vec_id, r.rank) for r in ivf.batch_topk(one, asked, 10).collect()] == [(1, 0, 1)]
    none = ivf.build(spark.createDataFrame([], "vec_id long, v array<double>"), "vec_id", "v")
    assert ivf.batch_topk(none, asked.limit(0), 10).count() == 0 and none.table.count() == 0
