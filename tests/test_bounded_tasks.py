import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lodeworks.operators import vectors
from lodeworks.scratch import new_path
from lodeworks.sources import store, syntax


def test_a_large_segment_without_postings_is_not_one_tasks(spark, monkeypatch):
    monkeypatch.setattr(store, "FOLDER_ROWS", 1000)
    s = store.Store(spark, new_path(spark, "parts"))
    rows = spark.range(4000, numPartitions=4).select(F.col("id").cast("string").alias("path"), F.lit("h").alias("hash"))
    s.publish({"manifest": rows}, "f")
    files = s.require("manifest").inputFiles()
    assert len(files) == 4 and s.require("manifest").count() == 4000
    s.publish({"manifest": rows.limit(10)}, "f")
    assert len(s.require("manifest").inputFiles()) == 1


def test_files_are_parsed_a_few_at_a_time(spark, monkeypatch):
    """What a worker holds follows the characters of a few files, not those of a whole batch."""
    monkeypatch.setattr(syntax, "TOGETHER", 64)
    made = []
    monkeypatch.setattr(syntax, "extract", lambda lang, text: made.append(text) or ([], [], []))

    class Files:
        def select(self, *_):
            return self

        def mapInArrow(self, run, _):
            return run

    texts = ["x" * 40] * 6 + [None, "", "y" * 500, "z"]
    batch = pa.RecordBatch.from_arrays([pa.array([str(i) for i in range(10)]), pa.array(["python"] * 10), pa.array(texts, pa.string())], names=["path", "lang", "content"])
    held, paths = [], []
    for out in syntax.extracted(Files())(iter([batch])):
        held.append(sum(map(len, made)))
        made.clear()
        paths += out.column(0).to_pylist()
    assert paths == [str(i) for i in range(10)] and max(held[:3]) <= 80 and len(held) >= 4


def test_nearest_of_many_with_ties(spark):
    rng = random.Random(3)
    rows = [(i, [float(rng.randrange(3)), float(rng.randrange(3))]) for i in range(400)]
    e = spark.createDataFrame(rows, "k long, v array<double>").repartition(3)
    q = spark.createDataFrame([(j, [1.0, j / 2]) for j in range(4)], "query_id int, vector array<double>")
    found = {}
    for r in vectors.batch_topk(e, "k", "v", q, 7).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append(r.k)
    for j in range(4):
        assert found[j] == [k for _, k in sorted((-round(float(np.dot(v, [1.0, j / 2])), 9), k) for k, v in rows)[:7]]
