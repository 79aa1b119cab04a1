import os
import random

import pytest
from pyspark.sql import functions as F

from lodeworks.functions.models import ModelEmbedder
from lodeworks.functions.text import lexical_text
from lodeworks.operators import lexical
from lodeworks.plans.index import build_index, index_dir
from lodeworks.sources import store as S
from lodeworks.sources.store import Store

TABLE = {"manifest": ["path", "hash"], "chunks": ["path", "start_line", "end_line", "symbol", "text", "embedding", "dl"], "postings": ["chunk_id", "term", "tf", "dl"],
         "extracted": ["path"], "symbols": ["id", "qualified", "path", "start_line", "ordinal"], "calls": ["call_id", "caller_id", "callee", "line"]}


def module(i, k=0):
    return f"def work_{i}(x):\n    return helper_{i % 3}(x) + {k}\n\n\ndef helper_{i}(x):\n    return x\n"


def tree(root, n):
    root.mkdir(parents=True)
    for i in range(n):
        (root / f"m{i:03d}.py").write_text(module(i))
        settle(root / f"m{i:03d}.py")
    return str(root)


def settle(path, seconds=60):
    """As if written a while ago."""
    at = os.stat(path).st_mtime_ns - seconds * 10**9
    os.utime(path, ns=(at, at))


def contents(store):
    return {t: sorted(map(str, store.require(t).select(c).collect())) for t, c in TABLE.items()}


def ranked(store, query, k=6):
    return [(r.chunk_id, round(r.score, 8)) for r in store.bm25(query, k)[0].collect()]


def plainly(store, query, k=6):
    """The same from texts, without blocks or stored statistics."""
    body = lexical_text(F.col("path"), F.col("symbol"), F.col("text"))
    return [(r.chunk_id, round(r.score, 8)) for r in lexical.topk(store.require("chunks"), "chunk_id", body, query, k).collect()]


def folders(repo):
    return {x for x in os.listdir(index_dir(repo)) if x.startswith("segment-")}


def size(repo, names):
    return sum(os.path.getsize(os.path.join(d, f)) for n in names for d, _, fs in os.walk(os.path.join(index_dir(repo), n)) for f in fs)


def test_a_refresh_writes_what_changed(spark, tmp_path):
    written = []
    for n in (6, 60):
        repo = tree(tmp_path / f"r{n}", n)
        build_index(spark, repo)
        before = folders(repo)
        (tmp_path / f"r{n}" / "m001.py").write_text(module(1, 7))
        report = build_index(spark, repo)
        assert (report["added"], report["changed"], report["deleted"]) == (0, 1, 0)
        written.append(size(repo, folders(repo) - before))
        assert before <= folders(repo) and len(Store(spark, index_dir(repo)).segments()) == 2
    assert written[1] < 1.1 * written[0]


def test_any_series_of_edits_equals_a_full_build(spark, tmp_path, monkeypatch):
    """Small fan-out and tiers, so that segments are merged over and over, tombstones with older segments below them."""
    monkeypatch.setattr(S, "FAN_OUT", 3)
    monkeypatch.setattr(S, "LEAST_TIER", 40_000)
    monkeypatch.setattr(S, "FOLDER_ROWS", 100)
    rng, root = random.Random(2), tmp_path / "r"
    repo = tree(root, 8)
    build_index(spark, repo)
    store, merges = Store(spark, index_dir(repo)), []
    inner = Store.compact
    monkeypatch.setattr(Store, "compact", lambda self, everything=False: merges.append(inner(self, everything)) or merges[-1])
    for _ in range(3):
        for i in rng.sample(range(10), 2):
            path = root / f"m{i:03d}.py"
            if path.exists() and rng.random() < 0.4:
                path.unlink()
            else:
                path.write_text(module(i, rng.randrange(100)))
        build_index(spark, repo)
        assert len(store.segments()) <= 3 * 3
        assert ranked(store, "work helper return 7") == plainly(store, "work helper return 7")
    grown = contents(store)
    assert any(merges) and not all(merges)
    store.compact(everything=True)
    assert len(store.segments()) == 1 and "gone_paths" not in store.segments()[0]["tables"] and contents(store) == grown
    build_index(spark, repo, full=True)
    assert contents(store) == grown and ranked(store, "x return") == plainly(store, "x return")
    # The state before the last stays for its readers, and no older one.
    assert len(folders(repo)) == 2 and len([x for x in os.listdir(index_dir(repo)) if x.startswith(S.POINTER) and not x.endswith(".crc")]) == 2


def test_which_segments_are_merged():
    big = 50 * S.LEAST_TIER
    assert S.to_merge([big] + [10] * (S.FAN_OUT - 1)) == 0 and S.to_merge([big] + [10] * S.FAN_OUT) == S.FAN_OUT
    assert S.to_merge([big] * S.FAN_OUT + [10]) == S.FAN_OUT + 1 and S.to_merge([]) == 0
    assert [S.tier(x) for x in (1, S.LEAST_TIER, S.LEAST_TIER + 1, S.LEAST_TIER * S.FAN_OUT + 1)] == [0, 0, 1, 2]


def test_equal_texts_are_embedded_once(spark, tmp_path):
    repo = tree(tmp_path / "r", 4)
    model = ModelEmbedder("length", lambda: lambda texts: [[float(len(t)), float(sum(map(ord, t)) % 97)] for t in texts], "none")
    build_index(spark, repo, model)
    path = tmp_path / "r" / "m002.py"
    path.write_text(module(2).replace("return x\n", "return 2\n"))
    assert build_index(spark, repo, model)["embedded"] == 1
    grown = contents(Store(spark, index_dir(repo)))
    assert build_index(spark, repo, model, full=True)["embedded"] == 8 and contents(Store(spark, index_dir(repo))) == grown


def test_a_graph_left_out_comes_later(spark, tmp_path):
    repo = tree(tmp_path / "r", 3)
    build_index(spark, repo, graph=False)
    store = Store(spark, index_dir(repo))
    assert store.read("symbols") is None
    build_index(spark, repo)
    assert store.require("symbols").count() == 6
    (tmp_path / "r" / "m000.py").unlink()
    build_index(spark, repo, graph=False)
    assert store.require("symbols").count() == 4 and build_index(spark, repo)["embedded"] == 0
    assert sorted(r.qualified for r in store.require("symbols").collect()) == ["helper_1", "helper_2", "work_1", "work_2"]


def test_an_index_of_another_layout_is_built_anew(spark, tmp_path):
    repo = tree(tmp_path / "r", 2)
    build_index(spark, repo)
    names = sorted(x for x in os.listdir(index_dir(repo)) if x.startswith(S.POINTER) and not x.endswith(".crc"))
    path = os.path.join(index_dir(repo), names[-1])
    text = open(path).read()
    os.remove(os.path.join(index_dir(repo), f".{names[-1]}.crc"))
    open(path, "w").write(text.replace(f'"layout": {S.LAYOUT}', '"layout": 1'))
    assert Store(spark, index_dir(repo)).read("chunks") is None
    assert build_index(spark, repo)["added"] == 2


def test_a_refresh_of_an_unchanged_tree_opens_nothing(spark, tmp_path):
    repo = tree(tmp_path / "r", 3)
    (tmp_path / "r" / "_private.py").write_text("def hidden():\n    return 1\n")
    settle(tmp_path / "r" / "_private.py")
    none = {"added": 0, "changed": 0, "deleted": 0, "embedded": 0}
    assert build_index(spark, repo)["added"] == 4
    store = Store(spark, index_dir(repo))
    first, grown = folders(repo), contents(store)
    # Other contents of the same length and time: whoever opened the files would see it.
    for name in ("m001.py", "_private.py"):
        path = tmp_path / "r" / name
        at, text = os.stat(path).st_mtime_ns, path.read_text()
        path.write_text(text.replace("return", "retrun"))
        os.utime(path, ns=(at, at))
        assert build_index(spark, repo) == none and folders(repo) == first
        path.write_text(text)
        os.utime(path, ns=(at, at))
    for name in ("m001.py", "_private.py"):
        settle(tmp_path / "r" / name, 30)
    # Touched, with equal bytes: read once, nothing but the manifest is written, and then vouched for.
    assert build_index(spark, repo) == none
    assert len(store.segments()) == 2 and store.segments()[-1]["tables"] == {"manifest": 2, "gone_stats": 2}
    assert contents(store) == grown and build_index(spark, repo) == none and len(store.segments()) == 2
    (tmp_path / "r" / "m001.py").write_text(module(1, 5))
    assert build_index(spark, repo)["changed"] == 1
    build_index(spark, repo)  # written a moment ago: read again, and then vouched for
    assert len(store.segments()) in (3, 4)
