"""Model files for the seams, written byte by byte: a table of token vectors, and sums of them as logits."""


import numpy as np
import pytest

from lodeworks.functions import models
from lodeworks.plans.index import build_index, index_dir
from lodeworks.plans.retrieve import retrieve
from lodeworks.sources.store import Store

pytest.importorskip("onnxruntime")
tokenizers = pytest.importorskip("tokenizers")

WORDS = "[UNK] [PAD] mint key user seal text door enter".split()


def varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def part(number, value):
    """A field of a message: a number, or bytes with their length."""
    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    value = value.encode() if isinstance(value, str) else value
    return varint(number << 3 | 2) + varint(len(value)) + value


def tensor(name, array):
    kind = {np.dtype("float32"): 1, np.dtype("int64"): 7}[array.dtype]
    return b"".join(part(1, d) for d in array.shape) + part(2, kind) + part(8, name) + part(9, array.tobytes())


def port(name, kind, axes):
    shape = b"".join(part(1, part(2, a)) for a in axes)
    return part(1, name) + part(2, part(1, part(1, kind) + part(2, shape)))


def node(op, inputs, output, **numbers):
    text = b"".join(part(1, i) for i in inputs) + part(2, output) + part(4, op)
    return text + b"".join(part(5, part(1, k) + part(3, v) + part(20, 2)) for k, v in numbers.items())


def write_model(folder, vectors, nodes, output, axes):
    folder.mkdir()
    tables = [tensor("table", vectors), tensor("axes", np.array([1, 2], np.int64))]
    graph = b"".join(part(1, n) for n in nodes) + part(2, "g") + b"".join(part(5, t) for t in tables)
    graph += part(11, port("input_ids", 7, ["b", "s"])) + part(12, port(output, 1, axes))
    (folder / "model.onnx").write_bytes(part(1, 8) + part(8, part(1, "") + part(2, 13)) + part(7, graph))
    t = tokenizers.Tokenizer(tokenizers.models.WordLevel({w: i for i, w in enumerate(WORDS)}, unk_token="[UNK]"))
    t.pre_tokenizer = tokenizers.pre_tokenizers.Whitespace()
    t.save(str(folder / "tokenizer.json"))
    return f"onnx:{folder}"


VECTORS = np.arange(len(WORDS) * 3, dtype=np.float32).reshape(-1, 3) % 7 + 1


def test_embedder_and_cross_encoder(spark, tmp_path):
    gather = node("Gather", ["table", "input_ids"], "hidden")
    name = write_model(tmp_path / "embed", VECTORS, [gather], "hidden", ["b", "s", "d"])
    unit = lambda v: v / np.linalg.norm(v)
    first, mean = models.named_embedder(name, "none"), models.named_embedder(name, "e5")
    assert np.allclose(first.query(spark, "key seal"), unit(VECTORS[3]))
    rows = spark.createDataFrame([(1, "mint key"), (2, "door")], "id int, t string")
    got = {r.id: np.array(r.v) for r in models.ModelEmbedder(name, lambda: __import__("lodeworks.functions.onnx", fromlist=["x"]).embedder(str(tmp_path / "embed"), "mean"), "none").add(rows, "t", "v").collect()}
    assert np.allclose(got[1], unit((VECTORS[2] + VECTORS[3]) / 2), atol=1e-6) and np.allclose(got[2], unit(VECTORS[7]), atol=1e-6)
    assert mean.fingerprint() == f"{name}|prefix=e5"
    total = node("ReduceSum", ["hidden", "axes"], "logits", keepdims=0)
    cross = models.named_reranker(write_model(tmp_path / "cross", VECTORS, [gather, total], "logits", ["b"]))
    assert np.allclose(cross("key", ["door", "mint mint"]), [VECTORS[[3, 7, 1]].sum(), VECTORS[[3, 2, 2]].sum()]) and cross("key", []) == []
    assert models.load_reranker(lambda: models.named_reranker("onnx:/no/such/folder")) is None


def test_index_and_retrieval_with_model_files(spark, tmp_path):
    tree = tmp_path / "tree"
    tree.mkdir()
    (tree / "a.py").write_text("def mint(key):\n    return seal(key)\n\n\ndef enter(door):\n    return door\n")
    name = write_model(tmp_path / "embed", VECTORS, [node("Gather", ["table", "input_ids"], "hidden")], "hidden", ["b", "s", "d"])
    e = models.named_embedder(name, "none")
    assert build_index(spark, str(tree), e)["embedded"] == 2
    hits = retrieve(spark, Store(spark, index_dir(str(tree))), "mint", 2, "vector", e).collect()
    assert len(hits) == 2 and all(-1.001 <= h.score <= 1.001 for h in hits)
