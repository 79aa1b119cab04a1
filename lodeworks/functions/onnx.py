"""Models from local ONNX files: a folder with ``model.onnx`` and ``tokenizer.json``. Needs onnxruntime and tokenizers.

No files come with this repository; the usual exports of sentence embedders and cross-encoders fit.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

#: Tokens of a text, or of a query with a text, that a model sees.
LONGEST = 512


class _Session:
    def __init__(self, folder: str) -> None:
        import onnxruntime
        from tokenizers import Tokenizer

        options = onnxruntime.SessionOptions()
        options.intra_op_num_threads = 1  # a Spark task has one core
        self.session = onnxruntime.InferenceSession(f"{folder}/model.onnx", options, providers=["CPUExecutionProvider"])
        self.inputs = {i.name for i in self.session.get_inputs()}
        self.tokenizer = Tokenizer.from_file(f"{folder}/tokenizer.json")
        self.tokenizer.enable_truncation(LONGEST)
        if self.tokenizer.padding is None:
            token = next((t for t in ("[PAD]", "<pad>") if self.tokenizer.token_to_id(t) is not None), None)
            self.tokenizer.enable_padding(**({"pad_token": token, "pad_id": self.tokenizer.token_to_id(token)} if token else {}))

    def run(self, texts: list) -> tuple[np.ndarray, np.ndarray]:
        """The first output, and the mask of tokens that are no padding."""
        found = self.tokenizer.encode_batch(texts)
        mask = np.array([e.attention_mask for e in found], np.int64)
        given = {"input_ids": [e.ids for e in found], "attention_mask": mask, "token_type_ids": [e.type_ids for e in found]}
        out = self.session.run(None, {k: np.asarray(v, np.int64) for k, v in given.items() if k in self.inputs})[0]
        return np.asarray(out, np.float64), mask


def embedder(folder: str, pooling: str = "first") -> Callable[[list[str]], list[list[float]]]:
    """A model over lists of texts. Token vectors are pooled: the first token's (as bge does) or their mean (as e5)."""
    session = _Session(folder)

    def embed(texts: list[str]) -> list[list[float]]:
        if not texts:
            return []
        out, mask = session.run(texts)
        if out.ndim == 3:
            weight = mask[:, :, None]
            out = out[:, 0] if pooling == "first" else (out * weight).sum(1) / np.maximum(weight.sum(1), 1)
        return out.tolist()

    return embed


def reranker(folder: str) -> Callable[[str, list[str]], list[float]]:
    """A cross-encoder over (query, texts): the first logit of each pair."""
    session = _Session(folder)

    def score(query: str, texts: list[str]) -> list[float]:
        return session.run([(query, t) for t in texts])[0].reshape(len(texts), -1)[:, 0].tolist() if texts else []

    return score
