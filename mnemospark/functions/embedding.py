"""Text to vectors.  An embedder turns a text column into ``array<float>`` and one
text into a list; the model is loaded once per Python worker."""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from mnemospark.functions import fixed_values as fv
from mnemospark.functions.queries import tokenize


def _unit(vectors: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
    return np.divide(vectors, norms, out=np.zeros_like(vectors), where=norms > 0)


class Embedder:
    """Base: subclasses give ``vectors(texts)`` as a float matrix."""

    def vectors(self, texts: list[str]) -> np.ndarray:
        raise NotImplementedError

    def one(self, text: str) -> list[float]:
        return [float(x) for x in self.vectors([text])[0]]

    def __call__(self, text: Column) -> Column:
        make = self.vectors

        @F.arrow_udf("array<float>")
        def embed(batch: pa.Array) -> pa.Array:
            rows = make([s or "" for s in batch.to_pylist()]).astype(np.float32)
            flat = pa.array(rows.reshape(-1), pa.float32())
            ends = np.arange(0, (len(rows) + 1) * rows.shape[1], rows.shape[1], dtype=np.int32)
            return pa.ListArray.from_arrays(pa.array(ends), flat)

        return embed(text)


class HashingEmbedder(Embedder):
    """Signed token hashing: no model needed, good for tests, weak at meaning."""

    def __init__(self, dim: int = fv.EMBEDDING_DIM):
        self.dim = dim

    def vectors(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim))
        for i, text in enumerate(texts):
            for word in tokenize(text):
                h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
                out[i, h % self.dim] += 1.0 if h >> 63 else -1.0
        return _unit(out)


@lru_cache(maxsize=2)
def _onnx(folder: str):
    import onnxruntime
    from tokenizers import Tokenizer

    tokens = Tokenizer.from_file(f"{folder}/tokenizer.json")
    tokens.enable_truncation(512)
    tokens.enable_padding()
    return tokens, onnxruntime.InferenceSession(f"{folder}/model.onnx")


class OnnxEmbedder(Embedder):
    """Sentence model from a folder on every worker: tokens, model, mean, unit length."""

    def __init__(self, folder: str):
        self.folder = folder

    def vectors(self, texts: list[str]) -> np.ndarray:
        tokens, model = _onnx(self.folder)
        encoded = tokens.encode_batch(texts)
        ids = np.array([e.ids for e in encoded], dtype=np.int64)
        mask = np.array([e.attention_mask for e in encoded], dtype=np.int64)
        given = {"input_ids": ids, "attention_mask": mask, "token_type_ids": np.zeros_like(ids)}
        wanted = {i.name for i in model.get_inputs()}
        hidden = model.run(None, {k: v for k, v in given.items() if k in wanted})[0]
        weights = mask[:, :, None].astype(np.float64)
        return _unit((hidden * weights).sum(axis=1) / np.maximum(weights.sum(axis=1), 1e-9))
