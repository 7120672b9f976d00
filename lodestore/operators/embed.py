"""Embedders: texts to packed codes of 64 bytes. encode() works on the driver, column() in the cluster."""

from __future__ import annotations

import hashlib
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def pack(vectors: np.ndarray) -> np.ndarray:
    """Bytes of the first 512 features' signs; 1 where a feature is > 0."""
    return np.packbits(np.asarray(vectors)[:, :512] > 0, axis=1)


def pooling(tokens: np.ndarray, mask: np.ndarray, strategy: str = "cls") -> np.ndarray:
    """A vector of each text from its tokens' vectors (texts, tokens, features): the first, or the masked mean."""
    if strategy == "cls":
        return tokens[:, 0]
    if strategy == "mean":
        m = mask[:, :, None]
        return (tokens * m).sum(1) / m.sum(1)
    raise NotImplementedError(strategy)


class Embedder(Protocol):
    name: str
    dtype: str
    context_length: int

    def encode(self, texts: list[str]) -> list[list[int]]: ...

    def column(self, text: Column) -> Column: ...


class Md5TestEmbedder:
    """Deterministic and the same in SQL, but without meaning: md5 of the text with each of four suffixes. For tests."""

    name, dtype, context_length = "md5-test", "float32", 512

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [[b for k in range(4) for b in hashlib.md5(f"{t}#{k}".encode()).digest()] for t in texts]

    def column(self, text: Column) -> Column:
        joined = F.unhex(F.concat(*[F.md5(F.concat(text, F.lit(f"#{k}"))) for k in range(4)]))
        # bound once by a lambda: within the inner one it would be computed again for each byte
        return F.get(F.transform(F.array(F.hex(joined)), lambda h: F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.conv(F.substring(h, i * 2 + 1, F.lit(2)), 16, 10).cast("int"))), F.lit(0))


class HashingEmbedder:
    """Signed hashing of words and their trigrams in 512 features: weakly semantic, needs no model."""

    name, dtype, context_length = "hashing-512", "float32", 512

    def vectors(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), 512))
        seen: dict[str, tuple[int, float]] = {}
        for row, text in zip(out, texts):
            for word in text.lower().split():
                for gram in [word, *(word[i : i + 3] for i in range(len(word) - 2))]:
                    hit = seen.get(gram)
                    if hit is None:
                        h = int.from_bytes(hashlib.blake2b(gram.encode(), digest_size=8).digest(), "big")
                        hit = seen[gram] = (h % 512, 1.0 if h >> 63 else -1.0)
                    row[hit[0]] += hit[1]
        return out

    def encode(self, texts: list[str]) -> list[list[int]]:
        return pack(self.vectors(texts)).astype(int).tolist() if texts else []

    def column(self, text: Column) -> Column:
        own = self

        @F.pandas_udf("array<int>")
        def run(t: pd.Series) -> pd.Series:
            return pd.Series(own.encode([x or "" for x in t]), dtype=object)

        return run(text)


class SentenceTransformerEmbedder:
    """A sentence-transformers model, loaded once for each worker process; an optional package."""

    dtype, context_length = "float32", 512
    _loaded: dict[str, object] = {}

    def __init__(self, name: str = "mixedbread-ai/mxbai-embed-large-v1", device: str | None = None):
        self.name, self.device = name, device

    def _model(self):
        if self.name not in self._loaded:
            try:
                from sentence_transformers import SentenceTransformer
            except ImportError as e:
                raise ImportError("this embedder needs the optional package sentence-transformers") from e
            self._loaded[self.name] = SentenceTransformer(self.name, device=self.device)
        return self._loaded[self.name]

    def encode(self, texts: list[str], precision: str = "binary") -> list[list[int]]:
        if precision != "binary":
            raise ValueError(f"unsupported precision: {precision}")
        return pack(self._model().encode(texts)).astype(int).tolist()

    def column(self, text: Column) -> Column:
        own = self

        @F.pandas_udf("array<int>")
        def run(t: pd.Series) -> pd.Series:
            return pd.Series(own.encode([x or "" for x in t]), dtype=object)

        return run(text)
