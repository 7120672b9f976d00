"""Shared pieces of the training-data operators: vectorised tokens, shared folder, column safety.

Texts are handled as UTF-8 bytes with numpy, a few MB at a time, so a very long
document costs memory in proportion to its own length and nothing is cut off.
"""

from __future__ import annotations

import ctypes
import functools
import os
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from ..shared import cut, shared_dir  # noqa: F401

CHUNK_BYTES = 1 << 19

_B = np.arange(256, dtype=np.uint16)
IS_WORD = ((_B >= 48) & (_B <= 57)) | ((_B >= 65) & (_B <= 90)) | ((_B >= 97) & (_B <= 122)) | (_B >= 128)
IS_SPACE = (_B <= 32) | (_B == 127)
#: 0 space, 1 word, 2 other
KIND = np.where(IS_WORD, 1, np.where(IS_SPACE, 0, 2)).astype(np.int8)

_P = 0x9E3779B97F4A7C15 | 1
_P_INV = pow(_P, -1, 1 << 64)
_POW = np.ones(1, np.uint64)
_INV = np.ones(1, np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POW, _INV
    if len(_POW) < n:
        size = max(n, CHUNK_BYTES + (CHUNK_BYTES >> 1))
        for name, base in (("_POW", _P), ("_INV", _P_INV)):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            globals()[name] = np.multiply.accumulate(x)
    return _POW, _INV


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser over a uint64 array."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Scripts written without spaces: each of their letters is a token.
UNSPACED = ((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3040, 0x30FF), (0x31F0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF))


@functools.cache
def letter_classes() -> np.ndarray:
    """For each code point: 1 a letter, mark or number, 2 one of an unspaced script, 0 any other."""
    out = np.zeros(0x110000, np.int8)
    for a, b in ((0, 0x40000), (0xE0100, 0xE01F0)):  # no other plane has letters
        out[a:b] = [unicodedata.category(chr(i))[0] in "LMN" for i in range(a, b)]
    for a, b in UNSPACED:
        out[a : b + 1] *= 2
    return out


def lower_bytes(text: str) -> tuple[bytes, bytes]:
    """UTF-8 of the text and of its lower case, byte for byte in step.

    A character whose lower case has another number of bytes stays as it is.
    """
    raw, low = text.encode("utf-8", "replace"), text.lower().encode("utf-8", "replace")
    if len(raw) == len(low):
        a, b = np.frombuffer(raw, np.uint8), np.frombuffer(low, np.uint8)
        if not ((a ^ b) & 0xC0).any():
            return raw, low
    kept = "".join(x if len((x := c.lower()).encode("utf-8", "replace")) == len(c.encode("utf-8", "replace")) else c for c in text)
    return raw, kept.encode("utf-8", "replace")


@dataclass
class Tokens:
    """Tokens of a few documents. start and end are byte offsets in raw; doc counts from 0."""

    raw: bytes
    doc_at: np.ndarray  # first byte of each document, and one past the end
    hash: np.ndarray
    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    n_docs: int

    def counts(self) -> np.ndarray:
        return np.bincount(self.doc, minlength=self.n_docs)

    def first(self) -> np.ndarray:
        """Index of each document's first token."""
        c = np.zeros(self.n_docs + 1, np.int64)
        np.cumsum(self.counts(), out=c[1:])
        return c

    def ngrams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of n tokens in a row and the index of their first token."""
        if len(self.hash) < n:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        m = len(self.hash) - n + 1
        h = np.full(m, n * 0x1000193 + 7, np.uint64)
        for k in range(n):
            h = (h * np.uint64(0xD6E8FEB86659FD93)) ^ self.hash[k : k + m]
            h = h * np.uint64(0xFF51AFD7ED558CCD)
            h ^= h >> np.uint64(32)
        at = np.flatnonzero(self.doc[:m] == self.doc[n - 1 :])
        return h[at], at


def tokenize(texts: list[str | None], symbols: bool = False) -> Tokens:
    """Maximal runs of letters, marks and numbers of any script, in lower case; in UNSPACED scripts each letter.

    symbols: runs of other printable characters are tokens too, and all bytes from 0x80 on count
    as letters. A null counts as an empty text.
    """
    pairs = [lower_bytes(t or "") for t in texts]
    raw = b"\n".join(p[0] for p in pairs) + b"\n"
    low = np.frombuffer(b"\n".join(p[1] for p in pairs) + b"\n", np.uint8)
    doc_at = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(p[0]) + 1 for p in pairs], out=doc_at[1:])
    if symbols:
        kind = KIND[low]
        change = np.flatnonzero(np.diff(kind)) + 1
        edge = np.concatenate([[0], change, [len(low)]])
        real = kind[edge[:-1]] > 0
        start, end = edge[:-1][real], edge[1:][real]
    elif (low & 0x80).any():
        points = np.frombuffer(low.tobytes().decode().encode("utf-32-le"), np.uint32)
        kind = letter_classes()[points]
        run = np.flatnonzero(kind)
        more = (kind[1:] == 1) & (kind[:-1] == 1)  # the text ends with a line feed, so no run does
        at = np.zeros(len(points) + 1, np.int64)
        np.cumsum(1 + (points >= 0x80) + (points >= 0x800).astype(np.int64) + (points >= 0x10000), out=at[1:])
        start, end = at[run[~np.concatenate([[False], more])[run]]], at[run[~np.concatenate([more, [False]])[run]] + 1]
    else:
        step = np.diff(IS_WORD[low].view(np.int8), prepend=np.int8(0))
        start, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    power, inverse = _powers(len(low) + 1)
    sums = np.zeros(len(low) + 1, np.uint64)
    np.cumsum((low.astype(np.uint64) + np.uint64(1)) * power[: len(low)], out=sums[1:])
    h = mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64))
    counts = np.searchsorted(start, doc_at)
    doc = np.repeat(np.arange(len(texts), dtype=np.int64), np.diff(counts))
    return Tokens(raw, doc_at, h, doc, start, end, len(texts))


def hash_text(text: str) -> int:
    """The hash that tokenize() gives this single token."""
    t = tokenize([text])
    return int(t.hash[0])


def chunks(texts: list[str | None], size: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of whole documents of about this size."""
    begin, n = 0, 0
    for i, t in enumerate(texts):
        n += len(t) if t else 0
        if n >= size:
            yield begin, i + 1
            begin, n = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


def slices(batch: pa.RecordBatch, text: int, size: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch, each of about this size of text, so memory follows a part and not the batch."""
    end = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(end, (end[at - 1] if at else 0) + size, "right")))
        yield batch.slice(at, to - at)
        at = to


_HELD: tuple[str, Callable[[], None]] | None = None


def hold(owner: str, drop: Callable[[], None] = lambda: None) -> None:
    """Called where a task begins: what another operator's tasks keep in this worker goes first."""
    global _HELD
    if _HELD and _HELD[0] != owner:
        _HELD[1]()
        trim()
    _HELD = (owner, drop)


def trim() -> None:
    """Give freed memory back to the system: a worker that waits for its next task holds little."""
    pa.default_memory_pool().release_unused()
    give = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU library only
    if give:
        give(0)


def unique_sorted(keys: np.ndarray) -> np.ndarray:
    keys = np.sort(keys)
    return keys[np.concatenate([[True], keys[1:] != keys[:-1]])] if len(keys) else keys


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def buckets_for(df: DataFrame, each: int) -> int:
    """Buckets of about so many bytes of df by the optimizer's estimate, and as many as shuffle partitions at least."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    known = size if size < 1 << 60 else 0  # an RDD's size is unknown
    return max(partitions(df.sparkSession), -(-known // each))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def spare(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
