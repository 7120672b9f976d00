"""Text functions: chunkers, token counts and the text of web pages."""

from __future__ import annotations

import base64
import hashlib
import html
import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK_TOKENS = 512
CHARS_A_TOKEN = 4
#: Bytes of texts that are chunked at once.
SLICE_BYTES = 1 << 20


def fast_chunks(text: Column, tokens: int = CHUNK_TOKENS) -> Column:
    """Windows of 4 * tokens characters, the last one shorter; no window for an empty or null text."""
    width = tokens * CHARS_A_TOKEN
    n = F.ceil(F.char_length(text) / width).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(text, i * width + 1, F.lit(width)))).otherwise(F.array().cast("array<string>"))


class Tokenizer(Protocol):
    """Ids of a text and the text of ids."""

    def encode(self, text: str) -> list[int]: ...

    def decode(self, ids: list[int]) -> str: ...


class WordTokenizer:
    """Needs no vocabulary: a token is a run of letters and digits, of spaces, or one other character."""

    _RUN = re.compile(r"\w+|\s+|[^\w\s]")

    def pieces(self, text: str) -> list[str]:
        return self._RUN.findall(text)

    def windows(self, text: str, tokens: int) -> list[str]:
        """The text of so many pieces in a row at a time, without a list of the pieces."""
        return re.findall(rf"(?:\w++|\s++|[^\w\s]){{1,{tokens}}}+", text)

    def encode(self, text: str) -> list[int]:
        """Ids by a hash that is the same in every process."""
        return [int.from_bytes(hashlib.blake2b(p.encode(), digest_size=8).digest(), "big") >> 1 for p in self.pieces(text)]

    def decode(self, ids: list[int]) -> str:
        raise TypeError("a word tokenizer keeps no vocabulary; use pieces()")


class RankTokenizer:
    """A tiktoken encoding from a file of ranks (byte-level BPE); special tokens count as ordinary text."""

    def __init__(self, path: str, pattern: str):
        self.path, self.pattern = path, pattern
        self._encoding = None

    def __getstate__(self):
        return {"path": self.path, "pattern": self.pattern, "_encoding": None}

    @property
    def encoding(self):
        if self._encoding is None:
            import tiktoken

            with open(self.path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self._encoding = tiktoken.Encoding("own", pat_str=self.pattern, mergeable_ranks=ranks, special_tokens={})
        return self._encoding

    def encode(self, text: str) -> list[int]:
        return self.encoding.encode_ordinary(text)

    def decode(self, ids: list[int]) -> str:
        return self.encoding.decode(ids)


def token_windows(tokenizer: Tokenizer, text: str, tokens: int = CHUNK_TOKENS) -> list[str]:
    """Texts of consecutive groups of tokens; a text of no more than that many tokens stays as it is."""
    if isinstance(tokenizer, WordTokenizer):
        return tokenizer.windows(text, tokens) or [text]
    ids = tokenizer.encode(text)
    return [text] if len(ids) <= tokens else [tokenizer.decode(ids[i : i + tokens]) for i in range(0, len(ids), tokens)]


def token_chunks(tokenizer: Tokenizer, tokens: int = CHUNK_TOKENS) -> Callable[[Column], Column]:
    """Arrow-batched chunker: array<string>; one empty chunk for an empty text, null for null."""

    @F.arrow_udf("array<string>")
    def chunk(text: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in text:
            for part in _slices(batch):
                yield pa.array([None if t is None else token_windows(tokenizer, t, tokens) for t in part.to_pylist()], pa.list_(pa.string()))

    return chunk


def _slices(batch: pa.Array) -> Iterator[pa.Array]:
    """Parts of SLICE_BYTES or one text, so what a worker holds beside the batch follows a part."""
    end = np.cumsum(pc.fill_null(pc.binary_length(batch), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(batch):
        to = max(at + 1, int(np.searchsorted(end, (end[at - 1] if at else 0) + SLICE_BYTES, "right")))
        yield batch.slice(at, to - at)
        at = to


def token_count(tokenizer: Tokenizer, special: int = 0) -> Callable[[Column], Column]:
    """Tokens of a text, with so many special ones added."""
    count = (lambda t: len(tokenizer.pieces(t))) if isinstance(tokenizer, WordTokenizer) else (lambda t: len(tokenizer.encode(t)))

    @F.pandas_udf("long")
    def run(text: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else count(t) + special for t in text], dtype="Int64")

    return run


def word_token_count(text: Column) -> Column:
    """WordTokenizer's count in generated code, for ASCII and other letters alike."""
    return F.regexp_count(text, F.lit(r"[\p{L}\p{N}_]+|\s+|[^\p{L}\p{N}_\s]")).cast("long")


class _Text(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style", "template"):
            self.hidden += 1

    def handle_endtag(self, tag):
        if tag in ("script", "style", "template") and self.hidden:
            self.hidden -= 1

    def handle_data(self, data):
        if not self.hidden:
            self.parts.append(data)


def page_text_of(page: str) -> str:
    """All text of a page in order, without scripts, styles and comments, entities decoded."""
    p = _Text()
    p.feed(page)
    p.close()
    return "".join(p.parts)


def parsed_page_text(page: Column) -> Column:
    """page_text_of() in Arrow batches: any page, all entities."""

    @F.pandas_udf("string")
    def run(pages: pd.Series) -> pd.Series:
        return pd.Series([None if p is None else page_text_of(p) for p in pages], dtype=object)

    return run(page)


#: Entities that the expression below decodes; others need parsed_page_text
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")]


def page_text(page: Column) -> Column:
    """The same for pages that are well formed, in generated code; the entities of ENTITIES only."""
    bare = F.regexp_replace(page, r"(?s)<!--.*?-->", "")
    bare = F.regexp_replace(bare, r"(?is)<(script|style|template)\b.*?</(script|style|template)\s*>", "")
    bare = F.regexp_replace(bare, r"(?s)<[^>]*>", "")
    for a, b in ENTITIES:
        bare = F.replace(bare, F.lit(a), F.lit(b))
    return bare


def unescape(text: str) -> str:
    return html.unescape(text)


def exploded(df: DataFrame, chunks: Column, *keep: str) -> DataFrame:
    """A row for each chunk: the kept columns, chunk_idx and chunk."""
    return df.select(*keep, F.posexplode(chunks).alias("chunk_idx", "chunk"))


def show_tokens(tokens: list[str]) -> str:
    """Tokens on alternating backgrounds, for a terminal."""
    colours = (24, 94, 22, 53, 58)
    return "".join(f"\x1b[48;5;{colours[i % len(colours)]}m{t}" for i, t in enumerate(tokens)) + "\x1b[0m"
