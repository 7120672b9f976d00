"""Benchmark decontamination with a generalised suffix automaton of the normalised test items.

Tokens are lower-case runs of letters and digits. The automaton holds all items; a document's
tokens stream through it, and at each token the longest match ending there is known. An item of
n tokens needs a match of k = min(length, max(least, ceil(coverage * n))) tokens: the length
limit for long items, the coverage limit for short ones. Tokens of such matches are removed
with what stands between them; a document that loses more than `document` of its tokens goes
as a whole.

Only stretches that can hold a match are walked: a match of at least K tokens (the least k)
consists of K-grams of the items, and the others are told apart by a vectorised hash lookup, so
the result is that of walking everything.

Items are dealt to automata of about MATCHER_TOKENS tokens each, built on the executors and
broadcast one by one; a long item is cut into parts that overlap by k - 1 tokens, so each k-gram
of it is in one. A task goes through its texts once for each automaton and unites the covered
tokens, so memory doesn't grow with the items and the work is their blocks times the texts.

Defined results: null text stays null with 0 tokens; empty text stays empty; a null, empty or
too short item (fewer than `least` tokens) matches nothing; repeated items count once; no items
or an empty table change nothing; repeated rows are each cleaned; further columns stay as they are.
"""

from __future__ import annotations

import math
import pickle
import uuid
from collections.abc import Iterable, Sequence

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Tokens, chunks, hold, spare, tokenize

LENGTH, COVERAGE, LEAST, DOCUMENT = 13, 0.8, 5, 0.5
#: Tokens of an automaton: some 60 bytes each. Tokens of a part of an item.
MATCHER_TOKENS, PART = 500_000, 4096


def need(n: int, length: int = LENGTH, coverage: float = COVERAGE, least: int = LEAST) -> int:
    return min(length, max(least, math.ceil(coverage * n - 1e-9)))


class SuffixAutomaton:
    """All substrings of several token sequences, with the least match that counts for each state."""

    def __init__(self, items: Iterable[tuple[list[int], int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len, self.need = [-1], [0], [1 << 30]
        for tokens, k in items:
            last = 0
            for t in tokens:
                last = self._extend(last, t)
                self.need[last] = min(self.need[last], k)
        order = sorted(range(1, len(self.len)), key=lambda s: -self.len[s])
        for s in order:  # an ancestor occurs wherever its descendants do
            self.need[self.link[s]] = min(self.need[self.link[s]], self.need[s])
        #: longest proper suffix state that counts by itself
        short = [0] * len(self.len)
        for s in reversed(order):
            p = self.link[s]
            short[s] = self.len[p] if p > 0 and self.len[p] >= self.need[p] else short[p] if p > 0 else 0
        # most states have one transition: arrays hold it, a dictionary only the states that branch
        self.only = np.array([next(iter(d)) if len(d) == 1 else 0 for d in self.next], np.uint64)
        self.to = np.array([next(iter(d.values())) if len(d) == 1 else -1 for d in self.next], np.int32)
        self.branch = {s: d for s, d in enumerate(self.next) if len(d) > 1}
        self.next = []
        self.link, self.len, self.need, self.short = (np.array(x, np.int32) for x in (self.link, self.len, self.need, short))

    def _clone(self, p: int, q: int, t: int) -> int:
        c = len(self.len)
        self.next.append(dict(self.next[q]))
        self.len.append(self.len[p] + 1)
        self.link.append(self.link[q])
        self.need.append(1 << 30)
        self.link[q] = c
        while p >= 0 and self.next[p].get(t) == q:
            self.next[p][t] = c
            p = self.link[p]
        return c

    def _extend(self, last: int, t: int) -> int:
        q = self.next[last].get(t)
        if q is not None:
            return q if self.len[q] == self.len[last] + 1 else self._clone(last, q, t)
        new = len(self.len)
        self.next.append({})
        self.len.append(self.len[last] + 1)
        self.link.append(0)
        self.need.append(1 << 30)
        p = last
        while p >= 0 and t not in self.next[p]:
            self.next[p][t] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][t]
            self.link[new] = q if self.len[q] == self.len[p] + 1 else self._clone(p, q, t)
        return new

    def step(self, s: int, t: int) -> int | None:
        to = self.to[s]
        if to >= 0:
            return int(to) if self.only[s] == t else None
        return self.branch.get(s, {}).get(t)

    def matches(self, tokens: Sequence[int]) -> list[int]:
        """For each token, how many tokens ending there a counting match has (0: none)."""
        out, s, n = [], 0, 0
        for t in tokens:
            while (to := self.step(s, t)) is None and s:
                s = int(self.link[s])
                n = int(self.len[s])
            if to is not None:
                s, n = to, n + 1
            out.append(n if n >= self.need[s] else int(self.short[s]))
        return out


class Matcher:
    """Spans of a few documents that match the items, given as tokens with the match that they need."""

    def __init__(self, items: Iterable[tuple[np.ndarray, int]]):
        known = {(x.tobytes(), k): (x, k) for x, k in items}
        sized = [known[key] for key in sorted(known)]
        self.k = min((k for _, k in sized), default=0)
        self.automaton = SuffixAutomaton((x.tolist(), k) for x, k in sized)
        grams = [Tokens(b"", np.zeros(2, np.int64), x, np.zeros(len(x), np.int64), x, x, 1).ngrams(self.k)[0] for x, _ in sized]
        self.grams = np.unique(np.concatenate(grams)) if grams else np.zeros(0, np.uint64)
        self.sieve = np.zeros(1 << 20, bool)
        self.sieve[(self.grams >> np.uint64(44)).astype(np.int64)] = True

    def covered(self, t: Tokens) -> np.ndarray:
        """Which tokens belong to a match."""
        out = np.zeros(len(t.hash), bool)
        if not self.k:
            return out
        g, at = t.ngrams(self.k)
        maybe = np.flatnonzero(self.sieve[(g >> np.uint64(44)).astype(np.int64)])
        g, at = g[maybe], at[maybe]
        if not len(g):
            return out
        place = np.minimum(np.searchsorted(self.grams, g), len(self.grams) - 1)
        at = at[self.grams[place] == g]
        if not len(at):
            return out
        new = np.flatnonzero(np.concatenate([[True], (np.diff(at) > 1) | (t.doc[at[1:]] != t.doc[at[:-1]])]))
        for a, b in zip(at[new], at[np.append(new[1:] - 1, len(at) - 1)]):
            part = t.hash[a : b + self.k].tolist()
            for j, n in enumerate(self.automaton.matches(part)):
                if n:
                    out[a + j - n + 1 : a + j + 1] = True
        return out


def _parts(length: int, coverage: float, least: int):
    """Parts of items, with the match that the whole item needs."""

    def run(batches):
        for pdf in batches:
            texts = pdf["text"].tolist()
            for a, b in chunks(texts):
                t = tokenize(texts[a:b])
                first, out = t.first(), []
                for begin, end in zip(first[:-1], first[1:]):
                    n = int(end - begin)
                    if n >= least:
                        k = need(n, length, coverage, least)
                        out += [(t.hash[x : min(x + PART, end)].tobytes(), k, int(min(x + PART, end) - x)) for x in range(begin, max(begin + 1, end - k + 1), PART - k + 1)]
                yield pd.DataFrame(out, columns=["tokens", "k", "n"])

    return run


def _build(pdf: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"matcher": [pickle.dumps(Matcher((np.frombuffer(x, np.uint64), int(k)) for x, k in zip(pdf["tokens"], pdf["k"])))]})


def matchers(items: DataFrame, length: int, coverage: float, least: int) -> list[tuple[str, Broadcast]]:
    """Named broadcasts of pickled matchers, each of about MATCHER_TOKENS tokens, for items given as (text)."""
    parts = items.mapInPandas(_parts(length, coverage, least), "tokens binary, k int, n long")
    total = parts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    groups = -(-total // MATCHER_TOKENS)
    if not groups:
        return []
    built = parts.groupBy(F.pmod(F.xxhash64("tokens"), F.lit(groups))).applyInPandas(_build, "matcher binary")
    send = items.sparkSession.sparkContext.broadcast
    return [(uuid.uuid4().hex, send(bytes(row.matcher))) for row in built.toLocalIterator()]


_loaded: tuple[str, Matcher] | None = None


def _load(name: str, sent: Broadcast) -> Matcher:
    """The matcher; a worker keeps the last one only."""
    global _loaded
    if _loaded is None or _loaded[0] != name:
        _loaded = None
        _loaded = (name, pickle.loads(sent.value))
        sent.__dict__.pop("_value", None)  # it stays on disk
    return _loaded[1]


def _forget() -> None:
    global _loaded
    _loaded = None


def _clean(t: Tokens, covered: np.ndarray, limit: float) -> tuple[list[str | None], np.ndarray, np.ndarray, np.ndarray]:
    """Changed texts (None: unchanged), tokens removed, spans removed, whether the document goes."""
    removed = np.bincount(t.doc, covered, t.n_docs).astype(np.int64)
    total = t.counts()
    gone = removed > limit * total
    texts: list[str | None] = [None] * t.n_docs
    spans = np.zeros(t.n_docs, np.int64)
    first = t.first()
    for d in np.flatnonzero(removed):
        a, b = first[d], first[d + 1]
        c = np.flatnonzero(np.diff(covered[a:b].astype(np.int8), prepend=0, append=0))
        spans[d] = len(c) // 2
        at, parts = t.doc_at[d], []
        for s, e in zip(c[::2], c[1::2]):
            parts.append(t.raw[at : t.start[a + s]])
            at = t.end[a + e - 1]
        parts.append(t.raw[at : t.doc_at[d + 1] - 1])
        texts[d] = b"".join(parts).decode("utf-8", "replace")
    return texts, removed, spans, gone


_RESULT = "changed string, n_tokens long, n_removed long, n_spans long, dropped boolean"


def with_matches(docs: DataFrame, benchmark: DataFrame, column: str, length: int = LENGTH, coverage: float = COVERAGE, least: int = LEAST, document: float = DOCUMENT) -> DataFrame:
    """docs with a struct column: changed (the cleaned text where it differs), n_tokens, n_removed, n_spans, dropped."""
    items = benchmark.select(F.col("text").cast("string").alias("text")).where("text is not null").distinct()
    sent = matchers(items, length, coverage, least)

    @F.pandas_udf(_RESULT)
    def match(text: pd.Series) -> pd.DataFrame:
        hold("decontaminate", _forget)
        texts, out = text.tolist(), []
        ranges = list(chunks(texts))
        before: dict[int, np.ndarray] = {}
        for name, b in sent[:-1]:
            m = _load(name, b)
            for begin, end in ranges:
                found = m.covered(tokenize(texts[begin:end]))
                before[begin] = before[begin] | found if begin in before else found
        for begin, end in ranges:
            t = tokenize(texts[begin:end])
            covered = _load(*sent[-1]).covered(t) if sent else np.zeros(len(t.hash), bool)
            changed, removed, spans, gone = _clean(t, covered | before[begin] if begin in before else covered, document)
            out.append(pd.DataFrame({"changed": pd.Series(changed, dtype=object), "n_tokens": t.counts(), "n_removed": removed, "n_spans": spans, "dropped": gone}))
        return pd.concat(out, ignore_index=True)

    # else a filter on the result matches each text once more, in a second worker for each task
    return docs.withColumn(column, match.asNondeterministic()(docs["text"]))


def scan(docs: DataFrame, benchmark: DataFrame, **limits: float) -> DataFrame:
    """A row for each document: doc_id, the cleaned text (null if the document goes), counts of tokens and spans, dropped."""
    m = with_matches(docs.select("doc_id", "text"), benchmark, "__m", **limits)
    text = F.when(~F.col("__m.dropped"), F.coalesce("__m.changed", "text"))
    return m.select("doc_id", text.alias("text"), "__m.n_tokens", "__m.n_removed", "__m.n_spans", "__m.dropped")


def decontaminate(docs: DataFrame, benchmark: DataFrame, **limits: float) -> DataFrame:
    """The documents without test passages; columns as they came, n_chars (if there) of the new text."""
    name = spare(docs, "__m")
    m = with_matches(docs, benchmark, name, **limits).where(~F.col(f"{name}.dropped"))
    changed = F.col(f"{name}.changed")
    new = {"text": F.coalesce(changed, F.col("text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(changed.isNotNull(), F.char_length(changed)).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return m.withColumns(new).select(*[F.col(f"`{c}`") for c in docs.columns])
