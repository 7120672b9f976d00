"""Language ID: each document as a mixture of languages, by expectation-maximisation.

A language's model is its smoothed distribution of byte trigrams of lower-case words with their
borders, in 2**16 hashed slots. A document's words are draws from a mixture: EM estimates the
proportions from the words' likelihoods, until none moves by more than `tolerance`. The set of
languages is chosen by penalised likelihood: from all languages, the one of least proportion
goes as long as log-likelihood - penalty / 2 * (languages - 1) * log(words) doesn't fall.

Models are fitted on at most max_rows labelled documents of each language (different doc_ids,
those of least hash), a bound of the fit alone; every document is inferred from all its words.

Defined results: a null or empty text, or one without words, has no languages (empty lists, null
language); with no labelled rows no document has any; more than LANGUAGES different labels raise ValueError; rows without a doc_id or label aren't
fitted on, but inferred as all others; ties between proportions go to the language that sorts first;
repeated rows stay; further columns don't matter.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import IS_WORD, chunks, lower_bytes

SLOTS = 1 << 16
MAX_ROWS, PENALTY, TOLERANCE = 1000, 4.0, 1e-4
#: More labels than that aren't languages; it bounds the models.
LANGUAGES = 512


@dataclass
class Models:
    names: list[str]
    #: log-probabilities, a row for each language; the last slot is of no word and 0
    table: np.ndarray


def _trigrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slot at each byte, starts of words, and the first word of each document (and the end)."""
    low = [b"\n" + lower_bytes(t or "")[1] for t in texts]
    at = np.cumsum([0, *map(len, low)])
    raw = np.frombuffer(b"".join(low) + b"\n", np.uint8)
    word = IS_WORD[raw] & ~((raw >= 48) & (raw <= 57))
    b = np.where(word, raw, 32).astype(np.uint32)
    key = np.full(len(b), 0, np.uint32)
    key[1:-1] = (b[:-2] << 16) | (b[1:-1] << 8) | b[2:]
    slot = ((key * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.int32)
    slot[~word] = SLOTS
    start = np.flatnonzero(np.diff(word.view(np.int8), prepend=np.int8(0)) == 1)
    return slot, start, np.searchsorted(start, at)


def count_slots(texts: list[str | None]) -> np.ndarray:
    slot, *_ = _trigrams(texts)
    return np.bincount(slot, minlength=SLOTS + 1)[:SLOTS]


def models(counts: dict[str, np.ndarray], smoothing: float = 0.5) -> Models:
    names = sorted(counts)
    table = np.zeros((len(names), SLOTS + 1), np.float32)
    for k, name in enumerate(names):
        c = counts[name] + smoothing
        table[k, :SLOTS] = np.log(c / c.sum())
    return Models(names, table)


def _em(lik: np.ndarray, top: np.ndarray, doc: np.ndarray, start: np.ndarray, n: np.ndarray, share: np.ndarray, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
    """Proportions where they stay, and the log-likelihood there. share: a row for each document, 0 where a language is out."""
    final, live = share.copy(), np.arange(len(n))
    part, who, at, m = lik, doc, start, n
    while True:
        w = part * final[live][who]
        w /= np.maximum(w.sum(1, keepdims=True), 1e-300)
        new = np.add.reduceat(w, at, axis=0) / m[:, None]
        go = np.abs(new - final[live]).max(1) > tolerance
        final[live] = new
        if not go.any():
            break
        if not go.all():  # a document that has converged leaves
            words = go[who]
            part, m, live = part[words], m[go], live[go]
            at = np.concatenate([[0], np.cumsum(m)[:-1]])
            who = np.repeat(np.arange(len(m)), m)
    total = np.log(np.maximum((lik * final[doc]).sum(1), 1e-300)) + top
    return final, np.add.reduceat(total, start)


def infer(texts: list[str | None], m: Models, penalty: float = PENALTY, tolerance: float = TOLERANCE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Proportions (a row for each text; all 0 without words), penalised log-likelihood, words."""
    k = len(m.names)
    out, score = np.zeros((len(texts), k)), np.zeros(len(texts))
    slot, start, first = _trigrams(texts)
    n_all = np.diff(first)
    if not len(start) or not k:
        return out, score, n_all
    log = np.stack([np.add.reduceat(m.table[j][slot], start) for j in range(k)], axis=1).astype(np.float64)
    top = log.max(1)
    lik = np.exp(log - top[:, None])

    def rows(docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        n = n_all[docs]
        begin = np.concatenate([[0], np.cumsum(n)[:-1]])
        who = np.repeat(np.arange(len(docs)), n)
        return np.repeat(first[docs] - begin, n) + np.arange(n.sum()), who, begin, n

    live = np.flatnonzero(n_all)
    w, who, begin, n = rows(live)
    share, ll = _em(lik[w], top[w], who, begin, n, np.full((len(live), k), 1 / k), tolerance)
    fine = penalty / 2 * np.log(np.maximum(n, 2))
    out[live], score[live] = share, ll - fine * (k - 1)
    size = np.full(len(texts), k)
    for _ in range(k - 1):  # those that lost a language last time try the next
        docs = live
        share = out[docs].copy()
        least = np.argmin(np.where(share > 0, share, np.inf)[:, ::-1], axis=1)
        share[np.arange(len(docs)), k - 1 - least] = 0
        dead = share.sum(1) <= 0
        share[dead] = out[docs][dead]
        share /= share.sum(1, keepdims=True)
        w, who, begin, n = rows(docs)
        share, ll = _em(lik[w], top[w], who, begin, n, share, tolerance)
        fine = penalty / 2 * np.log(np.maximum(n, 2))
        new = ll - fine * ((share > 0).sum(1) - 1)
        better = ~dead & (new >= score[docs])
        out[docs[better]], score[docs[better]] = share[better], new[better]
        live = docs[better]
        size[live] -= 1
        if not len(live):
            break
    return out, score, n_all


def fit(docs: DataFrame, max_rows: int = MAX_ROWS) -> Models:
    """Models of all languages, each from at most max_rows labelled documents."""
    rows = docs.select(docs["doc_id"].alias("id"), docs["lang"].cast("string").alias("lang"), docs["text"].alias("text")).where("id is not null and lang is not null")
    rows = rows.withColumn("place", F.pmod(F.xxhash64("id"), F.lit(1 << 40)))
    size = rows.groupBy("lang").agg(F.approx_count_distinct("id", 0.02).alias("ids")).limit(LANGUAGES + 1).collect()
    if len(size) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    if not size:
        return models({})
    # a cut by hash that leaves some more than max_rows of each language, then the exact bound on those
    share = F.create_map(*[F.lit(x) for r in size for x in (r.lang, min(1.0, (2 * max_rows + 100) / max(r.ids, 1)))])
    near = rows.where(F.col("place") < F.lit(1 << 40) * share[F.col("lang")])
    first = Window.partitionBy("lang").orderBy("place", "id")
    some = near.select("lang", "place", "id").distinct().withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= max_rows).select("lang", "id")

    def count(batches):
        for pdf in batches:
            for lang, part in pdf.groupby("lang"):
                texts = part["text"].tolist()
                total = sum((count_slots(texts[a:b]) for a, b in chunks(texts)), np.zeros(SLOTS, np.int64))
                used = np.flatnonzero(total)
                yield pd.DataFrame({"lang": lang, "slot": used, "n": total[used]})

    # at most max_rows a language, so broadcast() is safe at any input size; the driver gets at most SLOTS counts a language
    found = near.join(F.broadcast(some), ["lang", "id"]).select("lang", "text").mapInPandas(count, "lang string, slot int, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n")).toPandas()
    counts: dict[str, np.ndarray] = {}
    for lang, part in found.groupby("lang"):
        counts[lang] = np.zeros(SLOTS, np.int64)
        counts[lang][part["slot"]] = part["n"]
    return models(counts)


def identify(docs: DataFrame, max_rows: int = MAX_ROWS, penalty: float = PENALTY) -> DataFrame:
    """A row for each document: doc_id, language, n_words, languages with their proportions (most first), penalised log-likelihood."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, max_rows))

    @F.pandas_udf("language string, n_words long, languages array<string>, proportions array<double>, score double")
    def run(text: pd.Series) -> pd.DataFrame:
        m, texts, out = shared.value, text.tolist(), []
        for a, b in chunks(texts):
            share, score, n = infer(texts[a:b], m, penalty)
            for s, x, c in zip(share, score, n):
                order = sorted(np.flatnonzero(s), key=lambda j: (-s[j], j))
                out.append((m.names[order[0]] if order else None, int(c), [m.names[j] for j in order], [round(float(s[j]), 4) for j in order], round(float(x), 3)))
        return pd.DataFrame(out, columns=["language", "n_words", "languages", "proportions", "score"])

    return docs.select("doc_id", run(docs["text"]).alias("r")).select("doc_id", "r.*")
