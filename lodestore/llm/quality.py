"""Quality classifier: naive Bayes support vectors over n-gram indicators.

Features are indicators of token uni- and bigrams (words and runs of symbols) in 2**20 hashed
slots. Each is scaled by the log-count ratio of its class shares (add-one smoothed), and a
linear hinge-loss model is fitted on them by dual coordinate descent, then pulled towards its
mean weight. One model is fitted for each head: `quality` and `toxic`; a document is kept if
its quality is good and it isn't toxic.

Fitting uses at most max_rows labelled rows (those of least xxhash64 of the doc_id, ties by
doc_id) and of these no more than max_bytes of features, a bound of the fit alone; scoring covers
every document and its whole text.

Defined results: null or empty text has no features and gets the intercept's score; a label row
with a null doc_id or label is left out, and so are labels of unknown documents; of several texts
under one doc_id the fit takes the least; with no labels
of one of the classes the head scores 0 everywhere and rejects nothing; rows that repeat stay
and get equal scores; further columns don't matter, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import chunks, hold, spare, tokenize, trim, unique_sorted

BITS = 20
MAX_ROWS, MAX_BYTES = 8000, 256 << 20
#: Parts in which the fit's features come to the driver, one after the other.
PARTS = 16
_MASK = np.uint64((1 << BITS) - 1)


def features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (document, slot) pairs of a few texts, sorted."""
    t = tokenize(texts, symbols=True)
    two, at = t.ngrams(2)
    h = np.concatenate([t.hash, two]) >> np.uint64(64 - BITS)
    doc = np.concatenate([t.doc, t.doc[at]]).astype(np.uint64)
    keys = unique_sorted((doc << np.uint64(BITS)) | h)
    return (keys >> np.uint64(BITS)).astype(np.int64), (keys & _MASK).astype(np.int64)


@dataclass
class Head:
    """Scores are intercept + the sum of the weights of the slots that a text has."""

    weights: np.ndarray
    intercept: float


def dual_coordinate_descent(rows: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, cost: np.ndarray, epochs: int = 30, tolerance: float = 1e-3, seed: int = 7) -> tuple[np.ndarray, float]:
    """L2-regularised hinge loss over rows of slots scaled by ratio; the bias is one more feature of value 1.

    Each dual variable is set to its best value in [0, cost] in turn, in random order, until the
    projected gradient's range is under the tolerance.
    """
    w, bias = np.zeros(len(ratio), np.float64), 0.0
    alpha = np.zeros(len(rows))
    values = [ratio[r].astype(np.float32) for r in rows]
    q = np.array([float(v @ v) + 1.0 for v in values])
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        top, low = -np.inf, np.inf
        for i in rng.permutation(len(rows)):
            r, v = rows[i], values[i]
            g = y[i] * (w[r] @ v + bias) - 1.0
            pg = min(g, 0.0) if alpha[i] == 0 else max(g, 0.0) if alpha[i] == cost[i] else g
            top, low = max(top, pg), min(low, pg)
            if pg:
                new = min(max(alpha[i] - g / q[i], 0.0), cost[i])
                step = (new - alpha[i]) * y[i]
                alpha[i] = new
                w[r] += step * v
                bias += step
        if top - low < tolerance:
            break
    return w, bias


def fit(rows: list[np.ndarray], labels: np.ndarray, smoothing: float = 1.0, cost: float = 0.1, beta: float = 0.9) -> Head:
    """rows: distinct slots of each text; labels: 0 or 1."""
    size = 1 << BITS
    y = np.where(np.asarray(labels) == 1, 1.0, -1.0)
    if not len(rows) or (y == 1).all() or (y == -1).all():
        return Head(np.zeros(size, np.float32), 0.0)
    share = []
    for c in (1.0, -1.0):
        n = np.full(size, smoothing)
        for r, k in zip(rows, y):
            if k == c:
                n[r] += 1
        share.append(n / n.sum())
    ratio = np.log(share[0] / share[1])
    del share, n
    per_class = np.where(y == 1, len(y) / (2 * (y == 1).sum()), len(y) / (2 * (y == -1).sum()))
    w, bias = dual_coordinate_descent(rows, y, ratio, cost * per_class)
    used = np.zeros(size, bool)
    for r in rows:
        used[r] = True
    mean = np.abs(w[used]).mean()
    return Head((((1 - beta) * mean + beta * w) * ratio * used).astype(np.float32), float(beta * bias))


def scores(texts: list[str | None], heads: list[Head]) -> np.ndarray:
    """A row for each head."""
    out = np.zeros((len(heads), len(texts)))
    for a, b in chunks(texts):
        doc, slot = features(texts[a:b])
        for k, head in enumerate(heads):
            out[k, a:b] = np.bincount(doc, head.weights[slot].astype(np.float64), b - a) + head.intercept
    return out


def _to_features(batches):
    hold("quality")
    for pdf in batches:
        texts, out = pdf["text"].tolist(), []
        for a, b in chunks(texts):
            doc, slot = features(texts[a:b])
            edge = np.searchsorted(doc, np.arange(b - a + 1))
            out += [slot[s:e].astype(np.int32).tobytes() for s, e in zip(edge[:-1], edge[1:])]
        yield pd.DataFrame({"order": pdf["order"], "quality": pdf["quality"], "toxic": pdf["toxic"], "slots": out})
    trim()


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES) -> dict[str, Head]:
    """Heads `quality` and `toxic` from at most max_rows labelled rows and max_bytes of their features."""
    known = labels.select(F.col("doc_id").cast("long").alias("id"), F.col("quality").cast("int").alias("quality"), F.col("toxic").cast("int").alias("toxic")).where("id is not null and (quality is not null or toxic is not null)")
    order = F.xxhash64("id")
    # bounded by max_rows, so broadcast() is safe at any input size
    some = known.withColumn("order", order).orderBy("order", "id", "quality", "toxic").limit(max_rows)
    texts = docs.select(docs["doc_id"].cast("long").alias("id"), docs["text"].alias("text"))
    rows = texts.where("text is not null").join(F.broadcast(some), "id").groupBy("id", "order", "quality", "toxic").agg(F.min("text").alias("text"))
    sized = rows.mapInPandas(_to_features, "order long, quality int, toxic int, slots binary")
    so_far = Window.orderBy("order", "slots", "quality", "toxic").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = sized.withColumn("so_far", F.sum(F.length("slots")).over(so_far)).where(F.col("so_far") <= max_bytes).select("order", "slots", "quality", "toxic")
    found = [(o, bytes(s), q, t) for o, s, q, t in found.repartition(PARTS, "order").toLocalIterator()]
    found.sort(key=lambda r: (r[0], r[1], *((x is not None, x or 0) for x in r[2:])))
    heads = {}
    for k, name in ((2, "quality"), (3, "toxic")):
        has = [r for r in found if r[k] is not None]
        heads[name] = fit([np.frombuffer(r[1], np.int32) for r in has], np.array([r[k] for r in has]))
        trim()
    del found, has
    trim()
    return heads


def with_scores(docs: DataFrame, labels: DataFrame, column: str, max_rows: int = MAX_ROWS) -> DataFrame:
    """docs with a struct column: quality_score, quality, toxic_score, toxic, keep."""
    heads = train(docs, labels, max_rows)
    model = docs.sparkSession.sparkContext.broadcast([heads["quality"], heads["toxic"]])  # 8 MB, whatever the input

    @F.pandas_udf("quality_score double, quality int, toxic_score double, toxic int, keep boolean")
    def score(text: pd.Series) -> pd.DataFrame:
        hold("quality")
        good, bad = scores(text.tolist(), model.value)
        trim()
        quality, toxic = (good >= 0).astype(np.int32), (bad > 0).astype(np.int32)
        return pd.DataFrame({"quality_score": good.round(6), "quality": quality, "toxic_score": bad.round(6), "toxic": toxic, "keep": (quality == 1) & (toxic == 0)})

    return docs.withColumn(column, score(docs["text"]))


def classify(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """A row for each document: doc_id, the scores and decisions of both heads, and keep."""
    return with_scores(docs.select("doc_id", "text"), labels, "__s", max_rows).select("doc_id", "__s.*")


def keep_good(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """The documents that the classifier keeps; columns as they came."""
    name = spare(docs, "__s")
    return with_scores(docs, labels, name, max_rows).where(F.col(f"{name}.keep")).drop(name)
