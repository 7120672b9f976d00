"""Secret scans: a battery of randomness tests for each inferred encoding, with length-aware FDR control.

A candidate is a run of at least `shortest` characters that touches no other letter and is
maximal in one of the alphabets A-Za-z0-9 with +/_-, with +/, with _- and alone; so a name before
"=" or the directories of a path aren't tested with the secret only. All candidates, nested ones
too, take part in the tests. A candidate's encoding is the smallest alphabet that holds it. Tests:

* uniformity: Pearson's chi-squared statistic over the alphabet (equivalently the number of
  coinciding symbol pairs), with exact mean and variance for its length both under uniform
  symbols and under the letter frequencies of text, identifiers or numbers;
* runs: changes of character class (digit or not, upper case or not) against a random
  sequence, and against text, which rarely changes class;
* serial correlation of neighbouring symbols.

A secret must be consistent with randomness (each of the three p-values at least `random`), and
its p-value for "ordinary text" (uniformity and runs, by Fisher's method) must be a discovery of
the Benjamini-Hochberg procedure at level `fdr`, run in each stratum of encoding and length
(powers of two), so short tokens, of which ordinary text has many, need much more evidence than
long ones. Decimal numbers are as uniform as random ones and thus never a discovery.

The procedure sees all candidates of all documents: a first pass counts p-values (rounded up to
1/100 of a decade) in each stratum, the few counts give exact thresholds, a second pass decides.
No text is shuffled. Of nested secrets the outermost is reported; all that any covers is masked.

Defined results: null and empty texts have no candidates; a repeated token or row counts as
often as it occurs; ties share a decision; an empty table has no secrets and redacts nothing;
further columns stay, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import chunks, spare

SHORTEST, FDR, RANDOM = 16, 0.05, 1e-4
MASK = "[SECRET]"

DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: name, alphabet, sums of squares and cubes of its symbols' shares in ordinary tokens, chance of a class change there
ENCODINGS = [
    ("decimal", DIGITS, 0.1, 0.01, 0.0),
    ("hex", "0123456789abcdef", 0.1, 0.0102, 0.12),
    ("HEX", "0123456789ABCDEF", 0.1, 0.0102, 0.12),
    ("base32", UPPER + "234567", 0.062, 0.0052, 0.12),
    ("lower", LOWER, 0.0667, 0.0058, 0.0),
    ("upper", UPPER, 0.0667, 0.0058, 0.0),
    ("lower36", DIGITS + LOWER, 0.06, 0.005, 0.12),
    ("upper36", DIGITS + UPPER, 0.06, 0.005, 0.12),
    ("letters", UPPER + LOWER, 0.062, 0.0053, 0.12),
    ("base62", UPPER + LOWER + DIGITS, 0.055, 0.0046, 0.15),
    ("base64", UPPER + LOWER + DIGITS + "+/", 0.055, 0.0046, 0.18),
    ("base64url", UPPER + LOWER + DIGITS + "-_", 0.055, 0.0046, 0.18),
    ("mixed", UPPER + LOWER + DIGITS + "+/-_", 0.055, 0.0046, 0.2),
]
NAMES = np.array([e[0] for e in ENCODINGS])
_SIZE = np.array([len(e[1]) for e in ENCODINGS], np.float64)
_S2, _S3, _STICK = (np.array([e[i] for e in ENCODINGS]) for i in (2, 3, 4))
_INDEX = np.full((len(ENCODINGS), 256), -1, np.int16)
for _k, _e in enumerate(ENCODINGS):
    _INDEX[_k, [ord(c) for c in _e[1]]] = np.arange(len(_e[1]))
#: alphabets in which a candidate is a maximal run
_IN = np.zeros((4, 256), bool)
for _k, _s in enumerate(("+/-_", "+/", "-_", "")):
    _IN[_k, [ord(c) for c in DIGITS + LOWER + UPPER + _s]] = True
#: class of a character: digit, lower, upper, other
_CLASS = np.full(256, 3, np.int8)
for _c, _s in enumerate((DIGITS, LOWER, UPPER)):
    _CLASS[[ord(c) for c in _s]] = _c
#: share of class pairs that differ, for uniform symbols
_CHANGE = np.array([1 - sum((np.mean([_CLASS[ord(c)] == k for c in e[1]])) ** 2 for k in range(4)) for e in ENCODINGS])


def _upper_tail(z: np.ndarray) -> np.ndarray:
    return np.array([0.5 * math.erfc(x / math.sqrt(2)) for x in np.asarray(z, np.float64)])


def _letter(char: np.ndarray) -> bool:
    """Whether the bytes of one character are a letter's."""
    return char.tobytes().decode("utf-8", "replace").isalpha()


def candidates(raw: np.ndarray, shortest: int = SHORTEST) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of candidates in UTF-8 bytes, by start, the longer of two first; padding (=) isn't part of them."""
    found = []
    for table in _IN:
        step = np.diff(np.concatenate([[0], table[raw].view(np.int8), [0]]).astype(np.int8))
        start, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        long = end - start >= shortest
        found.append(np.stack([start[long], -end[long]], axis=1))
    both = np.unique(np.concatenate(found), axis=0)
    start, end = both[:, 0], -both[:, 1]
    touch = np.zeros(len(start), bool)
    for i in np.flatnonzero((start > 0) & (raw[np.maximum(start - 1, 0)] >= 128)):
        at = start[i] - 1
        while at > 0 and start[i] - at < 4 and raw[at] & 0xC0 == 0x80:
            at -= 1
        touch[i] = _letter(raw[at : start[i]])
    for i in np.flatnonzero((end < len(raw)) & (raw[np.minimum(end, len(raw) - 1)] >= 128)):
        lead = raw[end[i]]
        touch[i] |= _letter(raw[end[i] : end[i] + (4 if lead >= 0xF0 else 3 if lead >= 0xE0 else 2)])
    return start[~touch], end[~touch]


def battery(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> dict[str, np.ndarray]:
    """Encoding and p-values of each candidate. p_text: of ordinary text, by which secrets are found."""
    n = (end - start).astype(np.int64)
    m = len(n)
    at = np.concatenate([[0], np.cumsum(n)[:-1]]) if m else np.zeros(0, np.int64)
    who = np.repeat(np.arange(m), n)
    sym = raw[np.repeat(start - at, n) + np.arange(int(n.sum()))] if m else np.zeros(0, np.uint8)
    enc = np.full(m, len(ENCODINGS) - 1)
    for k in range(len(ENCODINGS) - 1, -1, -1):
        bad = np.bincount(who, _INDEX[k][sym] < 0, m)
        enc[bad == 0] = k
    f = n.astype(np.float64)
    key, count = np.unique(who * 256 + sym, return_counts=True)
    pairs = np.bincount(key // 256, count * (count - 1) / 2, m)
    all_pairs = f * (f - 1) / 2

    def moments(s2: np.ndarray, s3: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        var = all_pairs * s2 * (1 - s2) + f * (f - 1) * (f - 2) * np.maximum(s3 - s2 * s2, 0)
        return all_pairs * s2, np.sqrt(np.maximum(var, 1e-9))

    u = 1 / _SIZE[enc]
    mean, sd = moments(u, u * u)
    chi = 2 * _SIZE[enc] / f * (pairs + f / 2) - f
    p_chi = _upper_tail((pairs - 0.5 - mean) / sd)
    mean, sd = moments(_S2[enc], _S3[enc])
    p_text = _upper_tail(-(pairs + 0.5 - mean) / sd)

    cls = _CLASS[sym]
    differ = np.zeros(len(sym))
    differ[1:] = (cls[1:] != cls[:-1]) & (who[1:] == who[:-1])
    changes = np.bincount(who, differ, m)
    steps = np.maximum(f - 1, 1)
    c = _CHANGE[enc]
    mixed = c > 0
    # neighbouring changes depend on each other; twice the binomial variance bounds theirs
    sd = np.sqrt(np.maximum(2 * steps * c * (1 - c), 1e-9))
    p_runs = np.where(mixed, np.minimum(1, 2 * _upper_tail(np.maximum(np.abs(changes - steps * c) - 0.5, 0) / sd)), 1.0)
    share, stick = np.clip(changes / steps, 1e-12, 1 - 1e-12), np.where(_STICK[enc] > 0, _STICK[enc], 0.5)
    kl = share * np.log(share / stick) + (1 - share) * np.log((1 - share) / (1 - stick))
    p_sticky = np.where((_STICK[enc] > 0) & (share > stick), np.exp(-steps * kl), 1.0)  # Chernoff's bound

    rank = _INDEX[enc[who], sym].astype(np.float64)
    total, square = np.bincount(who, rank, m), np.bincount(who, rank * rank, m)
    prod = np.zeros(len(sym))
    prod[1:] = np.where(who[1:] == who[:-1], rank[1:] * rank[:-1], 0)
    mu = total / np.maximum(f, 1)
    var = square - f * mu * mu
    first, last = rank[at] if m else rank, rank[at + n - 1] if m else rank
    cov = np.bincount(who, prod, m) - mu * (2 * total - first - last) + steps * mu * mu
    serial = np.where(var > 1e-9, cov / np.maximum(var, 1e-9), 1.0)
    p_serial = np.minimum(1, 2 * _upper_tail(np.abs(serial + 1 / np.maximum(f, 1)) * np.sqrt(f)))

    one, two = np.maximum(p_text, 1e-290), np.maximum(p_sticky, 1e-290)
    x = -(np.log(one) + np.log(two))
    both = np.where(_STICK[enc] > 0, np.exp(-x) * (1 + x), one)
    both = np.where(NAMES[enc] == "decimal", 1.0, np.clip(both, 1e-290, 1.0))
    return {"encoding": enc, "n": n, "chi": chi, "serial": serial, "p_chi": p_chi, "p_runs": p_runs, "p_serial": p_serial, "p_text": both}


def _tested(texts: list[str | None], shortest: int, random: float) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray, dict[str, np.ndarray]]:
    """Encoded texts, and each candidate's document, start and end there with its tests, decided p-value grade and stratum."""
    raws = [(t or "").encode("utf-8", "replace") for t in texts]
    edge = np.zeros(len(raws) + 1, np.int64)
    np.cumsum([len(r) + 1 for r in raws], out=edge[1:])
    raw = np.frombuffer(b"\n".join(raws) + b"\n", np.uint8)
    start, end = candidates(raw, shortest)
    t = battery(raw, start, end)
    p = np.where(np.minimum(np.minimum(t["p_chi"], t["p_runs"]), t["p_serial"]) >= random, t["p_text"], 1.0)
    t["grade"] = np.floor(-100 * np.log10(p) + 1e-9).astype(np.int64)  # a higher grade is a lower p-value
    t["stratum"] = t["encoding"] * 64 + np.floor(np.log2(np.maximum(t["n"], 1))).astype(np.int64)
    doc = np.searchsorted(edge, start, "right") - 1
    return raws, doc, start - edge[doc], end - edge[doc], t


def thresholds(counts: pd.DataFrame, fdr: float) -> dict[int, int]:
    """Least grade that is a discovery in each stratum (Benjamini-Hochberg); counts: stratum, grade, n."""
    out = {}
    for stratum, part in counts.groupby("stratum"):
        part = part.sort_values("grade", ascending=False)
        m, found = part["n"].sum(), part["n"].cumsum()
        ok = 10.0 ** (-part["grade"] / 100) <= fdr * found / m
        if ok.any():
            out[int(stratum)] = int(part["grade"][ok].min())
    return out


def learn(docs: DataFrame, shortest: int = SHORTEST, fdr: float = FDR, random: float = RANDOM) -> dict[int, int]:
    def count(batches):
        for pdf in batches:
            texts = pdf["text"].tolist()
            for a, b in chunks(texts):
                *_, t = _tested(texts[a:b], shortest, random)
                yield pd.DataFrame({"stratum": t["stratum"], "grade": t["grade"], "n": 1}).groupby(["stratum", "grade"], as_index=False)["n"].sum()

    counted = docs.select(docs["text"].alias("text")).where("text is not null").mapInPandas(count, "stratum long, grade long, n long")
    return thresholds(counted.groupBy("stratum", "grade").agg(F.sum("n").alias("n")).toPandas(), fdr)


def _found(texts: list[str | None], limit: dict[int, int], shortest: int, random: float):
    raws, doc, start, end, t = _tested(texts, shortest, random)
    least = np.array([limit.get(int(s), 1 << 40) for s in t["stratum"]], np.int64)
    hit = np.flatnonzero(t["grade"] >= least)
    return raws, doc, start, end, t, hit


def scan(docs: DataFrame, shortest: int = SHORTEST, fdr: float = FDR, random: float = RANDOM) -> DataFrame:
    """A row for each secret: doc_id, its place in characters, encoding and test results; never the secret itself."""
    limit = learn(docs, shortest, fdr, random)

    @F.pandas_udf("array<struct<start:long,length:int,encoding:string,chi_squared:double,serial_correlation:double,p_uniform:double,p_runs:double,p_serial:double,p_text:double>>")
    def find(text: pd.Series) -> pd.Series:
        texts = text.tolist()
        out: list[list[tuple]] = [[] for _ in texts]
        for a, b in chunks(texts):
            raws, doc, start, end, t, hit = _found(texts[a:b], limit, shortest, random)
            last, reach = -1, 0
            for i in hit:
                if doc[i] == last and end[i] <= reach:  # within a secret
                    continue
                last, reach = doc[i], end[i]
                place = len(raws[doc[i]][: start[i]].decode("utf-8", "replace"))
                numbers = (float(f"{t[k][i]:.6g}") for k in ("chi", "serial", "p_chi", "p_runs", "p_serial", "p_text"))
                out[a + doc[i]].append((place, int(end[i] - start[i]), str(NAMES[t["encoding"][i]]), *numbers))
        return pd.Series(out, dtype=object)

    return docs.select("doc_id", F.explode(find(docs["text"])).alias("s")).select("doc_id", "s.*")


def redact(docs: DataFrame, shortest: int = SHORTEST, fdr: float = FDR, random: float = RANDOM) -> DataFrame:
    """The documents with secrets masked; columns as they came, n_chars (if there) of the new text."""
    limit = learn(docs, shortest, fdr, random)

    @F.pandas_udf("string")
    def mask(text: pd.Series) -> pd.Series:
        """The new text where something was masked, else null."""
        texts = text.tolist()
        out: list[str | None] = [None] * len(texts)
        for a, b in chunks(texts):
            raws, doc, start, end, _, hit = _found(texts[a:b], limit, shortest, random)
            for d in np.unique(doc[hit]):
                at, parts = 0, []
                for i in hit[doc[hit] == d]:
                    if not parts or start[i] >= at:
                        parts += [raws[d][at : start[i]], MASK.encode()]
                    at = max(at, end[i])
                out[a + d] = b"".join([*parts, raws[d][at:]]).decode("utf-8", "replace")
        return pd.Series(out, dtype=object)

    name = spare(docs, "__s")
    m = docs.withColumn(name, mask(docs["text"]))
    new = {"text": F.coalesce(F.col(name), F.col("text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col(name).isNotNull(), F.char_length(name)).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return m.withColumns(new).select(*[F.col(f"`{c}`") for c in docs.columns])
