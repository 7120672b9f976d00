"""PII: high-recall generators propose overlapping spans, boosted trees score them, calibrated thresholds redact.

Generators (e-mail, IPv4, phone, card, SSN, IBAN, long numbers) propose all that may be personal
data. Each candidate becomes features of its format (checksums, octets, groups, separators) and
of its context (neighbouring characters, words nearby). Gradient-boosted trees with logistic
loss, trained here on generated examples with hard negatives, score it; scores are calibrated by
isotonic regression on held-out examples, which also give each kind's threshold. Of overlapping
spans that pass, the most probable is taken first (ties: the longer, then the earlier one, then
the kind that comes first in KINDS).

Defined results: a null text stays null with 0 spans; empty texts stay; equal texts are redacted
equally; an empty table gives no rows; further columns don't matter, whatever their names.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ["EMAIL", "IP", "PHONE", "CARD", "SSN", "IBAN", "NUMBER"]
#: of e-mail addresses, the name and the domain: each run of a name's characters is looked at once
_NAME, _DOMAIN = re.compile(r"[A-Za-z0-9._%+\-]+"), re.compile(r"@[A-Za-z0-9][A-Za-z0-9\-]*+(?:\.[A-Za-z0-9\-]++)*+")
GENERATORS = [
    re.compile(r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\.?\d)"),
    re.compile(r"(?<![\w+])\+?(?:\d{1,3}[ .\-]?)?\(?\d{2,4}\)?[ .\-]?\d{2,4}[ .\-]?\d{2,4}(?:[ .\-]?\d{2,4})?(?![\w])"),
    re.compile(r"(?<!\d)(?:\d[ \-]?){12,18}\d(?!\d)"),
    re.compile(r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])"),
    re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    re.compile(r"(?<!\d)\d{7,19}(?!\d)"),
]
_LIKELY = re.compile(r"[@\d]")
_PERSONAL = re.compile(r"phone|tel|call|mobile|cell|card|visa|pay|mail|contact|address|host|login|ssn|social|iban|account|user", re.I)
_OTHER = re.compile(r"order|version|\bv\b|release|build|\bid\b|ref|invoice|isbn|part|page|token|hash|serial|section|date|size|count", re.I)
CONTEXT = 32


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def iban_ok(s: str) -> bool:
    s = s.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def candidates(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind); overlaps are wanted."""
    if not _LIKELY.search(text):
        return []
    found = {(m.start(), m.end(), k) for k, g in enumerate(GENERATORS, 1) for m in g.finditer(text)}
    if "@" in text:
        reach = 0
        for m in _NAME.finditer(text):
            domain = _DOMAIN.match(text, m.end())
            if domain and m.end() > reach:
                found.add((max(m.start(), reach), domain.end(), 0))
                reach = domain.end()
    return sorted(found)


def _side(c: str) -> int:
    return 0 if not c or c.isspace() else 2 if c.isalnum() else 3 if c in "\"'=_/#" else 1


FEATURES = 24


def featurise(text: str, start: int, end: int, kind: int) -> list[float]:
    s = text[start:end]
    before, after = text[max(0, start - CONTEXT) : start], text[end : end + CONTEXT]
    digits = "".join(c for c in s if "0" <= c <= "9")
    groups = re.findall(r"\d+", s)
    octets = [int(g) for g in groups[:4]] if kind == 1 else []
    domain = s.rpartition("@")[2] if "@" in s else ""
    top = domain.rpartition(".")[2] if "." in domain else ""
    return [
        kind,
        len(s),
        len(digits),
        sum(c.isalpha() for c in s),
        sum(not c.isalnum() for c in s),
        float(12 <= len(digits) <= 19 and luhn(digits)),
        max(octets, default=0),
        float(any(len(g) > 1 and g[0] == "0" for g in groups[:4])),
        len(set(digits)),
        float(s[0] == "+"),
        float("(" in s),
        float("-" in s),
        float("." in s),
        float(" " in s),
        len(groups),
        len(groups[0]) if groups else 0,
        len(groups[-1]) if groups else 0,
        len(top) if top.isalpha() else 0,
        domain.count("."),
        float(kind == 5 and iban_ok(s)),
        _side(text[start - 1 : start]),
        _side(after[:1]),
        float(bool(_PERSONAL.search(before))),
        float(bool(_OTHER.search(before))),
    ]


# boosted trees


@dataclass
class Trees:
    """Trees of one depth, stored level by level: feature and cut of each node, value of each leaf."""

    depth: int
    base: float = 0.0
    feature: list[np.ndarray] = field(default_factory=list)
    cut: list[np.ndarray] = field(default_factory=list)
    leaf: list[np.ndarray] = field(default_factory=list)

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for f, c, v in zip(self.feature, self.cut, self.leaf):
            node = np.zeros(len(x), np.int64)
            for d in range(self.depth):
                at = (1 << d) - 1 + node
                node = node * 2 + (x[rows, f[at]] > c[at])
            out += v[node]
        return out


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 32, l2: float = 1.0) -> Trees:
    """Newton boosting of the logistic loss over histograms."""
    p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    t = Trees(depth, float(np.log(p / (1 - p))))
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    b = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], axis=1)  # x <= cuts[k] iff bin <= k
    width = bins + 1
    margin = np.full(len(y), t.base)
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-margin))
        g, h = q - y, np.maximum(q * (1 - q), 1e-9)
        feature, cut, node = np.zeros((1 << depth) - 1, np.int64), np.full((1 << depth) - 1, np.inf), np.zeros(len(y), np.int64)
        for d in range(depth):
            n = 1 << d
            best = np.full(n, 1e-9)
            for j, c in enumerate(cuts):
                if not len(c):
                    continue
                key = node * width + b[:, j]
                gs = np.bincount(key, g, n * width).reshape(n, width).cumsum(1)
                hs = np.bincount(key, h, n * width).reshape(n, width).cumsum(1)
                gl, hl, gt, ht = gs[:, : len(c)], hs[:, : len(c)], gs[:, -1:], hs[:, -1:]
                gain = gl**2 / (hl + l2) + (gt - gl) ** 2 / (ht - hl + l2) - gt**2 / (ht + l2)
                k = gain.argmax(1)
                top = gain[np.arange(n), k]
                better = top > best
                best[better] = top[better]
                feature[n - 1 : 2 * n - 1][better] = j
                cut[n - 1 : 2 * n - 1][better] = c[k[better]]
            at = n - 1 + node
            node = node * 2 + (x[np.arange(len(y)), feature[at]] > cut[at])
        leaf = -rate * np.bincount(node, g, 1 << depth) / (np.bincount(node, h, 1 << depth) + l2)
        t.feature.append(feature)
        t.cut.append(cut)
        t.leaf.append(leaf)
        margin = margin + leaf[node]
    return t


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Steps of the monotone least-squares fit (pool adjacent violators): scores and probabilities."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []
    for s, v in zip(score[order], y[order]):
        blocks.append([s, v, 1.0])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][2] >= blocks[-1][1] / blocks[-1][2]:
            _, v1, n1 = blocks.pop()
            blocks[-1][1] += v1
            blocks[-1][2] += n1
    return np.array([b[0] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


# generated examples

_SYLLABLES = "an ar be ca de el en er fo ga he in ka la le mi no or pa re sa st ti un ve wa".split()


def _examples(rng: np.random.Generator, n: int) -> list[tuple[str, int, int, bool]]:
    """(text, start, end, whether it is personal)."""

    def digits(k: int) -> str:
        return "".join(map(str, rng.integers(0, 10, k)))

    def word() -> str:
        return "".join(rng.choice(_SYLLABLES, rng.integers(1, 5)))

    def words() -> str:
        return " ".join(word() + ("." if rng.random() < 0.1 else "") for _ in range(rng.integers(1, 6)))

    def card(ok: bool) -> str:
        k = int(rng.choice([16, 16, 16, 15, 13, 19]))
        while True:
            s = digits(k)
            if luhn(s) == ok and s[0] != "0":
                break
        if k == 16 and rng.random() < 0.3:
            s = str(rng.choice([" ", "-"])).join(s[i : i + 4] for i in range(0, 16, 4))
        return s

    def octets() -> str:
        return ".".join(str(v) for v in rng.integers(1, 256, 4))

    def iban(ok: bool) -> str:
        body = digits(int(rng.integers(14, 20)))
        land = str(rng.choice(["DE", "FR", "ES", "NL", "GB"]))
        check = 98 - int("".join(str(int(c, 36)) for c in body + land + "00")) % 97
        return f"{land}{(check if ok else (check + int(rng.integers(1, 50))) % 97):02d}{body}"

    def phone() -> str:
        a, b, c = digits(3), digits(3), digits(4)
        forms = [f"+{rng.integers(1, 99)} ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"+{rng.integers(1, 99)} {a} {b} {c}", f"+{rng.integers(30, 50)}{a}{b}{c}", f"{a}.{b}.{c}"]
        return str(rng.choice(forms))

    def email() -> str:
        return f"{word()}{rng.choice(['.', '_', ''])}{rng.integers(0, 99)}@{word()}{rng.choice(['', str(rng.integers(0, 9))])}.{rng.choice(['com', 'org', 'net', 'example.com', 'de', 'co.uk', 'io'])}"

    good = [(email, "mail contact user"), (phone, "phone tel call mobile"), (lambda: card(True), "card visa pay"), (octets, "address host login"), (lambda: f"{rng.integers(100, 700)}-{rng.integers(10, 99)}-{digits(4)}", "ssn social"), (lambda: iban(True), "iban account")]
    bad = [
        (lambda: card(False), "order ref id"),
        (lambda: ".".join(str(v) for v in [*rng.integers(0, 255, 3), rng.integers(256, 999)]), "version section"),
        (lambda: ".".join(str(v) for v in rng.integers(0, 12, 4)), "version release build"),
        (lambda: f"{rng.integers(1990, 2030)}-{rng.integers(10, 12)}-{rng.integers(10, 28)}", "date"),
        (lambda: digits(int(rng.integers(7, 12))), "id invoice part count size"),
        (lambda: digits(int(rng.integers(12, 15))), "serial id"),
        (lambda: "".join(rng.choice(list("0123456789abcdef"), 40)), "token hash"),
        (lambda: f"{word()}@{word()}", "ref"),
        (lambda: iban(False), "part serial"),
        (lambda: f"978{digits(10)}", "isbn"),
        (lambda: f"{digits(2)}.{digits(3)}.{digits(3)}", "count size"),
    ]
    out = []
    for _ in range(n):
        ok = rng.random() < 0.5
        make, near = (good if ok else bad)[rng.integers(0, len(good if ok else bad))]
        s = make()
        cue = f"{rng.choice(near.split())}{rng.choice([' ', ': ', ' = ', ' no '])}" if rng.random() < (0.3 if ok else 0.4) else ""
        quote = '"' if not ok and rng.random() < 0.3 else ""
        tail = str(rng.choice(["", "", "", ".", ",", "###", "%%%", "!!"]))
        head = f"{words()} {cue}{quote}"
        out.append((f"{head}{s}{quote}{tail} {words()}", len(head), len(head) + len(s), ok))
    return out


@dataclass
class Detector:
    trees: Trees
    steps: np.ndarray
    probabilities: np.ndarray
    thresholds: np.ndarray

    def probability(self, x: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.steps, self.trees.margin(x), "right") - 1
        return self.probabilities[np.maximum(at, 0)]

    def spans(self, text: str) -> list[tuple[int, int, str, float]]:
        """Spans to redact, in order, without overlaps."""
        found = candidates(text)
        if not found:
            return []
        p = self.probability(np.array([featurise(text, *c) for c in found], np.float64))
        taken: list[tuple[int, int, str, float]] = []  # by start, without overlaps
        for i in sorted(range(len(found)), key=lambda i: (-p[i], found[i][0] - found[i][1], *found[i])):
            s, e, k = found[i]
            if p[i] >= self.thresholds[k]:
                at = bisect_left(taken, (s,))
                if (at == 0 or taken[at - 1][1] <= s) and (at == len(taken) or e <= taken[at][0]):
                    taken.insert(at, (s, e, KINDS[k], float(p[i])))
        return taken


def _rows(examples: list[tuple[str, int, int, bool]]) -> tuple[np.ndarray, np.ndarray]:
    """Features of all candidates; personal if they are the example's span of a positive."""
    x, y = [], []
    for text, a, b, ok in examples:
        for s, e, k in candidates(text):
            inside = s < b and a < e
            if ok and inside and (s, e) != (a, b) and s >= a and e <= b:
                y.append(0)  # a part only
            else:
                y.append(int(ok and (s, e) == (a, b)))
            x.append(featurise(text, s, e, k))
    return np.array(x, np.float64), np.array(y)


@lru_cache(1)
def detector(n: int = 6000, seed: int = 11, recall: float = 0.99) -> Detector:
    """Trained on generated examples; each kind's threshold keeps this recall on held-out ones, at 0.5 at most."""
    rng = np.random.default_rng(seed)
    x, y = _rows(_examples(rng, n))
    trees = boost(x, y)
    hx, hy = _rows(_examples(rng, n // 2))
    steps, probabilities = isotonic(trees.margin(hx), hy)
    d = Detector(trees, steps, probabilities, np.full(len(KINDS), 0.5))
    p = d.probability(hx)
    for k in range(len(KINDS)):
        own = np.sort(p[(hx[:, 0] == k) & (hy == 1)])
        if len(own):
            d.thresholds[k] = min(0.5, max(0.1, own[int(len(own) * (1 - recall))]))
    return d


def redact_text(d: Detector, text: str) -> tuple[str, list[tuple[int, int, str, float]]]:
    spans, at, parts = d.spans(text), 0, []
    for s, e, kind, _ in spans:
        parts += [text[at:s], f"[{kind}]"]
        at = e
    return "".join([*parts, text[at:]]), spans


def redact(docs: DataFrame) -> DataFrame:
    """A row for each document: doc_id, text with its personal data masked, the number of spans, and kinds and least probability of them."""
    model = docs.sparkSession.sparkContext.broadcast(detector())  # some 10 kB

    @F.pandas_udf("changed string, n_spans int, kinds array<string>, least_probability double")
    def run(text: pd.Series) -> pd.DataFrame:
        out = []
        for t in text:
            new, spans = redact_text(model.value, t) if t else (None, [])
            out.append((new if spans else None, len(spans), [s[2] for s in spans], round(min(s[3] for s in spans), 6) if spans else None))
        frame = pd.DataFrame(out, columns=["changed", "n_spans", "kinds", "least_probability"])
        frame["n_spans"] = frame["n_spans"].astype("int32")
        frame["least_probability"] = frame["least_probability"].astype("float64")
        return frame

    return docs.select("doc_id", "text", run(docs["text"]).alias("__r")).select("doc_id", F.coalesce("__r.changed", "text").alias("text"), "__r.n_spans", "__r.kinds", "__r.least_probability")
