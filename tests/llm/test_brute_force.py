"""Plain versions of the operators that SQL can't express, sharing no code, tokens or constants with them, and of the pipeline."""

import math
import random
import re

import pytest
import sentencepiece
from pyspark.sql import functions as F

from lodestore.llm import pieces, pii, quality, secrets

from .test_jaccard_join import brute as brute_pairs
from .test_jaccard_join import components

DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ENCODINGS = [
    ("decimal", DIGITS, 0.1, 0.01, 0), ("hex", DIGITS + "abcdef", 0.1, 0.0102, 0.12), ("HEX", DIGITS + "ABCDEF", 0.1, 0.0102, 0.12), ("base32", UPPER + "234567", 0.062, 0.0052, 0.12),
    ("lower", LOWER, 0.0667, 0.0058, 0), ("upper", UPPER, 0.0667, 0.0058, 0), ("lower36", DIGITS + LOWER, 0.06, 0.005, 0.12), ("upper36", DIGITS + UPPER, 0.06, 0.005, 0.12),
    ("letters", UPPER + LOWER, 0.062, 0.0053, 0.12), ("base62", UPPER + LOWER + DIGITS, 0.055, 0.0046, 0.15), ("base64", UPPER + LOWER + DIGITS + "+/", 0.055, 0.0046, 0.18),
    ("base64url", UPPER + LOWER + DIGITS + "-_", 0.055, 0.0046, 0.18), ("mixed", UPPER + LOWER + DIGITS + "+/-_", 0.055, 0.0046, 0.2),
]


def tail(z):
    return 0.5 * math.erfc(z / math.sqrt(2))


def kind(c):
    return 0 if c in DIGITS else 1 if c in LOWER else 2 if c in UPPER else 3


def brute_battery(s):
    name, alphabet, s2, s3, stick = next(e for e in ENCODINGS if set(s) <= set(e[1]))
    n, size = len(s), len(alphabet)
    same = sum(s[i] == s[j] for i in range(n) for j in range(i))
    all_ = n * (n - 1) / 2
    p_chi = tail((same - 0.5 - all_ / size) / math.sqrt(max(all_ / size * (1 - 1 / size), 1e-9)))
    var = all_ * s2 * (1 - s2) + n * (n - 1) * (n - 2) * max(s3 - s2 * s2, 0)
    p_text = tail(-(same + 0.5 - all_ * s2) / math.sqrt(max(var, 1e-9)))
    change = 1 - sum((sum(kind(c) == k for c in alphabet) / size) ** 2 for k in range(4))
    changes = sum(kind(a) != kind(b) for a, b in zip(s, s[1:]))
    p_runs = 1.0
    if change > 0:
        p_runs = min(1, 2 * tail(max(abs(changes - (n - 1) * change) - 0.5, 0) / math.sqrt(max(2 * (n - 1) * change * (1 - change), 1e-9))))
    p_sticky = 1.0
    if stick and changes / (n - 1) > stick:
        q = min(max(changes / (n - 1), 1e-12), 1 - 1e-12)
        p_sticky = math.exp(-(n - 1) * (q * math.log(q / stick) + (1 - q) * math.log((1 - q) / (1 - stick))))
    r = [alphabet.index(c) for c in s]
    mu = sum(r) / n
    var = sum((x - mu) ** 2 for x in r)
    serial = sum((a - mu) * (b - mu) for a, b in zip(r, r[1:])) / var if var > 1e-9 else 1.0
    p_serial = min(1, 2 * tail(abs(serial + 1 / n) * math.sqrt(n)))
    x = -math.log(max(p_text, 1e-290)) - math.log(max(p_sticky, 1e-290))
    p = math.exp(-x) * (1 + x) if stick else max(p_text, 1e-290)
    return name, 1.0 if name == "decimal" or min(p_chi, p_runs, p_serial) < 1e-4 else min(max(p, 1e-290), 1)


def brute_secrets(texts):
    """For each text, the places of its secrets (outermost ones), by a plain Benjamini-Hochberg over all candidates."""
    found = []
    for k, t in enumerate(texts):
        spans = {m.span() for more in (r"+/\-_", "+/", r"\-_", "") for m in re.finditer(rf"[A-Za-z0-9{more}]{{16,}}", t or "")}
        for a, b in spans:
            if not any(ord(c) > 127 and c.isalpha() for c in (t[a - 1 : a], t[b : b + 1]) if c):
                name, p = brute_battery(t[a:b])
                found.append((k, a, b, (name, int(math.log2(b - a))), math.floor(-100 * math.log10(p) + 1e-9)))
    out = [[] for _ in texts]
    for k, a, b, stratum, grade in sorted(found, key=lambda x: (x[0], x[1], -x[2])):
        own = [g for *_, s, g in found if s == stratum]
        ok = [g for g in set(own) if 10 ** (-g / 100) <= 0.05 * sum(x >= g for x in own) / len(own)]
        if ok and grade >= min(ok) and not any(c <= a and b <= d for c, d in out[k]):
            out[k].append((a, b))
    return out


def secret_texts(seed, n=60):
    rng = random.Random(seed)
    words = "the secret of this long internationalization is a token in some/path/to/configuration_file.name and nothing-more-than-that".split()
    out = []
    for _ in range(n):
        t = [rng.choice(words) for _ in range(rng.randrange(3, 40))]
        if rng.random() < 0.4:
            alphabet, size = rng.choice([(DIGITS + "abcdef", 40), (UPPER + LOWER + DIGITS, 32), (UPPER + LOWER + DIGITS + "+/", 44), (DIGITS, 20), (LOWER, 24), (UPPER + "234567", 32)])
            s = "".join(rng.choice(alphabet) for _ in range(size))
            t.insert(rng.randrange(len(t)), rng.choice([s, f"key={s}", f'"{s}"', f"/v1/{s}/x", f"“{s}”", f"é{s}", f"{s}=="]))
        out.append(" ".join(t))
    return [*out, None, "", out[0], out[0], "=" * 3000, "x" * 5000]


@pytest.mark.parametrize("seed", [1, 2])
def test_secrets(spark, seed):
    texts = secret_texts(seed)
    df = spark.createDataFrame([(i, t, "a") for i, t in enumerate(texts)], "doc_id long, text string, start string").repartition(3)
    want = brute_secrets(texts)
    assert sorted((r.doc_id, r.start, r.start + r.length) for r in secrets.scan(df).collect()) == sorted((i, *s) for i, x in enumerate(want) for s in x)
    assert sum(map(len, want)) > 5


# the quality classifier


def indicators(text):
    t = re.findall(r"[a-z0-9\u0080-\U0010ffff]+|[!-/:-@\[-`{-~]+", (text or "").lower())
    return {*t, *zip(t, t[1:])}


def brute_head(train):
    """Score of a set of indicators; train: (indicators, 0 or 1)."""
    if len({y for _, y in train}) < 2:
        return lambda x: 0.0
    counts = [{}, {}]
    for x, y in train:
        for f in x:
            counts[y][f] = counts[y].get(f, 0) + 1
    total = [sum(c.values()) + 2**20 for c in counts]
    used = {*counts[0], *counts[1]}
    ratio = {f: math.log((counts[1].get(f, 0) + 1) / total[1]) - math.log((counts[0].get(f, 0) + 1) / total[0]) for f in used}
    size = [sum(y == k for _, y in train) for k in (0, 1)]
    w, bias, alpha = dict.fromkeys(used, 0.0), 0.0, [0.0] * len(train)
    while True:
        moved = 0.0
        for i, (x, y) in enumerate(train):
            s, cost = 2 * y - 1, 0.1 * len(train) / (2 * size[y])
            g = s * (sum(w[f] * ratio[f] for f in x) + bias) - 1
            new = min(max(alpha[i] - g / (sum(ratio[f] ** 2 for f in x) + 1), 0.0), cost)
            step = (new - alpha[i]) * s
            alpha[i], bias, moved = new, bias + step, max(moved, abs(step))
            for f in x:
                w[f] += step * ratio[f]
        if moved < 1e-10:
            break
    mean = sum(map(abs, w.values())) / len(w)
    return lambda x: sum((0.1 * mean + 0.9 * w[f]) * ratio[f] for f in x if f in used) + 0.9 * bias


def brute_quality(docs, labels):
    """(quality score, toxic score) for each (doc_id, text)."""
    heads = []
    for k in (1, 2):
        train = []
        for row in labels:
            own = [t for i, t in docs if i == row[0] and i is not None and t is not None]
            if own and row[k] is not None:
                train.append((indicators(min(own)), row[k]))
        heads.append(brute_head(train))
    return [tuple(h(indicators(t)) for h in heads) for _, t in docs]


def labelled(seed, n=60):
    rng = random.Random(seed)
    good, poor, toxic = "a careful study of rivers and their banks in winter".split(), "buy now click here cheap !!! $$$ offer free".split(), "you stupid hateful idiot".split()
    docs, labels = [], []
    for i in range(n):
        q, x = int(rng.random() < 0.7), int(rng.random() < 0.2)
        t = [rng.choice(good if q else poor) for _ in range(rng.randrange(10, 30))]
        if x:
            t[3:3] = toxic
        docs.append((i, " ".join(t)))
        if i % 3 < 2:
            labels.append((i, q, x))
    return docs, labels


def test_quality(spark):
    docs, labels = labelled(4)
    docs += [(60, None), (61, ""), (None, docs[0][1]), docs[0], docs[1], (2, "zzz another text of it")]
    labels += [(None, 1, 0), (3000, 1, 1), (4, None, None), (7, None, 1), (62, 1, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("quality", F.lit("x"))
    got = quality.classify(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    want = brute_quality(docs, labels)
    key = lambda r: (r[0] is None, r[0], r[1])
    for g, w in zip(sorted([(r.doc_id, r.quality_score, r.toxic_score) for r in got], key=key), sorted([(i, *s) for (i, _), s in zip(docs, want)], key=key)):
        assert g[0] == w[0] and g[1:] == pytest.approx(w[1:], abs=0.03)
    for r in got:
        assert r.keep == (r.quality_score >= 0 and r.toxic_score <= 0)


# personal data

PATTERNS = [
    r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9](?:[A-Za-z0-9\-]*\.?[A-Za-z0-9\-]+)*",
    r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\.?\d)",
    r"(?<![\w+])\+?(?:\d{1,3}[ .\-]?)?\(?\d{2,4}\)?[ .\-]?\d{2,4}[ .\-]?\d{2,4}(?:[ .\-]?\d{2,4})?(?![\w])",
    r"(?<!\d)(?:\d[ \-]?){12,18}\d(?!\d)",
    r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])",
    r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    r"(?<!\d)\d{7,19}(?!\d)",
]


def brute_spans(d, text):
    """Trees walked node by node, steps looked up one by one, overlaps by comparing with all that is taken."""
    found = []
    for k, p in enumerate(PATTERNS):
        for m in re.finditer(p, text):
            x = pii.featurise(text, m.start(), m.end(), k)
            margin = d.trees.base
            for feature, cut, leaf in zip(d.trees.feature, d.trees.cut, d.trees.leaf):
                node = 0
                for level in range(d.trees.depth):
                    at = 2**level - 1 + node
                    node = 2 * node + (x[feature[at]] > cut[at])
                margin += leaf[node]
            p_own = d.probabilities[0]
            for s, q in zip(d.steps, d.probabilities):
                if s <= margin:
                    p_own = q
            if p_own >= d.thresholds[k]:
                found.append((-p_own, m.start() - m.end(), m.start(), m.end(), k))
    taken = []
    for _, _, s, e, k in sorted(found):
        if not any(s < b and a < e for a, b, _ in taken):
            taken.append((s, e, ["EMAIL", "IP", "PHONE", "CARD", "SSN", "IBAN", "NUMBER"][k]))
    return sorted(taken)


def test_personal_spans(spark, sf):
    rng = random.Random(6)
    texts = [t for t, *_ in pii._examples(__import__("numpy").random.default_rng(77), 150)]
    texts += [" ".join(rng.choice(["mail", "a.b@c.org", "10.1.2.3", "555-123-4567", "x@y", "1234 5678 9012 3456", "078-05-1120", "DE89370400440532013000", "12345678", ",", "tel"]) for _ in range(30)) for _ in range(40)]
    texts += [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect() if r.text and len(r.text) < 5000]
    texts += ["", texts[0], "a@b.co a@b.co", "@" * 50, "a@b@c.d@e.fg"]
    d = pii.detector()
    got = {r.doc_id: r for r in pii.redact(spark.createDataFrame([*enumerate(texts), (None, None)], "doc_id long, text string").withColumn("kinds", F.lit(1))).collect()}
    n = 0
    for i, t in enumerate(texts):
        want = brute_spans(d, t)
        n += len(want)
        assert [s[:3] for s in d.spans(t)] == want
        at, parts = 0, []
        for s, e, k in want:
            parts += [t[at:s], f"[{k}]"]
            at = e
        assert got[i].text == "".join([*parts, t[at:]]) and got[i].kinds == [k for *_, k in want]
    assert n > 200 and got[None].text is None and got[None].n_spans == 0


def test_personal_data_of_very_long_texts():
    import time

    d, rng = pii.detector(), random.Random(3)
    text = " ".join(f"call {rng.randrange(100, 999)}-{rng.randrange(100, 999)}-{rng.randrange(1000, 9999)}" for _ in range(60_000))
    began = time.time()
    assert len(d.spans(text)) > 59_000
    assert d.spans("7 " + "x" * 3_000_000) == [] and time.time() - began < 60


# encoding and decoding


def test_decoding(spark):
    texts = ["one two, three.", "", None, "déjà vu 漢字", "  two  spaces ", "a\nb\tc"]
    rows = pieces.encode(spark.createDataFrame([*enumerate(texts)], "doc_id long, text string"))
    assert {r.doc_id: r.text for r in pieces.decode(rows).collect()} == dict(enumerate(texts))


# the pipeline


def brute_pipeline(docs, labels, items, model):
    """docs: (doc_id, text). (doc_id, ids) of what all five stages leave."""
    kept = [d for d, (q, x) in zip(docs, brute_quality(docs, labels)) if q >= 0 and x <= 0]
    ids = {i for i, _ in kept if i is not None}
    first = components(ids, brute_pairs(kept, 3, 0.5))
    kept = [(i, t) for i, t in kept if i is None or first[i] == i]
    word, out = re.compile(r"[^\W_]+"), []
    for i, t in kept:
        spans = [m.span() for m in word.finditer(t or "")]
        words = [t[a:b].lower() for a, b in spans]
        hit = set()
        for item in items:
            v = word.findall((item or "").lower())
            if len(v) >= 5:
                k = min(13, max(5, math.ceil(0.8 * len(v) - 1e-9)))
                runs = {tuple(v[j : j + k]) for j in range(len(v) - k + 1)}
                hit |= {x for j in range(len(words) - k + 1) if tuple(words[j : j + k]) in runs for x in range(j, j + k)}
        if len(hit) > 0.5 * len(words):
            continue
        gone = [(spans[x][0], spans[x + 1][0] if x + 1 in hit else spans[x][1]) for x in sorted(hit)]
        for a, b in reversed(gone):
            t = t[:a] + t[b:]
        out.append((i, t))
    for k, spans in enumerate(brute_secrets([t for _, t in out])):
        i, t = out[k]
        for a, b in reversed(spans):
            t = f"{t[:a]}[SECRET]{t[b:]}"
        out[k] = (i, t)
    return [(i, None if t is None else model.encode(t)) for i, t in out]


@pytest.mark.parametrize("empty", [False, True])
def test_pipeline(spark, tmp_path, empty):
    import corpus_pipeline

    rng = random.Random(8)
    docs, labels = labelled(5, 50)
    items = [" ".join(rng.choice(["river", "bank", "winter", "ice", "study", "flow", "stone"]) + str(k) for k in range(n)) for n in (8, 30, 3)] + [None, ""]
    extra = [t for t in secret_texts(3, 25) if t is not None]
    docs += [(100 + i, f"{docs[0][1]} {t}" if t else t) for i, t in enumerate(extra)]
    docs += [(200 + i, f"{t} {items[i % 2]} and {docs[i + 4][1]}") for i, (_, t) in enumerate(docs[:12])] + [(230, items[1])]
    docs += [(300 + i, t) for i, (_, t) in enumerate(docs[5:15])] + [(320 + i, (t or "") + " end") for i, (_, t) in enumerate(docs[50:60])]
    docs += [(None, "a careful study of nothing"), (400, None), docs[3], docs[3]]
    rows = [] if empty else [(i, t, "en", "web", len(t or ""), "g", 1) for i, t in docs]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, gone string, __m int").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([*enumerate(items)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    model = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    want = [] if empty else brute_pipeline(docs, labels, items, model)
    assert sorted(((r.doc_id, r.ids) for r in got), key=repr) == sorted(want, key=repr)
    assert all(r.checked in (True, None) for r in got)
    if not empty:
        assert 20 < len(want) < len(docs) - 20
        assert not any("river0 " in model.decode(x or []) for _, x in want) and any("[SECRET]" in model.decode(x or []) for _, x in want)
