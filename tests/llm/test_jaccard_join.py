import random
from collections import Counter, defaultdict

import re

import pytest

from lodestore.llm import jaccard_join as J

#: words, and ideographs one by one
TOKEN = re.compile(r"[一-鿿ぁ-ヿ]|[^\W_一-鿿ぁ-ヿ]+")


def brute(rows, n, threshold):
    sets = defaultdict(list)
    for i, x in rows:
        if i is None or x is None:
            continue
        t = TOKEN.findall(x.lower())
        s = frozenset(tuple(t[k : k + n]) for k in range(len(t) - n + 1)) or (frozenset([tuple(t)]) if t else None)
        if s:
            sets[i].append(s)
    out = {}
    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            j = max(len(x & y) / len(x | y) for x in sets[a] for y in sets[b])
            if j >= threshold - 1e-12:
                out[a, b] = round(j, 6)
    return out


def made(seed, docs=120):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(docs):
        if rows and rng.random() < 0.6:
            t = rng.choice(rows)[1].split()
            for _ in range(rng.randrange(0, 6)):
                t[rng.randrange(len(t))] = rng.choice(words)
        else:
            t = [rng.choice(words) for _ in range(rng.choice([1, 2, 5, 30, 60]))]
        rows.append((i, " ".join(t)))
    return rows


def pairs(spark, rows, n, threshold):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found, members = J.near_duplicate_pairs(df, n, threshold)
    same = {}
    for r in members.collect():
        same.setdefault(r.same_as, set()).add(r.doc_id)
    out = {}
    for a, b, s in [*(tuple(r) for r in found.collect()), *((a, a, 1.0) for a in same)]:
        for x in same[a]:
            for y in same[b]:
                if x != y:
                    out[min(x, y), max(x, y)] = max(s, out.get((min(x, y), max(x, y)), 0))
    return out


def components(ids, found):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in found:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("seed,block", [(3, 1500), (5, 5), (8, 1)])
def test_classes(spark, monkeypatch, seed, block):
    monkeypatch.setattr(J, "SUB_BLOCK", block)
    rows = made(seed, 90) + [(900, None), (901, ""), (902, "..."), (None, "w1 w2"), (3, made(seed, 90)[3][1])]
    found = brute(rows, 3, 0.5)
    ids = {i for i, _ in rows if i is not None}
    want = {i: (c, sum(i in p for p in found)) for i, c in components(ids, found).items()}
    out = J.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.class_id, r.n_links) for r in out} == want and len(out) == len(want)
    assert sum(n > 0 for _, n in want.values()) > 20


def test_copies_cost_no_pairs(spark):
    rows = [(i, "one text that very many documents have in common") for i in range(3000)] + [(5000, "one text that very many documents have in common now")]
    out = {r.doc_id: (r.class_id, r.n_links) for r in J.classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).collect()}
    assert out == {i: (0, 3000) for i, _ in rows}


def test_words_of_any_script(spark):
    a = "他说，今天的天气很好，我们一起去公园散步吧。"
    b = a.replace("公园", "学校")
    quoted = "one two three four “five” six – seven eight nine ten"
    rows = [(1, a), (2, b), (3, "天气"), (4, quoted), (5, quoted.replace("“", '"').replace("”", '"').replace("–", "-"))]
    found = brute(rows, 3, 0.5)
    assert set(found) == {(1, 2), (4, 5)} and found[4, 5] == 1.0
    assert pairs(spark, rows, 3, 0.5) == found


@pytest.mark.parametrize("n,threshold", [(3, 0.5), (1, 0.7), (2, 0.3)])
def test_all_pairs(spark, n, threshold):
    rows = made(n)
    assert pairs(spark, rows, n, threshold) == brute(rows, n, threshold)


def test_join_sets_across_sides():
    import numpy as np

    rng = np.random.default_rng(5)
    sets, prefixes, raw = [], [], []
    base = rng.integers(0, 1 << 40, 50).astype(np.uint64)
    for k in range(40):
        s = base.copy()
        s[rng.integers(0, 50, rng.integers(0, 12))] = rng.integers(0, 1 << 40, 1).astype(np.uint64)
        raw.append(np.unique(s))
    count = Counter(int(g) for s in raw for g in s)
    for k, s in enumerate(raw):
        shared = sorted((g for g in s if count[int(g)] > 1), key=lambda g: (count[int(g)], g))
        p = int(J.prefix_length(np.array([len(s)]), 0.6)[0]) - (len(s) - len(shared))
        sets.append((k, len(s), np.array(shared, np.uint64), np.array([count[int(g)] for g in shared], np.int32)))
        prefixes.append(max(0, min(p, len(shared))))
    side = np.array([k % 2 for k in range(40)])
    got = {(min(a, int(b)), max(a, int(b))): s for a, y, jac in J.join_sets(sets, prefixes, side, 0.6) for b, s in zip(y, jac)}
    want = {(a, b): len(set(raw[a]) & set(raw[b])) / len(set(raw[a]) | set(raw[b])) for a in range(40) for b in range(a) if side[a] != side[b]}
    assert {(min(k), max(k)) for k, v in want.items() if v >= 0.6} == set(got)


def test_edges(spark):
    rows = [(1, "a b c d e"), (2, "a b c d e"), (2, "a b c d e"), (None, "a b c d e"), (3, None), (4, ""), (5, "..."), (6, ""), (7, "hi"), (8, "HI!"), (2, "other words are in here")]
    assert pairs(spark, rows, 3, 0.5) == {(1, 2): 1.0, (7, 8): 1.0}
    assert pairs(spark, [], 3, 0.5) == {}
    long = "word " * 10 + " ".join(f"x{i}" for i in range(60_000))
    assert pairs(spark, [(1, long), (2, long + " more")], 3, 0.5) == {(1, 2): pytest.approx(0.99998, abs=1e-4)}


def test_sub_blocks(spark, monkeypatch):
    monkeypatch.setattr(J, "SUB_BLOCK", 5)
    rows = made(9, 80)
    assert pairs(spark, rows, 2, 0.4) == brute(rows, 2, 0.4)


def test_groups_and_columns(spark):
    rows = made(4)
    df = spark.createDataFrame([(i, t, "en", i) for i, t in rows] + [(None, "x", "en", 1)], "doc_id long, text string, key string, __gone long")
    kept = sorted(i for i, c in components([i for i, _ in rows], brute(rows, 3, 0.5)).items() if c == i)
    out = J.drop_near_duplicates(df)
    assert out.columns == df.columns
    assert sorted(r.doc_id for r in out.collect() if r.doc_id is not None) == kept
    assert out.where("doc_id is null").count() == 1


def test_short_near_copy_with_scattered_edits(spark):
    words = [f"w{i}" for i in range(24)]
    near = ["x" if i == 8 else w for i, w in enumerate(words)]
    near[16] = "y"
    rows = [(1, " ".join(words)), (2, " ".join(near))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert pairs(spark, rows, 3, 0.5) == brute(rows, 3, 0.5) == {(1, 2): round(16 / 28, 6)}
    assert [r.doc_id for r in J.drop_near_duplicates(df).collect()] == [1]
