"""Brute-force versions, round trips and edge cases of the operators that SQL can't express, and SQL for the others."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestore.llm import decontaminate, flac, language, pieces, pii, quality, secrets, sharding, url_templates
from lodestore.llm.queries import ORACLE, QUERIES

from ..oracle import compare, connect

EDGES = [(1, None, "a"), (2, "", "a"), (None, "some words are here", None), (4, "x" * 70_000, "b"), (5, "same text twice", "b"), (5, "same text twice", "b")]
SCHEMA = "doc_id long, text string, __s string"


@pytest.fixture
def edges(spark):
    return spark.createDataFrame(EDGES, SCHEMA), spark.createDataFrame([], SCHEMA)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_as_sql(spark, sf, name):
    assert compare(QUERIES[name](spark, sf), ORACLE[name], connect(sf)) is None


# FLAC


@pytest.mark.parametrize("bits", [8, 16, 24])
@pytest.mark.parametrize("channels", [1, 2])
def test_flac_round_trip(bits, channels):
    rng, top = np.random.default_rng(bits), 1 << (bits - 1)
    t = np.arange(1111)
    waves = [np.stack([(np.sin(t / (9 + c)) * top * 0.6).astype(int) + rng.integers(-5, 6, len(t)) for c in range(channels)]), rng.integers(-top, top, (channels, 500)), np.full((channels, 300), 7), np.zeros((channels, 1), int)]
    for x in waves:
        data = flac.encode(x, bits=bits, block=400)
        frames = list(flac.decode_frames(data))
        assert all(f.error is None for f in frames)
        assert (np.concatenate([f.samples for f in frames], axis=1) == x).all()
        assert [f.first for f in frames] == list(range(0, x.shape[1], 400))


def test_flac_stream_of_the_standard():
    """The first example file of RFC 9639."""
    data = bytes.fromhex("664c614380000022100010000000 0f00000f0ac442f0000000013e84b41807dc690307586a3dad1a2e0ffff869180000bf0358fd03128baa9a".replace(" ", ""))
    rows = flac._rows(data)
    assert [(r[2], r[3], r[4], r[5], r[8], r[11]) for r in rows] == [(1, 2, 44100, 16, True, True)]
    assert np.frombuffer(rows[0][10], "<i2").tolist() == [25588, 10416]


def test_crc16_of_all_lengths():
    def plain(data):
        c = 0
        for b in data:
            c ^= b << 8
            for _ in range(8):
                c = (c << 1 ^ 0x8005 if c & 0x8000 else c << 1) & 0xFFFF
        return c

    data = random.Random(1).randbytes(9000)
    for n in (0, 1, 2, 3, 255, 4095, 4096, 4097, 4098, 8193, 9000):
        assert flac.crc16(data[:n]) == plain(data[:n])


def test_flac_damaged_streams_never_crash():
    rng, good = random.Random(7), []
    for bits, order in ((16, 4), (8, 2), (24, 8), (32, 3)):
        t = np.arange(900)
        x = np.stack([(2 ** (bits - 2) * np.sin(t / 9)).astype(np.int64), (2 ** (bits - 3) * np.cos(t / 30)).astype(np.int64) + t % 5])
        good.append(flac.encode(x, bits=bits, order=order))
    worse = 0
    for _ in range(5000):
        data = bytearray(rng.choice(good))
        for _ in range(rng.randrange(1, 5)):
            data[rng.randrange(len(data))] ^= 1 << rng.randrange(8)
        data = bytes(data[: rng.randrange(len(data))] if rng.random() < 0.2 else data)
        rows = flac._rows(data)
        worse += not rows or not all(r[8] for r in rows) or not rows[0][11]
    assert worse > 4800


def test_flac_key_named_like_an_output(spark):
    x = np.arange(50)[None, :]
    df = flac.blocks(spark.createDataFrame([(1, flac.encode(x)), (2, None), (3, b"junk")], "ok long, flac binary"), "ok")
    assert len(set(df.columns)) == len(df.columns) and [(r.ok, r.ok_, r.md5_ok) for r in df.collect()] == [(1, True, True), (3, False, None)]


def test_flac_damage_and_seek(spark):
    x = np.stack([(np.sin(np.arange(1600) / 20) * 9000).astype(int)] * 2)
    good = flac.encode(x)
    second = list(flac.decode_frames(good))[1]
    bad = bytearray(good)
    bad[second.at + second.size // 2] ^= 0x10
    rows = [(1, good), (2, bytes(bad)), (3, None), (4, b"no stream"), (5, b""), (1, good)]
    df = flac.blocks(spark.createDataFrame(rows, "k long, flac binary"), "k")
    got = df.collect()
    assert [(r.block, r.ok) for r in got if r.k == 2] == [(0, True), (1, False), (2, True), (3, True)]
    assert sum(r.k == 1 for r in got) == 8 and not any(r.k == 3 for r in got)
    assert [(r.ok, r.pcm) for r in got if r.k in (4, 5)] == [(False, None)] * 2
    hit = flac.seek(df.where("k = 2"), "k", 1234).first()
    assert hit.first_sample == 1200 and int.from_bytes(hit.pcm[hit.pcm_offset : hit.pcm_offset + 2], "little", signed=True) == x[0, 1234]
    assert flac.blocks(spark.createDataFrame([], "k long, flac binary"), "k").count() == 0


# secrets


def test_secrets_are_found_and_prose_is_not(spark):
    rng = random.Random(3)
    key = "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(40))
    token = "".join(rng.choice("0123456789abcdef") for _ in range(64))
    prose = "the internationalisation of misunderstandings and counterrevolutionaries some_function_name_in_code 2024010112345678"
    rows = [(1, f"key={key} end"), (2, f"token {token}"), (3, prose), (4, None), (5, ""), (5, "")] + [(i, prose) for i in range(10, 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in secrets.scan(docs).collect()) == [1, 2]
    out = {r.doc_id: r.text for r in secrets.redact(docs).collect()}
    assert key not in out[1] and token not in out[2] and out[3] == prose and out[4] is None and out[5] == ""


def test_secrets_after_names_and_paths(spark):
    rng = random.Random(4)
    rows = [(10 * k + n // 20, form.format("".join(rng.choice("0123456789abcdef") for _ in range(n)))) for k, form in enumerate(["token={}", "GET /v1/keys/{}", "a=1&access_token={}&b=2", "my-key_{}"], 1) for n in (40, 64)]
    docs = spark.createDataFrame(rows + [(100, "some_function_name_in_code=another/name/of_something-else")] * 50, "doc_id long, text string")
    assert {r.doc_id for r in secrets.scan(docs).collect()} == {i for i, _ in rows}
    out = {r.doc_id: r.text for r in secrets.redact(docs).collect()}
    for i, text in rows:
        assert re.search("[0-9a-f]{40,}", text).group() not in out[i]
    assert out[10 * 3 + 2] == "a=1&access_token=[SECRET]&b=2" and out[100].startswith("some_")


def test_secrets_beside_other_than_ascii():
    key = "q7Zt0mXv4LbR9sKe2WuY8hDp"
    for before, after in [("“", "”"), ("«", "»"), ("\u00a0", "…"), ("：", "。"), ("—", "\U0001f511"), ("", "’"), ("\U0001f511", "")]:
        raw = np.frombuffer(f"a {before}{key}{after} b".encode(), np.uint8)
        assert [raw[a:b].tobytes().decode() for a, b in zip(*secrets.candidates(raw))] == [key], (before, after)
    for text in (f"é{key}", f"{key}é", f"\U00010400{key}", f"“{key}ß"):
        assert not len(secrets.candidates(np.frombuffer(text.encode(), np.uint8))[0]), text


def test_nested_secrets_are_masked_once(spark):
    rng = random.Random(6)
    a, b, c = ("".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(40)) for _ in range(3))
    docs = spark.createDataFrame([(1, f"x {a}-{b}/{c} y")], "doc_id long, text string")
    assert [r.text for r in secrets.redact(docs).collect()] == ["x [SECRET] y"]
    places = [(r.start, r.start + r.length) for r in secrets.scan(docs).collect()]
    assert not any(p != q and p[0] <= q[0] and q[1] <= p[1] for p in places for q in places)


def test_false_discovery_thresholds_against_brute_force():
    import pandas as pd

    rng = np.random.default_rng(1)
    grades = np.concatenate([rng.exponential(40, 500), rng.exponential(400, 20)]).astype(int)
    counts = pd.DataFrame({"stratum": 1, "grade": grades, "n": 1}).groupby(["stratum", "grade"], as_index=False)["n"].sum()
    p = np.sort(10.0 ** (-grades / 100))
    ok = np.flatnonzero(p <= 0.05 * np.arange(1, len(p) + 1) / len(p))
    limit = secrets.thresholds(counts, 0.05)[1]
    assert (grades >= limit).sum() == ok.max() + 1


# sharding


def test_table_is_even_and_moves_little():
    table = sharding.fill(sharding.SHARDS)
    n = np.bincount(table)
    assert n.max() - n.min() <= 1
    less = sharding.fill(sharding.SHARDS[:-1])
    moved = (table != less) & (table != len(sharding.SHARDS) - 1)
    assert moved.mean() < 0.1
    for bad in ([], ["a", "a"]):
        with pytest.raises(ValueError):
            sharding.fill(bad)


# pieces


def test_pieces_are_the_librarys(spark, sf):
    rng = random.Random(2)
    odd = ["".join(rng.choice("ab \n▁é漢.\t  ") for _ in range(rng.randrange(30))) for _ in range(300)]
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()] + odd
    e = pieces.encoder(pieces.MODEL)
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, None)]
    for r in pieces.encode(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        if r.doc_id is None:
            assert (r.ids, r.n_pieces, r.checked, r.round_trip) == (None,) * 4
        else:
            text = texts[r.doc_id] or ""
            assert r.ids == e.library.encode(text) and r.checked and r.round_trip
            assert e.vocabulary.decode(r.ids) == text.replace(pieces.SPACE, " ")


def test_generations_change_nothing(monkeypatch):
    monkeypatch.setattr(pieces, "KEEP", 3)
    with open(pieces.MODEL, "rb") as f:
        e = pieces.Encoder(f.read())
    texts = ["one two three four. five", "two three", "six seven one", "", "one"]
    ids, wrong = e.encode(texts)
    assert not wrong and [i.tolist() for i in ids] == [e.library.encode(t) for t in texts]


def test_list_and_heap_are_the_same_agenda(spark, sf):
    v, rng = pieces.encoder(pieces.MODEL).vocabulary, random.Random(5)
    words = {w for r in spark.read.parquet(f"{sf}/documents.parquet").limit(60).collect() for w in (r.text or "").split()}
    for w in [*words, *("".join(rng.choice("aaabs\u2581n") for _ in range(rng.randrange(60))) for _ in range(500))]:
        assert v.merged(w) == v.merged_short(w)


def test_new_short_parts_have_their_agendas_side_by_side(spark, sf, monkeypatch):
    with open(pieces.MODEL, "rb") as f:
        data = f.read()
    texts, rng = [r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").limit(60).collect()], random.Random(6)
    odd = ["".join(rng.choice("aaabs n1\u2581é漢\0\ud800") for _ in range(rng.randrange(1, 40))) for _ in range(500)]
    words = sorted({p for t in texts for p in pieces.Encoder(data).parts(t)})
    for coarse in (1, 2000):  # with equal scores too: the leftmost is first
        v = pieces.Vocabulary(data)
        v.scores = [float(s // coarse) for s in v.scores]
        v.cost = {p: -v.scores[i] for p, i in v.ids.items()}
        parts = [*words, *odd, "漢\ud800"]
        for p, ids in zip(parts, v.agendas(parts)):
            assert (ids is None) == any(c not in v.ids for c in p.replace(" ", pieces.SPACE))
            assert ids is None or np.frombuffer(ids, "<u4").tolist() == v.agenda(p.replace(" ", pieces.SPACE))
        assert v.agendas(["\ud800", "\ud800a"]) == [None, None]
    monkeypatch.setattr(pieces, "BATCH", 7)
    e, alone = pieces.Encoder(data), []
    one = e.vocabulary.agenda
    e.vocabulary.agenda = lambda part: alone.append(part) or one(part)
    short = [w for t in texts for w in t.split() if len(w) < pieces.SHORT and all(c in e.vocabulary.ids for c in w)]
    for some in (short[:999], [" ".join(short), "\n".join(short)]):
        ids, wrong = e.encode(some)
        assert not wrong and [i.tolist() for i in ids] == [e.library.encode(t) for t in some]
    assert len(short) > 2000 and set(alone) <= {"\n"}  # which is no piece


def test_texts_are_cut_by_pattern_only_where_spaces_repeat_or_a_part_is_new():
    class Counted:
        def __init__(self, cut):
            self.cut, self.n = cut, 0

        def findall(self, text):
            self.n += 1
            return self.cut.findall(text)

    with open(pieces.MODEL, "rb") as f:
        e = pieces.Encoder(f.read())
    plain, e.cut = e.cut, Counted(e.cut)
    rng = random.Random(8)
    texts = ["one, two\nthree (four) five", *("".join(rng.choice("ab1 \n\r\t\0\u2581\u2028,.é漢") for _ in range(rng.randrange(25))) for _ in range(3000))]
    ids, wrong = e.encode(texts)
    assert not wrong and [i.tolist() for i in ids] == [e.library.encode(t) for t in texts]
    for t in texts[1:]:  # the parts cut further are the pattern's
        if t:
            assert [p for x in e.parts(t) for p in plain.findall(x)] == plain.findall(" " + t.replace(pieces.SPACE, " "))
    e.cut.n = 0
    e.encode(texts[:1] * 10)
    assert e.cut.n == 0


def test_every_text_is_checked_by_itself():
    with open(pieces.MODEL, "rb") as f:
        e = pieces.Encoder(f.read())
    assert e.encode(["one two", "two three", ""])[1] == []
    e.known[" two"] = e.known[" one"]
    assert e.encode(["three one", "two", "one two", "one"])[1] == [1, 2]
    whole = e.parts
    e.parts = lambda text: whole(text)[:-1]
    assert e.encode(["one three", "", "three one"])[1] == [0, 2]


# languages


def test_mixtures():
    rng = random.Random(5)
    words = {"aa": ["kala", "mulo", "tiso", "ravo"], "bb": ["xyrt", "qwop", "zjkd", "vbnm"], "cc": ["eiue", "ouae", "iaeo", "uoia"]}

    def text(lang, n):
        return " ".join(rng.choice(words[lang]) for _ in range(n))

    m = language.models({k: language.count_slots([text(k, 500)]) for k in words})
    share, _, n = language.infer([text("aa", 50), text("aa", 60) + " " + text("bb", 40), "", None, "123"], m)
    assert share[0].round(2).tolist() == [1, 0, 0]
    assert abs(share[1][0] - 0.6) < 0.05 and abs(share[1][1] - 0.4) < 0.05 and share[1][2] == 0
    assert not share[2:].any() and n[2:].tolist() == [0, 0, 0]


def test_languages_held_out(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    m = language.fit(docs.where("doc_id % 2 = 0"))
    rows = [r for r in docs.where("doc_id % 2 = 1").collect() if r.text]
    share, _, n = language.infer([r.text for r in rows], m)
    right = [m.names[int(np.argmax(s))] == r.lang for r, s, k in zip(rows, share, n) if k >= 20]
    assert len(right) > 50 and sum(right) > 0.95 * len(right)


def brute_languages(train, texts, penalty=4.0):
    """Words as dictionaries of byte trigrams, plain loops, EM until nothing moves."""
    word = re.compile(r"[^\W\d_]+")

    def grams(w):
        b = b" " + w.encode() + b" "
        return [b[i : i + 3] for i in range(len(b) - 2)]

    counts = {}
    for lang, text in train:
        own = counts.setdefault(lang, {})
        for w in word.findall(text.lower()):
            for g in grams(w):
                own[g] = own.get(g, 0) + 1
    names = sorted(counts)
    total = {k: sum(c.values()) + 0.5 * 65536 for k, c in counts.items()}
    out = []
    for text in texts:
        words = word.findall((text or "").lower())
        logs = [[sum(math.log((counts[k].get(g, 0) + 0.5) / total[k]) for g in grams(w)) for k in names] for w in words]
        top = [max(x) for x in logs]
        lik = [[math.exp(v - t) for v in x] for x, t in zip(logs, top)]

        def em(share):
            while True:
                new = [0.0] * len(names)
                for x in lik:
                    z = sum(a * b for a, b in zip(x, share))
                    for j, a in enumerate(x):
                        new[j] += a * share[j] / z / len(lik)
                if max(abs(a - b) for a, b in zip(new, share)) < 1e-9:
                    return new
                share = new

        def score(share):
            ll = sum(math.log(sum(a * b for a, b in zip(x, share))) + t for x, t in zip(lik, top))
            return ll - penalty / 2 * (sum(s > 0 for s in share) - 1) * math.log(max(len(words), 2))

        if not words:
            out.append({})
            continue
        share = em([1 / len(names)] * len(names))
        while sum(s > 0 for s in share) > 1:
            j = min((s, -k) for k, s in enumerate(share) if s > 0)[1] * -1
            cut = [0 if k == j else s for k, s in enumerate(share)]
            cut = em([s / sum(cut) for s in cut])
            if score(cut) < score(share):
                break
            share = cut
        out.append({k: s for k, s in zip(names, share) if s > 0})
    return out


def test_languages_against_brute_force(spark):
    rng = random.Random(9)
    vocabulary = {"de": "der hund und die katze über strasse müde".split(), "en": "the dog and that cat over street tired".split(), "fr": "le chien et la souris très fatigué rue".split()}

    def text(*parts):
        return " ".join(rng.choice(vocabulary[k]) for k, n in parts for _ in range(n))

    train = [(i, text((k, 60)), k) for i, k in enumerate(["de", "en", "fr"] * 3)]
    others = [text(("de", 30)), text(("en", 25), ("fr", 15)), text(("de", 12), ("en", 12), ("fr", 12)), text(("fr", 1)), None, "", "123 ...", "the the the"]
    rows = train + [(50 + i, t, None) for i, t in enumerate([*others, others[1]])] + [(None, text(("en", 5)), "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("language", F.lit(1)).withColumn("place", F.lit("x"))
    got = {r.doc_id: r for r in language.identify(df).collect() if r.doc_id is not None}
    want = brute_languages([(k, t) for _, t, k in train], [t for i, t, _ in rows if i is not None])
    for (i, *_), w in zip([r for r in rows if r[0] is not None], want):
        assert dict(zip(got[i].languages, got[i].proportions)) == pytest.approx(w, abs=2e-3), i
        assert got[i].language is None if not w else w[got[i].language] == pytest.approx(max(w.values()), abs=2e-3)


def test_language_ties_and_bounds(spark):
    same = language.models({"aa": language.count_slots(["kala mulo"]), "bb": language.count_slots(["kala mulo"])})
    share, *_ = language.infer(["kala mulo kala"], same)
    assert share[0].tolist() == [1, 0]  # the last of equal ones goes first
    docs = spark.createDataFrame([(i % 40, f"w{chr(97 + i % 20)}", "xx" if i else "yy") for i in range(400)], "doc_id long, text string, lang string")
    assert language.fit(docs, 10).names == ["xx", "yy"]
    assert language.fit(docs.limit(0)).names == []
    with pytest.raises(ValueError):
        language.fit(spark.range(600).selectExpr("id as doc_id", "'x' as text", "cast(id as string) as lang"))


# decontamination


def test_automaton_against_brute_force():
    rng = random.Random(8)
    for _ in range(30):
        items = [[rng.randrange(3) for _ in range(rng.randrange(4, 9))] for _ in range(4)]
        sized = [(x, decontaminate.need(len(x), 6, 0.8, 4)) for x in items]
        a, doc = decontaminate.SuffixAutomaton(sized), [rng.randrange(3) for _ in range(40)]
        got, want = set(), set()
        for j, n in enumerate(a.matches(doc)):
            got |= set(range(j - n + 1, j + 1))
        for x, k in sized:
            for i in range(len(doc) - k + 1):
                if any(x[s : s + k] == doc[i : i + k] for s in range(len(x) - k + 1)):
                    want |= set(range(i, i + k))
        assert got == want


def brute_decontaminate(text, items, length=13, coverage=0.8, least=5):
    """(words, covered words) with no automaton: every window of every item."""
    word = re.compile(r"[^\W_]+")
    w = word.findall(text.lower())
    hit = set()
    for item in items:
        v = word.findall(item.lower())
        if len(v) < least:
            continue
        k = min(length, max(least, math.ceil(coverage * len(v) - 1e-9)))
        windows = {tuple(v[i : i + k]) for i in range(len(v) - k + 1)}
        for i in range(len(w) - k + 1):
            if tuple(w[i : i + k]) in windows:
                hit.update(range(i, i + k))
    return len(w), len(hit)


def test_each_text_is_matched_once(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", 11)], "doc_id long, text string, n_chars long")
    plan = decontaminate.decontaminate(docs, spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython [match") == 1


@pytest.mark.parametrize("tokens,part", [(500_000, 4096), (60, 30), (7, 13), (1, 20)])
def test_matchers_of_any_size_find_the_same(spark, monkeypatch, tokens, part):
    monkeypatch.setattr(decontaminate, "MATCHER_TOKENS", tokens)
    monkeypatch.setattr(decontaminate, "PART", part)
    rng = random.Random(3)
    items = [" ".join(rng.choice("abcdefgh") for _ in range(rng.choice([3, 5, 9, 16, 40, 90]))) for _ in range(12)] + [None, ""]
    docs = [(i, " ".join([*(rng.choice("abcdxyz") for _ in range(rng.randrange(0, 30))), *rng.choice(items[:12]).split()[rng.randrange(3) :], "End."]), i) for i in range(40)] + [(90, None, 1), (91, "", 1), (92, items[4], 1), (92, items[4], 1)]
    df = spark.createDataFrame(docs, "doc_id long, text string, __row long")
    got = decontaminate.scan(df, spark.createDataFrame([(i, x) for i, x in enumerate(items + items[:3])], "item_id long, text string"))
    want = [(i, *brute_decontaminate(t or "", [x for x in items if x])) for i, t, _ in docs]
    assert sorted((r.doc_id, r.n_tokens, r.n_removed) for r in got.collect()) == sorted(want)
    assert {r.doc_id: r.dropped for r in got.collect()} == {i: gone > 0.5 * n for i, n, gone in want}
    kept = decontaminate.decontaminate(df, spark.createDataFrame([(i, x) for i, x in enumerate(items)], "item_id long, text string"))
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == sorted(i for i, n, gone in want if gone <= 0.5 * n)



# URLs, quality, PII


def brute_templates(pages, labels, least=5, z=1.96, weight=10, limit=0.6):
    """Plain recursion over all pages of a node."""
    from urllib.parse import urlsplit

    rows = []
    for i, url in pages:
        u = urlsplit(url or "")
        host = u.hostname if u.scheme else None
        got = [x for k, x in labels if k == i and None not in (i, x)]
        rows.append((i, host, [x for x in u.path.split("/") if x] if host else [], len(got), got.count(0)))
    place = {}

    def grow(node, depth, prefix):
        children = {}
        for r in node:
            if len(r[2]) == depth:
                place.setdefault((r[1], prefix), []).append(r)
            else:
                children.setdefault(r[2][depth], []).append(r)
        digits = [s for s in children if re.search("[0-9]", s)]
        branches = {}
        for s, own in children.items():
            name = "*" if len(own) < least or s in digits and len(digits) >= least else s
            branches.setdefault(name, []).extend(own)
        count = {s: (sum(r[3] for r in own), sum(r[4] for r in own)) for s, own in branches.items()}
        pl, pb = sum(c[0] for c in count.values()), sum(c[1] for c in count.values())
        alike = set()
        for s, (n, bad) in count.items():
            if n and pl > n:
                p = pb / pl
                if p in (0, 1) or abs(bad / n - (pb - bad) / (pl - n)) / (p * (1 - p) * (1 / n + 1 / (pl - n))) ** 0.5 < z:
                    alike.add(s)
        merged = {}
        for s, own in branches.items():
            merged.setdefault("~" if s in alike and len(alike) > 1 else s, []).extend(own)
        for s, own in merged.items():
            grow(own, depth + 1, f"{prefix}/{s}")

    for host in {r[1] for r in rows if r[1]}:
        grow([r for r in rows if r[1] == host], 0, "")
    known = [r for r in rows if r[1]]
    prior = 1 - sum(r[4] for r in known) / sum(r[3] for r in known) if sum(r[3] for r in known) else 1.0
    out = [(i, None, "", 0, 0, 0, None, False) for i, host, *_ in rows if not host]
    for (host, t), own in place.items():
        n, bad = sum(r[3] for r in own), sum(r[4] for r in own)
        purity = round((n - bad + weight * prior) / (n + weight), 6)
        out += [(r[0], host, t, len(own), n, bad, purity, purity < limit and n > 0) for r in own]
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_templates_against_brute_force(spark, seed):
    rng, pages, labels = random.Random(seed), [], []

    def add(url, bad, labelled=0.5):
        pages.append((len(pages), url))
        if rng.random() < labelled:
            labels.append((len(pages) - 1, int(rng.random() >= bad)))

    for s in range(70):  # more equal sections than any share of a host, one of them bad
        for k in range(8):
            add(f"http://Big.example.com/section-{'xyz'[s % 3]}{chr(97 + s // 3)}/{rng.randrange(10**6)}", 0.95 if s == 20 else 0.1, 0.95)
    for k in range(40):  # a bad subtree far down
        add(f"https://deep.example.com/a/b/c/d/e/f/g/{'cheap' if k % 4 == 0 else 'fine'}/{k}.html?x=1", 0.95 if k % 4 == 0 else 0.05, 0.95)
    for k in range(30):  # users with pages of their own
        add(f"http://users.example.com/u{k % 6}/post/{k}", 0.2)
    for k in range(25):
        add(f"http://none.example.com/{'ab'[k % 2]}/{k}", 0, 0)
        add(rng.choice(["http://x.example.com", "http://x.example.com//p//q/", "http://x.example.com/p/q#z", "http://x.example.com/" + "y/" * 300, "http://x.example.com/" + "y/" * 300 + "end"]), 0.5)
    pages += [(900, None), (901, ""), (902, "not a url"), pages[5], (None, "http://x.example.com/p")]
    labels += [(5, 0), (5, None), (None, 1)]
    got = url_templates.templates(spark.createDataFrame(pages, "page_id long, url string").withColumn("host", F.lit(1)), spark.createDataFrame(labels, "page_id long, good int"))
    want = brute_templates(pages, labels)
    assert sorted(map(tuple, got.collect()), key=repr) == want
    bad = {(r[1], r[2]) for r in want if r[7]}
    assert any(h == "big.example.com" for h, _ in bad) and any(h == "deep.example.com" and "cheap" in t for h, t in bad) and any("~" in r[2] for r in want)
    assert all("~" not in r[2] for r in want if r[1] == "none.example.com")


def test_url_edges(spark):
    pages = spark.createDataFrame([(1, None, 0), (2, "nonsense", 0), (3, "https://A.b/x/1?q#f", 0), (3, "https://A.b/x/1", 0)], "page_id long, url string, prefix int")
    labels = spark.createDataFrame([(3, None), (None, 1)], "page_id long, good int")
    got = url_templates.templates(pages, labels).collect()
    assert sorted(r.page_id for r in got) == [1, 2, 3, 3] and not any(r.rejected for r in got)
    assert {r.host for r in got} == {None, "a.b"}


def test_quality_held_out(spark, sf):
    big = sf.replace("sf0.001", "sf0.1")
    docs, labels = (spark.read.parquet(f"{big}/{t}.parquet") for t in ("documents", "labels"))
    train, test = labels.where("doc_id % 2 = 0"), {r.doc_id: r for r in labels.where("doc_id % 2 = 1").collect()}
    got = [r for r in quality.classify(docs, train).collect() if r.doc_id in test]
    for name, least in (("quality", 0.85), ("toxic", 0.95)):
        assert np.mean([getattr(r, name) == getattr(test[r.doc_id], name) for r in got]) >= least
    assert np.mean([r.toxic for r in got if test[r.doc_id].toxic == 0]) <= 0.01
    assert np.mean([r.toxic for r in got if test[r.doc_id].toxic == 1]) >= 0.6


def test_descent_separates():
    rng = np.random.default_rng(3)
    rows = [np.unique(np.append(rng.integers(10, 200, 8), k % 2)) for k in range(80)]
    y = np.array([k % 2 for k in range(80)])
    head = quality.fit(rows, y)
    assert all((head.weights[r].sum() + head.intercept > 0) == c for r, c in zip(rows, y))


def test_personal_data(spark):
    text = "mail me at ana.li@example.org or call +49 (030) 555-1234, server 10.20.30.40, card 4111111111111111"
    clean = "chapter 3 of 2021 has 12 parts and version 1.2.3 of it"
    out = {r.doc_id: r for r in pii.redact(spark.createDataFrame([(1, text), (2, clean), (3, None), (4, "")], "doc_id long, text string")).collect()}
    for s in ("ana.li@example.org", "555-1234", "10.20.30.40", "4111111111111111"):
        assert s not in out[1].text
    assert out[2].text == clean and out[3].text is None and out[4].text == ""


# edges of all that take documents


def test_edges(spark, edges):
    full, empty = edges
    items = spark.createDataFrame([(1, None), (2, ""), (3, "a b")], "item_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0), (5, 0, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    runs = [pieces.encode, language_of_none, pii.redact, sharding.place, lambda d: quality.classify(d, labels), lambda d: decontaminate.scan(d, items)]
    for run in runs:
        assert run(full).count() == len(EDGES) and run(empty).count() == 0
    for run in (secrets.redact, lambda d: decontaminate.decontaminate(d, items)):
        out = run(full)
        assert out.columns == full.columns and sorted(map(repr, out.collect())) == sorted(map(repr, full.collect()))
    assert quality.keep_good(full, labels.limit(0)).count() == len(EDGES)


def language_of_none(docs):
    from pyspark.sql import functions as F

    return language.identify(docs.withColumn("lang", F.lit(None).cast("string")))
