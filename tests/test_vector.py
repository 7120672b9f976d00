import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestore.functions import vector as V
from lodestore.operators import embed
from lodestore.operators import search as S
from lodestore.sources import ctx


def test_pack(spark):
    rows = [([1.0] + [-1.0] * 7,), ([0.0] * 8,), ([-1.0] * 7 + [0.5],), ([1.0, 1.0, 1.0],), ([],)]
    df = spark.createDataFrame(rows, "v array<float>")
    assert [r.c for r in df.select(V.pack_bits(F.col("v")).alias("c")).collect()] == [[128], [0], [1], [224], []]


def test_distances(spark):
    rows = [([128], [0]), ([1], [0]), ([200, 15], [200, 240])]
    df = spark.createDataFrame(rows, "a array<int>, b array<int>")
    out = df.select(V.xor_distance(F.col("a"), F.col("b")).alias("x"), V.byte_mismatches(F.col("a"), F.col("b")).alias("m"), V.bit_mismatches(F.col("a"), F.col("b")).alias("h")).collect()
    assert [tuple(r) for r in out] == [(128, 1, 1), (1, 1, 1), (255, 1, 8)]


@pytest.mark.parametrize("width", [1, 8, 63, 64])
def test_planes_are_the_byte_form(spark, width):
    rng = random.Random(width)
    rows = [(i, [rng.randrange(256) for _ in range(width)]) for i in range(60)]
    df = S.with_planes(spark.createDataFrame(rows, "seq long, code array<int>"))
    q = rows[7][1]
    got = {r.seq: r.dist for r in df.withColumn("dist", S.distance(df, q)).select("seq", "dist").collect()}
    assert got == {i: sum(a ^ b for a, b in zip(c, q)) for i, c in rows}


@given(st.integers(0, 255), st.integers(0, 255))
@settings(max_examples=300, deadline=None)
def test_disk_form_keeps_the_xor(a, b):
    assert ctx.from_disk(ctx.to_disk(a)) == a
    assert ctx.to_disk(a) ^ ctx.to_disk(b) == a ^ b


def test_disk_values():
    assert [ctx.to_disk(b) for b in (0, 127, 128, 255)] == [-128, -1, -256, -129]


def test_cosine_and_norm(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0])], "a array<float>, b array<float>")
    r = df.select(V.cosine(F.col("a"), F.col("b")).alias("c"), V.l2_normalize(F.col("a")).alias("n")).first()
    assert r.c == pytest.approx(0.96) and list(r.n) == pytest.approx([0.6, 0.8])


def test_pooling():
    tokens = np.arange(12.0).reshape(1, 3, 4)
    mask = np.array([[1, 1, 0]])
    assert embed.pooling(tokens, mask).tolist() == [[0, 1, 2, 3]]
    assert embed.pooling(tokens, mask, "mean").tolist() == [[2, 3, 4, 5]]
    with pytest.raises(NotImplementedError):
        embed.pooling(tokens, mask, "max")


def test_embedders_are_equal_on_driver_and_cluster(spark):
    texts = ["hello world", "", "Ünïcode ★", "hello world"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for e in (embed.Md5TestEmbedder(), embed.HashingEmbedder()):
        assert [list(r.c) for r in df.orderBy("i").select(e.column(F.col("t")).alias("c")).collect()] == e.encode(texts)
    with pytest.raises(ValueError):
        embed.SentenceTransformerEmbedder().encode(["x"], "float")


def test_code_index(spark):
    index = S.CodeIndex(spark)
    index.add_batch(["a", "b", "c"], [[1, 2, 3, 4], [1, 2, 9, 9], [9, 9, 9, 9]])
    index.add("b", [1, 2, 3, 9])
    index.remove("c")
    assert index.search([1, 2, 3, 4, 5], 5) == (["a", "b"], [1.0, 0.75])


@pytest.mark.parametrize("width,planes", [(4, False), (4, True), (64, True), (70, False)])
def test_many_queries_in_blocks_of_any_size(spark, monkeypatch, width, planes):
    rng = random.Random(3)
    rows = [(i, [rng.choice((0, 1, 255, rng.randrange(256))) for _ in range(width)], f"n{i}") for i in range(60)] + [(90, None, "x"), (91, [1], "y")]
    rows += [(100 + i, rows[i][1], "again") for i in range(20)]
    corpus = spark.createDataFrame(rows, "seq long, code array<int>, name string").repartition(3)
    corpus = S.with_planes(corpus) if planes else corpus
    asked = [(f"q{i}", rows[i][1]) for i in range(30)] + [("none", None), ("odd", [3] * 5)]
    want = sorted((q, d, s, n) for q, c in asked if c for d, s, n in sorted((sum(a ^ b for a, b in zip(c, r)), s, n) for s, r, n in rows if r and len(r) == len(c))[:3])
    for block in (4096, 7, 1):
        monkeypatch.setattr(S, "QUERY_BLOCK", block)
        queries = spark.createDataFrame(asked if block > 1 else asked[:4], "qid string, q array<int>")
        got = sorted(tuple(r) for r in S.per_query(corpus, queries, 3, keep=["name"]).collect())
        assert got == [w for w in want if block > 1 or w[0] in ("q0", "q1", "q2", "q3")]
    assert S.per_query(corpus, spark.createDataFrame([], "qid string, q array<int>"), 3).count() == 0


@pytest.mark.parametrize("width,values", [(8, 256), (8, 3), (3, 256), (64, 256)])
def test_nearest_codes_are_those_of_all_pairs(width, values, monkeypatch):
    rng = np.random.default_rng(5)
    monkeypatch.setattr(S, "CELL_PAIRS", 3000)
    codes, queries = (rng.integers(0, values, (n, width)).astype(np.uint8) for n in (900, 200))
    seq = rng.permutation(900)
    got = {}
    for q, c, d in zip(*S.nearest_codes(queries, codes, seq, 5)):
        got.setdefault(int(q), []).append((int(d), int(seq[c])))
    for i, q in enumerate(queries):
        assert got[i] == sorted(zip((codes ^ q).astype(int).sum(1).tolist(), seq.tolist()))[:5]
    assert len(S.nearest_codes(queries, codes[:2], seq[:2], 5)[0]) == 400


def test_many_queries_take_no_pass_for_each_block(spark, monkeypatch):
    rng = random.Random(6)
    rows = [(i, [rng.randrange(256) for _ in range(8)]) for i in range(400)]
    rows += [(1000 + i, rows[i % 9][1]) for i in range(100)]
    corpus = spark.createDataFrame(rows, "seq long, code array<int>")
    monkeypatch.setattr(S, "QUERY_BLOCK", 50)
    monkeypatch.setattr(S, "CELL_QUERIES", 90)
    monkeypatch.setattr(S, "CELL_CODES", 170)
    monkeypatch.setattr(S, "_block", None)
    got = sorted(tuple(r) for r in S.per_query(corpus, corpus.select(F.col("seq").alias("qid"), F.col("code").alias("q")), 5).collect())
    want = [(i, d, s) for i, c in rows for d, s in sorted((sum(a ^ b for a, b in zip(c, r)), s) for s, r in rows)[:5]]
    assert got == sorted(want)
    best = S.merged(corpus, corpus.select(F.col("seq").alias("qid"), F.col("code").alias("q")), 5)
    assert [(r.qid, r.dist, r.seq) for r in best.collect()] == sorted(want, key=lambda x: (x[1], x[0], x[2]))[:5]


def test_packing_without_lambdas_is_the_same(spark):
    rng = random.Random(4)
    df = spark.createDataFrame([(i, [rng.uniform(-1, 1) for _ in range(64)]) for i in range(50)], "seq long, v array<float>")
    both = df.select(V.pack_bits(df.v).alias("a"), V.pack_bits(df.v, 64).alias("b"))
    assert both.where("a = b").count() == 50
    assert both.select(*[(x == y).alias(f"p{i}") for i, (x, y) in enumerate(zip(V.planes(F.col("a")), V.planes(F.col("a"), width=8)))]).where(" and ".join(f"p{i}" for i in range(8))).count() == 50
