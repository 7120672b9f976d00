import json
import math
import re
import tracemalloc

import pyarrow as pa
import pytest

from lodestore.functions import metadata as M
from lodestore.functions import text as T
from lodestore.operators import rows as R
from lodestore.operators.collection import Collection
from lodestore.operators.embed import Md5TestEmbedder
from lodestore.sources import ctx, files
from lodestore.streaming.ingest import ingest


@pytest.fixture
def make(spark, tmp_path):
    def opened(name="c", **options):
        return Collection(spark, name, str(tmp_path / "db"), **{"embedder": Md5TestEmbedder(), **options})

    return opened


def test_add_and_get(make):
    c = make()
    out = c.add("This is a text. " * 86, {"source": "test"}, "t1")
    assert len(out) == 1 and out[0][0] == "t1" and out[0][2] == {"source": "test"} and len(out[0][1][0]) == 64
    c.add(["x", {"text": "y", "metadata": {"a": 1, "source": "own"}}], {"source": "call"}, "d")
    assert [r.chunk_id for r in c.dump().collect()] == ["t1_0", "d_0", "d_1"]
    assert c.get("d") == [("d", "x y", {"source": "call", "a": 1})]
    assert [g[0] for g in c.get(["d", "missing", "t1", "t1"])] == ["d", "t1", "t1"]
    assert c.get([]) == [] and len(c.get()) == 3 and c.count() == 3


def test_chunks(make):
    c = make()
    c.add("a" * 5000, item_id="l", need_chunks=True)
    assert [len(g[1]) for g in c.get()] == [2048, 2048, 904]
    c.add("", item_id="e", need_chunks=True)
    assert c.count() == 3
    c.add("short", item_id="l")
    assert c.get("l")[0][1] == "short " + "a" * 2048 + " " + "a" * 904


def test_own_ids_are_opt_in(make):
    c = make()
    assert c.add({"text": "x", "id": "mine"})[0][0] != "mine"
    assert c.add([{"text": "x", "id": "mine"}, {"text": "y", "id": "other"}], use_item_ids=True)[1][0] == "other"


def test_retrieve(make):
    c = make()
    for i in range(30):
        c.add(f"text {i}", {"n": i % 3, "odd": bool(i % 2)}, f"i{i}")
    found = c.retrieve("text 4", top_k=3, return_scores=True)
    assert found[0] == ("i4_0", "text 4", {"n": 1, "odd": False}, 0) and len(found) == 3
    assert [f[3] for f in found] == sorted(f[3] for f in found)
    assert len(c.retrieve("text 4", top_k=100)) == 30
    both = c.retrieve(["text 4", "text 5"], top_k=2)
    assert [b[0] for b in both] == ["i4_0", "i5_0"]
    some = c.retrieve("text 4", top_k=2, metadata={"n": 1})
    wide = [w for w in c.retrieve("text 4", top_k=8) if w[2]["n"] == 1][:2]
    assert some == wide
    assert len(c.retrieve("text 4", top_k=2, metadata={"n": 1}, prefilter=True)) == 2
    assert c.retrieve(None) is None and c.retrieve("") is None
    assert c.similarity_search("text 9", 1)[0][0] == "i9_0"
    with pytest.raises(ValueError):
        make("empty").retrieve("x")


def test_postfilter_can_come_short(make):
    c = make()
    codes = [[b] + [0] * 63 for b in (1, 2, 3, 4, 5)]
    c.set_batch([str(i) for i in range(5)], codes, [{"m": int(i == 4)} for i in range(5)])
    assert c.rank_and_filter([0] * 64, 1, {"m": 1}).count() == 0
    assert c.rank_and_filter([0] * 64, 1, {"m": 1}, prefilter=True).first().dist == 5
    assert c.rank_and_filter([0] * 64, 2, {"m": 1}).first().dist == 5
    assert c.rank_and_filter([0] * 64, 2, {"m": 1}, compat_scores=True).first().dist == 1


def test_update_set_delete(make):
    c = make()
    c.add(["one", "two"], {"k": 1}, "a")
    c.add("other", {}, "a_b")
    assert c.update("a", "new", {"k": 2, "z": [1, {"y": None}]}) and not c.update("none", "x")
    assert c.get("a") == [("a", "new new", {"k": 2, "z": [1, {"y": None}]})]
    c.update("a", vector=[5] * 64)
    assert [list(r.binary_vector) == [5] * 64 for r in c.dump().collect()] == [True, True, False]
    c.set("a_b", "set", {"s": True})
    c.set("fresh", "text", {"f": 1}, vector=[-128] * 64)
    assert c.get("a_b")[0][1:] == ("set", {"s": True}) and c.count() == 4
    assert list(c.dump().collect()[-1].binary_vector) == [0] * 64
    assert c.delete("a") == 2 and c.count() == 2 and c.delete("a") == 0
    assert c.delete(["fresh", "a_b", "fresh"]) == 2


def test_prefix_match(make):
    c = make(match="prefix")
    c.add("1", item_id="a")
    c.add("2", item_id="a_b")
    assert c.get("a") == [("a", "1 2", {})] and [g[0] for g in c.get()] == ["a", "a"]
    assert c.delete("a") == 2
    e = make("e")
    e.add("1", item_id="a")
    e.add("2", item_id="a_b")
    assert e.delete("a") == 1 and [g[0] for g in e.get()] == ["a_b"]


def test_save_and_reopen(make):
    c = make()
    c.add("a", {"x": 1}, "a")
    c.save()
    c.delete("a")
    c.add("b", item_id="b")
    c.save()
    c.save()
    again = make()
    assert [r.chunk_id for r in again.dump().collect()] == ["b_0"]
    again.clear()
    assert again.count() == 0 and make().count() == 0
    assert again.info().first().collection == "c" and "c" in repr(again)


def test_many_mutations(make):
    c = make()
    for i in range(20):
        c.add(f"t{i}", item_id=f"i{i % 5}")
    assert c.count() == 5 and c.get("i4")[0][1] == "t19"


def test_set_batch_refuses(make):
    c = make()
    with pytest.raises(ValueError):
        c.set_batch(["a"], [])
    with pytest.raises(ValueError):
        c.set_batch(["a"], [[1]], [{}, {}])
    with pytest.raises(ValueError):
        c.set_batch(["a"], [[0.5] * 64])


@pytest.mark.parametrize("where,hits", [({"x": None}, [1, 4, 5]), ({"x": 69}, [2, 6]), ({"x": "69"}, [3]), ({"o": {"b": 1, "a": 2}}, [4]), ({"l": [1, 2]}, [5]), ({"l": [2, 1]}, []), ({"x.y": 1}, [6]), ({}, [1, 2, 3, 4, 5, 6]), ({"t": True}, [1]), ({"t": 1}, []), ({"x": 69, "x.y": 1}, [6])])
def test_metadata_equality(spark, where, hits):
    rows = [(1, {"t": True}), (2, {"x": 69}), (3, {"x": "69"}), (4, {"x": None, "o": {"a": 2, "b": 1}}), (5, {"l": [1, 2]}), (6, {"x": 69.0, "x.y": 1})]
    df = spark.createDataFrame([(i, json.dumps(m)) for i, m in rows], "i int, metadata string")
    assert [r.i for r in df.where(M.matches(df.metadata, where)).orderBy("i").collect()] == hits


def test_add_dataframe_and_stream(spark, make, tmp_path):
    docs = [(i, "word " * i * 200) for i in range(1, 40)]
    spark.createDataFrame(docs, "id long, body string").repartition(3).write.parquet(str(tmp_path / "in"))
    c = make("bulk")
    c.add_dataframe(spark.read.parquet(str(tmp_path / "in")), "id", "body")
    want = [(str(i), n) for i, t in docs for n in range(math.ceil(len(t) / 2048))]
    got = c.df.orderBy("seq").collect()
    assert [(r.item_id, r.chunk_idx) for r in got] == want and [r.seq for r in got] == list(range(len(want)))
    s = make("stream")
    stream = spark.readStream.schema("id long, body string").parquet(str(tmp_path / "in"))
    ingest(stream, s, "id", "body", str(tmp_path / "cp"), available_now=True).awaitTermination()
    assert sorted(r.chunk_id for r in s.df.collect()) == sorted(f"{a}_{b}" for a, b in want)
    assert sorted(r.chunk_id for r in make("stream").df.collect()) == sorted(f"{a}_{b}" for a, b in want)


def test_ctx(spark, make, tmp_path):
    c = make("x")
    c.add(["é", "two"], {"k": [1]}, "a_b")
    at = c.export_ctx(str(tmp_path / "ctx"))
    with open(at, "rb") as f:
        data = f.read()
    parsed = ctx.loads(data)
    assert data[:4] == b"CTXF" and parsed.texts == ["é", "two"] and list(parsed.metadata) == ["a_b_0", "a_b_1"]
    assert parsed.header["embedding_size"] == 64 and ctx.dumps(parsed) == data and "a_b_0" in ctx.describe(parsed)
    d = make("x")
    d.import_ctx(str(tmp_path / "ctx"))
    assert [tuple(r) for r in d.dump().collect()] == [tuple(r) for r in c.dump().collect()]
    assert d.get("a_b")[0][1] == "é two"
    catalog = ctx.Catalog(str(tmp_path / "ctx"))
    assert catalog.read(spark, "none").count() == 0 and catalog.header("x")["context_length"] == 512
    catalog.delete("x")
    assert catalog.read(spark, "x").count() == 0


def test_ctx_damage():
    good = ctx.dumps(ctx.Contents({}, [(1.0,) * 64], ["ok", "bad"], {"a": {}, "b": {}}))
    at = good.rindex(b"bad")
    rows = list(ctx.rows_of(ctx.loads(good[:at] + b"\xff\xfe\xfd" + good[at + 3 :]), "f"))
    assert [r[2] for r in rows] == ["ok", None] and rows[1][3] is None
    for broken in (b"XXXX" + good[4:], good[:4] + b"\x09" + good[5:], good + b"\x07\0\0\0\0\0\0\0"):
        with pytest.raises(ValueError):
            ctx.loads(broken)
    with pytest.raises(Exception):
        ctx.dumps(ctx.Contents({}, [(1.0,)], ["x"], {"a": {}}))


@pytest.mark.parametrize("section_bytes", [ctx.SECTION_BYTES, 1 << 20])
def test_ctx_in_several_tasks(spark, tmp_path, section_bytes):
    df = spark.range(20000, numPartitions=5).selectExpr("concat('é', id) chunk_id", "repeat(cast(id as string), cast(id % 7 as int)) text", "transform(sequence(0, 63), i -> cast(id + i as float)) embedding", """concat('{"n": ', id, '}') metadata""")
    catalog = ctx.Catalog(str(tmp_path))
    for _ in range(2):
        catalog.create(df, "x", section_bytes=section_bytes)
    files = sorted(p.name for p in tmp_path.iterdir())
    assert len(files) == (1 if section_bytes > 1 << 20 else 5) and files[0] == "x.ctx"
    back = catalog.read(spark, "x")
    assert back.rdd.getNumPartitions() > 2
    want = [(i, f"é{i}", str(i) * (i % 7), [float(i + k) for k in range(64)], json.dumps({"n": i})) for i in range(20000)]
    assert [(r.pos, r.chunk_id, r.text, r.embedding, r.metadata) for r in back.orderBy("pos").collect()] == want
    catalog.delete("x")
    assert not list(tmp_path.iterdir())


def test_ctx_ranges_are_the_whole_file(tmp_path):
    vector = (1.5,) * 64
    cases = [
        ctx.Contents({"a": 1}, [vector] * 3, ["a", "ß" * 9, ""], {"k,": {"x": [1, "}"]}, "é": 3, '"': "long " * 99}),
        ctx.Contents({}, [vector], ["a"] * 20000, {"k": {}}),
        ctx.Contents({}, [], [], {str(i): i for i in range(20000)}),
        ctx.Contents({}, [vector] * 9000, [], {}),
        ctx.Contents(),
    ]
    whole = [ctx.dumps(c) for c in cases]
    whole.append(whole[0].replace(b"\\u00e9", "éé__".encode()))  # not escaped
    twice = b'{"a": 1, "b": 2, "\\u0061": 3}'
    whole.append(whole[4][: whole[4].rindex(b"{}") - 4] + len(twice).to_bytes(4, "little") + twice)
    whole.append(whole[0].replace("ß".encode(), b"\xff\xfe"))
    for i, data in enumerate(whole):
        at = str(tmp_path / f"{i}.ctx")
        with open(at, "wb") as f:
            f.write(data)
        parts, rows, _ = ctx._ranges(at, 0)
        want = list(ctx.rows_of(ctx.loads(data), at))
        got = [tuple(r.values()) for p in parts for b in [ctx._batch(*p)] for r in b.to_pylist()] if parts and len(parts[0]) > 2 else [tuple(r) for p in parts for r in ctx._Reader("").read(ctx.InputPartition(p))]
        assert rows == len(want) and got == want


def test_files(spark, tmp_path):
    (tmp_path / "t.txt").write_text("one two three")
    assert files.process_file(spark, str(tmp_path / "t.txt"), chunk_size=3) == ["one two", " three"]
    (tmp_path / "c.CSV").write_text("a,b,c,d\n1,x,2.5,True\n,y,,False\n")
    assert files.process_file(spark, str(tmp_path / "c.CSV")) == [["1.0", "x", "2.5", "True"], ["nan", "y", "nan", "False"]]
    import zipfile

    with zipfile.ZipFile(tmp_path / "d.docx", "w") as z:
        w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body><w:p><w:r><w:t>Hello</w:t><w:tab/><w:t>you</w:t></w:r></w:p><w:p><w:r><w:t>Bye</w:t></w:r></w:p></w:body></w:document>')
    assert "".join(files.process_file(spark, str(tmp_path / "d.docx"))).split() == ["Hello", "you", "Bye"]
    with pytest.raises(FileNotFoundError):
        files.process_file(spark, str(tmp_path / "no.txt"))
    (tmp_path / "z.zip").write_text("")
    with pytest.raises(ValueError):
        files.process_file(spark, str(tmp_path / "z.zip"))
    with pytest.raises(ImportError):
        files.pdf_chunks(spark, str(tmp_path), T.WordTokenizer(), use_ocr=True)


def test_page_text(spark):
    page = '<html><script>var t="</p>";</script><style>p{}</style><p>a &amp; b<br>c</p><!-- no --><i>&lt;&eacute;</i></html>'
    assert T.page_text_of(page) == "a & bc<é"
    df = spark.createDataFrame([(1, page)], "page_id int, html string")
    assert df.select(T.parsed_page_text("html").alias("t")).first().t == "a & bc<é"
    assert df.select(T.page_text(df.html).alias("t")).first().t == "a & bc<&eacute;"
    assert files.page_chunks(df, T.WordTokenizer()).first().chunk == "a & bc<é"


def test_token_windows():
    t = T.WordTokenizer()
    assert T.token_windows(t, "") == [""] and T.token_windows(t, "a b", 3) == ["a b"]
    assert "".join(T.token_windows(t, "a b c d, e", 3)) == "a b c d, e"
    assert "48;5" in T.show_tokens(["a", "b"])


def test_token_windows_hold_no_list_of_tokens():
    text = "ab é_9, " * 200_000
    tracemalloc.start()
    parts = T.token_windows(T.WordTokenizer(), text, 512)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    pieces = T.WordTokenizer().pieces(text)
    assert parts == ["".join(pieces[i : i + 512]) for i in range(0, len(pieces), 512)] and peak < 6 * len(text)
    assert T.token_windows(T.WordTokenizer(), "", 512) == [""] and T.token_windows(T.WordTokenizer(), "a b", 2) == ["a ", "b"]


def test_token_chunks_come_in_slices():
    texts = ["word " * 30_000, None, "", *["x"] * 5] * 20
    out = list(T.token_chunks(T.WordTokenizer()).func(iter([pa.array(texts)])))
    assert len(out) > 2 and [t for o in out for t in o.to_pylist()] == [None if t is None else T.token_windows(T.WordTokenizer(), t) for t in texts]


def test_duplicate_rows_of_an_item(spark, make):
    c = make("dup")
    rows = [(1, "k", "old " * 600), (2, "k", "new"), (3, "z", "z"), (4, "k", "newest")]
    c.add_dataframe(spark.createDataFrame(rows, "at int, id string, body string"), "id", "body", order="at")
    got = {r.chunk_id: r.text for r in c.df.collect()}
    assert c.count() == len(got) == 3 and got["k_0"] == "newest" and got["k_1"] == ("old " * 600)[2048:] and got["z_0"] == "z"
    c.add_dataframe(spark.createDataFrame(rows[:1], "at int, id string, body string"), "id", "body", order="at")
    assert c.count() == 3 and [r.chunk_id for r in c.dump().collect()] == ["k_0", "k_1", "z_0"]


def test_stream_keeps_the_last_row_of_an_item(spark, make, tmp_path):
    rows = [(i % 3, i, f"text {i}") for i in range(60)]
    spark.createDataFrame(rows, "id long, at int, body string").repartition(5).write.parquet(str(tmp_path / "in"))
    c = make("s")
    stream = spark.readStream.schema("id long, at int, body string").parquet(str(tmp_path / "in"))
    ingest(stream, c, "id", "body", str(tmp_path / "cp"), available_now=True, order="at").awaitTermination()
    assert {r.item_id: r.text for r in make("s").df.collect()} == {str(k): f"text {57 + k}" for k in range(3)}


def _files(path):
    import os

    return {os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_a_mutation_writes_its_buckets_only(spark, make, tmp_path):
    c = make("b")
    c.add_dataframe(spark.createDataFrame([(f"i{k}", f"text {k}") for k in range(200)], "id string, body string"), "id", "body")
    c.save()
    before = _files(tmp_path / "db" / "b")
    assert len({f.split("bucket=")[1].split("/")[0] for f in before}) == 16
    assert c.update("i7", "changed")
    new = _files(tmp_path / "db" / "b") - before
    assert len({f.split("bucket=")[1].split("/")[0] for f in new}) == 1
    c.add("fresh", item_id="fresh")
    c.save()
    last = _files(tmp_path / "db" / "b") - before - new
    assert len(last) == 1 and spark.read.parquet(*last).count() == 1  # appended
    assert c.delete("i9") == 1 and make("b").count() == 200 and make("b").get("i7")[0][1] == "changed"
    for k in range(12):
        c.add(f"again {k}", item_id=f"more{k}")
        c.save()
    c.update("i1", "x")
    again = make("b")
    assert again.count() == 212 and all(len(v) <= 10 for v in again._saved["versions"].values())
    assert [r.chunk_id for r in again.dump().collect()][-12:] == [f"more{k}_0" for k in range(12)]
    assert len(_files(tmp_path / "db" / "b")) < 80


def test_set_batch_of_a_table(spark, make):
    c = make("t")
    rows = [(k, f"t{k}", [k - 128] * 64, json.dumps({"k": k})) for k in range(128)] + [(200, "none", [5] * 64, None)]
    c.set_batch_dataframe(spark.createDataFrame(rows, "at int, body string, e array<int>, m string"), "body", "e", "m", "at")
    got = [(r.text, r.metadata, r.binary_vector[0]) for r in make("t").dump().collect()]
    assert got == [(f"t{k}", json.dumps({"k": k}), k) for k in range(128)] + [("none", "{}", 5)]
    d = make("d")
    d.set_batch(["a", "b"], [[-128] * 64, [127] * 64])
    assert [r.binary_vector[0] for r in d.dump().collect()] == [0, 127]


def test_search_reads_planes_and_no_texts(spark, make):
    c = make("p")
    c.add_dataframe(spark.createDataFrame([(f"i{k}", f"text {k}") for k in range(50)], "id string, body string"), "id", "body")
    c.save()
    codes = c.embedder.encode(["text 3", "text 4"])
    for asked in (codes[:1], codes):
        plan = c.search(asked, 3)._jdf.queryExecution().executedPlan().toString()
        scans = [x for x in plan.splitlines() if "FileScan" in x]
        assert len(scans) == 1
        read = re.findall(r"(\w+)#", scans[0].split("[")[1].split("]")[0])
        assert set(read) - {"version"} == {"chunk_id", "seq", "width", *R.PLANES, "bucket"}
    assert "bit_count" in c.search(codes[:1], 3)._jdf.queryExecution().executedPlan().toString()
    assert [b[0] for b in c.retrieve(["text 4", "text 5"], top_k=2)] == ["i4_0", "i5_0"]


def test_lists_of_queries_are_single_queries_merged(make):
    c = make("q")
    for i in range(40):
        c.add(f"text {i}", {"n": i % 3}, f"i{i}")
    texts = [f"text {i}" for i in (3, 8, 30)] + ["other"]
    for options in ({}, {"metadata": {"n": 2}}, {"metadata": {"n": 2}, "prefilter": True}, {"metadata": {"n": 2}, "compat_scores": True}):
        singles = [(r[3], q, r[0], r) for q, t in enumerate(texts) for r in c.retrieve(t, top_k=4, return_scores=True, **options)]
        got = c.retrieve(texts, top_k=4, return_scores=True, **options)
        assert [(r[3], r[0]) for r in got] == [(d, i) for d, _, i, _ in sorted(singles, key=lambda x: x[:2])[:4]]
    c.save()
    assert c.retrieve(texts, top_k=1, return_scores=True)[0][3] == 0


def test_a_crash_before_the_pointer_leaves_the_old_state(spark, make, monkeypatch):
    c = make("crash")
    c.add("one", item_id="a")
    c.save()
    c.add("two", item_id="b")
    monkeypatch.setattr(c, "_point", lambda pointer: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        c.save()
    assert [r.chunk_id for r in make("crash").dump().collect()] == ["a_0"]


def test_pdf_pages_with_a_reader(spark, tmp_path, monkeypatch):
    import sys
    import types

    class Reader:
        def __init__(self, f):
            self.pages = [types.SimpleNamespace(extract_text=lambda t=t: t) for t in f.read().decode().split("|")]

    monkeypatch.setitem(sys.modules, "pypdf", types.SimpleNamespace(PdfReader=Reader))
    assert files.pdf_pages_of(b"one two|three") == ["one two", "three"]


def test_rank_tokenizer(tmp_path):
    import base64

    ranks = [bytes([b]) for b in range(256)] + [b"he", b"ll", b"hell"]
    (tmp_path / "r").write_bytes(b"".join(base64.b64encode(t) + f" {i}\n".encode() for i, t in enumerate(ranks)))
    t = T.RankTokenizer(str(tmp_path / "r"), r"\w+|\s+|[^\w\s]+")
    assert t.encode("hello") == [258, ord("o")] and t.decode(t.encode("hello é")) == "hello é"
    assert "".join(T.token_windows(t, "hello hello", 2)) == "hello hello"


def test_token_ids_are_the_same_in_every_process():
    import subprocess
    import sys

    code = "from lodestore.functions.text import WordTokenizer; print(WordTokenizer().encode('a b'))"
    assert len({subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, env={"PYTHONHASHSEED": str(k), "PYTHONPATH": ":".join(sys.path)}).stdout for k in (1, 2)}) == 1
