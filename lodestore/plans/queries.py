"""Queries of the core operators and the DuckDB SQL that says the same.

Single searches take the code of the table's mean vector as their query, so they depend on all
rows; searches for many take every row of a table.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import metadata as M
from ..functions import text as T
from ..functions import vector as V
from ..operators import rows as R
from ..operators import search as S
from ..operators.collection import Collection
from ..operators.embed import Md5TestEmbedder
from ..shared import shared_dir
from ..sources import ctx, files

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
DIMS, K = 64, 10
MD5 = Md5TestEmbedder()


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    M.session(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# vectors

_BYTE = " + ".join(f"(CASE WHEN embedding[8 * j + {k + 1}] > 0 THEN {1 << (7 - k)} ELSE 0 END)" for k in range(8))
_CODES = f"codes AS (SELECT vec_id, label, list_transform(range({DIMS // 8}), lambda j: {_BYTE}) AS code FROM embeddings)"
_MEAN = "means AS (SELECT i, avg(v) AS v FROM (SELECT unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY i), mean AS (SELECT list(v ORDER BY i) AS embedding FROM means)"
_Q = f"q AS (SELECT list_transform(range({DIMS // 8}), lambda j: {_BYTE}) AS q FROM mean)"
_DIST = f"list_sum(list_transform(range(1, {DIMS // 8 + 1}), lambda i: xor(code[i], q[i])))::BIGINT"
_RANKED = f"WITH {_CODES}, {_MEAN}, {_Q}, ranked AS (SELECT vec_id, label, {_DIST} AS dist FROM codes, q)"


def _codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "embeddings")
    return e.select("vec_id", "label", F.col("vec_id").alias("seq"), V.pack_bits(F.col("embedding"), DIMS).alias("code"))


def _corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    noted = _codes(spark, sf_dir).withColumn("metadata", F.to_json(F.struct("label")))
    return S.with_planes(noted, width=DIMS // 8)


def _mean(spark: SparkSession, sf_dir: str) -> list[float]:
    row = _table(spark, sf_dir, "embeddings").agg(*[F.avg(F.get("embedding", F.lit(i))).alias(f"f{i}") for i in range(DIMS)]).first()
    return [float(v) for v in row]


def _query_code(spark: SparkSession, sf_dir: str) -> list[int]:
    mean = _mean(spark, sf_dir)
    return [sum((mean[8 * j + k] > 0) << (7 - k) for k in range(8)) for j in range(DIMS // 8)]


@query(f"WITH {_CODES} SELECT vec_id, " + ", ".join(f"code[{j + 1}]::INT AS b{j}" for j in range(DIMS // 8)) + " FROM codes")
def pack_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _codes(spark, sf_dir).select("vec_id", *[F.get("code", F.lit(j)).alias(f"b{j}") for j in range(DIMS // 8)])


def _plane_sql(k: int) -> str:
    terms = [f"((code[{j + 1}] >> {7 - k}) & 1)::BIGINT * {-(1 << 63) if j == 0 else 1 << (63 - j)}" for j in range(DIMS // 8)]
    return f"({' + '.join(terms)})::BIGINT AS p{k}"


@query(f"WITH {_CODES} SELECT vec_id, " + ", ".join(map(_plane_sql, range(8))) + " FROM codes")
def bit_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.with_planes(_codes(spark, sf_dir), width=DIMS // 8).select("vec_id", *S.PLANES)


@query(f"{_RANKED} SELECT vec_id, dist FROM ranked ORDER BY dist, vec_id LIMIT {K}")
def knn_xor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.nearest(_corpus(spark, sf_dir), _query_code(spark, sf_dir), K).select("vec_id", "dist")


_EACH = f"WITH {_CODES}, pairs AS (SELECT a.vec_id AS qid, b.vec_id, list_sum(list_transform(range(1, {DIMS // 8 + 1}), lambda i: xor(b.code[i], a.code[i])))::BIGINT AS dist FROM codes a CROSS JOIN codes b)"


def _as_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _codes(spark, sf_dir).select(F.col("vec_id").alias("qid"), F.col("code").alias("q"))


@query(f"{_EACH}, r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, vec_id) AS n FROM pairs) SELECT qid, vec_id, dist FROM r WHERE n <= 5")
def knn_xor_per_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector is a query."""
    return S.per_query(_corpus(spark, sf_dir), _as_queries(spark, sf_dir), 5, keep=["vec_id"]).select("qid", "vec_id", "dist")


@query(f"{_EACH}, r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, vec_id) AS n FROM pairs) SELECT qid, vec_id, dist FROM r WHERE n <= 5 ORDER BY dist, qid, vec_id LIMIT 5")
def knn_xor_multi_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.merged(_corpus(spark, sf_dir), _as_queries(spark, sf_dir), 5, keep=["vec_id"]).select("qid", "vec_id", "dist")


_WIDE = f"{_RANKED}, wide AS (SELECT * FROM ranked ORDER BY dist, vec_id LIMIT {K * 4})"
LABEL = {"label": 3}


@query(f"{_WIDE} SELECT vec_id, dist FROM wide WHERE label = 3 ORDER BY dist, vec_id LIMIT {K}")
def knn_postfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.rank_and_filter(_corpus(spark, sf_dir), _query_code(spark, sf_dir), K, LABEL).select("vec_id", "dist")


@query(f"{_WIDE}, c AS (SELECT dist, row_number() OVER (ORDER BY dist, vec_id) AS n FROM wide), k AS (SELECT vec_id, row_number() OVER (ORDER BY dist, vec_id) AS n FROM wide WHERE label = 3) SELECT vec_id, c.dist FROM k JOIN c USING (n) WHERE n <= {K}")
def knn_postfilter_compat_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.rank_and_filter(_corpus(spark, sf_dir), _query_code(spark, sf_dir), K, LABEL, compat_scores=True).select("vec_id", "dist")


@query(f"{_RANKED} SELECT vec_id, dist FROM ranked WHERE label = 3 ORDER BY dist, vec_id LIMIT {K}")
def knn_prefilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.rank_and_filter(_corpus(spark, sf_dir), _query_code(spark, sf_dir), K, LABEL, prefilter=True).select("vec_id", "dist")


@query(f"{_RANKED} SELECT vec_id, label FROM (SELECT * FROM ranked ORDER BY dist, vec_id LIMIT {K})")
def knn_no_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.nearest(_corpus(spark, sf_dir), _query_code(spark, sf_dir), K).select("vec_id", "label")


@query(f"{_RANKED} SELECT vec_id, dist FROM ranked")
def knn_k_exceeds_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus = _corpus(spark, sf_dir)
    return S.nearest(corpus, _query_code(spark, sf_dir), corpus.count() + 1).select("vec_id", "dist")


_MISS = f"len(list_filter(range(1, {DIMS // 8 + 1}), lambda i: code[i] <> q[i]))"


@query(f"WITH {_CODES}, {_MEAN}, {_Q} SELECT vec_id, round(1 - {_MISS} / {DIMS // 8}.0::DOUBLE, 6) AS similarity FROM codes, q ORDER BY similarity DESC, vec_id LIMIT {K}")
def byte_mismatch_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.byte_similarity(_corpus(spark, sf_dir), _query_code(spark, sf_dir), K).select("vec_id", F.round("similarity", 6).alias("similarity"))


@query(f"WITH {_CODES}, {_MEAN}, {_Q} SELECT vec_id, {_MISS}::BIGINT AS mismatches FROM codes, q")
def byte_mismatch_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _corpus(spark, sf_dir).select("vec_id", V.byte_mismatches(F.col("code"), F.lit(_query_code(spark, sf_dir))).alias("mismatches"))


@query(f"WITH {_CODES}, {_MEAN}, {_Q} SELECT vec_id, list_sum(list_transform(range(1, {DIMS // 8 + 1}), lambda i: bit_count(xor(code[i], q[i]))))::BIGINT AS bits, round(1 - {_MISS} / {DIMS}.0::DOUBLE, 6) AS byte_score FROM codes, q")
def bit_hamming_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.lit(_query_code(spark, sf_dir))
    return _corpus(spark, sf_dir).select("vec_id", V.bit_mismatches(F.col("code"), q).alias("bits"), F.round(1 - V.byte_mismatches(F.col("code"), q) / DIMS, 6).alias("byte_score"))


_DOT = "list_sum(list_transform(range(1, 65), lambda i: {0}[i]::DOUBLE * {1}[i]::DOUBLE))"


@query(f"WITH {_MEAN} SELECT vec_id, round({_DOT.format('e.embedding', 'mean.embedding')} / (sqrt({_DOT.format('e.embedding', 'e.embedding')}) * sqrt({_DOT.format('mean.embedding', 'mean.embedding')})), 6) AS cosine FROM embeddings e, mean")
def cosine_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.round(V.cosine(F.col("embedding"), F.lit(_mean(spark, sf_dir))), 6).alias("cosine"))


@query(f"SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS i, round(unnest(embedding)::DOUBLE / sqrt({_DOT.format('embedding', 'embedding')}), 6) AS v FROM embeddings")
def l2_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.posexplode(V.l2_normalize(F.col("embedding"))).alias("i", "v")).select("vec_id", F.col("i").cast("long").alias("i"), F.round("v", 6).alias("v"))


@query("SELECT label, i, round(avg(v), 6) AS v FROM (SELECT label, generate_subscripts(embedding, 1) - 1 AS i, unnest(embedding)::DOUBLE AS v FROM embeddings) GROUP BY label, i")
def mean_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean vector of each label, as a token mean pools a text's vectors."""
    e = _table(spark, sf_dir, "embeddings")
    means = e.groupBy("label").agg(F.array(*[F.avg(F.get("embedding", F.lit(i)).cast("double")) for i in range(DIMS)]).alias("m"))
    return means.select("label", F.posexplode("m").alias("i", "v")).select("label", F.col("i").cast("long").alias("i"), F.round("v", 6).alias("v"))


# text retrieval by the test embedder

_MD5 = "unhex(md5(text || '#0') || md5(text || '#1') || md5(text || '#2') || md5(text || '#3'))"
_HEX = "md5(text || '#0') || md5(text || '#1') || md5(text || '#2') || md5(text || '#3')"
_MD5_CODE = f"list_transform(range(64), lambda i: ('0x' || substr({_HEX}, 2 * i + 1, 2))::INT)"
_TEXT_PAIRS = f"""WITH d AS (SELECT doc_id, lang, {_MD5_CODE} AS code FROM documents), q AS (SELECT item_id AS qid, {_MD5_CODE} AS q FROM benchmark),
pairs AS (SELECT qid, doc_id, lang, list_sum(list_transform(range(1, 65), lambda i: xor(code[i], q[i])))::BIGINT AS dist FROM d CROSS JOIN q),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, doc_id) AS n FROM pairs)"""


def _embedded(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "lang", F.col("doc_id").alias("seq"), MD5.column(F.col("text")).alias("code"))
    queries = _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), MD5.column(F.col("text")).alias("q"))
    return S.with_planes(docs), queries


@query(f"{_TEXT_PAIRS} SELECT qid, doc_id, dist FROM r WHERE n <= 5 ORDER BY dist, qid, doc_id LIMIT 5")
def retrieve_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All benchmark texts as one query list, results merged."""
    return S.merged(*_embedded(spark, sf_dir), 5, keep=["doc_id"]).select("qid", "doc_id", "dist")


@query(f"{_TEXT_PAIRS}, f AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, doc_id) AS m FROM r WHERE n <= 20 AND lang = 'en') SELECT qid, doc_id, dist FROM f WHERE m <= 5")
def retrieve_text_where_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each benchmark text by itself: 20 candidates, then the filter, then 5."""
    wide = S.per_query(*_embedded(spark, sf_dir), 20, keep=["doc_id", "lang"]).where("lang = 'en'")
    n = F.row_number().over(Window.partitionBy("qid").orderBy("dist", "doc_id"))
    return wide.withColumn("m", n).where("m <= 5").select("qid", "doc_id", "dist")


# chunks and rows

_CHUNKS = "chunks AS (SELECT doc_id, lang, source, i AS chunk_idx, substr(text, 2048 * i + 1, 2048) AS chunk FROM (SELECT *, unnest(range((length(text) + 2047) // 2048)) AS i FROM documents))"
_STEP = 1 << 20


def _chunked(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _table(spark, sf_dir, "documents")
    return T.exploded(d, T.fast_chunks(F.col("text")), "doc_id", "lang", "source")


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as items, chunked; metadata {lang, source}."""
    item = F.col("doc_id").cast("string")
    return _chunked(spark, sf_dir).select(
        F.concat_ws("_", item, "chunk_idx").alias("chunk_id"),
        item.alias("item_id"),
        "chunk_idx",
        (F.col("doc_id") * _STEP + F.col("chunk_idx")).alias("seq"),
        F.col("chunk").alias("text"),
        F.to_json(F.struct("lang", "source")).alias("metadata"),
        F.lit(None).cast("array<int>").alias("code"),
    )


@query(f"WITH {_CHUNKS} SELECT doc_id, chunk_idx::BIGINT AS chunk_idx, chunk FROM chunks")
def chunk_fast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunked(spark, sf_dir).select("doc_id", F.col("chunk_idx").cast("long").alias("chunk_idx"), "chunk")


@query(f"WITH {_CHUNKS} SELECT doc_id || '_' || chunk_idx AS chunk_id, length(chunk)::BIGINT AS n FROM chunks")
def chunk_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(spark, sf_dir).select("chunk_id", F.char_length("text").cast("long").alias("n"))


@query("SELECT doc_id::VARCHAR AS id, text FROM documents WHERE length(text) > 0")
def chunk_reassemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = _rows(spark, sf_dir).groupBy("item_id").agg(F.sort_array(F.collect_list(F.struct("seq", "text"))).alias("c"))
    return parts.select(F.col("item_id").alias("id"), F.array_join(F.transform("c", lambda x: x["text"]), "").alias("text"))


@query(f"WITH {_CHUNKS} SELECT doc_id || '_' || chunk_idx AS chunk_id, CASE WHEN lang = 'en' AND chunk_idx = 0 THEN 'again' ELSE chunk END AS text, doc_id * {_STEP} + chunk_idx AS seq FROM chunks")
def add_upsert_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items are added again with one chunk: it takes the first one's place, later ones stay."""
    rows = _rows(spark, sf_dir)
    again = rows.where("chunk_idx = 0").where(M.equals(F.col("metadata"), "lang", "en")).withColumns({"text": F.lit("again"), "seq": F.lit(0).cast("long")})
    return R.upsert(rows, again).select("chunk_id", "text", "seq")


ITEM = "7"


@query(f"WITH {_CHUNKS} SELECT doc_id || '_' || chunk_idx AS chunk_id, CASE WHEN doc_id = {ITEM} THEN 'new text' ELSE chunk END AS text FROM chunks")
def update_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.update(_rows(spark, sf_dir), ITEM, "new text").select("chunk_id", "text")


@query(f"""WITH {_CHUNKS} SELECT doc_id || '_' || chunk_idx AS chunk_id, CASE WHEN doc_id = {ITEM} THEN 'xx' ELSE lang END AS lang, source, CASE WHEN doc_id = {ITEM} THEN 'true' END AS updated FROM chunks""")
def update_metadata_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = R.update(_rows(spark, sf_dir), ITEM, metadata=json.dumps({"lang": "xx", "updated": True}))
    return out.select("chunk_id", *[F.get_json_object("metadata", f"$.{k}").alias(k) for k in ("lang", "source", "updated")])


_GONE = "SELECT DISTINCT doc_id FROM labels WHERE quality = 0"


def _bad_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "labels").where("quality = 0").select(F.col("doc_id").cast("string").alias("id"))


@query(f"WITH {_CHUNKS} SELECT doc_id || '_' || chunk_idx AS chunk_id FROM chunks WHERE doc_id NOT IN ({_GONE})")
def delete_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.delete(_rows(spark, sf_dir), _bad_ids(spark, sf_dir)).select("chunk_id")


@query(f"WITH {_CHUNKS} SELECT count(*) AS n FROM chunks WHERE doc_id IN ({_GONE})")
def delete_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.matched(_rows(spark, sf_dir), _bad_ids(spark, sf_dir)).select("chunk_id").distinct().agg(F.count("*").alias("n"))


_PREFIXED = "SELECT item || '_' || n AS chunk_id FROM (SELECT source || CASE WHEN doc_id % 2 = 0 THEN '_x' ELSE '' END AS item, doc_id AS n, source FROM documents)"


@query(f"WITH p AS ({_PREFIXED}) SELECT chunk_id, s.source AS id FROM p JOIN (SELECT DISTINCT source FROM documents) s ON starts_with(chunk_id, s.source || '_')")
def match_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids by prefix: item `a` also has the chunks of item `a_x`."""
    d = _table(spark, sf_dir, "documents")
    item = F.concat("source", F.when(F.col("doc_id") % 2 == 0, "_x").otherwise(""))
    rows = d.select(F.concat_ws("_", item, "doc_id").alias("chunk_id"), item.alias("item_id"))
    return R.matched(rows, d.select(F.col("source").alias("id")).distinct(), "prefix")


def _set(spark: SparkSession, sf_dir: str, item: str) -> DataFrame:
    rows = _rows(spark, sf_dir)
    if not rows.where(R.is_item(item)).isEmpty():
        return R.update(rows, item, "set", json.dumps({"by": "set"}))
    new = spark.createDataFrame([(f"{item}_0", item, 0, 0, "set", json.dumps({"by": "set"}), None)], R.SCHEMA)
    return R.upsert(rows, new)


@query(f"WITH {_CHUNKS} SELECT doc_id || '_' || chunk_idx AS chunk_id, CASE WHEN doc_id = {ITEM} THEN 'set' ELSE chunk END AS text, CASE WHEN doc_id = {ITEM} THEN 'set' END AS by FROM chunks")
def set_existing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _set(spark, sf_dir, ITEM).select("chunk_id", "text", F.get_json_object("metadata", "$.by").alias("by"))


@query(f"WITH {_CHUNKS} SELECT doc_id || '_' || chunk_idx AS chunk_id, chunk AS text, doc_id * {_STEP} + chunk_idx AS seq FROM chunks UNION ALL SELECT 'absent_0', 'set', max(doc_id * {_STEP} + chunk_idx) + 1 FROM chunks")
def set_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _set(spark, sf_dir, "absent").select("chunk_id", "text", "seq")


@query(f"WITH {_CODES} SELECT 'vector ' || vec_id AS text, label::BIGINT AS label, list_sum(code)::BIGINT AS total FROM codes")
def set_batch_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precomputed codes, an item each; ids are fresh, so they aren't shown."""
    new = _codes(spark, sf_dir).select(F.uuid().alias("item_id"), F.col("vec_id").alias("seq"), F.concat(F.lit("vector "), F.col("vec_id")).alias("text"), F.to_json(F.struct("label")).alias("metadata"), "code")
    rows = R.upsert(spark.createDataFrame([], R.SCHEMA), new.select(F.concat("item_id", F.lit("_0")).alias("chunk_id"), "item_id", F.lit(0).alias("chunk_idx"), "seq", "text", "metadata", "code"))
    return rows.select("text", F.get_json_object("metadata", "$.label").cast("long").alias("label"), F.aggregate("code", F.lit(0).cast("long"), lambda a, b: a + b).alias("total"))


# get: conversations as items, turns as chunks

_TURNS = "c AS (SELECT conv_id::VARCHAR AS id, conv_id, turn, role, text FROM conversations)"


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _table(spark, sf_dir, "conversations")
    item = F.col("conv_id").cast("string")
    return c.select(F.concat_ws("_", item, "turn").alias("chunk_id"), item.alias("item_id"), F.col("turn").cast("int").alias("chunk_idx"), (F.col("conv_id") * _STEP + F.col("turn")).alias("seq"), "text", F.to_json(F.struct("role", "turn")).alias("metadata"), F.lit(None).cast("array<int>").alias("code"))


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, and one id that isn't there."""
    ids = _table(spark, sf_dir, "conversations").select("conv_id").distinct()
    return ids.select(F.col("conv_id").cast("int").alias("pos"), F.col("conv_id").cast("string").alias("id")).unionByName(spark.createDataFrame([(-1, "missing")], "pos int, id string"))


def _shown(df: DataFrame, *columns: str | Column) -> DataFrame:
    return df.select(*columns, "id", "text", F.get_json_object("metadata", "$.role").alias("role"), F.get_json_object("metadata", "$.turn").cast("long").alias("turn"))


_JOINED = f"WITH {_TURNS} SELECT conv_id::INT AS pos, id, string_agg(text, ' ' ORDER BY turn) AS text, arg_max(role, turn) AS role, max(turn) AS turn FROM c GROUP BY conv_id, id"


@query(_JOINED)
def get_ids_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(R.joined(_turns(spark, sf_dir), _requests(spark, sf_dir)), "pos")


@query(f"WITH {_TURNS} SELECT id, text, role, turn FROM c")
def get_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(R.listed(_turns(spark, sf_dir)))


@query(f"WITH {_TURNS} SELECT id, text, role, turn FROM c WHERE role = 'user'")
def get_where(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(R.where(R.listed(_turns(spark, sf_dir)), {"role": "user"}))


@query(f"SELECT * FROM ({_JOINED}) WHERE role = 'assistant' AND turn = 3")
def get_ids_where(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The filter sees the merged metadata."""
    return _shown(R.where(R.joined(_turns(spark, sf_dir), _requests(spark, sf_dir)), {"role": "assistant", "turn": 3}), "pos")


@query("SELECT event_id FROM events WHERE json_type(props, '$.k') IN ('BIGINT', 'UBIGINT', 'DOUBLE') AND (props->>'$.k')::DOUBLE = 69")
def metadata_eq_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "events").where(M.equals(F.col("props"), "k", 69.0)).select("event_id")


_FIRST = "(SELECT min(event_type) FROM events)"


@query(f"SELECT event_id FROM events WHERE NOT coalesce(event_type = {_FIRST}, false) OR value IS NULL OR (props->>'$.k') IS NULL")
def metadata_missing_is_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the metadata lacks the key v: missing equals null, and a number isn't a string."""
    e = _table(spark, sf_dir, "events")
    first = F.lit(e.agg(F.min("event_type")).first()[0])
    note = F.to_json(F.struct(F.when(F.col("event_type") == first, F.col("value")).alias("v"), F.get_json_object("props", "$.k").cast("int").alias("k")))
    e = e.select("event_id", note.alias("note"))
    return e.where((M.equals(F.col("note"), "v", None) | M.equals(F.col("note"), "k", None)) & ~M.equals(F.col("note"), "k", "69")).select("event_id")


@query(f"WITH {_CHUNKS} SELECT count(*) AS n FROM chunks")
def count_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(spark, sf_dir).agg(F.count("*").alias("n"))


@query(f"WITH {_CHUNKS} SELECT count(*) AS items, 'documents' AS collection, 'md5-test' AS model FROM chunks")
def info(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(spark, sf_dir).agg(F.count("*").alias("items")).select("items", F.lit("documents").alias("collection"), F.lit(MD5.name).alias("model"))


@query(f"WITH {_CHUNKS} SELECT doc_id || '_' || chunk_idx AS chunk_id, text, lang, source, list_sum({_MD5_CODE})::BIGINT AS total FROM (SELECT *, chunk AS text FROM chunks)")
def dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir).withColumn("code", MD5.column(F.col("text")))
    return rows.select("chunk_id", "text", *[F.get_json_object("metadata", f"$.{k}").alias(k) for k in ("lang", "source")], F.aggregate("code", F.lit(0).cast("long"), lambda a, b: a + b).alias("total"))


@query(f"WITH {_CHUNKS} SELECT count(*) FILTER (WHERE false) AS n FROM chunks")
def clear_then_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _collection(spark, sf_dir)
    c.clear()
    return Collection(spark, c.name, c.path).df.agg(F.count("*").alias("n"))


def _collection(spark: SparkSession, sf_dir: str) -> Collection:
    """A collection of the documents' chunks, saved."""
    c = Collection(spark, "documents", _fresh(spark, "collections"), MD5)
    c.add_dataframe(_table(spark, sf_dir, "documents"), "doc_id", "text", F.to_json(F.struct("lang", "source")))
    c.save()
    return c


@query(f"WITH {_CHUNKS} SELECT doc_id || '_' || chunk_idx AS chunk_id, text, lang, row_number() OVER (ORDER BY doc_id, chunk_idx) - 1 AS seq, list_sum({_MD5_CODE})::BIGINT AS total FROM (SELECT *, chunk AS text FROM chunks)")
def save_and_reopen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The collection as another session finds it."""
    c = _collection(spark, sf_dir)
    df = Collection(spark, c.name, c.path).df
    return df.select("chunk_id", "text", F.get_json_object("metadata", "$.lang").alias("lang"), "seq", F.aggregate("code", F.lit(0).cast("long"), lambda a, b: a + b).alias("total"))


@query(f"WITH {_CHUNKS}, d AS (SELECT doc_id || '_' || chunk_idx AS chunk_id, doc_id * {_STEP} + chunk_idx AS seq, {_MD5_CODE} AS code FROM (SELECT *, chunk AS text FROM chunks)), q AS (SELECT item_id AS qid, {_MD5_CODE} AS q FROM benchmark), pairs AS (SELECT qid, chunk_id, seq, list_sum(list_transform(range(1, 65), lambda i: xor(code[i], q[i])))::BIGINT AS dist FROM d CROSS JOIN q) SELECT qid, chunk_id, dist FROM pairs QUALIFY row_number() OVER (PARTITION BY qid ORDER BY dist, seq) <= 3")
def collection_retrieve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each benchmark text in the saved collection, all in one pass over its planes."""
    c = _collection(spark, sf_dir)
    asked = [(r.item_id, r.text) for r in _table(spark, sf_dir, "benchmark").toLocalIterator()]
    found = c.search(MD5.encode([t for _, t in asked]), 3)
    names = F.broadcast(spark.createDataFrame([(n, i) for n, (i, _) in enumerate(asked)], "__q int, qid long"))
    return found.join(names, "__q").select("qid", "chunk_id", "dist")


@query(f"WITH {_CODES} SELECT 'vector ' || vec_id AS text, label::BIGINT AS label, list_sum(code)::BIGINT AS total, row_number() OVER (ORDER BY vec_id) - 1 AS seq FROM codes")
def set_batch_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collection.set_batch_dataframe, saved and opened again."""
    rows = _codes(spark, sf_dir).select("vec_id", F.concat(F.lit("vector "), F.col("vec_id")).alias("text"), F.to_json(F.struct("label")).alias("metadata"), "code")
    c = Collection(spark, "vectors", _fresh(spark, "collections"), MD5)
    c.set_batch_dataframe(rows, "text", "code", "metadata", "vec_id")
    return Collection(spark, c.name, c.path).df.select("text", F.get_json_object("metadata", "$.label").cast("long").alias("label"), F.aggregate("code", F.lit(0).cast("long"), lambda a, b: a + b).alias("total"), "seq")


@query(f"WITH {_CODES}, {_MEAN}, {_Q} SELECT vec_id::VARCHAR AS chunk_id, round(1 - {_MISS} / {DIMS // 8}.0::DOUBLE, 6) AS similarity FROM codes, q ORDER BY similarity DESC, vec_id LIMIT {K}")
def code_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keyed index of codes; two ids are added again and one is removed and added."""
    rows = _codes(spark, sf_dir).select("seq", F.col("vec_id").cast("string").alias("chunk_id"), "code")
    index = S.CodeIndex(spark, rows)
    again = rows.where("seq in (0, 1)").collect()
    index.add_batch([r.chunk_id for r in again], [[0] * len(r.code) for r in again])
    index.add_batch([r.chunk_id for r in again], [r.code for r in again])
    ids, shares = index.search(_query_code(spark, sf_dir), K)
    return spark.createDataFrame([(i, round(x, 6)) for i, x in zip(ids, shares)], "chunk_id string, similarity double")


@query(f"SELECT split_part(source || CASE WHEN doc_id % 2 = 0 THEN '_x' ELSE '' END || '_' || doc_id, '_', 1) AS id, doc_id AS seq FROM documents")
def listed_by_first_underscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prefix mode names an item by what stands before the first underscore."""
    d = _table(spark, sf_dir, "documents")
    item = F.concat("source", F.when(F.col("doc_id") % 2 == 0, "_x").otherwise(""))
    rows = d.select(F.concat_ws("_", item, "doc_id").alias("chunk_id"), item.alias("item_id"), F.col("doc_id").alias("seq"), "text", F.lit("{}").alias("metadata"))
    return R.listed(rows, "prefix").select("id", "seq")


# sources


def _page_sql() -> str:
    out = r"regexp_replace(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '(?is)<(script|style|template)\b.*?</(script|style|template)\s*>', '', 'g'), '(?s)<[^>]*>', '', 'g')"
    for a, b in T.ENTITIES:
        quoted = [x.replace("'", "''") for x in (a, b)]
        out = f"replace({out}, '{quoted[0]}', '{quoted[1]}')"
    return f"SELECT page_id, {out} AS text FROM pages"


@query(_page_sql())
def webpage_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "pages").select("page_id", T.page_text(F.col("html")).alias("text"))


def _fresh(spark: SparkSession, kind: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


#: Rows of a CSV file: with line breaks in cells, a file is read by one task.
CSV_ROWS = 5000


@query("SELECT doc_id::VARCHAR AS a, lang AS b, source AS c, n_chars::VARCHAR AS d, coalesce(nullif(replace(text, chr(13), ' '), ''), 'nan') AS e FROM documents")
def csv_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with quotes, commas and line breaks too; carriage returns, which readers take for line ends, are spaces."""
    at = _fresh(spark, "csv")
    rows = _table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars", F.replace("text", F.lit("\r"), F.lit(" ")).alias("text"))
    rows.write.option("maxRecordsPerFile", CSV_ROWS).csv(at, header=True, escape='"', quoteAll=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, emptyValue="")
    cells = files.csv_rows(spark, at)
    return cells.select(*[F.get("cells", F.lit(i)).alias(c) for i, c in enumerate("abcde")])


_WORDS = r"regexp_extract_all(text, '[\p{L}\p{N}_]+|\s+|[^\p{L}\p{N}_\s]')"


def _windows_sql(key: str, source: str, n: int) -> str:
    chunk = f"CASE WHEN len(w) <= {n} THEN text ELSE array_to_string(w[i * {n} + 1:(i + 1) * {n}], '') END"
    return f"SELECT {key}, i AS chunk_idx, {chunk} AS chunk FROM (SELECT *, unnest(range(greatest(1, (len(w) + {n - 1}) // {n}))) AS i FROM (SELECT *, {_WORDS} AS w FROM {source}))"


@query(_windows_sql("item_id", "(SELECT item_id, text || chr(10) AS text FROM benchmark)", 16))
def txt_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text file of each benchmark item."""
    at = _fresh(spark, "txt")
    _table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("value")).write.partitionBy("item_id").text(at)
    found = files.txt_chunks(spark, f"{at}/*/*.txt", T.WordTokenizer(), 16)
    return found.select(F.regexp_extract("file", r"item_id=(\d+)", 1).cast("long").alias("item_id"), F.col("chunk_idx").cast("long").alias("chunk_idx"), "chunk")


@query(_windows_sql("doc_id", "documents", T.CHUNK_TOKENS))
def token_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _table(spark, sf_dir, "documents")
    out = T.exploded(d, T.token_chunks(T.WordTokenizer())(F.col("text")), "doc_id")
    return out.select("doc_id", F.col("chunk_idx").cast("long").alias("chunk_idx"), "chunk")


@query(f"SELECT doc_id, len({_WORDS})::BIGINT AS n FROM documents")
def token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", T.word_token_count(F.col("text")).alias("n"))


@query(f"SELECT doc_id, len({_WORDS})::BIGINT AS n, len({_WORDS})::BIGINT + 2 AS n_special FROM documents")
def token_count_tokenizer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tokenizer's own count, in Arrow batches, and with two special tokens."""
    text = F.col("text")
    return _table(spark, sf_dir, "documents").select("doc_id", T.token_count(T.WordTokenizer())(text).alias("n"), T.token_count(T.WordTokenizer(), special=2)(text).alias("n_special"))


@query("SELECT item_id, replace(trim(text), chr(10), chr(10) || chr(10)) AS text FROM benchmark")
def docx_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word documents made of the benchmark's texts, a file each, written by the executors and read again."""
    at = _fresh(spark, "docx").removeprefix("file://")

    def write(batches):
        for pdf in batches:
            for i, t in zip(pdf["item_id"], pdf["text"]):
                ctx._write(f"{at}/{i}.docx", files.docx_of(t))
            yield pdf[["item_id"]]

    _table(spark, sf_dir, "benchmark").select("item_id", "text").mapInPandas(write, "item_id long").write.format("noop").mode("overwrite").save()
    found = files.read_docx(spark, f"{at}/*.docx")
    return found.select(F.regexp_extract("file", r"(\d+)\.docx$", 1).cast("long").alias("item_id"), F.trim("text").alias("text"))


@query(f"SELECT (row_number() OVER (ORDER BY doc_id) - 1)::INT AS pos, doc_id || '_0' AS chunk_id, text, lang, list_sum({_MD5_CODE})::BIGINT AS total FROM documents")
def ctx_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the test embedder's codes to a CTX file and back."""
    at = _fresh(spark, "ctx").removeprefix("file://")
    rows = _table(spark, sf_dir, "documents").orderBy("doc_id").withColumn("code", MD5.column(F.col("text")))
    disk = F.transform("code", lambda b: F.when(b < 128, b - 128).otherwise(b - 384).cast("float"))
    out = rows.select(F.concat("doc_id", F.lit("_0")).alias("chunk_id"), "text", disk.alias("embedding"), F.to_json(F.struct("lang")).alias("metadata"))
    catalog = ctx.Catalog(at)
    catalog.create(out, "documents")
    code = F.transform("embedding", lambda v: F.pmod(v.cast("int"), F.lit(256)).bitwiseXOR(F.lit(128)))
    back = catalog.read(spark, "documents").withColumn("code", code)
    return back.select("pos", "chunk_id", "text", F.get_json_object("metadata", "$.lang").alias("lang"), F.aggregate("code", F.lit(0).cast("long"), lambda a, b: a + b).alias("total"))
