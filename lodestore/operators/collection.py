"""Collection: a named table of text chunks with metadata and packed vectors.

The state is an immutable DataFrame; each mutation replaces it by a plan over the old one. Every
CUT mutations its lineage is cut with a reliable checkpoint.

On disk a collection is `version=…/bucket=…` folders of Parquet, buckets by a hash of the item id,
and a pointer file that names each bucket's versions. save() writes only what changed: new rows
are appended as a further version of their bucket, and a bucket whose rows were replaced or
deleted, or that has more than APPENDS versions, is written anew. The pointer is replaced in one
step, so what is saved is the state; folders that neither this state nor the one before has are
deleted. Searches read the stored bit-planes and neither texts nor codes; texts follow for the
rows found.
"""

from __future__ import annotations

import datetime
import json
import uuid
import zlib
from collections.abc import Iterable, Mapping, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import metadata as M
from ..functions import text as T
from ..shared import cut
from ..sources import ctx
from . import rows as R
from . import search as S
from .embed import Embedder, HashingEmbedder

CUT, APPENDS = 8, 8
STATE = [*R.COLUMNS, "width", *R.PLANES, "bucket"]
STATE_SCHEMA = ", ".join([R.SCHEMA, "width int", *(f"{p} long" for p in R.PLANES), "bucket int"])


class Collection:
    def __init__(self, spark: SparkSession, name: str | None = None, path: str = "collections", embedder: Embedder | None = None, tokenizer: T.Tokenizer | None = None, match: str = "exact", buckets: int = 16):
        """Open a collection, or begin an empty one where nothing is saved under the name.

        match: `exact` compares item ids; `prefix` takes all chunks whose id begins with the item's and an underscore.
        buckets: of a new collection, the number of parts of which a mutation rewrites only its own.
        """
        M.session(spark)
        self.spark, self.path = spark, path.rstrip("/")
        self.name = name or f"collection_{datetime.datetime.now():%Y%m%d_%H%M%S}"
        self.embedder = embedder or HashingEmbedder()
        self.tokenizer = tokenizer or T.WordTokenizer()
        self.match = match
        self._load(self._pointer() or {"versions": {}, "buckets": buckets, "next": 0})

    # storage

    def _at(self) -> str:
        return f"{self.path}/{self.name}"

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _pointer(self) -> dict[str, Any] | None:
        fs, p = self._fs(f"{self._at()}/_current")
        if not fs.exists(p):
            return None
        stream = fs.open(p)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _point(self, pointer: dict[str, Any]) -> None:
        """Replace the pointer in one step."""
        sc = self.spark.sparkContext
        fs, target = self._fs(f"{self._at()}/_current")
        _, part = self._fs(f"{self._at()}/_next-{uuid.uuid4().hex}")
        stream = fs.create(part, True)
        stream.write(bytearray(json.dumps(pointer).encode()))
        stream.close()
        rename = sc._jvm.org.apache.hadoop.fs.Options.Rename
        how = sc._gateway.new_array(rename, 1)
        how[0] = rename.OVERWRITE
        qualified = [fs.makeQualified(p) for p in (part, target)]
        sc._jvm.org.apache.hadoop.fs.FileContext.getFileContext(qualified[0].toUri(), sc._jsc.hadoopConfiguration()).rename(*qualified, how)

    def _load(self, pointer: dict[str, Any]) -> None:
        self._saved, self._next = pointer, pointer["next"]
        places = _places(pointer)
        if places:
            read = self.spark.read.schema(STATE_SCHEMA + ", version string").option("basePath", self._at())
            self.df = read.parquet(*(f"{self._at()}/{p}" for p in sorted(places))).select(*STATE)
        else:
            self.df = self.spark.createDataFrame([], STATE_SCHEMA)
        self._mutations, self._dirty, self._fresh = 0, set(), None

    def save(self) -> None:
        """Write what changed as a new version and make that the state."""
        old = self._saved["versions"]
        dirty = self._dirty | {int(b) for b, v in old.items() if len(v) > APPENDS}
        out = self.df.where(F.col("bucket").isin(sorted(dirty))) if dirty else None
        if self._fresh is not None:
            fresh = self._fresh.where(~F.col("bucket").isin(sorted(dirty))) if dirty else self._fresh
            out = fresh if out is None else out.unionByName(fresh)
        if out is None and self._pointer() is not None:
            return
        version, names = f"v-{uuid.uuid4().hex}", []
        if out is not None:
            out.hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{self._at()}/version={version}")
            fs, root = self._fs(f"{self._at()}/version={version}")
            names = [s.getPath().getName().removeprefix("bucket=") for s in fs.listStatus(root) if s.isDirectory()]
        versions = {b: v for b, v in old.items() if int(b) not in dirty}
        for b in names:
            versions[b] = [*versions.get(b, []), version]
        header = {"embedding_model": self.embedder.name, "embedding_size": ctx.WIDTH, "embedding_dtype": self.embedder.dtype, "context_length": self.embedder.context_length}
        pointer = {"versions": versions, "before": old, "buckets": self._saved["buckets"], "next": self._top(), "header": header}
        self._point(pointer)
        for place in _places({"versions": self._saved.get("before", {})}) - _places(pointer) - _places({"versions": old}):
            fs, gone = self._fs(f"{self._at()}/{place}")
            fs.delete(gone, True)
        self._load(pointer)

    def clear(self) -> None:
        """Forget all rows and delete what is saved."""
        fs, p = self._fs(self._at())
        fs.delete(p, True)
        self._load({"versions": {}, "buckets": self._saved["buckets"], "next": 0})

    def _bucket(self, item: str) -> int:
        return zlib.crc32(item.encode()) % self._saved["buckets"]

    def _complete(self, rows: DataFrame) -> DataFrame:
        """Rows of R.COLUMNS with all columns of the state."""
        bucket = F.pmod(F.crc32(F.col("item_id").cast("binary")), F.lit(self._saved["buckets"])).cast("int")
        return S.with_planes(rows).withColumn("bucket", bucket).select(*STATE)

    def _top(self) -> int:
        """The seq after the last."""
        if self._next is None:
            self._next = self.df.agg(F.coalesce(F.max("seq") + 1, F.lit(0))).first()[0]
        return self._next

    def export_ctx(self, folder: str) -> str:
        """Write the state as a CTX file."""
        disk = F.transform("code", lambda b: F.when(b < 128, b - 128).otherwise(b - 384).cast("float"))
        out = self.df.orderBy("seq").select("chunk_id", "text", disk.alias("embedding"), "metadata")
        return ctx.Catalog(folder).create(out, self.name, embedding_model=self.embedder.name, embedding_dtype=self.embedder.dtype, context_length=self.embedder.context_length)

    def import_ctx(self, folder: str) -> None:
        """Replace the rows by those of the CTX file of this name; the item is what stands before the last underscore."""
        code = F.transform("embedding", lambda v: F.pmod(v.cast("int"), F.lit(256)).bitwiseXOR(F.lit(128)))
        item = F.regexp_extract("chunk_id", r"^(.*)_(\d+)$", 1)
        rows = ctx.Catalog(folder).read(self.spark, self.name).where("chunk_id is not null")
        new = self._complete(
            rows.select(
                "chunk_id",
                F.when(item != "", item).otherwise(F.col("chunk_id")).alias("item_id"),
                F.regexp_extract("chunk_id", r"_(\d+)$", 1).try_cast("int").alias("chunk_idx"),
                F.col("pos").cast("long").alias("seq"),
                F.coalesce("text", F.lit("")).alias("text"),
                "metadata",
                code.alias("code"),
            )
        )
        self._set(new, range(self._saved["buckets"]))

    def _set(self, df: DataFrame, dirty: Iterable[int] = (), fresh: DataFrame | None = None) -> None:
        """A new state: the buckets whose rows were replaced or deleted, and the rows that were only added."""
        self._mutations += 1
        if self._mutations % CUT == 0:
            df = cut(df)
        self.df = df
        self._dirty |= set(dirty)
        if fresh is not None:
            self._fresh = fresh if self._fresh is None else self._fresh.unionByName(fresh)
        self._next = None

    # writing

    def _put(self, new: DataFrame) -> None:
        """Upsert rows of R.COLUMNS, numbered from 0.

        What they replace is looked up first, so the plan has no more of the old state than one anti-join, and none if nothing is replaced.
        """
        new = cut(R.distinct(new))
        known = cut(self.df.select("chunk_id", "bucket", F.col("seq").alias("__old")).join(new.select("chunk_id"), "chunk_id"))
        dirty = [r.bucket for r in known.select("bucket").distinct().collect()]  # as many as buckets at most
        place = F.lit(self._top()) + F.col("seq")
        if dirty:
            new, place = new.join(known.select("chunk_id", "__old"), "chunk_id", "left"), F.coalesce("__old", place)
        self._replace(known if dirty else None, dirty, self._complete(new.withColumn("seq", place)))

    def _put_rows(self, new: list[tuple]) -> None:
        """The same for rows that the driver holds: those they replace are no more than they are, so it looks them up itself."""
        if not new:
            return
        rows = {r[0]: r for r in new}
        ids = _local(self.spark, [(c,) for c in rows], "chunk_id string")
        own = self.df.where(F.col("bucket").isin(sorted({self._bucket(r[1]) for r in new}))).select("chunk_id", "seq").join(F.broadcast(ids), "chunk_id")
        at, top = {r.chunk_id: r.seq for r in own.collect()}, self._top()
        first = {c: n for n, c in reversed([(r[3], r[0]) for r in new])}
        full = [(c, i, k, at.get(c, top + first[c]), t, m, e, *R.derived(e).values(), self._bucket(i)) for c, (_, i, k, _, t, m, e) in rows.items()]
        self._replace(ids if at else None, {self._bucket(rows[c][1]) for c in at}, _local(self.spark, full, STATE_SCHEMA))
        self._next = max(top, *(r[3] + 1 for r in full))

    def _replace(self, gone: DataFrame | None, dirty: Iterable[int], rows: DataFrame) -> None:
        kept = self.df if gone is None else self.df.join(gone.select("chunk_id"), "chunk_id", "left_anti").select(*STATE)
        self._set(kept.unionByName(rows), dirty, rows)

    def _chunks(self, text: str, need_chunks: bool, fast: bool) -> list[str]:
        if not need_chunks:
            return [text]
        if fast:
            n = T.CHUNK_TOKENS * T.CHARS_A_TOKEN
            return [text[i : i + n] for i in range(0, len(text), n)]
        return T.token_windows(self.tokenizer, text)

    def add(self, data: Any, metadata: Mapping[str, Any] | None = None, item_id: str | None = None, need_chunks: bool = False, fast: bool = True, use_item_ids: bool = False) -> list[tuple[str, list[list[int]], dict[str, Any]]]:
        """Add a text, a dict with `text` and `metadata`, or a list of them, as one item.

        Chunks are named item_0, item_1 …; known names are replaced where they stand. Returns one
        (item id, codes of all chunks, metadata of the last). use_item_ids: an `id` in a dict makes an item of its own.
        """
        data = data if isinstance(data, list) else [data]
        if use_item_ids and any(isinstance(d, dict) and "id" in d for d in data):
            out = []
            for d in data:
                out += self.add(d, metadata, str(d["id"]) if isinstance(d, dict) and "id" in d else None, need_chunks, fast)
            return out
        item_id = item_id or str(uuid.uuid4())
        texts: list[str] = []
        notes: list[dict[str, Any]] = []
        for d in data:
            text, own = (d["text"], d.get("metadata") or {}) if isinstance(d, dict) else (d, {})
            parts = self._chunks(text, need_chunks, fast)
            texts += parts
            notes += [{**own, **(metadata or {})}] * len(parts)
        codes = self.embedder.encode(texts)
        new = [(f"{item_id}_{i}", item_id, i, i, t, json.dumps(m), [int(b) for b in c]) for i, (t, m, c) in enumerate(zip(texts, notes, codes))]
        self._put_rows(new)
        return [(item_id, codes, notes[-1] if notes else dict(metadata or {}))]

    def add_dataframe(self, docs: DataFrame, item_id: str, text: str, metadata: Column | None = None, need_chunks: bool = True, fast: bool = True, order: str | None = None) -> None:
        """Add a table in a distributed way: each row is an item. Order of insertion is by `order` (the item id by default)."""
        body = F.col(f"`{text}`").cast("string")
        parts = F.array(body) if not need_chunks else T.fast_chunks(body) if fast else T.token_chunks(self.tokenizer)(body)
        key = F.col(f"`{item_id}`").cast("string")
        base = docs.where(body.isNotNull()).select(key.alias("item_id"), F.col(f"`{order or item_id}`").alias("__order"), (metadata if metadata is not None else F.lit("{}")).alias("metadata"), F.posexplode(parts).alias("chunk_idx", "text"))
        numbered = _numbered(base, ["__order", "item_id", "chunk_idx"])
        new = numbered.select(F.concat_ws("_", "item_id", "chunk_idx").alias("chunk_id"), "item_id", "chunk_idx", "seq", "text", "metadata", self.embedder.column(F.col("text")).alias("code"))
        self._put(new)

    def set_batch_dataframe(self, rows: DataFrame, text: str, code: str, metadata: str | None = None, order: str | None = None) -> None:
        """Bulk load of a table with texts and packed codes (array<int>), an item with a fresh id for each row; saves."""
        note = F.coalesce(F.col(f"`{metadata}`"), F.lit("{}")) if metadata else F.lit("{}")
        byte = F.transform(F.col(f"`{code}`"), lambda b: F.when(b >= 0, b).otherwise(F.pmod(b, F.lit(256)).bitwiseXOR(F.lit(128))).cast("int"))
        base = rows.select(F.uuid().alias("item_id"), F.col(f"`{order or text}`").alias("__order"), note.alias("metadata"), F.lit(0).alias("chunk_idx"), F.col(f"`{text}`").cast("string").alias("text"), byte.alias("code"))
        numbered = _numbered(base, ["__order", "item_id"])
        self._put(numbered.select(F.concat_ws("_", "item_id", "chunk_idx").alias("chunk_id"), *R.COLUMNS[1:]))
        self.save()

    def set_batch(self, texts: Any, embeddings: Sequence[Sequence[int]], metadatas: Any = None) -> None:
        """Bulk load of texts with packed codes, an item each; saves."""
        texts = texts if isinstance(texts, list) else [texts]
        metadatas = [{} for _ in texts] if metadatas is None else metadatas if isinstance(metadatas, list) else [metadatas]
        if len(texts) != len(embeddings):
            raise ValueError("as many embeddings as texts are needed")
        if len(texts) != len(metadatas):
            raise ValueError("as many metadatas as texts are needed")
        new = []
        for n, (t, e, m) in enumerate(zip(texts, embeddings, metadatas)):
            code = [_byte(b) for b in e]
            item = str(uuid.uuid4())
            new.append((f"{item}_0", item, 0, n, t, json.dumps(m), code))
        self._put_rows(new)
        self.save()

    def update(self, id: str, text: str | None = None, metadata: Mapping[str, Any] | None = None, vector: Sequence[int] | None = None, reembed: bool = False) -> bool:
        """Change all chunks of an item and save; whether there is such an item. The code stays unless vector or reembed is given."""
        touched = self._touched(id)
        if not touched:
            return False
        if vector is None and reembed and text is not None:
            vector = self.embedder.encode([text])[0]
        self._set(R.update(self.df, id, text, None if metadata is None else json.dumps(dict(metadata)), None if vector is None else [_byte(b) for b in vector], self.match), touched)
        self.save()
        return True

    def _touched(self, id: str) -> list[int]:
        """The buckets that have rows of an item."""
        df = self.df if self.match == "prefix" else self.df.where(F.col("bucket") == self._bucket(id))
        return [r.bucket for r in df.where(R.is_item(id, self.match)).select("bucket").distinct().collect()]

    def delete(self, ids: str | Sequence[str]) -> int:
        """Delete items; how many chunks went. Saves if any did."""
        ids = [ids] if isinstance(ids, str) else list(ids)
        wanted = self.spark.createDataFrame([(i,) for i in ids], "id string")
        df = self.df if self.match == "prefix" else self.df.where(F.col("bucket").isin(sorted({self._bucket(i) for i in ids})))
        gone = R.matched(df, wanted, self.match).select("chunk_id").distinct()
        by = df.join(gone, "chunk_id").groupBy("bucket").count().collect()
        if by:
            self._set(self.df.join(gone, "chunk_id", "left_anti").select(*STATE), [r.bucket for r in by])
            self.save()
        return sum(r["count"] for r in by)

    def set(self, id: str, text: str | None = None, metadata: Mapping[str, Any] | None = None, vector: Sequence[int] | None = None) -> None:
        """Update the item, or add it."""
        if self.update(id, text, metadata, vector):
            return
        self.add(text if text is not None else "", metadata, id)
        if vector is not None:
            self._set(R.update(self.df, id, code=[_byte(b) for b in vector]), [self._bucket(id)])

    # reading

    def rank_and_filter(self, code: Sequence[int], top_k: int, metadata: Mapping[str, Any] | None = None, top_k_multiplier: int = 4, **options: bool) -> DataFrame:
        return S.rank_and_filter(self.df, code, top_k, metadata, top_k_multiplier, **options)

    def retrieve(self, text: str | Sequence[str] | None = None, top_k: int = 5, metadata: Mapping[str, Any] | None = None, return_scores: bool = False, top_k_multiplier: int = 4, **options: bool) -> list[tuple] | None:
        """(chunk id, text, metadata[, distance]) of the nearest chunks over all query texts, nearest first; None without a text."""
        if not text:
            return None
        texts = [text] if isinstance(text, str) else list(text)
        codes = self.embedder.encode(texts)
        if S.same_width(self.df, len(codes[0])).isEmpty():
            raise ValueError("the collection has no vectors to compare with")
        found = self.search(codes, top_k, metadata, top_k_multiplier, **options)
        best = found.orderBy("dist", "__q", "seq").limit(top_k).collect()
        known = self._fetch([r.chunk_id for r in best], [r.bucket for r in best])
        return [(r.chunk_id, known[r.chunk_id][0], json.loads(known[r.chunk_id][1] or "{}"), *([int(r.dist)] if return_scores else [])) for r in best]

    def search(self, codes: Sequence[Sequence[int]], top_k: int, metadata: Mapping[str, Any] | None = None, top_k_multiplier: int = 4, prefilter: bool = False, compat_scores: bool = False) -> DataFrame:
        """(__q, dist, seq, chunk_id, bucket) of each query code's nearest rows, in one pass over the planes.

        Without a filter, or with prefilter, no more than planes and ids (and metadata) are read;
        otherwise the candidates' metadata is fetched for the filter.
        """
        keep = ["chunk_id", "bucket"]
        if len(codes) == 1:
            narrow = self.df.select("seq", *keep, "width", *R.PLANES, *(["metadata"] if metadata else []), *([] if len(codes[0]) <= 64 else ["code"]))
            return S.rank_and_filter(narrow, codes[0], top_k, metadata, top_k_multiplier, prefilter, compat_scores).select(F.lit(0).alias("__q"), "dist", "seq", *keep)
        if metadata and prefilter:
            return S.nearest_of(S.R.where(self.df, metadata), codes, top_k, keep)
        if not metadata:
            return S.nearest_of(self.df, codes, top_k, keep)
        wide = S.nearest_of(self.df, codes, top_k * top_k_multiplier, [*keep, "metadata"])
        return S.filtered(wide, metadata, top_k, compat_scores).select("__q", "dist", "seq", *keep)

    def _fetch(self, chunk_ids: Sequence[str], buckets: Sequence[int]) -> dict[str, tuple[str, str]]:
        """Text and metadata of the rows found, from their buckets only."""
        if not chunk_ids:
            return {}
        ids = _local(self.spark, [(c,) for c in sorted(set(chunk_ids))], "chunk_id string")
        rows = self.df.where(F.col("bucket").isin(sorted(set(buckets)))).join(F.broadcast(ids), "chunk_id").select("chunk_id", "text", "metadata")
        return {r.chunk_id: (r.text, r.metadata) for r in rows.collect()}

    def get(self, ids: str | Sequence[str] | None = None, where: Mapping[str, Any] | None = None) -> list[tuple[str, str, dict[str, Any]]]:
        """(id, text, metadata) of items in the order asked for, or of all chunks."""
        if ids is not None:
            ids = [ids] if isinstance(ids, str) else list(ids)
            if not ids:
                return []
            wanted = self.spark.createDataFrame(list(enumerate(ids)), "pos int, id string")
            found = R.where(R.joined(self.df, wanted, self.match), where).orderBy("pos")
        else:
            found = R.where(R.listed(self.df, self.match), where).orderBy("seq")
        return [(r.id, r.text, json.loads(r.metadata or "{}")) for r in found.collect()]

    def count(self) -> int:
        return self.df.count()

    def info(self) -> DataFrame:
        return self.df.agg(F.count("*").alias("items")).select("items", F.lit(self.name).alias("collection"), F.lit(self.embedder.name).alias("model"))

    def dump(self) -> DataFrame:
        return self.df.select("chunk_id", "text", "metadata", F.col("code").alias("binary_vector")).orderBy("seq")

    def __repr__(self) -> str:
        return f"Collection(name={self.name}, path={self.path}, embedder={self.embedder.name})"

    # names that other vector stores use

    def add_texts(self, texts: Iterable[str], metadatas: Sequence[Mapping[str, Any]] | None = None) -> list[str]:
        texts = list(texts)
        return [self.add(t, m)[0][0] for t, m in zip(texts, metadatas or [None] * len(texts))]

    def add_documents(self, documents: Iterable[Any]) -> list[str]:
        return [self.add(d.page_content, getattr(d, "metadata", None))[0][0] for d in documents]

    def similarity_search(self, query: str, k: int = 4) -> list[tuple]:
        return self.retrieve(query, top_k=k) or []


_ARROW = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "array<int>": pa.list_(pa.int32())}


def _local(spark: SparkSession, rows: list[tuple], ddl: str) -> DataFrame:
    """A table that the optimizer can look into, as a list of tuples is not."""
    fields = [f.rsplit(" ", 1) for f in ddl.split(", ")]
    columns = [pa.array([r[i] for r in rows], _ARROW[t]) for i, (_, t) in enumerate(fields)]
    return spark.createDataFrame(pa.table(columns, names=[n for n, _ in fields]))


def _places(pointer: Mapping[str, Any]) -> set[str]:
    """Folders that a pointer names."""
    return {f"version={v}/bucket={b}" for b, own in pointer["versions"].items() for v in own}


def _byte(b: Any) -> int:
    """A byte of a code; also the form that the CTX format has on disk. Fractions are refused."""
    if int(b) != b:
        raise ValueError("packed codes are whole numbers; pack float vectors first")
    b = int(b)
    if not -256 <= b <= 255:
        raise ValueError(f"not a byte: {b}")
    return b if b >= 0 else ctx.from_disk(b)


def _numbered(df: DataFrame, order: list[str]) -> DataFrame:
    """seq: 0, 1 … in this order, without gathering the rows in one partition.

    Rows are range-partitioned in order and checkpointed, so partitions stay what they are; a
    partition's first number is the sum of the sizes of those before it.
    """
    placed = cut(df.repartitionByRange(*order).sortWithinPartitions(*order))
    placed = placed.withColumn("__p", F.spark_partition_id()).withColumn("__m", F.monotonically_increasing_id())
    first, at = {}, 0
    for r in placed.groupBy("__p").count().orderBy("__p").collect():  # a row for each partition
        first[r["__p"]] = at
        at += r["count"]
    offset = F.create_map(*[F.lit(x) for kv in first.items() for x in kv])[F.col("__p")] if first else F.lit(0)
    local = F.col("__m").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.withColumn("seq", (offset + local).cast("long")).drop("__p", "__m", "__order")
