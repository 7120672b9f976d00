"""Exact nearest-neighbour search by the weighted XOR distance, lower is better, ties by `seq`.

A corpus has `seq` and `code` (array<int> of bytes), and `width` and planes p0..p7 where it has
been through with_planes(). One query's code becomes literals, so the scan is a projection with a
heap in each partition (TakeOrderedAndProject) and no shuffle. Up to QUERY_BLOCK queries are
broadcast: each Arrow batch of the corpus gives its k best rows for each query, and only these are
shuffled.

More queries than that are joined in cells, a block of different queries against a chunk of
different codes: at most k rows of a code can count, so each code is looked at once, by its least
`seq`. Within a cell codes are grouped by the highest bits of their first 8 bytes. Groups that
differ from a query's in p bits are p * 128 away at least, so a query that has k codes nearer than
that is done. The distances of a group are one matrix product, exact in float32.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import metadata as M
from ..functions import vector as V
from ..shared import cut
from . import rows as R

#: Queries of a pass; of 64 bytes each, 256 KB.
QUERY_BLOCK = 4096
#: Different queries and codes of a cell at most; distances that are held at once.
CELL_QUERIES, CELL_CODES, CELL_PAIRS = 1 << 16, 1 << 20, 1 << 22
PLANES = R.PLANES


def with_planes(df: DataFrame, code: str = "code", width: int | None = None) -> DataFrame:
    """width, and bit-planes of codes of up to 64 bytes; others keep using the code itself. width: that of all codes, where known."""
    fits = F.size(code) <= 64 if width is None else F.size(code) == width
    size = F.when(F.col(code).isNotNull(), F.size(code))
    return df.withColumns({"width": size, **{p: F.when(fits, c) for p, c in zip(PLANES, V.planes(F.col(code), width=width))}})


def distance(df: DataFrame, query: Sequence[int]) -> Column:
    """Distance of each row to a query's code: planes where the rows have them, else the bytes."""
    q = [int(b) for b in query]
    if set(PLANES) <= set(df.columns) and len(q) <= 64:
        return V.plane_distance([F.col(p) for p in PLANES], [F.lit(v).cast("long") for v in V.planes_of(q)])
    return V.xor_distance(F.col("code"), F.lit(q))


def same_width(df: DataFrame, n: int) -> DataFrame:
    return df.where((F.col("width") if "width" in df.columns else F.size("code")) == n)


def nearest(df: DataFrame, query: Sequence[int], k: int) -> DataFrame:
    """The k rows of least distance, with `dist`; rows whose code has another width are passed over."""
    return same_width(df, len(query)).withColumn("dist", distance(df, query)).orderBy("dist", "seq").limit(k)


def rank_and_filter(df: DataFrame, query: Sequence[int], top_k: int, where: Mapping[str, Any] | None = None, multiplier: int = 4, prefilter: bool = False, compat_scores: bool = False) -> DataFrame:
    """Candidates top_k * multiplier, then the metadata filter, then top_k: fewer rows than top_k are possible.

    prefilter: filter first. compat_scores: the i-th row that passes gets the i-th candidate's distance.
    """
    if not where:
        return nearest(df, query, top_k)
    if prefilter:
        return nearest(df.where(M.matches(F.col("metadata"), where)), query, top_k)
    wide = nearest(df, query, top_k * multiplier)
    if not compat_scores:
        return wide.where(M.matches(F.col("metadata"), where)).orderBy("dist", "seq").limit(top_k)
    kept = filtered(wide.withColumn("__q", F.lit(0)), where, top_k, True)
    return kept.drop("__q")


def filtered(wide: DataFrame, where: Mapping[str, Any], top_k: int, compat_scores: bool) -> DataFrame:
    """The first top_k of each query's candidates (__q, dist, seq, metadata …) that pass the filter."""
    # at most top_k * multiplier rows a query
    order = Window.partitionBy("__q").orderBy("dist", "seq")
    ranked = wide.withColumn("__all", F.sort_array(F.collect_list("dist").over(Window.partitionBy("__q"))))
    kept = ranked.where(M.matches(F.col("metadata"), where)).withColumn("__i", F.row_number().over(order)).where(F.col("__i") <= top_k)
    return (kept.withColumn("dist", F.element_at("__all", F.col("__i"))) if compat_scores else kept).drop("__all", "__i")


def _best(dist: np.ndarray, seq: np.ndarray, k: int) -> np.ndarray:
    """Places of the k least by (dist, seq)."""
    if len(dist) > k:
        at = np.flatnonzero(dist <= np.partition(dist, k - 1)[k - 1])
    else:
        at = np.arange(len(dist))
    return at[np.lexsort((seq[at], dist[at]))[:k]]


def _scan(sent: Broadcast, k: int, planes: bool):
    """Arrow batches of (seq, width, planes or code, kept columns) to (query, dist, seq, kept columns)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        widths, codes = sent.value
        for batch in batches:
            seq = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            width = batch.column(1).fill_null(-1).to_numpy(zero_copy_only=False)
            skip = 10 if planes else 3
            who, best, dists = [], [], []
            for w in np.intersect1d(np.unique(width), np.unique(widths)):
                rows = np.flatnonzero(width == w)
                asked = np.flatnonzero(widths == w)
                if planes:
                    own = np.stack([batch.column(2 + i).fill_null(0).to_numpy(zero_copy_only=False)[rows] for i in range(8)]).view(np.uint64)
                else:
                    own = batch.column(2).take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.uint8).reshape(len(rows), int(w))
                step = max(1, (1 << 20) // max(1, len(rows)))
                for a in range(0, len(asked), step):
                    part = asked[a : a + step]
                    total = np.zeros((len(part), len(rows)), np.int64)
                    if planes:
                        q = np.array([V.planes_of(codes[i]) for i in part], np.int64).view(np.uint64)
                        for i in range(8):
                            total += np.bitwise_count(own[i][None, :] ^ q[:, i, None]).astype(np.int64) << (7 - i)
                    else:
                        q = np.array([codes[i] for i in part], np.uint8)
                        for j in range(int(w)):
                            total += own[None, :, j] ^ q[:, j, None]
                    for i, d in zip(part, total):
                        at = _best(d, seq[rows], k)
                        who.append(np.full(len(at), i))
                        best.append(rows[at])
                        dists.append(d[at])
            if who:
                at = pa.array(np.concatenate(best))
                columns = [pa.array(np.concatenate(who), pa.int32()), pa.array(np.concatenate(dists), pa.int64()), batch.column(0).take(at).cast(pa.int64())]
                columns += [batch.column(i).take(at) for i in range(skip, batch.num_columns)]
                yield pa.RecordBatch.from_arrays(columns, ["__q", "dist", "seq", *batch.schema.names[skip:]])

    return run


def _block(corpus: DataFrame, codes: list[list[int]], k: int, keep: Sequence[str]) -> DataFrame:
    """(__q, dist, seq, kept columns): the k nearest rows of each of these codes, by its place in the list."""
    planes = set(PLANES) <= set(corpus.columns) and max(map(len, codes), default=0) <= 64
    width = F.col("width") if "width" in corpus.columns else F.when(F.col("code").isNotNull(), F.size("code"))
    rows = corpus.select("seq", width.alias("width"), *(PLANES if planes else ["code"]), *[F.col(c).alias(f"__k{i}") for i, c in enumerate(keep)])
    sent = corpus.sparkSession.sparkContext.broadcast((np.array(list(map(len, codes))), codes))
    kinds = [("__q", "int"), ("dist", "bigint"), ("seq", "bigint"), *rows.dtypes[10 if planes else 3 :]]
    near = rows.mapInArrow(_scan(sent, k, planes), ", ".join(f"`{n}` {t}" for n, t in kinds))
    ranked = near.withColumn("__r", F.row_number().over(Window.partitionBy("__q").orderBy("dist", "seq")))
    return ranked.where(F.col("__r") <= k).select("__q", "dist", "seq", *[F.col(f"__k{i}").alias(c) for i, c in enumerate(keep)])


def nearest_of(corpus: DataFrame, codes: Sequence[Sequence[int]], k: int, keep: Sequence[str] = ()) -> DataFrame:
    """_block() for codes that the driver holds, in one pass for each QUERY_BLOCK of them."""
    found = None
    for a in range(0, max(1, len(codes)), QUERY_BLOCK):
        part = [[int(b) for b in c] for c in codes[a : a + QUERY_BLOCK]]
        one = _block(corpus, part, k, keep).withColumn("__q", F.col("__q") + a)
        one = cut(one) if len(codes) > QUERY_BLOCK else one
        found = one if found is None else found.unionByName(one)
    return found


def per_query(corpus: DataFrame, queries: DataFrame, k: int, qid: str = "qid", keep: Sequence[str] = ()) -> DataFrame:
    """The k nearest rows of each query (qid, q: array<int>): qid, dist, seq and the kept columns."""
    asked = queries.where("q is not null").select(qid, "q")
    part = asked.limit(QUERY_BLOCK + 1).collect()
    if len(part) > QUERY_BLOCK:
        return _join(corpus, asked, k, qid, keep)
    names = corpus.sparkSession.createDataFrame([(i, r[qid]) for i, r in enumerate(part)], f"__q int, `{qid}` {queries.schema[qid].dataType.simpleString()}")
    return _block(corpus, [list(r["q"]) for r in part], k, keep).join(F.broadcast(names), "__q").select(qid, "dist", "seq", *keep)


def _bits(codes: np.ndarray) -> np.ndarray:
    return np.unpackbits(codes, axis=1).astype(np.float32)


def nearest_codes(queries: np.ndarray, codes: np.ndarray, seq: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k codes of least (distance, seq) of each query, bytes in rows of one width: places of query and code, distance."""
    weight = np.tile(2.0 ** np.arange(7, -1, -1), queries.shape[1]).astype(np.float32)
    high = lambda x: np.packbits(x[:, :8] >> 7, axis=1)[:, 0].astype(np.int64) if x.shape[1] else np.zeros(len(x), np.int64)
    group = high(codes)
    order = np.argsort(group, kind="stable")
    edge = np.searchsorted(group[order], np.arange(257))
    there, asked = np.flatnonzero(np.diff(edge)), high(queries)
    best = np.full((len(queries), k), -1, np.int64)
    dist = np.full((len(queries), k), np.inf, np.float32)
    by = np.argsort(asked, kind="stable")
    for rows in (r[a : a + 8192] for r in np.split(by, np.flatnonzero(np.diff(asked[by])) + 1) for a in range(0, len(r), 8192)):
        g = asked[rows[0]]
        bits = _bits(queries[rows]) * weight
        apart = np.bitwise_count(there ^ g)
        for p in np.unique(apart):
            live = np.flatnonzero(dist[rows, -1] >= p * 128.0)
            if not len(live):
                break
            near = np.concatenate([order[edge[h] : edge[h + 1]] for h in there[apart == p]])
            step = max(1, CELL_PAIRS // max(len(live), bits.shape[1]))
            for a in range(0, len(near), step):
                at = near[a : a + step]
                own = _bits(codes[at])
                d = bits[live].sum(1)[:, None] + (own @ weight)[None, :] - 2 * (bits[live] @ own.T)
                most = dist[rows[live], -1]
                if len(at) > k and np.isinf(most).any():
                    most = np.minimum(most, np.partition(d, k - 1, axis=1)[:, k - 1])
                x, y = np.nonzero(d <= most[:, None])
                if not len(x):
                    continue
                # the best so far and the new ones, sorted for each query
                hit = np.unique(x)
                old = best[rows[live[hit]]]
                who = np.concatenate([np.repeat(hit, k)[old.ravel() >= 0], x])
                what = np.concatenate([old[old >= 0], at[y]])
                far = np.concatenate([dist[rows[live[hit]]][old >= 0], d[x, y]])
                o = np.lexsort((seq[what], far, who))
                who, what, far = who[o], what[o], far[o]
                rank = np.arange(len(who)) - np.searchsorted(who, who)
                first = rank < k
                target = rows[live[who[first]]], rank[first]
                best[target], dist[target] = what[first], far[first]
    q, n = np.nonzero(best >= 0)
    return q, best[q, n], dist[q, n].astype(np.int64)


def _packed():
    """Arrow batches of (code, seq) and part to (part, width, codes, seqs)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code, seq = batch.column(0), batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            width = code.value_lengths().to_numpy(zero_copy_only=False)
            part = batch.column(2).to_numpy(zero_copy_only=False)
            out = []
            for w, c in np.unique(np.stack([width, part]), axis=1).T:
                at = np.flatnonzero((width == w) & (part == c))
                own = code.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.uint8)
                out.append((c, w, own.tobytes(), seq[at].tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.int32(), pa.int32(), pa.binary(), pa.binary()))], ["part", "width", "codes", "seqs"])

    return run


def _cell(k: int):
    """A cell's packed queries (side 0) and codes (side 1) to (q, code, dist, low)."""

    def listed(codes: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.arange(len(codes) + 1) * codes.shape[1], pa.int32()), pa.array(codes.ravel(), pa.int32()))

    def run(table: pa.Table) -> pa.Table:
        out = []
        side, width = table["side"].to_numpy(), table["width"].to_numpy()
        for w in np.unique(width):
            own = []
            for s in (0, 1):
                at = pa.array(np.flatnonzero((side == s) & (width == w)))
                own += [b"".join(table[c].take(at).to_pylist()) for c in ("codes", "seqs")]
            q, codes = (np.frombuffer(own[i], np.uint8).reshape(len(own[i + 1]) // 8, w) for i in (0, 2))
            seq = np.frombuffer(own[3], np.int64)
            if len(q) and len(codes):
                a, b, d = nearest_codes(q, codes, seq, k)
                out.append(pa.table({"q": listed(q[a]), "code": listed(codes[b]), "dist": d, "low": seq[b]}))
        return pa.concat_tables(out) if out else pa.table({"q": listed(np.zeros((0, 1), np.uint8)), "code": listed(np.zeros((0, 1), np.uint8)), "dist": np.zeros(0, np.int64), "low": np.zeros(0, np.int64)})

    return run


def _first(df: DataFrame, by: str, k: int, *order: str) -> DataFrame:
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("__r") <= k)


def _join(corpus: DataFrame, asked: DataFrame, k: int, qid: str, keep: Sequence[str]) -> DataFrame:
    """per_query() for any number of queries, in cells."""
    kept = [F.col(c).alias(f"__k{i}") for i, c in enumerate(keep)]
    few = _first(corpus.where("code is not null").select("code", F.col("seq").cast("long").alias("seq"), *kept), "code", k, "seq")
    n = asked.sparkSession.sparkContext.defaultParallelism
    total = asked.count()
    blocks = max(-(-total // CELL_QUERIES), min(3 * n, -(-total // 2048)))
    chunks = -(-corpus.count() // CELL_CODES) or 1
    part = lambda c, m: F.pmod(F.xxhash64(c), F.lit(m)).cast("int").alias("part")
    kinds = "part int, width int, codes binary, seqs binary"
    left = asked.select("q").distinct().select("q", F.lit(0).cast("long").alias("seq"), part("q", blocks)).mapInArrow(_packed(), kinds)
    right = few.where("__r = 1").select("code", "seq", part("code", chunks)).mapInArrow(_packed(), kinds)
    left = left.withColumns({"side": F.lit(0), "other": F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))}).withColumn("cell", F.col("part") * chunks + F.col("other"))
    right = right.withColumns({"side": F.lit(1), "other": F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))}).withColumn("cell", F.col("other") * chunks + F.col("part"))
    cells = left.unionByName(right).repartition(blocks * chunks, "cell")
    found = cells.groupBy("cell").applyInArrow(_cell(k), "q array<int>, code array<int>, dist long, low long")
    if chunks > 1:
        found = _first(found, "q", k, "dist", "low")
    near = _first(found.select("q", "code", "dist").join(few.drop("__r"), "code"), "q", k, "dist", "seq")
    return asked.join(near, "q").select(qid, "dist", "seq", *[F.col(f"__k{i}").alias(c) for i, c in enumerate(keep)])


def merged(corpus: DataFrame, queries: DataFrame, k: int, qid: str = "qid", keep: Sequence[str] = ()) -> DataFrame:
    """The k best rows over all queries; a row can come once for each query."""
    return per_query(corpus, queries, k, qid, keep).orderBy("dist", qid, "seq").limit(k)


def byte_similarity(df: DataFrame, query: Sequence[int], k: int) -> DataFrame:
    """The k rows of highest share of equal bytes, `similarity`; the query is cut to the rows' width."""
    q = F.lit([int(b) for b in query])
    miss = V.byte_mismatches(F.col("code"), q)
    return df.withColumn("similarity", 1 - miss / F.size("code")).orderBy(F.desc("similarity"), "seq").limit(k)


class CodeIndex:
    """A keyed table of codes with exact search by the share of equal bytes."""

    def __init__(self, spark, rows: DataFrame | None = None):
        self.rows = rows if rows is not None else spark.createDataFrame([], "seq long, chunk_id string, code array<int>")
        self.spark = spark

    def add(self, chunk_id: str, code: Sequence[int]) -> None:
        self.add_batch([chunk_id], [code])

    def add_batch(self, chunk_ids: Sequence[str], codes: Sequence[Sequence[int]]) -> None:
        """Later pairs replace earlier ones of the same id, which keep their place."""
        last = {i: [int(b) for b in c] for i, c in zip(chunk_ids, codes)}
        new = self.spark.createDataFrame([(n, i, last[i]) for n, i in enumerate(last)], "n long, chunk_id string, code array<int>")
        old = self.rows.select("chunk_id", "seq")
        top = self.rows.agg(F.coalesce(F.max("seq") + 1, F.lit(0))).first()[0]
        put = new.join(old, "chunk_id", "left").select(F.coalesce("seq", F.lit(top) + F.col("n")).alias("seq"), "chunk_id", "code")
        self.rows = self.rows.join(new.select("chunk_id"), "chunk_id", "left_anti").select("seq", "chunk_id", "code").unionByName(put)

    def remove(self, chunk_id: str) -> None:
        self.rows = self.rows.where(F.col("chunk_id") != chunk_id)

    def search(self, query: Sequence[int], top_k: int) -> tuple[list[str], list[float]]:
        found = byte_similarity(self.rows, query, top_k).select("chunk_id", "similarity").collect()
        return [r.chunk_id for r in found], [r.similarity for r in found]
