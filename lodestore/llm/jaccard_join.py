"""N-gram Jaccard join: rare-first prefix filter with length, positional and suffix filters.

Plan, with no all-pairs step and no per-pair shuffle of n-gram sets:

1. Each text becomes the set of its word n-grams' hashes. Texts with equal sets share one key; a
   task sends each key's set once, so a text that a third of all rows repeat costs a set a task.
   A mapper sends each reducer its range of hashes as one packed blob of 5 bytes an n-gram: there
   are reducers * 2**40 hashes, and reducers grow with the input. Equal hashes count as equal
   n-grams. Which document has which key travels beside, 16 bytes a document, and isn't grouped.
2. A reducer sees every posting list of its range, so it knows each n-gram's document frequency
   (kept as an eighth of an octave). N-grams in one set only can't be in an intersection: they
   stay behind, and only their number counts. The others go back to their key.
3. Per key: n-grams sorted rare-first (ties by hash); singletons fill the front of the prefix.
   Keys whose whole prefix is singletons have no partner and end here.
4. A key's label is the least key of its prefix's postings. Labels that meet at some prefix
   n-gram form components; a component's labels fill bins of SUB_BLOCK sets, big labels are
   split. So most sets that share a prefix n-gram share a bin.
5. Blocks are bins, and pairs of bins. By the postings of the prefix n-grams, a set goes to the
   blocks in which it has a possible partner: a set of that bin with such an n-gram and a size
   that the length filter admits.
6. A block joins its sets: prefix n-grams give candidates, then the length, positional and
   suffix filters, then one exact count a pair. Every pair belongs to exactly one block. For
   classes() a block gives each set's number of linked documents and a spanning forest of its
   links, so its result grows with the sets and not with the pairs.

Defined results: null text or text without a token has no n-grams and no partner; a text of
fewer than n tokens counts as one n-gram of all its tokens; a null doc_id is left out (it can't
be named); rows with equal doc_id and text count once; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import buckets_for, cut, hold, mix, slices, spare, tokenize, trim

N, THRESHOLD = 3, 0.5
#: Sets in a sub-block; two meet in a block, so memory is bounded by twice as many sets.
SUB_BLOCK = 1500
#: Of the two columns, by the optimizer's estimate, to a bucket of n-grams.
BUCKET_BYTES = 8 << 20
_LOW = np.uint64((1 << 40) - 1)


def gram_sets(texts: list[str | None], n: int, reducers: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (document, hash under reducers * 2**40), sorted: two arrays."""
    t = tokenize(texts)
    h, at = t.ngrams(n)
    doc = t.doc[at]
    count, first = t.counts(), t.first()
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        extra = np.zeros(len(short), np.uint64)
        for k in range(n - 1):
            has = count[short] > k
            x = np.where(has, t.hash[np.minimum(first[short] + k, len(t.hash) - 1)], np.uint64(0))
            extra = mix(extra * np.uint64(31) + x + np.uint64(k))
        h, doc = np.concatenate([h, extra]), np.concatenate([doc, short])
    h = ((h >> np.uint64(40)) % np.uint64(reducers)) << np.uint64(40) | h & _LOW
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    if len(h):
        new = np.concatenate([[True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])])
        h, doc = h[new], doc[new]
    return doc, h


def _pack(h: np.ndarray) -> bytes:
    """The low 40 bits; the bucket has the others."""
    return np.ascontiguousarray(h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def _unpack(b: bytes, bucket: int) -> np.ndarray:
    out = np.zeros((len(b) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(b, np.uint8).reshape(-1, 5)
    return out.view("<u8").ravel().astype(np.uint64) | np.uint64(bucket) << np.uint64(40)


def _mapper(n: int, reducers: int):
    """Arrow batches of (doc_id, text) to (bucket, keys, sizes, counts, grams, member_key, member_id); key 0: no n-gram."""

    def run(batches):
        hold("jaccard_join")
        sent: set[int] = set()
        for batch in batches:
            for part in slices(batch, 1):
                ids, m = part.column(0).to_numpy(zero_copy_only=False).astype(np.int64), part.num_rows
                doc, h = gram_sets(part.column(1).to_pylist(), n, reducers)
                size = np.bincount(doc, minlength=m)
                key = np.zeros(m, np.uint64)
                np.add.at(key, doc, mix(h + np.uint64(0x51ED27)))
                key = np.where(size > 0, np.maximum(mix(key + size.astype(np.uint64)), np.uint64(1)), np.uint64(0))
                new = np.zeros(m, bool)
                for d, k in enumerate(key.tolist()):
                    if k and k not in sent:
                        sent.add(k)
                        new[d] = True
                h, doc = h[new[doc]], doc[new[doc]]
                bucket = (h >> np.uint64(40)).astype(np.int64)
                order = np.lexsort((doc, bucket))
                bs, ds, hs = bucket[order], doc[order], h[order]
                edge = np.flatnonzero(np.diff(bs, prepend=-1))
                rows = {k: [] for k in _SCHEMA_1.names}
                for e, f in zip(edge, np.append(edge[1:], len(bs))):
                    at = np.flatnonzero(np.diff(ds[e:f], prepend=-1))
                    rows["bucket"].append(int(bs[e]))
                    rows["keys"].append(key[ds[e:f][at]].tobytes())
                    rows["sizes"].append(size[ds[e:f][at]].astype(np.int32).tobytes())
                    rows["counts"].append(np.diff(at, append=f - e).astype(np.int32).tobytes())
                    rows["grams"].append(_pack(hs[e:f]))
                    rows["member_key"].append(b"")
                    rows["member_id"].append(b"")
                # any bucket will do for the members: they are passed on, not grouped
                rows["bucket"].append(int(mix(ids[:1].astype(np.uint64))[0] % np.uint64(reducers)))
                for k in ("keys", "sizes", "counts", "grams"):
                    rows[k].append(b"")
                rows["member_key"].append(key.tobytes())
                rows["member_id"].append(ids.tobytes())
                yield pa.RecordBatch.from_pydict(rows, schema=_SCHEMA_1)
        trim()

    return run


_SCHEMA_1 = pa.schema([("bucket", pa.int32()), *((k, pa.binary()) for k in ("keys", "sizes", "counts", "grams", "member_key", "member_id"))])
_DDL_1 = "bucket int, keys binary, sizes binary, counts binary, grams binary, member_key binary, member_id binary"
_DDL_2 = "home int, bucket int, keys binary, sizes binary, counts binary, grams binary, df binary, low binary, member_key binary, member_id binary"


def _join(col, kind) -> np.ndarray:
    return np.frombuffer(b"".join(col), kind)


def _frequencies(homes: int):
    """All postings of a range of n-grams: those in two sets or more go to their key's home."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        keys, counts = _join(pdf["keys"], np.uint64), _join(pdf["counts"], np.int32)
        bucket = int(pdf["bucket"].iloc[0])
        gram = _unpack(b"".join(pdf["grams"]), bucket)
        member = np.repeat(np.arange(len(keys)), counts)
        # a first cut by hash alone drops most n-grams before the exact sort by key
        order = np.argsort(gram, kind="stable")
        g = gram[order]
        same = g[1:] == g[:-1]
        many = np.concatenate([[False], same]) | np.concatenate([same, [False]]) if len(g) else np.zeros(0, bool)
        g, m = g[many], member[order[many]]
        del gram, member, same, many
        k = keys[m]
        order = np.lexsort((k, g))
        g, m, k = g[order], m[order], k[order]
        new = np.concatenate([[True], (g[1:] != g[:-1]) | (k[1:] != k[:-1])]) if len(g) else np.zeros(0, bool)
        g, m, k = g[new], m[new], k[new]
        start = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])) if len(g) else np.zeros(0, np.int64)
        df = np.diff(start, append=len(g))
        low = np.repeat(k[start], df)  # keys are sorted within an n-gram
        df = np.repeat(df, df)
        two = df > 1
        df = np.floor(np.log2(np.maximum(df, 1)) * 8).astype(np.uint8)
        g, m, k, df, low = g[two], m[two], k[two], df[two], low[two]
        sizes = _join(pdf["sizes"], np.int32)[m]
        h = (k >> np.uint64(16)) % np.uint64(homes)
        o = np.lexsort((g, k, h))
        e = np.searchsorted(h[o], np.arange(homes + 1))
        out = []
        for r in np.flatnonzero(np.diff(e)):
            a = o[e[r] : e[r + 1]]
            first = np.flatnonzero(np.concatenate([[True], k[a][1:] != k[a][:-1]]))
            count = np.diff(first, append=len(a)).astype(np.int32)
            out.append((r, bucket, k[a][first].tobytes(), sizes[a][first].tobytes(), count.tobytes(), _pack(g[a]), df[a].tobytes(), (low[a] >> np.uint64(32)).astype(np.uint32).tobytes(), b"", b""))
        mk, mi = b"".join(pdf["member_key"]), b"".join(pdf["member_id"])
        if mk:
            out.append((-1 - bucket, bucket, b"", b"", b"", b"", b"", b"", mk, mi))
        trim()
        return pd.DataFrame(out, columns=["home", "bucket", "keys", "sizes", "counts", "grams", "df", "low", "member_key", "member_id"])

    return run


def prefix_length(size: np.ndarray, threshold: float) -> np.ndarray:
    return size - np.ceil(threshold * size - 1e-9).astype(np.int64) + 1


def _assemble(threshold: float):
    """Keys of a home with their shared n-grams rare-first and the prefix's share of them; below home 0, members as they are."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        columns = ["key", "size", "prefix", "label", "grams", "df", "member_key", "member_id"]
        if pdf["home"].iloc[0] < 0:
            return pd.DataFrame([(None, 0, 0, None, None, None, mk, mi) for mk, mi in zip(pdf["member_key"], pdf["member_id"])], columns=columns)
        counts = _join(pdf["counts"], np.int32)
        k, size = np.repeat(_join(pdf["keys"], np.uint64), counts), np.repeat(_join(pdf["sizes"], np.int32), counts)
        g = np.concatenate([_unpack(x, int(r)) for x, r in zip(pdf["grams"], pdf["bucket"])])
        df, low = _join(pdf["df"], np.uint8), _join(pdf["low"], np.uint32)
        order = np.lexsort((g, df, k))
        k, g, df, size, low = k[order], g[order], df[order], size[order], low[order]
        start = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
        end = np.append(start[1:], len(k))
        whole = size[start].astype(np.int64)
        prefix = np.minimum(prefix_length(whole, threshold) - (whole - (end - start)), end - start)
        out = []
        for s, e, p, n in zip(start, end, prefix, whole):
            if p > 0:
                out.append((k[s].astype(np.int64), int(n), int(p), int(low[s : s + p].min()), g[s:e].tobytes(), df[s:e].tobytes(), None, None))
        trim()
        return pd.DataFrame(out, columns=columns)

    return run


def _members(batches):
    """(key, doc_id) of the packed members."""
    for pdf in batches:
        for k, i in zip(pdf["member_key"], pdf["member_id"]):
            yield pd.DataFrame({"key": np.frombuffer(k, np.int64), "doc_id": np.frombuffer(i, np.int64)})


_DDL_3 = "key long, size int, prefix int, label long, grams binary, df binary, member_key binary, member_id binary"


def _prefix_entries(reducers: int):
    def run(batches):
        for pdf in batches:
            g, lab = [], []
            for grams, p, label in zip(pdf["grams"], pdf["prefix"], pdf["label"]):
                g.append(np.frombuffer(grams, np.uint64)[:p])
                lab.append(np.full(p, label, np.int64))
            if not g:
                continue
            g, lab = np.concatenate(g), np.concatenate(lab)
            order = np.lexsort((lab, g))
            g, lab = g[order], lab[order]
            new = np.concatenate([[True], (g[1:] != g[:-1]) | (lab[1:] != lab[:-1])]) if len(g) else np.zeros(0, bool)
            g, lab = g[new], lab[new]
            b = (g >> np.uint64(40)).astype(np.int64)
            edge = np.searchsorted(b, np.arange(reducers + 1))
            yield pd.DataFrame([(r, g[s:e].tobytes(), lab[s:e].astype(np.uint32).tobytes()) for r, (s, e) in enumerate(zip(edge[:-1], edge[1:])) if e > s], columns=["bucket", "grams", "labels"])

    return run


def _meetings(pdf: pd.DataFrame) -> pd.DataFrame:
    """Pairs of labels that connect all labels that share a prefix n-gram."""
    g, lab = _join(pdf["grams"], np.uint64), _join(pdf["labels"], np.uint32)
    order = np.lexsort((lab, g))
    g, lab = g[order], lab[order].astype(np.int64)
    next_to = (g[1:] == g[:-1]) & (lab[1:] != lab[:-1])
    edges = np.unique(np.stack([lab[:-1][next_to], lab[1:][next_to]]), axis=1) if next_to.any() else np.zeros((2, 0), np.int64)
    return pd.DataFrame({"la": edges[0], "lb": edges[1]})


def _postings(reducers: int):
    """Postings of the prefixes by range of n-grams."""

    def run(batches):
        for pdf in batches:
            count = pdf["prefix"].to_numpy()
            g = np.concatenate([np.frombuffer(x, np.uint64)[:p] for x, p in zip(pdf["grams"], count)]) if len(pdf) else np.zeros(0, np.uint64)
            row = np.repeat(np.arange(len(pdf)), count)
            key, size, at = pdf["key"].to_numpy(np.int64), pdf["size"].to_numpy(np.int32), pdf["bin"].to_numpy(np.int64)
            bucket = (g >> np.uint64(40)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            edge = np.searchsorted(bucket[order], np.arange(reducers + 1))
            rows = []
            for r in np.flatnonzero(np.diff(edge)):
                o = order[edge[r] : edge[r + 1]]
                own, index = np.unique(row[o], return_inverse=True)
                rows.append((r, _pack(g[o]), index.astype(np.uint32).tobytes(), key[own].tobytes(), size[own].tobytes(), at[own].tobytes()))
            yield pd.DataFrame(rows, columns=["bucket", "grams", "owners", "keys", "sizes", "bins"])

    return run


def _routes(threshold: float):
    """The blocks (ba, bb) in which a key has a possible partner by the n-grams of a range."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        bucket = int(pdf["bucket"].iloc[0])
        first = np.cumsum([0, *(len(k) // 8 for k in pdf["keys"])])
        own = np.concatenate([np.frombuffer(o, np.uint32) + f for o, f in zip(pdf["owners"], first)])
        g = _unpack(b"".join(pdf["grams"]), bucket)
        keys, sizes, bins = _join(pdf["keys"], np.int64), _join(pdf["sizes"], np.int32), _join(pdf["bins"], np.int64)
        order = np.argsort(g, kind="stable")
        g, own = g[order], own[order]
        same = g[1:] == g[:-1]
        many = np.concatenate([[False], same]) | np.concatenate([same, [False]])
        g, own = g[many], own[many]
        order = np.lexsort((keys[own], bins[own], g))
        g, own = g[order], own[order]
        k, n, b = keys[own], sizes[own].astype(np.float64), bins[own]
        out = []
        # runs of one n-gram and one bin
        run_at = np.flatnonzero(np.concatenate([[True], (g[1:] != g[:-1]) | (b[1:] != b[:-1])])) if len(g) else np.zeros(0, np.int64)
        length = np.diff(run_at, append=len(g))
        within = np.repeat(length > 1, length)
        out.append(np.unique(np.stack([k[within], b[within], b[within]]), axis=1))
        low, high = (np.minimum.reduceat(n, run_at), np.maximum.reduceat(n, run_at)) if len(g) else (n, n)
        gram_at = np.flatnonzero(np.concatenate([[True], g[run_at][1:] != g[run_at][:-1]])) if len(g) else np.zeros(0, np.int64)
        seen: set[bytes] = set()
        for r, e in zip(gram_at, np.append(gram_at[1:], len(run_at))):
            if e - r < 2:
                continue
            i, j = run_at[r], run_at[e] if e < len(run_at) else len(g)
            if (name := k[i:j].tobytes()) in seen:
                continue
            seen.add(name)
            step = max(1, (1 << 22) // (e - r))
            for a in range(i, j, step):
                z = min(j, a + step)
                ok = (n[a:z, None] * threshold <= high[r:e] + 1e-9) & (low[r:e] * threshold <= n[a:z, None] + 1e-9) & (b[a:z, None] != b[run_at[r:e]])
                x, y = np.nonzero(ok)
                mine, other = b[a:z][x], b[run_at[r:e]][y]
                out.append(np.stack([k[a:z][x], np.minimum(mine, other), np.maximum(mine, other)]))
        found = np.unique(np.concatenate(out, axis=1), axis=1)
        trim()
        return pd.DataFrame({"key": found[0], "ba": found[1], "bb": found[2]})

    return run


def join_sets(sets: list[tuple[int, int, np.ndarray, np.ndarray]], prefixes: list[int], side: np.ndarray | None, threshold: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For a set, its partners and their Jaccard similarity, each pair once; sets are (key, size, shared n-grams, their frequencies).

    side: 0 or 1 for each set where only pairs across count, None for all pairs.
    """
    m = len(sets)
    if m < 2:
        return
    size = np.array([s[1] for s in sets], np.int64)
    count = np.array([len(s[2]) for s in sets], np.int64)
    offset = np.zeros(m + 1, np.int64)
    np.cumsum(count, out=offset[1:])
    grams, df = np.concatenate([s[2] for s in sets]), np.concatenate([s[3] for s in sets])
    # local numbers of the n-grams in the global order: by frequency, then hash
    order = np.lexsort((grams, df))
    first = np.concatenate([[True], grams[order][1:] != grams[order][:-1]])
    number = np.empty(len(grams), np.int64)
    number[order] = np.cumsum(first) - 1
    v = int(first.sum())
    owner = np.repeat(np.arange(m), count)
    flat = owner * np.int64(v) + number  # rising: sets in order, n-grams rare-first
    single = size - count  # singletons stand in front of the order
    # postings of the prefixes, with positions in the full order
    prefix = np.asarray(prefixes, np.int64)
    within = np.arange(len(grams)) - offset[owner]
    keep = within < prefix[owner]
    p_num, p_own, p_pos = number[keep], owner[keep], (within + single[owner])[keep]
    by = np.argsort(p_num, kind="stable")
    p_num, p_own, p_pos = p_num[by], p_own[by], p_pos[by]
    post = np.searchsorted(p_num, np.arange(v + 1))
    rank = np.empty(m, np.int64)  # a pair is looked at from its set of higher rank
    rank[np.lexsort((np.arange(m), size))] = np.arange(m)
    mark = np.zeros(v + 1, np.int32)
    for x in range(m):
        own = number[offset[x] : offset[x] + prefix[x]]
        if not len(own):
            continue
        spans = [(post[w], post[w + 1], k) for k, w in enumerate(own) if post[w + 1] - post[w] > 1]
        if not spans:
            continue
        y = np.concatenate([p_own[a:b] for a, b, _ in spans])
        ypos = np.concatenate([p_pos[a:b] for a, b, _ in spans])
        xpos = np.repeat([k + single[x] for *_, k in spans], [b - a for a, b, _ in spans])
        # length filter
        ok = (rank[y] < rank[x]) & (size[y] >= threshold * size[x] - 1e-9)
        if side is not None:
            ok &= side[y] != side[x]
        y, ypos, xpos = y[ok], ypos[ok], xpos[ok]
        if not len(y):
            continue
        # positional filter, at the last n-gram that both prefixes have
        at = np.lexsort((xpos, y))
        y, ypos, xpos = y[at], ypos[at], xpos[at]
        last = np.flatnonzero(np.append(y[1:] != y[:-1], True))
        seen = np.diff(last, prepend=-1)
        y, ypos, xpos = y[last], ypos[last], xpos[last]
        need = np.ceil(threshold / (1 + threshold) * (size[x] + size[y]) - 1e-9)
        ok = seen + np.minimum(size[x] - 1 - xpos, size[y] - 1 - ypos) >= need
        y, ypos, xpos, seen, need = y[ok], ypos[ok], xpos[ok], seen[ok], need[ok]
        if not len(y):
            continue
        # suffix filter: split both suffixes at the middle n-gram of x's; sizes left and right bound the overlap
        mine = number[offset[x] : offset[x + 1]]
        xs = np.maximum(xpos - single[x] + 1, 0)
        mid = (xs + len(mine)) // 2
        has = mid < len(mine)
        w = mine[np.minimum(mid, len(mine) - 1)]
        ys = ypos - single[y] + 1
        cut_y = np.searchsorted(flat, y * np.int64(v) + w) - offset[y]
        cut_y = np.maximum(cut_y, ys)
        left = np.minimum(mid - xs, cut_y - ys)
        right = np.minimum(len(mine) - mid, count[y] - cut_y)
        ok = ~has | (seen + left + right >= need)
        y, need = y[ok], need[ok]
        if not len(y):
            continue
        # one exact count a pair
        mark[mine] = 1
        lens = count[y]
        idx = np.repeat(offset[y] - np.concatenate([[0], np.cumsum(lens)[:-1]]), lens) + np.arange(lens.sum())
        both = np.add.reduceat(mark[number[idx]], np.concatenate([[0], np.cumsum(lens)[:-1]]))
        mark[mine] = 0
        jac = both / (size[x] + size[y] - both)
        ok = jac >= threshold - 1e-12
        if ok.any():
            yield x, y[ok], jac[ok]


def _blocks(threshold: float, forest: bool):
    """Join the blocks of a group: all pairs (ka, kb, jaccard), or with forest edges (ka, kb) that connect, and links of ka, kb = 0."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for (ba, bb), part in pdf.groupby(["ba", "bb"], sort=False):
            part = part.drop_duplicates("key")
            key = part["key"].to_numpy()
            sets = [(int(k), int(n), np.frombuffer(g, np.uint64), np.frombuffer(d, np.uint8)) for k, n, g, d in zip(key, part["size"], part["grams"], part["df"])]
            side = None if ba == bb else (part["bin"].to_numpy() == bb).astype(np.int8)
            found = join_sets(sets, part["prefix"].tolist(), side, threshold)
            if not forest:
                for x, y, jac in found:
                    out.append(pd.DataFrame({"ka": np.minimum(key[x], key[y]), "kb": np.maximum(key[x], key[y]), "jaccard": jac, "links": 0}))
                continue
            copies = part["copies"].to_numpy(np.int64)
            links, tree = np.zeros(len(sets), np.int64), np.arange(len(sets))
            ends: list[tuple[int, int]] = []
            for x, y, _ in found:
                links[x] += copies[y].sum()
                links[y] += copies[x]
                others, first = np.unique(tree[y], return_index=True)
                ends += [(x, int(y[f])) for t, f in zip(others, first) if t != tree[x]]
                tree[np.isin(tree, others)] = tree[x]
            at = np.flatnonzero(links)
            out.append(pd.DataFrame({"ka": key[at], "kb": 0, "jaccard": 1.0, "links": links[at]}))
            if ends:
                a, b = key[np.array(ends)].T
                out.append(pd.DataFrame({"ka": a, "kb": b, "jaccard": 1.0, "links": 0}))
        trim()
        return pd.concat(out, ignore_index=True) if out else pd.DataFrame({"ka": np.zeros(0, np.int64), "kb": np.zeros(0, np.int64), "jaccard": np.zeros(0), "links": np.zeros(0, np.int64)})

    return run


def set_pairs(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, forest: bool = False) -> tuple[DataFrame, DataFrame]:
    """(members, found): members (key, doc_id), key 0 without n-grams; found (ka, kb, jaccard, links) of _blocks."""
    named = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).where("doc_id is not null")
    reducers = buckets_for(named, BUCKET_BYTES)
    sent = named.mapInArrow(_mapper(n, reducers), _DDL_1)
    back = sent.groupBy("bucket").applyInPandas(_frequencies(reducers), _DDL_2)
    sets = cut(back.groupBy("home").applyInPandas(_assemble(threshold), _DDL_3))
    members = sets.where("member_key is not null").select("member_key", "member_id").mapInPandas(_members, "key long, doc_id long").distinct()
    live = sets.where("prefix > 0")
    entries = live.select("grams", "prefix", "label").mapInPandas(_prefix_entries(reducers), "bucket int, grams binary, labels binary")
    met = entries.groupBy("bucket").applyInPandas(_meetings, "la long, lb long").distinct()
    met = cut(met)
    parts = F.ceil(F.count("*") / F.lit(SUB_BLOCK)).cast("int")
    labels = live.groupBy("label").agg(F.count("*").alias("n"), parts.alias("parts")).join(components(met), "label", "left")
    # units: labels, or parts of big ones; bins: units of a component in a row, of SUB_BLOCK sets together
    units = labels.select("label", F.coalesce("root", "label").alias("root"), F.ceil(F.col("n") / F.col("parts")).alias("n"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("sub"), "parts")
    before = F.sum("n").over(Window.partitionBy("root").orderBy("label", "sub").rowsBetween(Window.unboundedPreceding, -1))
    units = cut(units.withColumn("bin", F.xxhash64("root", F.floor(F.coalesce(before, F.lit(0)) / SUB_BLOCK))))
    sub = F.pmod(F.xxhash64("key"), F.col("parts")).cast("int")
    homes = live.select("key", "label").join(labels.select("label", "parts"), "label").withColumn("sub", sub).join(units.select("label", "sub", "bin"), ["label", "sub"]).select("key", "bin")
    if forest:
        homes = homes.join(members.groupBy("key").agg(F.count("*").alias("copies")), "key")
    placed = live.select("key", "size", "prefix", "grams", "df").join(homes, "key")
    posted = placed.select("key", "size", "prefix", "grams", "bin").mapInPandas(_postings(reducers), "bucket int, grams binary, owners binary, keys binary, sizes binary, bins binary")
    routes = posted.groupBy("bucket").applyInPandas(_routes(threshold), "key long, ba long, bb long").distinct()
    grouped = placed.join(routes, "key").withColumn("work", F.pmod(F.xxhash64("ba", "bb"), F.lit(reducers))).groupBy("work")
    return members, grouped.applyInPandas(_blocks(threshold, forest), "ka long, kb long, jaccard double, links long")


def components(edges: DataFrame, a: str = "la", b: str = "lb") -> DataFrame:
    """(label, root): the least label of each connected component; labels without an edge are left out.

    Each round takes the least root among the neighbours, then jumps to that root's root, until
    no root changes; the lineage is cut each round.
    """
    both = cut(edges.select(F.col(a).alias("x"), F.col(b).alias("y")).unionByName(edges.select(F.col(b).alias("x"), F.col(a).alias("y"))).distinct())
    roots = cut(both.groupBy(F.col("x").alias("label")).agg(F.least(F.first("x"), F.min("y")).alias("root")))
    while True:
        near = both.join(roots.withColumnRenamed("label", "y"), "y").groupBy(F.col("x").alias("label")).agg(F.min("root").alias("near"))
        step = roots.join(near, "label").select("label", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        jump = step.select(F.col("label").alias("root"), F.col("root").alias("far"))
        step = cut(step.join(jump, "root", "left").select("label", "old", F.least("root", F.coalesce("far", "root")).alias("root")))
        roots = step.select("label", "root")
        if step.where("root < old").isEmpty():
            return roots


def near_duplicate_pairs(docs: DataFrame, n: int = N, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(pairs, members). members: (doc_id, same_as), the least doc_id with the same n-grams.

    pairs: (doc_a, doc_b, jaccard), doc_a < doc_b, between such least ones, so copies aren't
    expanded and no link between different texts is lost.
    """
    members, found = set_pairs(docs, n, threshold)
    members = members.where("key <> 0")
    least = members.groupBy("key").agg(F.min("doc_id").alias("least"))
    pairs = found.join(least.select(F.col("key").alias("ka"), F.col("least").alias("x")), "ka").join(least.select(F.col("key").alias("kb"), F.col("least").alias("y")), "kb").where("x <> y")
    pairs = pairs.select(F.least("x", "y").alias("doc_a"), F.greatest("x", "y").alias("doc_b"), F.round("jaccard", 6).alias("jaccard"))
    return pairs, members.join(least, "key").select("doc_id", F.col("least").alias("same_as"))


def classes(docs: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """A row for each doc_id: (doc_id, class_id, n_links).

    class_id: the least doc_id of the connected group of documents of at least this similarity,
    its own where it has no partner. n_links: the other documents it is as similar to, copies too.
    A doc_id with several different texts gets the least of their classes and the sum of their
    links; there its own texts count as others.
    """
    members, found = set_pairs(docs, n, threshold, forest=True)
    found = cut(found)
    own = members.where("key <> 0").groupBy("key").agg(F.count("*").alias("copies"), F.min("doc_id").alias("least"))
    links = found.where("kb = 0").groupBy(F.col("ka").alias("key")).agg(F.sum("links").alias("links"))
    roots = components(found.where("kb <> 0"), "ka", "kb").withColumnRenamed("label", "key")
    keys = own.join(links, "key", "left").join(roots, "key", "left").withColumn("root", F.coalesce("root", "key"))
    keys = cut(keys.select("key", "root", "least", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links")))
    low = keys.groupBy("root").agg(F.min("least").alias("low"))
    lone = members.where("key = 0").select("doc_id", F.col("doc_id").alias("low"), F.lit(0).cast("long").alias("links"))
    each = members.where("key <> 0").join(keys.join(low, "root").select("key", "low", "links"), "key").select("doc_id", "low", "links").unionByName(lone)
    return each.groupBy("doc_id").agg(F.min("low").alias("class_id"), F.sum("links").alias("n_links"))


def drop_near_duplicates(docs: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """The documents without all but the first (least doc_id) of each group; columns as they came.

    Rows that repeat a doc_id keep or lose together; rows with a null doc_id stay.
    """
    name = spare(docs, "gone")
    gone = classes(docs, n, threshold).where("class_id < doc_id").select(F.col("doc_id").alias(name))
    return docs.join(gone, docs["doc_id"].cast("long") == gone[name], "left_anti")
