"""The CTX file format as a Python data source: spark.read.format("ctx").load(path), df.write.format("ctx").

A file is the magic CTXF, a little-endian u32 version 1, and sections (u32 kind, u32 length,
payload): 0 header JSON, 1 embeddings of 64 float32 each (left out when there are none), 2 texts
(u32 byte length, UTF-8), 3 metadata JSON {chunk id: object}.

Rows: pos INT, chunk_id STRING, text STRING, embedding ARRAY<FLOAT>, metadata STRING (JSON), file
STRING. Positions pair the sections; where one is shorter its column is null. A text that isn't
UTF-8 is null and shifts no other.

Paths are local ones or URIs of any file system that pyarrow knows (file, hdfs, s3, gs); executors
and driver must share them. Each task of a write streams its rows' sections into files beside the
target; the driver joins them in the order of the partitions, some MB at a time, and renames. The
format bounds a section to 4 GB: what is beyond goes to further files of the same format, which
the first one's header names as `parts`; read through the first they are one collection, and
positions go on. The reader cuts files into ranges of rows of about RANGE_BYTES of texts; a file
with a damaged or repeated section or a repeated chunk id is read whole by one task.
"""

from __future__ import annotations

import fnmatch
import json
import os
import struct
import uuid
from array import array
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

MAGIC, VERSION, WIDTH = b"CTXF", 1, 64
HEADER, EMBEDDINGS, TEXTS, METADATA = range(4)
SCHEMA = "pos int, chunk_id string, text string, embedding array<float>, metadata string, file string"
#: Most bytes of a section, by its u32 length.
SECTION_BYTES = (1 << 32) - 1
#: Texts and rows that a task reads at once; a writing task begins new files after so many bytes of a section.
RANGE_BYTES, RANGE_ROWS, PART_BYTES = 8 << 20, 1 << 13, 256 << 20
_IO_BYTES = 4 << 20


def to_disk(byte: int) -> int:
    """A byte of a packed code as the format has it."""
    return byte - 128 if byte < 128 else byte - 384


def from_disk(value: float) -> int:
    return (int(value) & 0xFF) ^ 0x80


@dataclass
class Contents:
    header: dict[str, Any] = field(default_factory=dict)
    embeddings: list[tuple[float, ...]] = field(default_factory=list)
    texts: list[str | None] = field(default_factory=list)
    metadata: dict[str, Any] = field(default_factory=dict)


def dumps(c: Contents) -> bytes:
    out = [MAGIC, struct.pack("<I", VERSION)]

    def section(kind: int, payload: bytes) -> None:
        out.append(struct.pack("<II", kind, len(payload)) + payload)

    section(HEADER, json.dumps(c.header).encode())
    if c.embeddings:
        section(EMBEDDINGS, b"".join(struct.pack(f"<{WIDTH}f", *e[:WIDTH]) for e in c.embeddings))
    texts = [(t or "").encode() for t in c.texts]
    section(TEXTS, b"".join(struct.pack("<I", len(t)) + t for t in texts))
    section(METADATA, json.dumps(c.metadata).encode())
    return b"".join(out)


def loads(data: bytes) -> Contents:
    if data[:4] != MAGIC:
        raise ValueError(f"not a CTX file: it begins with {data[:4]!r}")
    version = struct.unpack_from("<I", data, 4)[0]
    if version != VERSION:
        raise ValueError(f"CTX version {version} isn't supported")
    c, at = Contents(), 8
    while at < len(data):
        kind, size = struct.unpack_from("<II", data, at)
        body = data[at + 8 : at + 8 + size]
        at += 8 + size
        if kind == HEADER:
            c.header = json.loads(body)
        elif kind == EMBEDDINGS:
            c.embeddings = list(struct.iter_unpack(f"<{WIDTH}f", body[: len(body) // (4 * WIDTH) * 4 * WIDTH]))
        elif kind == TEXTS:
            p = 0
            while p < len(body):
                n = struct.unpack_from("<I", body, p)[0]
                try:
                    c.texts.append(body[p + 4 : p + 4 + n].decode())
                except UnicodeDecodeError:
                    c.texts.append(None)
                p += 4 + n
        elif kind == METADATA:
            c.metadata = json.loads(body)
        else:
            raise ValueError(f"unknown CTX section {kind}")
    return c


def rows_of(c: Contents, name: str) -> Iterator[tuple]:
    ids = list(c.metadata)
    for i in range(max(len(ids), len(c.texts), len(c.embeddings))):
        key = ids[i] if i < len(ids) else None
        yield (
            i,
            key,
            c.texts[i] if i < len(c.texts) else None,
            [float(v) for v in c.embeddings[i]] if i < len(c.embeddings) else None,
            json.dumps(c.metadata[key]) if key is not None else None,
            name,
        )


def _fs(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path else os.path.abspath(path.removeprefix("file:")))


def _exists(path: str) -> bool:
    fs, p = _fs(path)
    return fs.get_file_info(p).type == pafs.FileType.File


def _read(path: str) -> bytes:
    fs, p = _fs(path)
    with fs.open_input_stream(p) as f:
        return f.read()


def _write(path: str, data: bytes) -> None:
    fs, p = _fs(path)
    fs.create_dir(os.path.dirname(p), recursive=True)
    with fs.open_output_stream(p) as f:
        f.write(data)


def _delete(path: str) -> None:
    if _exists(path):
        fs, p = _fs(path)
        fs.delete_file(p)


def _files(path: str) -> list[str]:
    """A file, the .ctx files of a folder, or those that match a pattern in their last part."""
    fs, p = _fs(path)
    info = fs.get_file_info(p)
    if info.type == pafs.FileType.File:
        return [path]
    folder, pattern = (p, "*.ctx") if info.type == pafs.FileType.Directory else os.path.split(p)
    there = fs.get_file_info(pafs.FileSelector(folder, allow_not_found=True))
    root = path[: len(path) - len(p)] if path.endswith(p) else ""
    return sorted(root + x.path for x in there if x.type == pafs.FileType.File and fnmatch.fnmatch(x.base_name, pattern))


class _Odd(Exception):
    """A file that only loads() can tell the contents of."""


def _sections(f: pa.NativeFile) -> dict[int, tuple[int, int]]:
    """Where each section's payload begins, and its length."""
    size, found, at = f.size(), {}, 8
    if f.read_at(8, 0) != MAGIC + struct.pack("<I", VERSION):
        raise _Odd
    while at < size:
        head = f.read_at(8, at)
        kind, n = struct.unpack("<II", head) if len(head) == 8 else (-1, 0)
        if kind not in range(4) or kind in found or at + 8 + n > size:
            raise _Odd
        found[kind] = at + 8, n
        at += 8 + n
    return found


def _header(f: pa.NativeFile, sections: dict[int, tuple[int, int]]) -> dict[str, Any]:
    at, n = sections.get(HEADER, (0, 0))
    return json.loads(f.read_at(n, at)) if n else {}


def _text_ranges(f: pa.NativeFile, begin: int, size: int) -> Iterator[tuple[int, int]]:
    """(row, offset in the section) where ranges begin, and of the end."""
    rows = last_row = at = last = low = 0
    held = b""
    yield 0, 0
    while at < size:
        if at + 4 > low + len(held):
            low, held = at, f.read_at(min(_IO_BYTES, size - at), begin + at)
        if at + 4 > size:
            raise _Odd
        at += 4 + struct.unpack_from("<I", held, at - low)[0]
        rows += 1
        if at > size:
            raise _Odd
        if at - last >= RANGE_BYTES or rows - last_row >= RANGE_ROWS or at == size:
            yield rows, at
            last_row, last = rows, at


def _entries(f: pa.NativeFile, begin: int, size: int) -> tuple[array, int]:
    """Where each entry of the section's JSON object begins, and where the last one ends; and how many names differ.

    Read as Latin-1, in which places in the text are places in the bytes.
    """
    low, held, p = begin, "", 0
    starts, names = array("Q"), array("q")

    def more(least: int = 0) -> bool:
        nonlocal low, held, p
        there = low + len(held)
        got = f.read_at(min(max(_IO_BYTES, least), begin + size - there), there).decode("latin-1")
        low, held, p = low + p, held[p:] + got, 0
        return bool(got)

    def skip() -> str:
        nonlocal p
        while True:
            while p < len(held) and held[p] in " \t\n\r":
                p += 1
            if p < len(held):
                return held[p]
            if not more():
                raise _Odd

    def value() -> Any:
        nonlocal p
        skip()
        while True:
            try:
                v, e = _SCAN.raw_decode(held, p)
            except ValueError:
                e = len(held)
            if e < len(held):  # else it may go on
                p = e
                return v
            if not more(len(held)):
                raise _Odd

    def take() -> str:
        nonlocal p
        found = skip()
        p += 1
        return found

    if take() != "{":
        raise _Odd
    end = skip()
    while end != "}":
        skip()
        start = low + p
        name = value()
        if not isinstance(name, str):
            raise _Odd
        if not name.isascii():
            name = json.loads(f.read_at(low + p - start, start))
        if take() != ":":
            raise _Odd
        value()
        starts.append(start)
        names.append(hash(name))
        last, end = low + p, take()
        if end not in ",}":
            raise _Odd
    starts.append(last if names else begin)
    return starts, len(np.unique(np.frombuffer(names, np.int64))) if names else 0


_SCAN = json.JSONDecoder()


def _ranges(path: str, before: int) -> tuple[list[tuple], int, list[str]]:
    """Of a file: what tasks read of it, its rows and the files that go on from it. before: rows before it."""
    fs, p = _fs(path)
    with fs.open_input_file(p) as f:
        try:
            sections = _sections(f)
            more = _header(f, sections).get("parts", [])
            place, size = sections.get(EMBEDDINGS, (0, 0))
            embedded = size // (4 * WIDTH)
            begin, size = sections.get(TEXTS, (0, 0))
            texts = dict(_text_ranges(f, begin, size))
            starts, named = _entries(f, *sections[METADATA]) if METADATA in sections else (array("Q", [0]), 0)
            n_texts, rows = max(texts), max(max(texts), embedded, named)
            if named < len(starts) - 1:
                return [(path, before)], rows, more
        except _Odd:
            c = loads(_read(path))
            return [(path, before)], max(len(c.metadata), len(c.texts), len(c.embeddings)), c.header.get("parts", [])
    edges = sorted({*texts, *range(n_texts, rows, RANGE_ROWS), rows})
    out = []
    for a, b in zip(edges, edges[1:]):
        own = (begin + texts[a], begin + texts[b]) if b <= n_texts else (0, 0)
        out.append((path, before, a, b, own, (place + 4 * WIDTH * min(a, embedded), place + 4 * WIDTH * min(b, embedded)), (starts[min(a, named)], starts[min(b, named)])))
    return out, rows, more


def _beside(path: str, name: str) -> str:
    return f"{os.path.dirname(path)}/{name}" if "/" in path else name


_ARROW = pa.schema([("pos", pa.int32()), ("chunk_id", pa.string()), ("text", pa.string()), ("embedding", pa.list_(pa.float32())), ("metadata", pa.string()), ("file", pa.string())])


def _batch(path: str, before: int, a: int, b: int, text: tuple[int, int], vectors: tuple[int, int], named: tuple[int, int]) -> pa.RecordBatch:
    """Rows a to b of a file, of these places in it."""
    fs, p = _fs(path)
    with fs.open_input_file(p) as f:
        texts, body, at = [], f.read_at(text[1] - text[0], text[0]), 0
        while at < len(body):
            n = struct.unpack_from("<I", body, at)[0]
            try:
                texts.append(body[at + 4 : at + 4 + n].decode())
            except UnicodeDecodeError:
                texts.append(None)
            at += 4 + n
        floats = np.frombuffer(f.read_at(vectors[1] - vectors[0], vectors[0]), "<f4")
        noted = json.loads(b"{" + f.read_at(named[1] - named[0], named[0]).rstrip(b", \t\n\r") + b"}")
    m, k = b - a, len(floats) // WIDTH
    offsets = pa.array([*range(0, k * WIDTH, WIDTH), *[None] * (m - k), k * WIDTH] if k < m else range(0, (k + 1) * WIDTH, WIDTH), pa.int32())
    fill = lambda x: pa.array([*x, *[None] * (m - len(x))], pa.string())
    columns = [pa.array(range(before + a, before + b), pa.int32()), fill(list(noted)), fill(texts), pa.ListArray.from_arrays(offsets, pa.array(floats, pa.float32())), fill([json.dumps(v) for v in noted.values()]), pa.array([path] * m, pa.string())]
    return pa.RecordBatch.from_arrays(columns, schema=_ARROW)


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> Sequence[InputPartition]:
        out = []
        for first in _files(self.path):
            before, files = 0, [first]
            for path in files:
                found, rows, more = _ranges(path, before)
                out += map(InputPartition, found)
                before += rows
                files += [_beside(first, x) for x in more]
        return out or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[tuple] | Iterator[pa.RecordBatch]:
        part = partition.value
        if part is not None and len(part) > 2:
            yield _batch(*part)
        elif part is not None:
            for pos, *row in rows_of(loads(_read(part[0])), part[0]):
                yield pos + part[1], *row


@dataclass
class _Written(WriterCommitMessage):
    #: Of each part: the start of its files' names, and the bytes of their embeddings, texts and metadata.
    partition: int
    parts: list[tuple[str, list[int]]]


class _Part:
    """A task's rows as three files beside the target."""

    def __init__(self, path: str):
        self.path, self.bytes = path, [0, 0, 0]
        self.files = []
        for k in range(3):
            fs, p = _fs(f"{path}.{k}")
            self.files.append(fs.open_output_stream(p))

    def add(self, *payload: bytes) -> None:
        for k, data in enumerate(payload):
            self.files[k].write(data)
            self.bytes[k] += len(data)

    def close(self) -> None:
        for f in self.files:
            f.close()


def _payloads(batch: pa.RecordBatch) -> Iterator[tuple[bytes, bytes, bytes]]:
    """Embeddings, texts and metadata entries of some MB of rows at a time; each entry but a section's first has a comma before it."""
    column = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
    e = column["embedding"]
    if e.null_count or (pc.min(pc.list_value_length(e)).as_py() or 0) < WIDTH or e.flatten().null_count:
        raise ValueError(f"each embedding needs {WIDTH} numbers")
    sizes = np.cumsum(pc.fill_null(pc.binary_length(column["text"]), 0).to_numpy(zero_copy_only=False))
    a = 0
    while a < batch.num_rows:
        b = max(a + 1, int(np.searchsorted(sizes, (sizes[a - 1] if a else 0) + RANGE_BYTES, "right")))
        part = {k: c.slice(a, b - a) for k, c in column.items()}
        lengths = pc.list_value_length(part["embedding"]).to_numpy(zero_copy_only=False)
        values, first = part["embedding"].flatten().to_numpy(zero_copy_only=False), np.cumsum(lengths) - lengths
        vectors = values[first[:, None] + np.arange(WIDTH)].astype("<f4").tobytes()
        texts = [(t or "").encode() for t in part["text"].to_pylist()]
        noted = [f", {json.dumps('null' if i is None else i)}: {json.dumps(json.loads(m or '{}'))}" for i, m in zip(part["chunk_id"].to_pylist(), part["metadata"].to_pylist())]
        yield vectors, b"".join(x for t in texts for x in (struct.pack("<I", len(t)), t)), "".join(noted).encode()
        a = b


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, header: dict[str, Any], overwrite: bool, section_bytes: int = SECTION_BYTES):
        self.path, self.header, self.overwrite, self.section_bytes = path, header, overwrite, section_bytes
        self.folder = f"{path}.{uuid.uuid4().hex}.parts"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        done = _Written(TaskContext.get().partitionId(), [])
        part = None
        try:
            for batch in iterator:
                for payload in _payloads(batch) if batch.num_rows else ():
                    if part is None or max(map(sum, zip(part.bytes, map(len, payload)))) > min(PART_BYTES, self.section_bytes):
                        if part is not None:
                            part.close()
                        else:
                            fs, p = _fs(self.folder)
                            fs.create_dir(p, recursive=True)
                        part = _Part(f"{self.folder}/{uuid.uuid4().hex}")
                        done.parts.append((part.path, part.bytes))
                    part.add(*payload)
        finally:
            if part is not None:
                part.close()
        return done

    def commit(self, messages: list) -> None:
        try:
            if _exists(self.path) and not self.overwrite:
                raise FileExistsError(self.path)
            parts = [p for m in sorted((m for m in messages if m is not None), key=lambda m: m.partition) for p in m.parts]
            files: list[list] = [[]]
            for p in parts:
                if files[-1] and any(sum(x[1][k] for x in files[-1]) + p[1][k] > self.section_bytes for k in range(3)):
                    files.append([])
                files[-1].append(p)
            own = uuid.uuid4().hex
            names = [f"{os.path.basename(self.path)}.{own}.{i}" for i in range(1, len(files))]
            old = _parts(self.path)
            for name, some in zip(names, files[1:]):
                self._joined(_beside(self.path, name), self.header, some)
            first = f"{self.folder}/{own}"
            self._joined(first, self.header | ({"parts": names} if names else {}), files[0])
            fs, target = _fs(self.path)
            fs.move(_fs(first)[1], target)
            for name in old:
                _delete(name)
        finally:
            self._clear()

    @staticmethod
    def _joined(path: str, header: dict[str, Any], parts: list[tuple[str, list[int]]]) -> None:
        """A file of these parts, which go as they are copied, so the disk doesn't hold all twice."""
        fs, p = _fs(path)
        fs.create_dir(os.path.dirname(p), recursive=True)
        head = json.dumps(header).encode()
        with fs.open_output_stream(p) as out:
            out.write(MAGIC + struct.pack("<III", VERSION, HEADER, len(head)) + head)
            for k, kind in enumerate((EMBEDDINGS, TEXTS, METADATA)):
                size = sum(x[1][k] for x in parts)
                if kind == METADATA:  # braces, less the first comma
                    out.write(struct.pack("<II", kind, max(size - 2, 0) + 2) + b"{")
                elif size or kind == TEXTS:
                    out.write(struct.pack("<II", kind, size))
                for i, (part, _) in enumerate(parts):
                    own, q = _fs(f"{part}.{k}")
                    with own.open_input_stream(q) as f:
                        if kind == METADATA and i == 0:
                            f.read(2)
                        while data := f.read(_IO_BYTES):
                            out.write(data)
                    own.delete_file(q)
                if kind == METADATA:
                    out.write(b"}")

    def _clear(self) -> None:
        fs, p = _fs(self.folder)
        if fs.get_file_info(p).type == pafs.FileType.Directory:
            fs.delete_dir(p)

    def abort(self, messages: list) -> None:
        self._clear()


def _parts(path: str) -> list[str]:
    """The files that go on from one."""
    if not _exists(path):
        return []
    fs, p = _fs(path)
    with fs.open_input_file(p) as f:
        try:
            return [_beside(path, x) for x in _header(f, _sections(f)).get("parts", [])]
        except (_Odd, ValueError):
            return []


class CtxDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "ctx"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options["path"])

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        o = self.options
        header = {"embedding_model": o.get("embedding_model", ""), "embedding_size": int(o.get("embedding_size", WIDTH)), "embedding_dtype": o.get("embedding_dtype", "float32"), "context_length": int(o.get("context_length", 512))}
        return _Writer(o["path"], header, overwrite, int(o.get("section_bytes", SECTION_BYTES)))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(CtxDataSource)


class Catalog:
    """Names of CTX files in a folder."""

    def __init__(self, folder: str = "contexts"):
        self.folder = folder.rstrip("/")

    def get(self, name: str) -> str:
        return f"{self.folder}/{name}.ctx"

    def read(self, spark: SparkSession, name: str) -> DataFrame:
        """The file's rows; none if there is no such file."""
        register(spark)
        return spark.read.format("ctx").load(self.get(name))

    def create(self, df: DataFrame, name: str, **header: Any) -> str:
        """Write (chunk_id, text, embedding, metadata) rows in their order, that of the partitions."""
        register(df.sparkSession)
        df.write.format("ctx").options(**{k: str(v) for k, v in header.items()}).mode("overwrite").save(self.get(name))
        return self.get(name)

    def header(self, name: str) -> dict[str, Any]:
        fs, p = _fs(self.get(name))
        with fs.open_input_file(p) as f:
            try:
                return _header(f, _sections(f))
            except _Odd:
                return loads(_read(self.get(name))).header

    def delete(self, name: str) -> None:
        more = _parts(self.get(name))
        _delete(self.get(name))
        for part in more:
            _delete(part)


def describe(c: Contents) -> str:
    """A printable form of a file's contents."""
    lines = ["CtxFile:", "", "Header:", *(f"  {k}: {v}" for k, v in c.header.items())]
    for title, items in (("Embeddings", enumerate(c.embeddings)), ("Texts", enumerate(c.texts)), ("Metadata", c.metadata.items())):
        lines += ["", f"{title}:", *(f"  {k}: {list(v) if isinstance(v, tuple) else v}" for k, v in items)]
    return "\n".join(lines)
