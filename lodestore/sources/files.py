"""Ingestion of text, CSV, DOCX, PDF and web pages through Spark's readers.

Each reader takes a path or glob and gives rows (file, chunk_idx, chunk) in a distributed way;
process_file() is the dispatcher for one file that collects its chunks.
"""

from __future__ import annotations

import io
import os
import re
import zipfile
from collections.abc import Callable
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def _file() -> Column:
    return F.col("_metadata.file_path").alias("file")


def read_txt(spark: SparkSession, path: str) -> DataFrame:
    """(file, text): whole files."""
    return spark.read.text(path, wholetext=True).select(_file(), F.col("value").alias("text"))


def txt_chunks(spark: SparkSession, path: str, tokenizer: T.Tokenizer, chunk_size: int = T.CHUNK_TOKENS) -> DataFrame:
    return T.exploded(read_txt(spark, path), T.token_chunks(tokenizer, chunk_size)(F.col("text")), "file")


def rendered(df: DataFrame) -> Column:
    """A row's cells as strings the way pandas shows them: empty cells are `nan` and make an integer column a float one."""
    floats = {c for c, t in df.dtypes if t in ("int", "bigint", "smallint", "tinyint")}
    gaps = {}
    if floats:
        row = df.agg(*[F.max(F.col(f"`{c}`").isNull()).alias(c) for c in floats]).first()
        gaps = {c: bool(row[c]) for c in floats}

    def cell(name: str, kind: str) -> Column:
        c = F.col(f"`{name}`")
        if gaps.get(name):
            s = c.cast("double").cast("string")
        elif kind == "boolean":
            s = F.when(c, F.lit("True")).when(~c, F.lit("False"))
        elif kind == "double":
            s = F.when(c == F.floor(c), F.format_string("%.1f", c)).otherwise(c.cast("string"))
            s = F.when(F.abs(c) < 1e15, s).otherwise(c.cast("string"))
        else:
            s = c.cast("string")
        return F.coalesce(s, F.lit("nan"))

    return F.array(*[cell(c, t) for c, t in df.dtypes])


def csv_rows(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """(cells): each row's cells as strings; the first line is the header.

    multi_line: cells may have line breaks; a file is then read by one task. Without it large files are split.
    """
    df = spark.read.csv(path, header=True, inferSchema=True, multiLine=multi_line, escape='"')
    return df.select(rendered(df).alias("cells"))


def docx_text(data: bytes) -> str:
    """Paragraphs of a Word document, with tabs and line breaks."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    out = []
    for node in root.iter():
        if node.tag == f"{_W}t":
            out.append(node.text or "")
        elif node.tag == f"{_W}tab":
            out.append("\t")
        elif node.tag in (f"{_W}br", f"{_W}cr"):
            out.append("\n")
        elif node.tag == f"{_W}p":
            out.append("\n\n")
    return "".join(out).strip()


def docx_of(text: str) -> bytes:
    """The least Word document with a text, a paragraph for each line."""
    body = "".join(f'<w:p><w:r><w:t xml:space="preserve">{escape(line)}</w:t></w:r></w:p>' for line in text.split("\n"))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{_W[1:-1]}"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def read_docx(spark: SparkSession, path: str) -> DataFrame:
    @F.pandas_udf("string")
    def text(data: pd.Series) -> pd.Series:
        return pd.Series([docx_text(bytes(d)) for d in data], dtype=object)

    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), text("content").alias("text"))


def docx_chunks(spark: SparkSession, path: str, tokenizer: T.Tokenizer, chunk_size: int = T.CHUNK_TOKENS) -> DataFrame:
    return T.exploded(read_docx(spark, path), T.token_chunks(tokenizer, chunk_size)(F.col("text")), "file")


def pdf_pages_of(data: bytes) -> list[str]:
    try:
        from pypdf import PdfReader
    except ImportError as e:
        raise ImportError("reading PDF files needs the optional package pypdf") from e
    return [p.extract_text() for p in PdfReader(io.BytesIO(data)).pages]


def pdf_pages(spark: SparkSession, path: str) -> DataFrame:
    """(file, page, text)."""
    pdf_pages_available()

    @F.pandas_udf("array<string>")
    def pages(data: pd.Series) -> pd.Series:
        return pd.Series([pdf_pages_of(bytes(d)) for d in data], dtype=object)

    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), F.posexplode(pages("content")).alias("page", "text"))


def pdf_pages_available() -> None:
    try:
        import pypdf  # noqa: F401
    except ImportError as e:
        raise ImportError("reading PDF files needs the optional package pypdf") from e


def ocr_pages(spark: SparkSession, path: str, ocr: Callable[[bytes], list[str]]) -> DataFrame:
    """(file, page, text) by a function from a file's bytes to its pages' texts, such as an OCR package gives."""

    @F.pandas_udf("array<string>")
    def pages(data: pd.Series) -> pd.Series:
        return pd.Series([ocr(bytes(d)) for d in data], dtype=object)

    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), F.posexplode(pages("content")).alias("page", "text"))


def pdf_chunks(spark: SparkSession, path: str, tokenizer: T.Tokenizer, chunk_size: int = T.CHUNK_TOKENS, use_ocr: bool = False, ocr: Callable[[bytes], list[str]] | None = None) -> DataFrame:
    """Pages joined without a separator, then chunked. use_ocr: pages are read by `ocr`."""
    if use_ocr and ocr is None:
        raise ImportError("OCR needs a function that reads a file's pages")
    read = ocr_pages(spark, path, ocr) if use_ocr and ocr else pdf_pages(spark, path)
    pages = read.groupBy("file").agg(F.sort_array(F.collect_list(F.struct("page", "text"))).alias("p"))
    whole = pages.select("file", F.array_join(F.transform("p", lambda x: x["text"]), "").alias("text"))
    return T.exploded(whole, T.token_chunks(tokenizer, chunk_size)(F.col("text")), "file")


def page_chunks(pages: DataFrame, tokenizer: T.Tokenizer, key: str = "page_id", page: str = "html", chunk_size: int = T.CHUNK_TOKENS) -> DataFrame:
    """Chunks of the text of pages given as HTML."""
    texts = pages.select(key, T.parsed_page_text(F.col(page)).alias("text"))
    return T.exploded(texts, T.token_chunks(tokenizer, chunk_size)(F.col("text")), key)


def fetch(url: str, timeout: float = 30.0) -> str:
    """A page over the network, on the driver."""
    from urllib.request import urlopen

    with urlopen(url, timeout=timeout) as r:
        return r.read().decode(r.headers.get_content_charset() or "utf-8", "replace")


def process_webpage(url: str, tokenizer: T.Tokenizer, chunk_size: int = T.CHUNK_TOKENS) -> list[str]:
    return T.token_windows(tokenizer, T.page_text_of(fetch(url)), chunk_size)


def process_file(spark: SparkSession, path: str, tokenizer: T.Tokenizer | None = None, chunk_size: int = T.CHUNK_TOKENS) -> list:
    """The chunks of one file, by its extension; a CSV file's rows as lists of cells."""
    if not os.path.isfile(path):
        raise FileNotFoundError(f"no such file: {path}")
    tokenizer = tokenizer or T.WordTokenizer()
    kind = os.path.splitext(path)[1].lower()
    where = "file://" + re.sub(r"([\[\]{}*?\\])", r"\\\1", os.path.abspath(path))
    if kind == ".csv":
        return [list(r.cells) for r in csv_rows(spark, where).collect()]
    readers = {".txt": txt_chunks, ".docx": docx_chunks, ".pdf": pdf_chunks}
    if kind not in readers:
        raise ValueError(f"unsupported file type: {kind}")
    return [r.chunk for r in readers[kind](spark, where, tokenizer, chunk_size).orderBy("chunk_idx").collect()]
