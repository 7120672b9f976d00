"""The corpus pipeline: documents in, encoded clean documents out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet in
the shared folder and read again as the next stage's docs, so a lost executor costs a task and
not a stage; only the last one's table stays. All stages but the last return the columns of
documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from lodestore.llm import decontaminate, jaccard_join, pieces, quality, secrets
from lodestore.llm._common import shared_dir, table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents of poor quality and toxic ones."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the least doc_id of each group of near duplicates."""
    return jaccard_join.drop_near_duplicates(docs)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove passages of the benchmark; drop documents that are mostly such."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mask secrets in the texts."""
    return secrets.redact(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode the texts: doc_id, ids, n_pieces, checked, round_trip."""
    return pieces.encode(docs)


STAGES = [
    ("quality classifier", keep_quality),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("benchmark decontamination", decontaminate_benchmark),
    ("secret scans", mask_secrets),
    ("SentencePiece encoding and decoding", encode_pieces),
]

#: The first stages fit a model and follow graphs, which SQL can't express; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        at = f"{folder}/{k}.parquet"
        stage(spark, docs, sf_dir).write.parquet(at)
        docs = spark.read.parquet(at)
        if k:
            _remove(spark, f"{folder}/{k - 1}.parquet")
    return docs


def _remove(spark: SparkSession, path: str) -> None:
    """Delete a stage's table that has been read for the last time."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
