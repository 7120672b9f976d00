"""The folder that all executors share, and reliable checkpoints in it."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or in a local session (tests) a folder of our own where that is unset."""
    sc = spark.sparkContext
    own = sc._jsc.sc().getCheckpointDir()
    at = sc.getConf().get("spark.checkpoint.dir") or (own.get() if own.isDefined() else None)
    if at is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        at = tempfile.mkdtemp(prefix="lodestore-")
    if not own.isDefined():
        sc.setCheckpointDir(at)
    return at


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
