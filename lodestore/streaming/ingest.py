"""Streaming ingestion into a collection: readStream, then one upsert and one save for each micro-batch.

A save appends new rows and rewrites only buckets in which rows were replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.collection import Collection


def ingest(stream: DataFrame, collection: Collection, item_id: str, text: str, checkpoint: str, metadata: Column | None = None, need_chunks: bool = True, available_now: bool = False, order: str | None = None) -> StreamingQuery:
    """Add the rows of a stream. Upserts are keyed by chunk id, so a repeated batch changes nothing.

    Of a batch's rows for one item the last by `order` counts; without it, the last as they were read.
    """

    def add(batch: DataFrame, _: int) -> None:
        if batch.isEmpty():
            return
        name = order
        if name is None:
            name = "__read"
            batch = batch.withColumn(name, F.monotonically_increasing_id())
        collection.add_dataframe(batch, item_id, text, metadata, need_chunks, order=name)
        collection.save()

    writer = stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
