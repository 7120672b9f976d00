"""Operators on a collection's rows, as plans: normalise, upsert, match, update, delete, get.

Rows: chunk_id, item_id, chunk_idx, seq, text, metadata (JSON), code. `seq` is the insertion order.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import metadata as M
from ..functions import vector as V

SCHEMA = "chunk_id string, item_id string, chunk_idx int, seq long, text string, metadata string, code array<int>"
COLUMNS = ["chunk_id", "item_id", "chunk_idx", "seq", "text", "metadata", "code"]
PLANES = [f"p{k}" for k in range(8)]


def derived(code: Sequence[int]) -> dict[str, int | None]:
    """width, and the planes of a code of up to 64 bytes."""
    found = V.planes_of(code) if len(code) <= 64 else [None] * 8
    return {"width": len(code), **dict(zip(PLANES, found))}


def upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """New rows replace those of their chunk_id and keep their seq; others come after all old ones, in the order of new's seq.

    Of new rows of one chunk_id the last by seq counts, at the place of the first.
    """
    new = distinct(new)
    top = F.coalesce(F.max("seq") + 1, F.lit(0).cast("long"))
    base = old.agg(top.alias("__top"))  # one row
    kept = old.select("chunk_id", F.col("seq").alias("__old"))
    put = new.join(kept, "chunk_id", "left").crossJoin(F.broadcast(base)).withColumn("seq", F.coalesce("__old", F.col("__top") + F.col("seq")))
    return old.join(new.select("chunk_id"), "chunk_id", "left_anti").select(*old.columns).unionByName(put.select(*old.columns))


def distinct(new: DataFrame) -> DataFrame:
    """A row for each chunk_id: the last by seq, with the least seq."""
    own = Window.partitionBy("chunk_id")
    ranked = new.withColumns({"__r": F.row_number().over(own.orderBy(F.desc("seq"))), "__first": F.min("seq").over(own)})
    return ranked.where("__r = 1").withColumn("seq", F.col("__first")).select(*new.columns)


def matched(df: DataFrame, ids: DataFrame, match: str = "exact") -> DataFrame:
    """(chunk_id, id): rows of each id. exact: item_id equals; prefix: chunk_id starts with the id and an underscore.

    Prefixes are made of the rows and joined on equality, so there is no nested loop.
    """
    if match == "exact":
        return df.select("chunk_id", F.col("item_id").alias("id")).join(ids.select("id").distinct(), "id").select("chunk_id", "id")
    parts = F.split("chunk_id", "_")
    heads = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "_"))
    rows = df.where(F.size(parts) > 1).select("chunk_id", F.explode(heads).alias("id"))
    return rows.join(ids.select("id").distinct(), "id").select("chunk_id", "id")


def is_item(item: str, match: str = "exact") -> Column:
    return F.col("item_id") == item if match == "exact" else F.startswith(F.col("chunk_id"), F.lit(f"{item}_"))


def update(df: DataFrame, item: str, text: str | None = None, metadata: str | None = None, code: Sequence[int] | None = None, match: str = "exact") -> DataFrame:
    """All chunks of an item get the text, the merged metadata (JSON) and the code."""
    hit, new = is_item(item, match), {}
    if text is not None:
        new["text"] = F.when(hit, F.lit(text)).otherwise(F.col("text"))
    if metadata is not None:
        new["metadata"] = F.when(hit, M.merge(F.col("metadata"), F.lit(metadata))).otherwise(F.col("metadata"))
    if code is not None:
        new["code"] = F.when(hit, F.lit([int(b) for b in code])).otherwise(F.col("code"))
        for name, v in derived(code).items():
            if name in df.columns:
                new[name] = F.when(hit, F.lit(v)).otherwise(F.col(name))
    return df.withColumns(new) if new else df


def delete(df: DataFrame, ids: DataFrame, match: str = "exact") -> DataFrame:
    return df.join(matched(df, ids, match).select("chunk_id"), "chunk_id", "left_anti").select(*df.columns)


def joined(df: DataFrame, requests: DataFrame, match: str = "exact") -> DataFrame:
    """(pos, id, text, metadata) of each request (pos, id) that has chunks: texts joined by a space, metadata merged, in order of seq."""
    hits = matched(df, requests, match).join(df.select("chunk_id", "seq", "text", "metadata"), "chunk_id")
    one = hits.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("seq", "text", F.coalesce("metadata", F.lit("{}")).alias("metadata")))).alias("c"))
    maps = F.transform("c", lambda x: F.from_json(x["metadata"], "map<string,variant>"))
    empty = F.expr("cast(map() as map<string,variant>)")
    folded = F.aggregate(maps, empty, lambda a, m: F.map_concat(a, F.coalesce(m, empty)))
    text = F.array_join(F.transform("c", lambda x: F.coalesce(x["text"], F.lit(""))), " ")
    return requests.join(one.select("id", text.alias("text"), F.to_json(folded).alias("metadata")), "id").select("pos", "id", "text", "metadata")


def listed(df: DataFrame, match: str = "exact") -> DataFrame:
    """(seq, id, text, metadata): a row for each chunk; prefix mode cuts the id at its first underscore."""
    item = F.col("item_id") if match == "exact" else F.substring_index("chunk_id", "_", 1)
    return df.select("seq", item.alias("id"), "text", "metadata")


def where(df: DataFrame, conditions: Mapping[str, Any] | None) -> DataFrame:
    return df.where(M.matches(F.col("metadata"), conditions)) if conditions is not None else df
