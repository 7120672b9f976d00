"""Metadata: JSON objects in a string column, compared and merged in generated code.

Equality is by JSON value at top-level keys: "69" isn't 69, 69 equals 69.0, a missing key equals
null, objects don't care about the order of their keys, lists do. True isn't 1.
"""

from __future__ import annotations

import json
from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


def value_of(metadata: Column, key: str) -> Column:
    """The variant under a top-level key; null where it is missing or the text is no JSON."""
    quote = "'" if '"' in key else '"'
    return F.try_variant_get(F.try_parse_json(metadata), f"$[{quote}{key}{quote}]", "variant")


def equals(metadata: Column, key: str, value: Any) -> Column:
    v = value_of(metadata, key)
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        kind = F.schema_of_variant(v)
        number = F.try_variant_get(v, "$", "double")
        same = F.when(kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL|INT|SMALLINT|TINYINT)"), number == F.lit(float(value)))
        return F.coalesce(same, F.lit(False))
    wanted = F.nullif(F.to_json(F.parse_json(F.lit(json.dumps(value)))), F.lit("null"))
    return F.nullif(F.to_json(v), F.lit("null")).eqNullSafe(wanted)


def matches(metadata: Column, where: Mapping[str, Any]) -> Column:
    """All keys equal; an empty filter matches all rows."""
    out = F.lit(True)
    for key, value in where.items():
        out = out & equals(metadata, key, value)
    return out


def merge(*parts: Column) -> Column:
    """Shallow merge of JSON objects, the later one wins; keys keep their first place. Needs LAST_WIN (see session())."""
    maps = [F.coalesce(F.from_json(p, "map<string,variant>"), F.expr("cast(map() as map<string,variant>)")) for p in parts]
    return F.to_json(F.map_concat(*maps))


def session(spark) -> None:
    """Let map_concat take the last of equal keys."""
    spark.conf.set("spark.sql.mapKeyDedupPolicy", "LAST_WIN")
