"""Vector functions as Catalyst expressions: packing, bit-planes and distances.

A code is a vector of bytes 0..255; feature 8j of the vector is the most significant bit of
byte j. Plane k (0 the most significant) gathers bit 7-k of the bytes in 64-bit words, so the
distance needs only XOR and popcount on longs and stays in whole-stage codegen.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def pack_bits(vector: Column, dims: int | None = None) -> Column:
    """array<int> of bytes: bit 1 where the feature is > 0; missing features at the end count as 0.

    dims: the length of all vectors, where known; the expression then has no lambda.
    """
    if dims is not None:
        return F.array(*[_sum(F.when(F.get(vector, F.lit(8 * j + k)) > 0, F.lit(1 << (7 - k))).otherwise(F.lit(0)) for k in range(8)) for j in range((dims + 7) // 8)])
    n = F.floor((F.size(vector) + 7) / 8).cast("int")

    def byte(j: Column) -> Column:
        bits = [F.when(F.coalesce(F.get(vector, (j * 8 + k).cast("int")), F.lit(0.0)) > 0, F.lit(1 << (7 - k))).otherwise(F.lit(0)) for k in range(8)]
        out = bits[0]
        for b in bits[1:]:
            out = out + b
        return out

    return F.when(n == 0, F.array().cast("array<int>")).otherwise(F.transform(F.sequence(F.lit(0), n - 1), byte))


def _sum(parts) -> Column:
    return functools.reduce(lambda a, b: a + b, parts)


def planes(code: Column, words: int = 1, width: int | None = None) -> list[Column]:
    """8 * words longs: word w of plane k is column k * words + w; up to 64 bytes a word.

    width: that of all codes, where known and small; the expression then has no lambda.
    """
    if width is not None and width <= 8:
        return [functools.reduce(Column.bitwiseOR, [F.shiftleft(F.shiftright(F.get(code, F.lit(j)), 7 - k).bitwiseAND(F.lit(1)).cast("long"), 63 - j) for j in range(width)]) for k in range(8)]
    out = []
    for k in range(8):
        for w in range(words):
            part = F.slice(code, F.lit(w * 64 + 1), F.lit(64))
            shifted = F.transform(part, _placed(k))
            out.append(F.aggregate(shifted, F.lit(0).cast("long"), lambda a, v: a.bitwiseOR(v)))
    return out


def _placed(k: int) -> Callable[[Column, Column], Column]:
    def place(b: Column, i: Column) -> Column:
        bit = F.shiftright(b, 7 - k).bitwiseAND(F.lit(1)).cast("long")
        return F.call_function("shiftleft", bit, (F.lit(63) - i).cast("int"))

    return place


def planes_of(code: Sequence[int], words: int = 1) -> list[int]:
    """The same on the driver, for a query's code; signed 64-bit values."""
    out = []
    for k in range(8):
        for w in range(words):
            v = 0
            for i, b in enumerate(code[w * 64 : w * 64 + 64]):
                v |= ((b >> (7 - k)) & 1) << (63 - i)
            out.append(v - (1 << 64) if v >> 63 else v)
    return out


def plane_distance(left: Sequence[Column], right: Sequence[Column], words: int = 1) -> Column:
    """Weighted XOR distance from bit-planes, as BIGINT."""
    total = None
    for k in range(8):
        for w in range(words):
            i = k * words + w
            term = F.bit_count(left[i].bitwiseXOR(right[i])).cast("long") * F.lit(1 << (7 - k)).cast("long")
            total = term if total is None else total + term
    return total


def xor_distance(a: Column, b: Column) -> Column:
    """Sum of the bytes' XOR, for codes of any equal width."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.bitwiseXOR(y)), F.lit(0).cast("long"), lambda s, v: s + v)


def byte_mismatches(a: Column, b: Column) -> Column:
    """Bytes that differ; the right code is cut to the left one's width."""
    return F.size(F.filter(F.zip_with(a, F.slice(b, F.lit(1), F.size(a)), lambda x, y: F.when(x != y, F.lit(True)).otherwise(F.lit(False))), lambda z: z)).cast("long")


def bit_mismatches(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y)).cast("long")), F.lit(0).cast("long"), lambda s, v: s + v)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def l2_normalize(a: Column) -> Column:
    """Every feature over the L2 norm, which counts as 1e-12 at least."""
    n = F.greatest(norm(a), F.lit(1e-12))
    return F.transform(a, lambda x: x.cast("double") / n)
