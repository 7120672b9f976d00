"""Media columns: FLAC streams decoded to PCM blocks with seekable sample offsets.

decode_frames() reads a stream's metadata and frames: constant, verbatim, fixed and linear
predictor subframes, Rice partitions of both kinds with escapes, wasted bits and all stereo
modes, 4 to 32 bits a sample. Each frame's header CRC-8 and whole CRC-16 are verified. A
residual's unary parts depend on each other only through where they start, so a table "where
does the next code start" is built for all bits at once and then followed.

blocks() gives a row for each frame of a media column: the number of its first sample, of its
samples and its place in the stream, so a reader can seek to any sample by a range condition
on (first_sample, n_samples). encode() writes streams, for tests and for tables without media.

Defined results: a null stream has no blocks; a stream that doesn't start with the marker gives
one row with ok = false and an error; a damaged frame gives a row with ok = false, null pcm and
its error, and reading goes on at the next valid header; md5_ok is null where the stream has no
MD5, and false if a block fails or is missing; an empty table has no blocks; repeated rows each
give theirs; the key column keeps its name, an output of that name gets "_" at its end, and all
other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from operator import mul

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _table(poly: int, bits: int) -> list[int]:
    out, top, mask = [], 1 << (bits - 1), (1 << bits) - 1
    for b in range(256):
        c = b << (bits - 8)
        for _ in range(8):
            c = ((c << 1) ^ poly if c & top else c << 1) & mask
        out.append(c)
    return out


_CRC8, _CRC16 = _table(0x07, 8), _table(0x8005, 16)


def crc8(data: bytes) -> int:
    c = 0
    for b in data:
        c = _CRC8[c ^ b]
    return c


@functools.cache
def _crc16_rows() -> np.ndarray:
    """Row i: the CRC-16 of each byte with i zero bytes after it."""
    one = np.array(_CRC16, np.uint16)
    out = np.empty((4096, 256), np.uint16)
    out[0] = one
    for i in range(1, len(out)):
        out[i] = (out[i - 1] << 8) ^ one[out[i - 1] >> 8]
    return out


def crc16(data: bytes) -> int:
    """A CRC is linear, so that of a piece is the XOR of what each byte adds; the CRC so far goes into the first two bytes."""
    rows, c, whole = _crc16_rows(), 0, np.frombuffer(data, np.uint8)
    for at in range(0, len(whole), len(rows)):
        part = whole[at : at + len(rows)].copy()
        if len(part) == 1:
            c = ((c << 8) & 0xFFFF) ^ _CRC16[(c >> 8) ^ int(part[0])]
            continue
        part[0] ^= c >> 8
        part[1] ^= c & 255
        c = int(np.bitwise_xor.reduce(rows[np.arange(len(part) - 1, -1, -1), part]))
    return c


class FlacError(ValueError):
    pass


@dataclass
class Info:
    min_block: int
    max_block: int
    rate: int
    channels: int
    bits: int
    total: int
    md5: bytes


@dataclass
class Frame:
    number: int
    first: int
    n: int
    at: int
    size: int
    samples: np.ndarray | None  # (channels, n)
    error: str | None


_RATES = {1: 88200, 2: 176400, 3: 192000, 4: 8000, 5: 16000, 6: 22050, 7: 24000, 8: 32000, 9: 44100, 10: 48000, 11: 96000}
_DEPTHS = {1: 8, 2: 12, 4: 16, 5: 20, 6: 24, 7: 32}
_FIXED = [[], [1], [2, -1], [3, -3, 1], [4, -6, 4, -1]]


def metadata(data: bytes) -> tuple[Info, int]:
    """STREAMINFO, and where the frames begin."""
    if data[:4] != b"fLaC":
        raise FlacError("no fLaC marker")
    at, info = 4, None
    while True:
        if at + 4 > len(data):
            raise FlacError("metadata ends early")
        last, kind, size = data[at] >> 7, data[at] & 127, int.from_bytes(data[at + 1 : at + 4], "big")
        body = data[at + 4 : at + 4 + size]
        if kind == 0 and len(body) >= 34:
            x = int.from_bytes(body[10:18], "big")
            info = Info(int.from_bytes(body[:2], "big"), int.from_bytes(body[2:4], "big"), x >> 44, (x >> 41 & 7) + 1, (x >> 36 & 31) + 1, x & ((1 << 36) - 1), body[18:34])
        at += 4 + size
        if last:
            break
    if info is None:
        raise FlacError("no STREAMINFO")
    return info, at


def _header(data: bytes, at: int, info: Info) -> tuple[int, int, int, int, int, bool] | None:
    """(header's length, block size, channel code, bits, coded number, variable) of a valid frame header."""
    h = data[at : at + 16]
    if len(h) < 6 or h[0] != 0xFF or h[1] & 0xFE != 0xF8 or h[3] & 1:
        return None
    size, rate, channels, depth = h[2] >> 4, h[2] & 15, h[3] >> 4, h[3] >> 1 & 7
    if size == 0 or rate == 15 or channels > 10 or depth == 3:
        return None
    lead, p = h[4], 5
    if lead < 0x80:
        number = lead
    else:
        n = _extra(lead)
        if n is None or len(h) < 5 + n:
            return None
        number = lead & ((1 << (6 - n)) - 1) if n < 6 else 0
        for b in h[5 : 5 + n]:
            if b >> 6 != 2:
                return None
            number = number << 6 | b & 63
        p = 5 + n
    if size == 1:
        block = 192
    elif size <= 5:
        block = 576 << (size - 2)
    elif size == 6:
        block, p = h[p] + 1, p + 1
    elif size == 7:
        block, p = int.from_bytes(h[p : p + 2], "big") + 1, p + 2
    else:
        block = 256 << (size - 8)
    p += {12: 1, 13: 2, 14: 2}.get(rate, 0)
    if len(h) <= p or crc8(h[:p]) != h[p]:
        return None
    return p + 1, block, channels, _DEPTHS.get(depth, info.bits), number, bool(h[1] & 1)


def _extra(lead: int) -> int | None:
    """Bytes that follow the first of a coded number."""
    n = 0
    while n < 7 and lead << n & 0x80:
        n += 1
    return n - 1 if 2 <= n <= 7 else None


class _Bits:
    """Bits of a stream from a byte on. Unpacked in pieces as they are needed."""

    def __init__(self, data: bytes, at: int, room: int):
        self.data, self.base, self.room, self.p = data, at, 0, 0
        self._grow(room)

    def _grow(self, room: int) -> None:
        self.room = room
        raw = np.frombuffer(self.data, np.uint8, min(room, len(self.data) - self.base), self.base)
        self.n = 8 * len(raw)
        # the 64 bits from each byte on
        wide = np.concatenate([raw, np.zeros(8, np.uint8)]).astype(np.uint64)
        self.words = np.zeros(len(raw) + 1, np.uint64)
        for k in range(8):
            self.words |= wide[k : k + len(self.words)] << np.uint64(56 - 8 * k)
        bits = np.unpackbits(raw)
        place = np.where(bits, np.arange(self.n, dtype=np.int32), np.int32(self.n))
        self.next_one = np.minimum.accumulate(place[::-1])[::-1]
        ones = np.flatnonzero(bits)
        self.last_one = int(ones[-1]) if len(ones) else -1
        self.jumps: dict[int, list[int]] = {}

    def need(self, n: int) -> None:
        if self.p + n > self.n:
            if self.base + self.room >= len(self.data):
                raise FlacError("frame ends early")
            self._grow(max(2 * self.room, (self.p + n) // 8 + 64))
            self.need(n)

    def u(self, n: int) -> int:
        if not n:
            return 0
        self.need(n)
        a, b = self.p, self.p + n
        self.p = b
        i, j = a >> 3, (b + 7) >> 3
        return int.from_bytes(self.data[self.base + i : self.base + j], "big") >> ((j << 3) - b) & ((1 << n) - 1)

    def s(self, n: int) -> int:
        x = self.u(n)
        return x - (1 << n) if n and x >> (n - 1) else x

    def unary(self) -> int:
        while self.p > self.last_one:
            self.need(self.n - self.p + 1)
        q = int(self.next_one[self.p]) - self.p
        self.p += q + 1
        return q

    def many(self, start: np.ndarray, n: int) -> np.ndarray:
        """Unsigned numbers of n <= 57 bits that begin at these bits."""
        if not n:
            return np.zeros(len(start), np.int64)
        return (self.words[start >> 3] << (start & 7).astype(np.uint64) >> np.uint64(64 - n)).astype(np.int64)

    def signed(self, count: int, n: int) -> np.ndarray:
        self.need(count * n)
        out = self.many(self.p + n * np.arange(count), n) if n else np.zeros(count, np.int64)
        self.p += count * n
        return out - ((out >> (n - 1)) << n) if n else out

    def rice(self, count: int, k: int) -> np.ndarray:
        """count residuals with parameter k."""
        while True:
            jump = self.jumps.get(k)
            if jump is None:
                jump = self.jumps[k] = (self.next_one + 1 + k).tolist()
            p, starts, end = self.p, [], len(jump)
            for _ in range(count):
                if p > self.last_one or p >= end:
                    break
                starts.append(p)
                p = jump[p]
            if len(starts) == count and p <= end:
                break
            self.need(end - self.p + 1)
        starts = np.array(starts, np.int64)
        one = self.next_one[starts].astype(np.int64)
        x = ((one - starts) << k) | self.many(one + 1, k) if count else np.zeros(0, np.int64)
        self.p = p
        return (x >> 1) ^ -(x & 1)


def _residual(b: _Bits, n: int, order: int) -> np.ndarray:
    method = b.u(2)
    if method > 1:
        raise FlacError("reserved residual coding")
    width, parts = 4 + method, b.u(4)
    if n >> parts << parts != n or n >> parts < order:
        raise FlacError("partitions don't fit the block")
    out = []
    for i in range(1 << parts):
        count = (n >> parts) - (order if i == 0 else 0)
        k = b.u(width)
        if k == (1 << width) - 1:
            out.append(b.signed(count, b.u(5)))
        else:
            out.append(b.rice(count, k))
    return np.concatenate(out)


def _predict(warm: np.ndarray, residual: np.ndarray, coef: list[int], shift: int) -> np.ndarray:
    x, back = warm.tolist(), coef[::-1]
    at = 0
    for r in residual.tolist():
        x.append(r + (sum(map(mul, back, x[at:])) >> shift))
        at += 1
    if max(map(abs, x), default=0) >> 40:
        raise FlacError("a sample is out of range")
    return np.array(x, np.int64)


def _subframe(b: _Bits, n: int, bits: int) -> np.ndarray:
    if b.u(1):
        raise FlacError("subframe padding isn't 0")
    kind, wasted = b.u(6), 0
    if b.u(1):
        wasted = b.unary() + 1
        bits -= wasted
    if kind == 0:
        x = np.full(n, b.s(bits), np.int64)
    elif kind == 1:
        x = b.signed(n, bits)
    elif 8 <= kind <= 12:
        order = kind - 8
        warm = b.signed(order, bits)
        r = _residual(b, n, order)
        if order == 0:
            x = r
        else:  # a fixed predictor of order k is k running sums
            x = r
            for k in range(order, 0, -1):
                base = np.diff(warm, n=k - 1)[-1] if k > 1 else warm[-1]
                x = np.cumsum(x) + base
            x = np.concatenate([warm, x])
    elif kind >= 32:
        order = kind - 31
        warm = b.signed(order, bits)
        precision = b.u(4) + 1
        if precision == 16:
            raise FlacError("reserved precision")
        shift = b.s(5)
        if shift < 0:
            raise FlacError("negative shift")
        coef = [b.s(precision) for _ in range(order)]
        x = _predict(warm, _residual(b, n, order), coef, shift)
    else:
        raise FlacError("reserved subframe")
    return x << wasted


def _frame(data: bytes, at: int, head: tuple, info: Info) -> tuple[np.ndarray, int]:
    """Samples and length of the frame."""
    length, n, code, bits, *_ = head
    channels = code + 1 if code < 8 else 2
    b = _Bits(data, at + length, n * channels * bits // 8 + 64)
    side = {8: 1, 9: 0, 10: 1}.get(code)
    x = [_subframe(b, n, bits + (c == side)) for c in range(channels)]
    if code == 8:
        x[1] = x[0] - x[1]
    elif code == 9:
        x[0] = x[0] + x[1]
    elif code == 10:
        mid = x[0] << 1 | x[1] & 1
        x = [(mid + x[1]) >> 1, (mid - x[1]) >> 1]
    end = length + (b.p + 7 >> 3)
    if at + end + 2 > len(data):
        raise FlacError("frame ends early")
    if crc16(data[at : at + end]) != int.from_bytes(data[at + end : at + end + 2], "big"):
        raise FlacError("CRC-16 differs")
    return np.stack(x), end + 2


def decode_frames(data: bytes) -> Iterator[Frame]:
    info, at = metadata(data)
    number, usual = 0, info.max_block
    while at < len(data):
        head = _header(data, at, info)
        if head is None:
            skip = _resync(data, at + 1, info)
            yield Frame(number, -1, 0, at, skip - at, None, "no valid frame header")
            number, at = number + 1, skip
            continue
        first = head[4] if head[5] else head[4] * (usual if info.min_block == info.max_block else head[1])
        try:
            x, size = _frame(data, at, head, info)
            yield Frame(number, first, head[1], at, size, x, None)
        except FlacError as e:
            skip = _resync(data, at + head[0], info)
            yield Frame(number, first, head[1], at, skip - at, None, str(e))
            size = skip - at
        number, at = number + 1, at + size


def _resync(data: bytes, at: int, info: Info) -> int:
    while True:
        at = data.find(b"\xff", at)
        if at < 0:
            return len(data)
        if _header(data, at, info):
            return at
        at += 1


def pcm(x: np.ndarray, bits: int) -> bytes:
    """Interleaved little-endian samples, in whole bytes."""
    flat, width = x.T.ravel(), (bits + 7) // 8
    if width == 1:
        return flat.astype(np.int8).tobytes()
    if width == 2:
        return flat.astype("<i2").tobytes()
    return np.ascontiguousarray(flat.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


# encoding


def _bits_of(value: int, n: int) -> np.ndarray:
    value &= (1 << n) - 1
    return np.unpackbits(np.frombuffer((value << -n % 8).to_bytes(-(-n // 8), "big"), np.uint8))[:n]


def _rice_bits(r: np.ndarray, k: int) -> np.ndarray:
    u = (r << 1) ^ (r >> 63)
    q = u >> k
    size = q + 1 + k
    end = np.cumsum(size)
    out = np.zeros(int(end[-1]) if len(end) else 0, np.uint8)
    one = end - k - 1
    out[one] = 1
    for i in range(k):
        out[one + 1 + i] = u >> (k - 1 - i) & 1
    return out


def _best_k(r: np.ndarray) -> int:
    mean = float(np.abs(r).mean()) * 2 if len(r) else 0.0
    return max(0, int(np.log2(mean + 1e-9) + 0.5)) if mean > 1 else 0


def _residual_bits(r: np.ndarray, n: int, order: int, parts: int) -> np.ndarray:
    while parts and (n >> parts << parts != n or n >> parts <= order):
        parts -= 1
    edge = [0, *[(n >> parts) * (i + 1) - order for i in range(1 << parts)]]
    pieces = [r[a:b] for a, b in zip(edge[:-1], edge[1:])]
    ks = [_best_k(p) for p in pieces]
    wide = max(ks) > 14
    width = 5 if wide else 4
    out = [_bits_of(int(wide), 2), _bits_of(parts, 4)]
    for p, k in zip(pieces, ks):
        raw = int(np.abs(p).max()).bit_length() + 1 if len(p) else 0
        u = (p << 1) ^ (p >> 63)
        if len(p) and raw < 32 and int((u >> k).sum()) + len(p) * (k + 1) > raw * len(p) + 5:
            out += [_bits_of((1 << width) - 1, width), _bits_of(raw, 5), _raw_bits(p, raw)]
        else:
            out += [_bits_of(k, width), _rice_bits(p, k)]
    return np.concatenate(out)


def _raw_bits(x: np.ndarray, n: int) -> np.ndarray:
    return ((x[:, None] >> np.arange(n - 1, -1, -1)) & 1).astype(np.uint8).ravel()


def _lpc(x: np.ndarray, order: int, precision: int = 12) -> tuple[list[int], int] | None:
    """Quantised coefficients by Levinson and Durbin's recursion, and their shift."""
    f = x.astype(np.float64) * np.hanning(len(x))
    r = np.array([f[: len(f) - i] @ f[i:] for i in range(order + 1)])
    if r[0] <= 0:
        return None
    a, e = np.zeros(order), r[0]
    for i in range(order):
        k = (r[i + 1] - a[:i] @ r[i:0:-1]) / e
        a[: i + 1] = np.append(a[:i] - k * a[:i][::-1], k)
        e *= 1 - k * k
        if e <= 0:
            return None
    top = np.abs(a).max()
    shift = min(15, precision - 1 - int(np.ceil(np.log2(top + 1e-12))) - 1)
    if top == 0 or shift < 0:
        return None
    q = np.clip(np.round(a * (1 << shift)), -(1 << precision - 1), (1 << precision - 1) - 1)
    return [int(v) for v in q], shift


def _subframe_bits(x: np.ndarray, bits: int, order: int, parts: int) -> np.ndarray:
    """The smallest of constant, verbatim, fixed predictors and a linear predictor of this order (0: none)."""
    n = len(x)
    wasted = 0
    if x.any():
        low = int(np.bitwise_or.reduce(x))
        wasted = (low & -low).bit_length() - 1
    flag = [_bits_of(1, 1), np.append(np.zeros(wasted - 1, np.uint8), np.uint8(1))] if wasted else [_bits_of(0, 1)]
    x, bits = x >> wasted, bits - wasted
    if (x == x[0]).all():
        return np.concatenate([_bits_of(0, 7), *flag, _bits_of(int(x[0]), bits)])
    best = np.concatenate([_bits_of(1, 7), *flag, _raw_bits(x, bits)])
    diffs = [np.diff(x, n=k) for k in range(min(4, n - 1) + 1)]
    k = int(np.argmin([np.abs(d).sum() + 0.0 for d in diffs]))
    fixed = np.concatenate([_bits_of(8 + k, 7), *flag, _raw_bits(x[:k], bits), _residual_bits(diffs[k], n, k, parts)])
    if len(fixed) < len(best):
        best = fixed
    found = _lpc(x, order) if 0 < order < n else None
    if found:
        coef, shift = found
        pred = sum(c * x[order - 1 - i : n - 1 - i] for i, c in enumerate(coef)) >> shift
        lpc = np.concatenate([_bits_of(31 + order, 7), *flag, _raw_bits(x[:order], bits), _bits_of(11, 4), _bits_of(shift, 5), *[_bits_of(c, 12) for c in coef], _residual_bits(x[order:] - pred, n, order, parts)])
        if len(lpc) < len(best):
            best = lpc
    return best


def _coded(v: int) -> bytes:
    if v < 0x80:
        return bytes([v])
    n = next(k for k in range(1, 7) if v < 1 << (6 * k + 6 - k))
    return bytes([(0xFF00 >> (n + 1) & 0xFF) | v >> 6 * n, *[v >> 6 * i & 63 | 0x80 for i in range(n - 1, -1, -1)]])


def encode(x: np.ndarray, rate: int = 16000, bits: int = 16, block: int = 400, order: int = 4, parts: int = 2) -> bytes:
    """A FLAC stream of samples (channels, n), with the best stereo mode for each frame."""
    channels, total = x.shape
    x = x.astype(np.int64)
    packed = rate << 44 | (channels - 1) << 41 | (bits - 1) << 36 | total
    body = block.to_bytes(2, "big") * 2 + bytes(6) + packed.to_bytes(8, "big") + hashlib.md5(pcm(x, bits)).digest()
    out = [b"fLaC", bytes([0x80, 0, 0, 34]), body]
    for number, at in enumerate(range(0, total, block)):
        part = x[:, at : at + block]
        n, code, chosen = part.shape[1], channels - 1, [(part[c], bits) for c in range(channels)]
        if channels == 2:
            left, right = part
            side, mid = left - right, (left + right) >> 1
            cost = [float(np.abs(np.diff(v)).sum()) for v in (left, right, mid, side)]
            modes = [(cost[0] + cost[1], 1, [(left, bits), (right, bits)]), (cost[0] + cost[3], 8, [(left, bits), (side, bits + 1)]), (cost[1] + cost[3], 9, [(side, bits + 1), (right, bits)]), (cost[2] + cost[3], 10, [(mid, bits), (side, bits + 1)])]
            _, code, chosen = min(modes, key=lambda m: m[0])
        depth = next((k for k, v in _DEPTHS.items() if v == bits), 0)
        head = bytes([0xFF, 0xF8, 7 << 4, code << 4 | depth << 1]) + _coded(number) + (n - 1).to_bytes(2, "big")
        head += bytes([crc8(head)])
        frame = head + np.packbits(np.concatenate([_subframe_bits(v, b, order, parts) for v, b in chosen])).tobytes()
        out.append(frame + crc16(frame).to_bytes(2, "big"))
    return b"".join(out)


# Spark

_BLOCK = "block:int,first_sample:long,n_samples:int,channels:int,sample_rate:int,bits:int,byte_offset:long,byte_length:long,ok:boolean,error:string,pcm:binary,md5_ok:boolean"


def _rows(data: bytes) -> list[tuple]:
    try:
        info, _ = metadata(data)
    except FlacError as e:
        return [(0, None, 0, None, None, None, 0, len(data), False, str(e), None, None)]
    found = [(f, pcm(f.samples, info.bits) if f.samples is not None else None) for f in decode_frames(data)]
    whole = None
    if any(info.md5):
        digest = hashlib.md5()
        for _, x in found:
            digest.update(x or b"")
        whole = digest.digest() == info.md5 and all(f.error is None for f, _ in found)
    return [(f.number, f.first if f.first >= 0 else None, f.n, info.channels, info.rate, info.bits, f.at, f.size, f.error is None, f.error, x, whole) for f, x in found]


def blocks(media: DataFrame, key: str, column: str = "flac") -> DataFrame:
    """(key, block, first_sample, n_samples, channels, sample_rate, bits, byte_offset, byte_length, ok, error, pcm, md5_ok)."""

    @F.pandas_udf(f"array<struct<{_BLOCK}>>")
    def read(data: pd.Series) -> pd.Series:
        return pd.Series([None if d is None else _rows(bytes(d)) for d in data], dtype=object)

    names = [x.split(":")[0] for x in _BLOCK.split(",")]
    rows = media.select(F.col(f"`{key}`").alias("k"), read(media[column]).alias("b")).select("k", F.explode("b").alias("b"))
    return rows.select(F.col("k").alias(key), *[F.col(f"b.{n}").alias(f"{n}_" if n.lower() == key.lower() else n) for n in names])


def seek(found: DataFrame, key: str, sample: int | Column) -> DataFrame:
    """The block of each stream that holds a sample, with the sample's byte in pcm (`pcm_offset`)."""
    s = sample if isinstance(sample, Column) else F.lit(sample)
    at = (s - F.col("first_sample")) * F.col("channels") * F.ceil(F.col("bits") / 8)
    return found.where((F.col("first_sample") <= s) & (s < F.col("first_sample") + F.col("n_samples"))).withColumn("pcm_offset", at.cast("long"))


#: Clips made of vectors, as no table has media: features as levels of 16 samples each, a ramp between them, two channels
STEP = 16


def clip(vector: np.ndarray) -> np.ndarray:
    level = np.round(np.asarray(vector, np.float64) * 20000).astype(np.int64)
    nxt = np.append(level[1:], level[-1:])
    i = np.arange(STEP)
    left = (level[:, None] + (nxt - level)[:, None] * i // STEP).ravel()
    t = np.arange(len(left))
    return np.stack([left, left // 2 + (t * 7919) % 23 - 11])


def clips(vectors: DataFrame, key: str, column: str) -> DataFrame:
    """(key, flac): a stream for each vector; a null or empty vector has a null stream."""

    @F.pandas_udf("binary")
    def make(v: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or not len(x) else encode(clip(x)) for x in v], dtype=object)

    return vectors.select(F.col(f"`{key}`"), make(vectors[column]).alias("flac"))
