"""Distances and quantised vectors as Columns; sums are taken in double precision."""

from __future__ import annotations

import struct
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

ZERO = 0.0


def literal(v: list[float]) -> Column:
    return F.array(*(F.lit(float(x)) for x in v))


def _shared(a: Column, b: Column) -> tuple[Column, Column]:
    """Both cut to the shorter length."""
    n = F.least(F.size(a), F.size(b))
    return F.slice(a, 1, n), F.slice(b, 1, n)


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(ZERO), lambda s, x: s + x)


def _once(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once, however often it is used: as a lambda's argument."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def cosine(a: Column, b: Column, same_length: bool = True) -> Column:
    """0 for zero or non-finite vectors."""
    a, b = (a, b) if same_length else _shared(a, b)
    found = F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))
    return _once(found, lambda c: F.when(F.abs(c) <= float("1.7e308"), F.nanvl(c, F.lit(ZERO))).otherwise(F.lit(ZERO)))


def euclidean(a: Column, b: Column, same_length: bool = True) -> Column:
    a, b = (a, b) if same_length else _shared(a, b)
    found = F.sqrt(_sum(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0)))))
    return F.nanvl(found, F.lit(float("inf")))


def distance(a: Column, b: Column, metric: str = "euclidean", same_length: bool = True) -> Column:
    return 1.0 - cosine(a, b, same_length) if metric == "cosine" else euclidean(a, b, same_length)


def int8_scale(v: Column) -> Column:
    """The step of an int8 vector: the greatest magnitude / 127, 1 for a zero vector."""
    most = F.array_max(F.transform(v, lambda x: F.abs(x.cast("double"))))
    return F.when(most > 0, most / 127.0).otherwise(F.lit(1.0))


def to_int8(v: Column, scale: Column) -> Column:
    return F.transform(v, lambda x: F.greatest(F.lit(-127), F.least(F.lit(127), F.round(x.cast("double") / scale).cast("int"))).cast("tinyint"))


def int8_cosine(a: Column, b: Column) -> Column:
    whole = lambda x, y: _sum(F.zip_with(x, y, lambda p, q: (p.cast("int") * q.cast("int")).cast("double")))
    found = whole(a, b) / F.nullif(F.sqrt(whole(a, a)) * F.sqrt(whole(b, b)), F.lit(ZERO))
    return F.coalesce(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), found)), F.lit(ZERO))


def to_bits(v: Column) -> Column:
    """Signs (1: not negative) in words of 64 bits, least significant first."""
    words = F.sequence(F.lit(0), F.floor((F.size(v) - 1) / 64).cast("int"))
    bit = lambda x, i: F.when(x.cast("double") >= 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))
    word = lambda w: F.aggregate(F.transform(F.slice(v, w * 64 + 1, 64), bit), F.lit(0).cast("long"), lambda s, x: s.bitwiseOR(x))
    return F.transform(words, word)


def hamming(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


#: Scheme numbers of the codec's five-byte header (scheme, then dimensions, little-endian).
SCHEMES = {"f32": 0, "f16": 1, "int8": 2, "binary": 3}


def encode(v: np.ndarray, scheme: str) -> bytes:
    v = np.asarray(v, dtype=np.float32)
    head = struct.pack("<BI", SCHEMES[scheme], len(v))
    if scheme == "f32":
        return head + v.astype("<f4").tobytes()
    if scheme == "f16":
        return head + v.astype("<f2").tobytes()
    if scheme == "int8":
        most = float(np.abs(v).max(initial=0))
        scale = np.float32(most / 127) if most > 0 else np.float32(1)
        scaled = np.where(v < 0, np.ceil(v / scale - 0.5), np.floor(v / scale + 0.5))
        return head + struct.pack("<f", scale) + np.clip(scaled, -127, 127).astype(np.int8).tobytes()
    return head + np.packbits(v >= 0, bitorder="little").tobytes()


def payload_length(scheme: str, dims: int) -> int:
    return {"f32": 4 * dims, "f16": 2 * dims, "int8": 4 + dims, "binary": -(-dims // 8)}[scheme]


def decode(blob: bytes) -> np.ndarray:
    number, dims = struct.unpack_from("<BI", blob)
    scheme = {n: s for s, n in SCHEMES.items()}.get(number)
    if scheme is None or len(blob) != 5 + payload_length(scheme, dims):
        raise ValueError("not a quantised vector")
    if scheme == "binary":
        return np.where(np.unpackbits(np.frombuffer(blob, np.uint8, offset=5), bitorder="little")[:dims], 1, -1).astype(np.float32)
    if scheme == "int8":
        return np.frombuffer(blob, np.int8, offset=9).astype(np.float32) * np.float32(struct.unpack_from("<f", blob, 5)[0])
    return np.frombuffer(blob, "<f4" if scheme == "f32" else "<f2", offset=5).astype(np.float32)


def encoded(v: Column, scheme: str) -> Column:
    @F.pandas_udf("binary")
    def run(vectors: pd.Series) -> pd.Series:
        return vectors.map(lambda x: None if x is None else encode(x, scheme))

    return run(v)


def decoded(blob: Column) -> Column:
    @F.pandas_udf("array<float>")
    def run(blobs: pd.Series) -> pd.Series:
        return blobs.map(lambda b: None if b is None else decode(b))

    return run(blob)
