"""Element types: numbers of eight integer and three float types, their storage in Spark, order keys and casts.

A column says what it holds by its Spark type, or, where Spark has no such type, by the metadata entry ``dtype``: half
floats are stored as floats, unsigned integers in the next wider signed type, and 64-bit ones as DECIMAL(20, 0).

The *order key* of a number is a signed 64-bit integer that compares as the bits of the number do in total order: of
integers their value (unsigned 64-bit ones less 2**63), of floats their bits with negative values flipped.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
from pyspark.sql import types as T

DTYPE = "dtype"
#: name -> storage in Spark
STORAGE: dict[str, T.DataType] = {
    "int8": T.ByteType(), "int16": T.ShortType(), "int32": T.IntegerType(), "int64": T.LongType(),
    "uint8": T.ShortType(), "uint16": T.IntegerType(), "uint32": T.LongType(), "uint64": T.DecimalType(20, 0),
    "float16": T.FloatType(), "float32": T.FloatType(), "float64": T.DoubleType(),
}
_PLAIN = {"tinyint": "int8", "smallint": "int16", "int": "int32", "bigint": "int64", "float": "float32", "double": "float64"}


class KindError(TypeError):
    """A type that can't be guarded."""


def kind_of(field: T.StructField) -> str:
    """The element type of a column."""
    named = (field.metadata or {}).get(DTYPE)
    if named is not None:
        if named not in STORAGE or STORAGE[named] != field.dataType:
            raise KindError(f"{field.name}: {named!r} is not stored as {field.dataType.simpleString()}")
        return named
    name = _PLAIN.get(field.dataType.simpleString())
    if name is None:
        raise KindError(f"{field.name}: {field.dataType.simpleString()} is no type of elements")
    return name


def field_for(name: str, kind: str) -> T.StructField:
    plain = _PLAIN.get(STORAGE[kind].simpleString()) == kind
    return T.StructField(name, STORAGE[kind], True, {} if plain else {DTYPE: kind})


def correction_type(kind: str) -> T.DataType:
    """A signed integer as wide as the element."""
    return {1: T.ByteType(), 2: T.ShortType(), 4: T.IntegerType(), 8: T.LongType()}[np.dtype(kind).itemsize]


def from_storage(values, kind: str) -> np.ndarray:  # noqa: ANN001
    """A pandas or arrow column as numbers of ``kind``."""
    if kind == "uint64":
        return np.array([int(v) for v in (values.to_pylist() if hasattr(values, "to_pylist") else values)], np.uint64)
    return np.asarray(values.to_numpy(zero_copy_only=False) if hasattr(values, "to_pylist") else values).astype(kind)


def to_storage(values: np.ndarray, kind: str):  # noqa: ANN201
    """The reverse: what Arrow takes for the column's Spark type."""
    if kind == "uint64":
        return [Decimal(int(v)) for v in values]
    wider = {"uint8": np.int16, "uint16": np.int32, "uint32": np.int64, "float16": np.float32}
    return np.asarray(values).astype(wider.get(kind, kind))


# ---- bits and keys --------------------------------------------------------------------------------------------


def as_bits(x: np.ndarray) -> np.ndarray:
    """The bits of numbers, as signed integers of equal width."""
    x = np.ascontiguousarray(x)
    return x.view(f"int{8 * x.dtype.itemsize}")


def key_of(x: np.ndarray) -> np.ndarray:
    b = as_bits(x)
    if x.dtype.kind == "f":
        b = b ^ ((b >> (8 * b.itemsize - 1)) & np.iinfo(b.dtype).max)
        return b.astype(np.int64)
    if x.dtype == np.uint64:
        return b ^ np.int64(-(1 << 63))
    return x.astype(np.int64)


def value_of(key: np.ndarray, kind: str) -> np.ndarray:
    """The number of a key; the key must be one of ``kind``."""
    key, dtype = np.asarray(key, np.int64), np.dtype(kind)
    if dtype.kind == "f":
        b = key.astype(f"int{8 * dtype.itemsize}")
        return (b ^ ((b >> (8 * b.itemsize - 1)) & np.iinfo(b.dtype).max)).view(dtype)
    if dtype == np.uint64:
        return (key ^ np.int64(-(1 << 63))).view(np.uint64)
    return key.astype(dtype)


def key_range(kind: str) -> tuple[int, int]:
    dtype = np.dtype(kind)
    if dtype.kind == "u" and dtype.itemsize < 8:
        return 0, int(np.iinfo(dtype).max)
    bits = 8 * dtype.itemsize
    return -(1 << (bits - 1)), (1 << (bits - 1)) - 1


def finite_range(kind: str) -> tuple[int, int]:
    """Keys of the least and the largest finite number."""
    if np.dtype(kind).kind != "f":
        return key_range(kind)
    most = np.array([np.finfo(kind).max], kind)
    return int(key_of(-most)[0]), int(key_of(most)[0])


def toward(x: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The next number from x on toward the target, in total order (so -0 and +0 are neighbours)."""
    a, b = key_of(x), key_of(np.asarray(target, x.dtype))
    return value_of(a + np.sign(b - a) * (a != b), x.dtype.name)


# ---- casts ----------------------------------------------------------------------------------------------------


def wide(x: np.ndarray) -> np.ndarray:
    """As floats that hold every number of the type: doubles, or for 64-bit integers the widest float there is."""
    return x.astype(np.longdouble if x.dtype.kind in "iu" and x.dtype.itemsize == 8 else np.float64)


def from_wide(x: np.ndarray, kind: str) -> np.ndarray:
    """The nearest number of ``kind``: ties to even, clamped to finite values; NaN becomes zero for integers."""
    dtype = np.dtype(kind)
    x = np.asarray(x)
    if dtype.kind == "f":
        most = np.finfo(dtype).max
        return np.where(np.isnan(x), x, np.clip(x, -most.astype(x.dtype), most.astype(x.dtype))).astype(dtype)
    r = np.rint(np.where(np.isnan(x), 0, x)).astype(np.longdouble)
    info = np.iinfo(dtype)
    low, high = r <= np.longdouble(info.min), r >= np.longdouble(info.max)
    return np.where(low, info.min, np.where(high, info.max, np.where(low | high, 0, r).astype(dtype))).astype(dtype)


def lossless(x, kind: str) -> np.ndarray:  # noqa: ANN001
    """A cast that keeps every value (and every NaN's sign), or an error; floats don't become integers."""
    x = np.asarray(x)
    if x.dtype.kind == "f" and np.dtype(kind).kind != "f":
        raise KindError(f"{x.dtype.name} can't become {kind}")
    with np.errstate(all="ignore"):
        out = x.astype(kind)
        back = out.astype(x.dtype)
    same = (back == x) | ((x != x) & (back != back)) if x.dtype.kind == "f" else (back == x) & ((out < 0) == (x < 0))
    if not np.all(same):
        raise ValueError(f"a value is not exact as {kind}")
    return out


def saturating(x, kind: str) -> np.ndarray:  # noqa: ANN001
    """A cast of finite numbers to a float type, clamped to its finite values; others are an error."""
    x = np.asarray(x)
    if not np.all(np.isfinite(x.astype(np.longdouble))):
        raise ValueError("a value is not finite")
    return from_wide(x.astype(np.longdouble), kind)
