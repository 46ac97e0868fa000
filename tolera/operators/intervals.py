"""Safe sets as sorted, disjoint, non-adjacent intervals of order keys: ARRAY<STRUCT<lo: BIGINT, hi: BIGINT>>.

The order key of a double is its bits with negative values flipped, so that keys compare as values do.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from tolera.functions import kinds

LEAST, MOST = -(1 << 63), (1 << 63) - 1


def key_of(x: np.ndarray) -> np.ndarray:
    """Order keys of doubles; other types are in ``functions.kinds``."""
    return kinds.key_of(np.asarray(x, np.float64))


def value_of(k: np.ndarray) -> np.ndarray:
    return kinds.value_of(k, "float64")


def values(sets: Column, kind: str) -> Column:
    """Safe sets with numbers for keys, as doubles."""

    def run(column: pa.Array) -> pa.Array:
        ends = column.flatten()
        parts = [kinds.wide(kinds.value_of(ends.field(i).to_numpy(zero_copy_only=False), kind)).astype(np.float64) for i in (0, 1)]
        return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False)))).astype(np.int32)), pa.StructArray.from_arrays([pa.array(v) for v in parts], ["lo", "hi"]))

    run.__annotations__ = {"column": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "array<struct<lo:double,hi:double>>")(sets)


def _pair(lo: Column, hi: Column) -> Column:
    return F.struct(lo.cast("long").alias("lo"), hi.cast("long").alias("hi"))


def empty() -> Column:
    return F.array().cast("array<struct<lo:bigint,hi:bigint>>")


def full() -> Column:
    return F.array(_pair(F.lit(LEAST), F.lit(MOST)))


def full_of(kind: str) -> Column:
    """Every bit pattern of an element type."""
    low, high = kinds.key_range(kind)
    return F.array(_pair(F.lit(low), F.lit(high)))


def finite(kind: str) -> Column:
    low, high = kinds.finite_range(kind)
    return F.array(_pair(F.lit(low), F.lit(high)))


def infinite(kind: str, negative: bool) -> Column:
    """One infinity, exactly."""
    key = int(kinds.key_of(np.array([-np.inf if negative else np.inf], kind))[0])
    return F.array(_pair(F.lit(key), F.lit(key)))


def not_nan(kind: str) -> Column:
    if np.dtype(kind).kind != "f":
        return full_of(kind)
    low, high = (int(kinds.key_of(np.array([v], kind))[0]) for v in (-np.inf, np.inf))
    return F.array(_pair(F.lit(low), F.lit(high)))


def nans(kind: str, negative: bool = True, positive: bool = True) -> Column:
    """NaNs of one sign or both."""
    if np.dtype(kind).kind != "f":
        return empty()
    (low, high), inf = kinds.key_range(kind), int(kinds.key_of(np.array([np.inf], kind))[0])
    pieces = [_pair(F.lit(a), F.lit(b)) for a, b, on in ((low, -inf - 2, negative), (inf + 1, high, positive)) if on]
    return F.array(*pieces) if pieces else empty()


def clipped(a: Column, lower: Column, upper: Column) -> Column:
    """The members within lower..upper (keys)."""
    return intersect(a, interval(lower, upper))


def interval(lo: Column, hi: Column) -> Column:
    return F.when(lo <= hi, F.array(_pair(lo, hi))).otherwise(empty())


def intersect(a: Column, b: Column) -> Column:
    pairs = F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: _pair(F.greatest(x["lo"], y["lo"]), F.least(x["hi"], y["hi"])))))
    return F.array_sort(F.filter(pairs, lambda i: i["lo"] <= i["hi"]))


def union(a: Column, b: Column) -> Column:
    """Overlapping and adjacent intervals become one."""

    def add(acc: Column, i: Column) -> Column:
        last = F.element_at(acc, -1)
        touches = (last["hi"] == F.lit(MOST)) | (i["lo"] <= F.when(last["hi"] == F.lit(MOST), last["hi"]).otherwise(last["hi"] + 1))
        grown = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(_pair(last["lo"], F.greatest(last["hi"], i["hi"]))))
        return F.when(F.size(acc) == 0, F.array(_pair(i["lo"], i["hi"]))).when(touches, grown).otherwise(F.concat(acc, F.array(_pair(i["lo"], i["hi"]))))

    return F.aggregate(F.array_sort(F.concat(a, b)), empty(), add)


def contains(a: Column, key: Column) -> Column:
    return F.exists(a, lambda i: (i["lo"] <= key) & (key <= i["hi"]))


def width(a: Column) -> Column:
    """Members less one; may need 64 bits unsigned, so a decimal."""
    wide = "decimal(38,0)"
    return F.aggregate(a, F.lit(-1).cast(wide), lambda s, i: (s + i["hi"].cast(wide) - i["lo"].cast(wide) + 1).cast(wide))


def only_where(mask: Column, a: Column) -> Column:
    return F.when(mask, a).otherwise(full())
