"""Corrections: changes of ``p`` that make it meet its guards, as differences of bits.

Each element has a safe set (``Guard.safe``, or for neighbourhoods what all windows that hold it allow); p stays where it
is safe, and else becomes the member whose distance from p ends in the most zero bits, so that corrections compress.
Functions of Arrow columns do this; no other column passes through Python.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tolera.functions import kinds
from tolera.functions.ieee import NUMPY
from tolera.operators.guards import Guard
from tolera.operators.sets import Safe

SETS = T.ArrayType(T.StructType([T.StructField("lo", T.LongType()), T.StructField("hi", T.LongType())]))


def numbers(column: pa.Array | pa.ChunkedArray, kind: str, name: str = "an element") -> np.ndarray:
    """A column as numbers of its kind; a null is an error, as there is no element to guard."""
    if column.null_count:
        raise ValueError(f"{name} is null in {column.null_count} rows")
    return kinds.from_storage(column, kind)


def as_arrow(values: np.ndarray, kind: str) -> pa.Array:
    return pa.array(kinds.to_storage(values, kind), to_arrow_type(kinds.STORAGE[kind]))


def set_lists(sets: Safe) -> pa.Array:
    """Safe sets in the column form."""
    t = sets.tidy()
    some = t.lo <= t.hi
    end = np.concatenate(([0], np.cumsum(some.sum(axis=0)))).astype(np.int32)
    pick = some.T.ravel()
    parts = [pa.array(np.ascontiguousarray(a.T).ravel()[pick]) for a in (t.lo, t.hi)]
    return pa.ListArray.from_arrays(pa.array(end), pa.StructArray.from_arrays(parts, ["lo", "hi"]))


def corrected(guard: Guard, x: np.ndarray, p: np.ndarray, late: Mapping[str, np.ndarray]) -> np.ndarray:
    """Values that pass, next to p; x where rounding of the check itself leaves nothing else."""
    if not len(x):
        return p.copy()
    lost = ~passes(guard, x, x, late)
    if lost.any():
        raise ValueError(f"{int(lost.sum())} elements don't meet their own guards")
    fine = passes(guard, x, p, late)
    out = p.copy()
    bad = np.flatnonzero(~fine)
    if len(bad):
        own = {k: v[bad] for k, v in late.items()}
        out[bad] = guard.safe(x[bad], _getter(x[bad], own)).pick(p[bad])
        out[bad] = np.where(passes(guard, x[bad], out[bad], own), out[bad], x[bad])
    return out


def _getter(x: np.ndarray, late: Mapping[str, np.ndarray]) -> Callable[[str], np.ndarray]:
    return lambda name: kinds.wide(x) if name in ("$x", "$X") else late[name]


def passes(guard: Guard, x: np.ndarray, p: np.ndarray, late: Mapping[str, np.ndarray]) -> np.ndarray:
    get = _getter(x, late)
    with np.errstate(all="ignore"):
        return np.broadcast_to(guard.ok(NUMPY, kinds.wide(x), kinds.wide(p), lambda name, _: get(name)), len(x))


def difference(hat: np.ndarray, p: np.ndarray) -> np.ndarray:
    """The correction: bits(hat) - bits(p), wrapping."""
    with np.errstate(over="ignore"):
        return kinds.as_bits(hat) - kinds.as_bits(p)


def added(p: np.ndarray, correction: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (kinds.as_bits(p) + correction.astype(kinds.as_bits(p).dtype)).view(p.dtype)


# ---- columns ----------------------------------------------------------------------------------------------------


def _late_of(columns: Sequence[str], arrays: Sequence[pa.Array]) -> dict[str, np.ndarray]:
    return {k: numbers(a, "float64", k) for k, a in zip(columns, arrays, strict=True)}


def check_column(guard: Guard, x: Column, p: Column, kind: str, late: Mapping[str, Column]) -> Column:
    """The check in Arrow, in floats that hold every number of the type: for 64-bit integers.  Null elements don't pass."""
    names = list(late)

    def run(x: pa.Array, p: pa.Array, *more: pa.Array) -> pa.Array:
        import pyarrow.compute as pc

        known = pc.and_(pc.is_valid(x), pc.is_valid(p)).to_numpy(zero_copy_only=False)
        rows = pa.array(np.flatnonzero(known))
        out = np.zeros(len(x), bool)
        if len(rows):
            a, b, *rest = (c.take(rows) for c in (x, p, *more))
            out[known] = passes(guard, numbers(a, kind), numbers(b, kind), _late_of(names, rest))
        return pa.array(out)

    return F.arrow_udf(_typed(run, 2 + len(names)), T.BooleanType())(x, p, *[late[k] for k in names])


def set_column(guard: Guard, x: Column, kind: str, late: Mapping[str, Column]) -> Column:
    names = list(late)

    def run(x: pa.Array, *more: pa.Array) -> pa.Array:
        own, got = numbers(x, kind, "x"), _late_of(names, more)
        return set_lists(guard.safe(own, _getter(own, got)))

    return F.arrow_udf(_typed(run, 1 + len(names)), SETS)(x, *[late[k] for k in names])


def correction_column(guard: Guard, x: Column, p: Column, kind: str, late: Mapping[str, Column], where: Column | None = None) -> Column:
    """Zero where p passes, and where ``where`` doesn't hold."""
    names = list(late)
    narrow = kinds.correction_type(kind)

    def run(x: pa.Array, p: pa.Array, w: pa.Array, *more: pa.Array) -> pa.Array:
        a, b = numbers(x, kind, "x"), numbers(p, kind, "p")
        on = np.array([bool(v) for v in w.to_pylist()], bool)
        hat = b.copy()
        hat[on] = corrected(guard, a[on], b[on], {k: v[on] for k, v in _late_of(names, more).items()})
        return pa.array(difference(hat, b), to_arrow_type(narrow))

    return F.arrow_udf(_typed(run, 3 + len(names)), narrow)(x, p, where if where is not None else F.lit(True), *[late[k] for k in names])


def apply_column(p: Column, correction: Column, kind: str) -> Column:
    def run(p: pa.Array, c: pa.Array) -> pa.Array:
        return as_arrow(added(numbers(p, kind, "p"), numbers(c, f"int{8 * np.dtype(kind).itemsize}", "the correction")), kind)

    return F.arrow_udf(_typed(run, 2), kinds.STORAGE[kind])(p, correction)


def _typed(run: Callable[..., pa.Array], n: int) -> Callable[..., pa.Array]:
    """With the annotations that tell Spark what it is."""
    import inspect

    def call(*arrays):  # noqa: ANN002, ANN202
        return run(*arrays)

    call.__signature__ = inspect.Signature([inspect.Parameter(f"a{i}", inspect.Parameter.POSITIONAL_OR_KEYWORD, annotation=pa.Array) for i in range(n)], return_annotation=pa.Array)  # type: ignore[attr-defined]
    call.__annotations__ = {**{f"a{i}": pa.Array for i in range(n)}, "return": pa.Array}
    return call


def apply(df: DataFrame, p: str, correction: str = "x_sg", out: str = "x_hat") -> DataFrame:
    """df with ``out``: p with the correction added to its bits."""
    field = df.schema[p]
    kind = kinds.kind_of(field)
    if df.schema[correction].dataType != kinds.correction_type(kind):
        raise ValueError(f"{correction} is no correction of {kind}")
    return df.withColumn(out, apply_column(F.col(p), F.col(correction), kind)).withMetadata(out, {k: v for k, v in (field.metadata or {}).items() if k == kinds.DTYPE})


def metrics(df: DataFrame, x: str, p: str, ok: Column) -> DataFrame:
    """One row: n, violation_share, rmse, bias, max_error, exact_share."""
    d = F.col(x) - F.col(p)
    return df.agg(
        F.count("*").alias("n"),
        F.avg(F.when(ok, 0.0).otherwise(1.0)).alias("violation_share"),
        F.sqrt(F.avg(d * d)).alias("rmse"),
        F.avg(d).alias("bias"),
        F.max(F.abs(d)).alias("max_error"),
        F.avg(F.when(d == 0, 1.0).otherwise(0.0)).alias("exact_share"),
    )


__all__ = ["added", "apply", "apply_column", "as_arrow", "check_column", "correction_column", "corrected", "difference", "metrics", "numbers", "passes", "set_column", "set_lists"]
