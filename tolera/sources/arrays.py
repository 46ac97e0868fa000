"""Arrays as tables of elements, and files."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tolera.functions import kinds
from tolera.operators.correct import as_arrow


def elements(spark: SparkSession, data: np.ndarray, prediction: np.ndarray | None = None, late: Mapping[str, np.ndarray] | None = None) -> DataFrame:
    """i0..ik, x, p (and late-bound columns as doubles) of arrays of equal type and shape; the prediction is zero by default.

    The element type is kept (``functions.kinds``)."""
    prediction = np.zeros_like(data) if prediction is None else prediction
    if data.dtype != prediction.dtype or data.shape != prediction.shape:
        raise ValueError("data and prediction must have the same type and shape")
    kind = data.dtype.name
    if kind not in kinds.STORAGE:
        raise kinds.KindError(f"{data.dtype} is no type of elements")
    index = np.indices(data.shape).reshape(data.ndim, -1)
    columns: dict[str, Any] = {f"i{k}": pa.array(index[k].astype(np.int64)) for k in range(data.ndim)}
    columns |= {"x": as_arrow(data.ravel(), kind), "p": as_arrow(prediction.ravel(), kind)}
    columns |= {k: pa.array(np.broadcast_to(v, data.shape).astype(np.float64).ravel()) for k, v in (late or {}).items()}
    df = spark.createDataFrame(pa.table(columns))
    for c in ("x", "p"):
        df = df.withMetadata(c, kinds.field_for(c, kind).metadata)
    return df


def labelled(spark: SparkSession, data: Any, prediction: Any) -> DataFrame:
    """As ``elements``, of two arrays with named dimensions: objects with ``dims``, ``coords`` (name -> values along that
    dimension), ``values`` and ``name``, such as xarray's DataArray.

    Index columns are the places 0, 1, ... and are called by their dimension; a dimension's coordinate is a column
    ``d_NAME``, late-bound to quantities as ``$d_d_NAME``.  Names, dimensions and coordinates of both must agree."""
    for what in ("dims", "name"):
        if getattr(data, what) != getattr(prediction, what):
            raise ValueError(f"data and prediction have different {what}")
    df = elements(spark, np.asarray(data.values), np.asarray(prediction.values))
    for k, d in enumerate(data.dims):
        df = df.withColumnRenamed(f"i{k}", d)
        if d in data.coords:
            own, other = (np.asarray(getattr(a.coords[d], "values", a.coords[d]), np.float64) for a in (data, prediction))
            if not np.array_equal(own, other, equal_nan=True):
                raise ValueError(f"data and prediction have different coordinates along {d}")
            df = df.withColumn(f"d_{d}", F.get(F.lit(own.tolist()), F.col(d).cast("int")))
    return df


def array_of(df: DataFrame, index: Sequence[str], column: str) -> np.ndarray:
    """A column as an array again; for results that fit the driver."""
    kind = kinds.kind_of(df.schema[column])
    table = df.select(*index, column).toArrow()
    at = tuple(table.column(c).to_numpy() for c in index)
    out = np.zeros(tuple(int(a.max()) + 1 for a in at), kind)
    if out.size != len(table):
        raise ValueError("elements are missing or repeated")
    out[at] = kinds.from_storage(table.column(column), kind)
    return out


def read(spark: SparkSession, path: str, kind: str = "parquet", **options: str) -> DataFrame:
    return spark.read.format(kind).options(**options).load(path)


def bricks(spark: SparkSession, path: str, dtype: str, shape: Sequence[int]) -> DataFrame:
    """brick (file), i0..ik, x of raw binary files, each an array of ``shape`` and ``dtype`` (with byte order, such as '>f4')."""
    kind = np.dtype(dtype).newbyteorder("=").name
    total = int(np.prod(shape))
    fields = ["path string", *[f"i{k} long" for k in range(len(shape))], f"x {kinds.STORAGE[kind].simpleString()}"]

    def run(batches):  # noqa: ANN001, ANN202
        index = np.indices(tuple(shape)).reshape(len(shape), -1).astype(np.int64)
        for b in batches:
            for name, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                data = np.frombuffer(content, dtype)
                if len(data) != total:
                    raise ValueError(f"{name} doesn't hold {total} numbers")
                data = data.astype(kind)
                for a in range(0, total, 1 << 18):
                    z = slice(a, a + (1 << 18))
                    yield pa.record_batch([pa.array([name] * len(data[z])), *[pa.array(i[z]) for i in index], as_arrow(data[z], kind)], names=["path", *[f"i{k}" for k in range(len(shape))], "x"])

    raw = spark.read.format("binaryFile").load(path).select("path", "content")
    return raw.mapInArrow(run, ", ".join(fields)).withMetadata("x", kinds.field_for("x", kind).metadata).withColumnRenamed("path", "brick")


def vectors(df: DataFrame, column: str, key: str) -> DataFrame:
    """A two-dimensional grid (key, position) from a column of equally long arrays."""
    return df.select(F.col(key).alias("i0"), F.posexplode(column).alias("i1", "x"))


def write(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
