"""Neighbourhoods as columns: what a row's neighbours hold, with six kinds of border.

Rows of one axis are cut into blocks, border rows are copied into the neighbouring block, and a window per block reads
neighbours with lag and lead, so that no task holds the whole axis.  Arrays of several axes are dealt into ``tiles``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tolera.operators.guards import Axis

BLOCK = 1 << 16


def border(i: Column, n: Column, kind: str) -> Column:
    """The source of index i on an axis of n elements; null where there is none."""
    inside = (i >= 0) & (i < n)
    if kind in ("valid", "constant"):
        return F.when(inside, i)
    if kind == "edge":
        return F.greatest(F.lit(0), F.least(i, n - 1))
    if kind == "wrap":
        return F.pmod(i, n)
    if kind == "symmetric":
        m = F.pmod(i, 2 * n)
        return F.when(m < n, m).otherwise(2 * n - 1 - m)
    m = F.pmod(i, F.greatest(2 * (n - 1), F.lit(1)))
    return F.when(n == 1, F.lit(0)).when(m < n, m).otherwise(2 * (n - 1) - m)


def name_of(column: str, at: Sequence[int]) -> str:
    return f"{column}@{','.join(map(str, at))}"


def line(df: DataFrame, index: str, columns: Sequence[str], axis: Axis, offsets: Sequence[int], by: Sequence[str] = (), size: str | None = None, block: int = BLOCK) -> DataFrame:
    """df with ``column@offset`` for neighbours along ``index`` (0-based and dense within ``by``) and ``_full``: whether
    the neighbourhood lies inside.  size: column with the axis' length; counted when absent."""
    block = max(block, axis.before + axis.after + 1)
    if size is None:
        if by:
            n = df.groupBy(*by).agg((F.max(index) + 1).alias("_n"))
            df = df.join(n, list(by))
        else:
            df = df.crossJoin(F.broadcast(df.agg((F.max(index) + 1).alias("_n"))))  # one row
    else:
        df = df.withColumn("_n", F.col(size))
    i, n = F.col(index).cast("long"), F.col("_n").cast("long")
    # Places a row stands for: its own, and virtual ones beyond the borders.
    beyond = [F.lit(-k) for k in range(1, axis.before + 1)] + [n + k for k in range(axis.after)]
    places = F.array(i)
    if axis.border in ("edge", "reflect", "symmetric", "wrap") and beyond:
        # enough only for axes longer than the neighbourhood's reach; shorter ones wrap more than once and still match
        places = F.concat(places, F.filter(F.array(*[b.cast("long") for b in beyond]), lambda j: border(j, n, axis.border) == i))
    df = df.withColumn("_j", F.explode(places))
    home = F.floor(F.greatest(F.lit(0), F.least(F.col("_j"), n - 1)) / block)
    near = F.array_distinct(F.array(*[F.floor((F.col("_j") + d) / block) for d in (-axis.after, 0, axis.before)], home))
    last = F.floor((n - 1) / block)
    df = df.withColumn("_home", home).withColumn("_block", F.explode(F.filter(near, lambda b: (b >= 0) & (b <= last))))
    window = Window.partitionBy(*by, "_block").orderBy("_j")
    for c in columns:
        for o in offsets:
            at = F.lag(c, -o).over(window) if o < 0 else F.lead(c, o).over(window)
            if axis.border == "constant":
                at = F.when((i + o < 0) | (i + o >= n), F.lit(axis.constant).cast("double")).otherwise(at)
            df = df.withColumn(name_of(c, [o]), F.col(c) if o == 0 else at)
    full = (i - axis.before >= 0) & (i + axis.after < n)
    df = df.withColumn("_full", full if axis.border == "valid" else F.lit(True))
    return df.where((F.col("_block") == F.col("_home")) & (F.col("_j") == i)).drop("_j", "_home", "_block", "_n")
