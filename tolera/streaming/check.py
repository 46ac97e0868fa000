"""Pointwise guards on streams: a check needs no state, so it is a projection of the stream."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tolera.api import Guards


def checked(stream: DataFrame, guards: Guards, x: str = "x", p: str = "p", late: Mapping[str, Any] | None = None) -> DataFrame:
    if guards.root.around() or guards.root.late() & {"$x_min", "$x_max"}:
        raise ValueError("only pointwise guards without global constants run on a stream")
    return guards.check_rows(stream, x, p, late)


def violations(stream: DataFrame, guards: Guards, time: str, width: str = "5 minutes", late_by: str = "10 minutes", x: str = "x", p: str = "p") -> DataFrame:
    """Rows and violations per window of event time."""
    rows = checked(stream, guards, x, p).withWatermark(time, late_by)
    return rows.groupBy(F.window(time, width)).agg(F.count("*").alias("n"), F.sum(F.when(F.col("ok"), 0).otherwise(1)).alias("bad"))
