"""Queries of the catalogue against their SQL on values that the small tables lack."""

import math

import pytest

from tolera import catalogue


def results(spark, tmp_path, name, values):
    """(rows of the query, rows of its SQL) over events with these values."""
    import duckdb

    path = str(tmp_path / "events.parquet")
    kinds = ["click", "view"]
    rows = [(i, i % 3, kinds[i % 2], float(v)) for i, v in enumerate(values)]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double").coalesce(1).write.parquet(path)
    c = duckdb.connect()
    c.execute(f"create view events as select * from '{path}/*.parquet'")
    df = catalogue.queries()[name](spark, str(tmp_path))
    cols = sorted(df.columns)
    plain = lambda rows: sorted((tuple("nan" if isinstance(v, float) and math.isnan(v) else v for v in r) for r in rows), key=str)
    return plain(df.select(*cols).collect()), plain(c.sql(catalogue.oracle_sql()[name]).project(",".join(cols)).fetchall())


def equal(spark, tmp_path, name, values):
    got, want = results(spark, tmp_path, name, values)
    assert got == want


def test_all_check_asks_for_predictions_above_zero(spark, tmp_path):
    equal(spark, tmp_path, "all_check", [0.0, 0.0, 0.01, 12.5, 12.34, 80.0, 99.96, math.inf, math.nan])


def test_inverse_of_a_logarithm_of_zero(spark, tmp_path):
    equal(spark, tmp_path, "inverse_log10", [0.0, 0.01, 1.0, 12.34, 560.21])


def test_a_logarithm_of_zero_keeps_no_bound(spark, tmp_path):
    equal(spark, tmp_path, "qoi_eb_pw_check", [0.0, 0.0, 0.01, 12.5, 12.34, 80.0, 99.96])


def test_a_range_of_one_value_keeps_no_bound(spark, tmp_path):
    equal(spark, tmp_path, "noa_check", [2.5, 2.5, 2.5])


def test_halves_are_rounded_as_sql_does(spark, tmp_path):
    equal(spark, tmp_path, "qoi_exp", [493.46, 632.56, 668.55, 670.15, 672.7, 682.6, 695.82, 843.6, 932.62, 0.0, 1.9])
