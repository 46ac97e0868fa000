import gc
import json
import math
import os
import weakref

import numpy as np
import pytest
from pyspark.sql import functions as F

from tolera import api, catalogue
from tolera.api import Guards
from tolera.functions.ieee import NUMPY, SPARK
from tolera.operators import correct, intervals, stencil
from tolera.operators.guards import All, Any_, Axis, ErrorBound, GuardError, Quantity, Same, Select, Sign, Stencil, from_config
from tolera.plans import qoi
from tolera.sources import arrays
from tolera.streaming import check as streaming

EDGE = [0.0, -0.0, 1.0, -1.0, 0.5, -0.5, 2.5, -2.5, 1e300, -1e300, 5e-324, -5e-324, math.inf, -math.inf, math.nan, 3.0, 1e-9, 4503599627370497.5]


@pytest.mark.parametrize("text", ["ln(x)", "log2(x)", "log10(x)", "1/x", "x/(x-1)", "floor(x)", "ceil(x)", "trunc(x)", "round_ties_even(x)", "sign(x)", "sqrt(x)", "square(x)", "reciprocal(x)", "abs(x)", "isfinite(x)", "isinf(x)", "isnan(x)", "not(x)", "x < 1", "x != x", "x >= 0", "where(x, 2, 3)", "all([x, x > 0])", "any([x, x > 0])", "x ** 2", "exp(x)", "atan(x)", "tanh(x)"])
def test_columns_agree_with_numpy_on_edge_values(spark, text):
    node = qoi.parse(text)
    df = spark.createDataFrame([(i, x) for i, x in enumerate(EDGE)], "i int, x double")
    got = [r[1] for r in df.select("i", qoi.evaluate(node, SPARK, lambda at: F.col("x"), None).alias("q")).orderBy("i").collect()]
    with np.errstate(all="ignore"):
        want = qoi.evaluate(node, NUMPY, lambda at: np.array(EDGE), None)
    np.testing.assert_allclose(got, want, rtol=1e-14)


@pytest.mark.parametrize("text", ["e x p", "1 = x", 'v["a"] + x', 'v["a"] = x; v["a"] = 1; return x;', "2", "[x, 1]", "1 < x < 2", "foo(x)", "X[0]", "x +", "[[x, 1], [2]]", "ln(x, x)"])
def test_rejected_quantities(text):
    with pytest.raises(qoi.QoiError):
        qoi.parse(text)


def test_a_quantity_keeps_no_arrays():
    """Without a collection of cycles, which may come many tiles later."""
    node, x = qoi.parse("x + ln(x)"), np.ones(3)
    alive = weakref.ref(x)
    gc.collect()
    gc.disable()
    try:
        qoi.evaluate(node, NUMPY, lambda at, x=x: x, None)
        del x
        assert alive() is None
    finally:
        gc.enable()


def test_finite_difference_weights():
    def w(order, accuracy, kind, reach):
        n = qoi.parse(f"finite_difference(x, order={order}, accuracy={accuracy}, type={kind}, axis=0, grid_spacing=1)", [reach])
        size = reach[0] + reach[1] + 1
        out = []
        for k in range(size):
            hot = lambda at, k=k: np.array([1.0 if at[0] + reach[0] == k else 0.0])
            out.append(float(qoi.evaluate(n, NUMPY, hot, None)[0]))
        return out

    assert w(1, 2, 0, (1, 1)) == [-0.5, 0, 0.5]
    assert w(2, 4, 0, (2, 2)) == pytest.approx([-1 / 12, 4 / 3, -5 / 2, 4 / 3, -1 / 12])
    assert w(1, 3, 1, (0, 3)) == pytest.approx([-11 / 6, 3, -3 / 2, 1 / 3])
    assert w(2, 1, -1, (2, 0)) == [1, -2, 1]
    with pytest.raises(qoi.QoiError):
        qoi.parse("finite_difference(x, order=1, accuracy=4, type=0, axis=0, grid_spacing=1)", [(1, 1)])


@pytest.mark.parametrize("kind", ["edge", "reflect", "symmetric", "wrap", "constant"])
@pytest.mark.parametrize("n,block", [(40, 7), (5, 64)])
def test_borders_like_numpy_pad(spark, kind, n, block):
    x = np.arange(n) ** 2 + 1.0
    axis = Axis(0, 2, 3, kind, 42.0 if kind == "constant" else None)
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "i long, x double")
    got = stencil.line(df, "i", ["x"], axis, range(-2, 4), block=block).orderBy("i").collect()
    pad = np.pad(x, (2, 3), kind, **({"constant_values": 42.0} if kind == "constant" else {}))
    for r in got:
        assert [r[f"x@{o}"] for o in range(-2, 4)] == list(pad[r["i"] : r["i"] + 6])
    assert len(got) == n


def test_intervals_against_sets(spark):
    rng = np.random.RandomState(5)

    def some():
        return [(int(a), int(a + rng.randint(0, 9))) for a in rng.randint(0, 60, rng.randint(0, 5))]

    rows = [(k, some(), some()) for k in range(40)]
    df = spark.createDataFrame(rows, "k int, a array<struct<lo:bigint,hi:bigint>>, b array<struct<lo:bigint,hi:bigint>>")
    one = lambda c: intervals.union(F.col(c), intervals.empty())
    df = df.select("k", one("a").alias("a"), one("b").alias("b"))
    got = df.select("k", intervals.intersect(F.col("a"), F.col("b")).alias("both"), intervals.union(F.col("a"), F.col("b")).alias("any"), intervals.width(F.col("a")).alias("w")).collect()
    members = lambda iv: {v for i in iv for v in range(i[0], i[1] + 1)}
    for r, (_, a, b) in zip(sorted(got), rows, strict=True):
        assert members(r["both"]) == members(a) & members(b)
        assert members(r["any"]) == members(a) | members(b)
        assert all(p["hi"] + 1 < q["lo"] for p, q in zip(r["any"], r["any"][1:], strict=False))
        assert r["w"] == len(members(a)) - 1


def test_order_keys_sort_as_values():
    v = np.array(sorted(x for x in EDGE if not math.isnan(x)))
    k = intervals.key_of(v)
    assert ((k[1:] >= k[:-1]) | (v[1:] == v[:-1])).all()  # the two zeros are equal values with keys of their own
    np.testing.assert_array_equal(intervals.value_of(intervals.key_of(v)).view(np.int64), v.view(np.int64))


@pytest.mark.parametrize("guard", [ErrorBound("abs", 0.1), ErrorBound("rel", 0.01), ErrorBound("ratio", 1.1), Same(0.0), Same(2.5, True), Sign(), Sign(1.0), All([ErrorBound("abs", 1), Sign()]), Any_([Same(3.0), ErrorBound("abs", 0.5)]), Quantity("log10(abs(x) + 1)", "abs", 0.01), Quantity("floor(x)", "abs", 0), Select("s", [ErrorBound("abs", 0.1), Sign()])])
@pytest.mark.parametrize("predictor", ["zero", "neg", "identity", "noise"])
def test_corrections_meet_guards(spark, guard, predictor):
    x = np.array([v for v in EDGE] * 2)
    p = {"zero": np.zeros(len(x)), "neg": -x, "identity": x.copy(), "noise": np.where(np.isfinite(x), np.nan_to_num(x) + 0.3, x)}[predictor]
    late = {"s": np.arange(len(x)) % 2.0}
    fixed = correct.corrected(guard, x, p, late)
    with np.errstate(all="ignore"):
        assert np.all(guard.ok(NUMPY, x, fixed, lambda name, _: late[name]))
    if predictor == "identity":
        np.testing.assert_array_equal(fixed.view(np.int64), x.view(np.int64))


def test_round_trip_and_metadata(spark, tmp_path):
    rng = np.random.RandomState(0)
    x = rng.normal(size=(30, 4))
    df = arrays.elements(spark, x, np.round(x, 1)).withColumnRenamed("p", "y")
    guards = Guards([ErrorBound("abs", 0.02), Sign()])
    out = guards.correct(df, p="y", out="y_sg")
    arrays.write(out, str(tmp_path / "c"))
    back = arrays.read(spark, str(tmp_path / "c"))
    assert json.loads(back.schema["y_sg"].metadata["guards"]) == json.loads(guards.get_config())
    whole = api.safeguarded(back)
    assert "y_sg" not in whole.columns and guards.check(whole, p="y") and not guards.check(df, p="y")


def test_stencil_correction(spark):
    x = np.sin(np.arange(200) / 9.0)
    df = spark.createDataFrame([(i, float(v), float(np.round(v, 1))) for i, v in enumerate(x)], "i long, x double, p double")
    guards = Guards([Stencil("X[2] - X[0]", [Axis(0, 1, 1, "edge")], "abs", 0.03), ErrorBound("abs", 0.2)])
    assert not guards.check(df, index=["i"])
    fixed = correct.apply(guards.correct(df, index=["i"]), "p").withColumn("p", F.col("x_hat"))
    assert guards.check(fixed, index=["i"])


def test_blocked_windows_equal_one_window(spark):
    df = spark.range(500).select(F.col("id").alias("i"), (F.col("id") * 37 % 101).cast("double").alias("x"))
    axis = Axis(0, 3, 2, "wrap")
    a = stencil.line(df, "i", ["x"], axis, range(-3, 3), block=11).orderBy("i").collect()
    b = stencil.line(df, "i", ["x"], axis, range(-3, 3)).orderBy("i").collect()
    assert a == b


def test_configs_and_errors():
    g = Guards([Select("s", [ErrorBound("abs", "eb"), Stencil("sum(X)", [Axis(0, 1, 1, "edge")], "rel", 0.1)]), Same(0.0)])
    assert Guards.from_config(g.get_config()).get_config() == g.get_config()
    assert g.late_bound() == {"s", "eb"}
    for bad in (lambda: ErrorBound("abs", -1), lambda: ErrorBound("ratio", 0.5), lambda: ErrorBound("x", 1), lambda: Guards([]), lambda: from_config({"kind": "?"}), lambda: Axis(0, 1, 1, "constant"), lambda: All([])):
        with pytest.raises(GuardError):
            bad()


def test_late_names_must_match(spark):
    df = spark.createDataFrame([(1.0, 1.0)], "x double, p double")
    with pytest.raises(GuardError):
        Guards([ErrorBound("abs", "eb")]).check_rows(df)
    with pytest.raises(GuardError):
        Guards([ErrorBound("abs", 1)]).check_rows(df, late={"eb": 1})


def test_empty_table_passes(spark):
    assert Guards([ErrorBound("abs", 1)]).check(spark.createDataFrame([], "x double, p double"))


def test_stream(spark, tmp_path):
    spark.createDataFrame([(1.0, 1.0), (2.0, 3.0)], "x double, p double").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("x double, p double").parquet(str(tmp_path / "in"))
    q = streaming.checked(stream, Guards([ErrorBound("abs", 0.5)])).writeStream.format("memory").queryName("checked").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r["ok"] for r in spark.table("checked").collect()) == [False, True]


def test_plan_stays_in_the_jvm(spark):
    plan = catalogue.queries()["eb_abs_check"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Python" not in plan and "l_extendedprice" in plan and "l_shipdate" not in plan.split("ReadSchema")[1]


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_catalogue_equals_sql(spark, name):
    import duckdb

    sf = "/root/testdata/sf0.001"
    c = duckdb.connect()
    for f in os.listdir(sf):
        c.execute(f"create view {f[:-8]} as select * from '{sf}/{f}'")
    df = catalogue.queries()[name](spark, sf)
    cols = sorted(df.columns)
    plain = lambda rows: sorted((tuple("nan" if isinstance(v, float) and math.isnan(v) else v for v in r) for r in rows), key=str)
    want = c.sql(catalogue.oracle_sql()[name])
    assert sorted(want.columns) == cols
    assert plain(df.select(*cols).collect()) == plain(want.project(",".join(cols)).fetchall())
