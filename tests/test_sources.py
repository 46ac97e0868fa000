"""Arrays, files, codecs, accessors and the shell for quantities."""

import io
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from tolera import api
from tolera.api import Guards
from tolera.functions import kinds
from tolera.operators import correct
from tolera.operators.guards import Axis, ErrorBound, Guard, GuardError, Quantity, Sign, Stencil, from_config, register
from tolera.operators.sets import Safe
from tolera.plans import __main__ as shell
from tolera.sources import arrays, bindings, codec


def test_labelled_arrays(spark):
    make = lambda v, lat=(10.0, 20.0): SimpleNamespace(dims=("lat", "lon"), coords={"lat": np.array(lat)}, values=np.array(v, np.float32), name="t")
    data = make([[1, 2, 3], [4, 5, 6]])
    df = arrays.labelled(spark, data, make([[1, 2, 3], [4, 5, 7]]))
    assert df.columns == ["lat", "lon", "x", "p", "d_lat"] and kinds.kind_of(df.schema["x"]) == "float32"
    guards = Guards([Quantity('x * c["$d_d_lat"]', "abs", 15)])
    assert guards.builtin_late_bound() == {"$d_d_lat"}
    assert sorted((r["lat"], r["lon"]) for r in guards.check_rows(df).where("not ok").collect()) == [(1, 2)]
    with pytest.raises(ValueError, match="coordinates"):
        arrays.labelled(spark, data, make([[1, 2, 3], [4, 5, 6]], (10.0, 21.0)))


def test_bricks(spark, tmp_path):
    x = np.arange(24).reshape(2, 3, 4) / 7
    (tmp_path / "b").mkdir()
    x.astype(">f4").tofile(tmp_path / "b" / "P.bin")
    df = arrays.bricks(spark, str(tmp_path / "b"), ">f4", (2, 3, 4))
    assert kinds.kind_of(df.schema["x"]) == "float32"
    np.testing.assert_array_equal(arrays.array_of(df, ["i0", "i1", "i2"], "x"), x.astype(np.float32))


def test_arrays_in_configurations():
    a = np.array([[1.5, np.nan], [-0.0, np.inf]])
    back = bindings.from_json(bindings.to_json({"a": [a, 1, "s"], "n": np.float32(2)}))
    assert back["a"][0].tobytes() == a.tobytes() and back["a"][1:] == [1, "s"] and back["n"] == 2


# ---- codec ------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("kind", ["float16", "float32", "float64", "int8", "int32", "uint16", "int64"])
@pytest.mark.parametrize("inner", [codec.Zero(), codec.Rounded(0.3), codec.Narrow("float16")])
def test_codec_keeps_the_guards(kind, inner):
    x = (np.sin(np.arange(200) / 9).reshape(20, 10) * 50).astype(kind)
    if kind.startswith("f"):
        x[0, :3] = [np.nan, np.inf, -np.inf]
    guards = Guards([ErrorBound("abs", "eb"), Sign()])
    meta = codec.Guarded(inner, guards, {"eb": np.linspace(0.1, 1, 200).reshape(20, 10)})
    data = meta.encode(x)
    back = meta.decode(data, kind, x.shape)
    assert back.dtype == x.dtype and guards.check_array(x, back, meta.constants).all()
    again = codec.get(meta.config())
    assert again.config() == meta.config() and again.encode(x) == data
    strict = meta.update_constants(eb=0.0)
    np.testing.assert_array_equal(kinds.as_bits(strict.decode(strict.encode(x), kind, x.shape)), kinds.as_bits(x))


def test_codec_frames():
    x = np.random.RandomState(0).rand(1000) * 1000
    fine = codec.Guarded(codec.Narrow("float64"), Guards([ErrorBound("abs", 1)]))
    assert len(fine.encode(x)) == len(fine.codec.encode(x)) + 1  # nothing to correct: one byte
    assert fine.map(lambda c: codec.Zero()).codec.name == "zero"
    loose = codec.Guarded(codec.Zero(), Guards([ErrorBound("abs", 2)])).encode(x)
    assert len(loose) < len(codec.pack(kinds.as_bits(x))) and len(loose) < 8 * len(x)
    for n in (0, 1, 127, 128, 300, 1 << 40):
        assert codec.read_uleb128(codec.uleb128(n) + b"rest") == (n, len(codec.uleb128(n)))
    with pytest.raises(GuardError):
        codec.Guarded(fine, Guards([Sign()]))
    with pytest.raises(GuardError):
        codec.get({"id": "no such"})
    with pytest.raises(GuardError):
        codec.Guarded(codec.Zero(), Guards([Sign()]), {"eb": 1})
    with pytest.raises(ValueError):
        codec.read_uleb128(b"\xff")
    for v in (np.zeros(0, np.int64), np.array([3], np.int8), np.arange(999, dtype=np.int32) ** 2, np.array([np.iinfo(np.int64).min, np.iinfo(np.int64).max])):
        np.testing.assert_array_equal(codec.unpack(codec.pack(v), v.dtype.name), v)


def test_tables_of_encoded_arrays(spark):
    x = {"a": np.linspace(0, 1, 12).reshape(3, 4), "b": np.linspace(5, 9, 10).reshape(5, 2)}
    parts = [arrays.elements(spark, v).withColumn("name", F.lit(k)) for k, v in x.items()]
    df = parts[0].unionByName(parts[1]).drop("p")
    meta = codec.Guarded(codec.Rounded(0.5), Guards([ErrorBound("abs", 0.01)]))
    coded = codec.encode_arrays(df, meta, ["name"], ["i0", "i1"])
    assert {r["name"]: r["shape"] for r in coded.collect()} == {"a": [3, 4], "b": [5, 2]}
    back = codec.decode_arrays(coded, meta, ["name"], "float64", ["i0", "i1"])
    for k, v in x.items():
        got = arrays.array_of(back.where(F.col("name") == k), ["i0", "i1"], "x_hat")
        assert np.abs(got - v).max() <= 0.01


@pytest.mark.parametrize("guard", [Stencil("X[1] - X[0]", [Axis(0, 0, 1, "valid")], "abs", 0.02), Stencil("X[0] + X[2]", [Axis(0, 1, 1, "wrap")], "abs", 0.05), Quantity('x / c["$x_max"]', "abs", 0.001)])
def test_arrays_in_chunks(spark, guard):
    """No task holds an array, and windows that cross chunks keep their bounds."""
    rng = np.random.default_rng(3)
    x = {"a": rng.uniform(0, 30, 57), "b": rng.uniform(0, 9, 20)}
    parts = [arrays.elements(spark, v).withColumn("name", F.lit(k)) for k, v in x.items()]
    guards = Guards([ErrorBound("abs", 0.2), guard])
    meta = codec.Guarded(codec.Rounded(0.5), guards)
    coded = codec.encode_arrays(parts[0].unionByName(parts[1]).drop("p"), meta, ["name"], ["i0"], sides=[10])
    assert sorted((r["name"], r["first"], r["shape"]) for r in coded.collect()) == [*[("a", [i], [min(10, 57 - i)]) for i in range(0, 57, 10)], ("b", [0], [10]), ("b", [10], [10])]
    back = codec.decode_arrays(coded, meta, ["name"], "float64", ["i0"])
    for k, v in x.items():
        got = arrays.array_of(back.where(F.col("name") == k), ["i0"], "x_hat")
        assert guards.check_array(v, got).all() and (got != v).any()


# ---- datasets -----------------------------------------------------------------------------------------------------


def test_accessors_and_metadata(spark):
    df = arrays.elements(spark, np.linspace(0, 1, 50), np.round(np.linspace(0, 1, 50), 1)).withColumnRenamed("p", "y")
    guards = Guards([ErrorBound("abs", 0.02)])
    out = guards.correct(df, p="y", out="y_sg")
    assert api.guards_of(out)["y_sg"].get_config() == guards.get_config()
    whole = api.safeguarded(out)
    assert "y_sg" not in whole.columns and guards.check(whole, p="y") and set(api.guards_of(whole)) == {"y"}
    with pytest.raises(GuardError, match="already"):
        guards.correct(whole, p="y")
    assert guards.correct(whole, p="y", allow_corrected=True).where("x_sg <> 0").count() == 0


def test_corrections_in_tables_of_their_own(spark):
    df = arrays.elements(spark, np.linspace(0, 1, 50), np.round(np.linspace(0, 1, 50), 1))
    guards = Guards([ErrorBound("abs", 0.02)])
    sg = guards.correct(df).select("i0", "x_sg")
    fixed = api.apply_correction(df, sg, ["i0"])
    assert guards.check(fixed.drop("p").withColumnRenamed("x_hat", "p")) and set(api.guards_of(fixed)) == {"x_hat"}
    with pytest.raises(Exception, match="different elements"):
        api.apply_correction(df, sg.where("i0 > 3"), ["i0"]).collect()
    with pytest.raises(GuardError):
        api.apply_correction(df, sg.withMetadata("x_sg", {}), ["i0"])
    with pytest.raises(kinds.KindError):
        api.apply_correction(df.withColumn("p", F.col("p").cast("float")), sg, ["i0"])


def test_masks_of_corrections(spark):
    df = arrays.elements(spark, np.zeros(10), np.ones(10))
    got = correct.apply(Guards([Sign()]).correct(df, where=F.col("i0") < 4), "p").orderBy("i0").collect()
    assert [r["x_hat"] for r in got] == [0.0] * 4 + [1.0] * 6


def test_guards_of_ones_own(spark):
    @register
    class Even(Guard):
        """Even integers stay even."""

        kind = "test_even"

        def ok(self, ops, x, p, env):
            even = lambda v: ops.eq(ops.mul(ops.floor(ops.div(v, ops.lit(2))), ops.lit(2)), v)
            return ops.either(ops.no(even(x)), even(p))

        def safe(self, x, late):
            return Safe.exact(x).where(x % 2 == 0, Safe.full(x.dtype.name, len(x)))

        def config(self):
            return {"kind": self.kind}

    g = Guards([from_config({"kind": "test_even"}), ErrorBound("abs", 1)])
    assert Guards.from_config(g.get_config()).get_config() == g.get_config()
    with pytest.raises(GuardError):
        register(type("Other", (Guard,), {"kind": "sign"}))
    df = arrays.elements(spark, np.arange(8, dtype=np.int32), np.arange(8, dtype=np.int32) + 1)
    assert [r["ok"] for r in g.check_rows(df).orderBy("i0").collect()] == [False, True] * 4
    assert g.check(correct.apply(g.correct(df), "p").drop("p").withColumnRenamed("x_hat", "p"))


def test_errors_name_their_path():
    for bad, path in (({"kind": "all", "guards": [{"kind": "sign"}, {"kind": "eb", "type": "abs", "eb": -1}]}, r"guards\[1\].*eb.eb"), ({"kind": "any", "guards": [{"kind": "?"}]}, r"guards\[0\].kind"), ({"kind": "sign", "what": 1}, "guard"), ({"kind": "qoi_eb_pw", "qoi": "x +", "type": "abs", "eb": 1}, "line 1")):
        with pytest.raises(GuardError, match=path):
            from_config(bad)


def test_properties():
    g = Guards([ErrorBound("abs", "eb"), Stencil('sum(X) * c["$x_max"]', [Axis(0, 1, 1, "edge")], "rel", 0.1)])
    assert g.late_bound() == {"eb"} and g.builtin_late_bound() == {"$x_max"} and g.version == "1.0.0" and len(g.supported_kinds()) == 11
    assert g.correction_type("float16").simpleString() == "smallint" and "ErrorBound" in repr(g)


def test_shell(capsys):
    assert shell.main([], io.StringIO("x + 1\n\nx +\n")) == 1
    out = capsys.readouterr().out
    assert "add" in out and "error:" in out and "line 1" in out
    assert shell.main(["1,1"], io.StringIO("X[0] * 2\n")) == 0
