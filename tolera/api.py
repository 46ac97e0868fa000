"""The engine: guards over DataFrames of elements (index columns, ``x``, ``p``, late-bound columns).

Elements may be of any type in ``functions.kinds``.  Checks of doubles, floats and integers of up to 32 bits are columns that
Catalyst compiles; those of 64-bit integers run on Arrow batches, in wider floats.  A null x or p is no element: it never
passes a check, and a correction of it is an error.
"""

from __future__ import annotations

import dataclasses
import json
from collections.abc import Mapping, Sequence
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tolera.functions import kinds
from tolera.functions.ieee import NUMPY, SPARK
from tolera.operators import correct as _correct
from tolera.operators import stencil, tiles
from tolera.operators.guards import All, Any_, Axis, Guard, GuardError, Select, Stencil, from_config, register
from tolera.plans import qoi
from tolera.sources.bindings import from_json, to_json

VERSION = "1.0.0"
META = "guards"
BUILTIN = ("$x", "$X", "$x_min", "$x_max")


def data_range(df: DataFrame, x: str) -> DataFrame:
    """One row: x_min and x_max without NaN; zero if nothing is left."""
    plain = F.when(~F.isnan(x), F.col(x)) if isinstance(df.schema[x].dataType, (T.DoubleType, T.FloatType)) else F.col(x)
    return df.agg(F.coalesce(F.min(plain), F.lit(0.0)).alias("x_min"), F.coalesce(F.max(plain), F.lit(0.0)).alias("x_max"))


class Guards:
    """A list of guards that all must hold."""

    def __init__(self, guards: Sequence[Guard]):
        if not guards:
            raise GuardError("guards: at least one is needed")
        self.guards = list(guards)
        self.root: Guard = guards[0] if len(guards) == 1 else All(guards)

    # ---- properties and configuration

    version = VERSION

    @staticmethod
    def supported_kinds() -> frozenset[str]:
        return frozenset(kinds.STORAGE)

    @staticmethod
    def correction_type(kind: str) -> T.DataType:
        return kinds.correction_type(kind)

    def late_bound(self) -> set[str]:
        """Names that ``late`` must bind."""
        return {n for n in self.root.late() if not n.startswith("$")}

    def builtin_late_bound(self) -> set[str]:
        """Built-in names in use: the data (``$x``, ``$X``), its range, and coordinates (``$d_NAME`` is the index column NAME)."""
        return {n for n in self.root.late() if n.startswith("$")}

    def get_config(self) -> str:
        return json.dumps(to_json({"_version": VERSION, "guards": [g.config() for g in self.guards]}))

    @classmethod
    def from_config(cls, text: str) -> Guards:
        c = from_json(json.loads(text))
        if str(c.get("_version", VERSION)).split(".")[0] != VERSION.split(".")[0]:
            raise GuardError(f"_version: {c['_version']} can't be read")
        return cls([from_config(g, f"guards[{i}]") for i, g in enumerate(c["guards"])])

    def __repr__(self) -> str:
        return f"Guards({self.guards!r})"

    # ---- late-bound names

    def _bound(self, df: DataFrame, x: str, late: Mapping[str, Any]) -> tuple[DataFrame, dict[str, Column]]:
        missing, extra = self.late_bound() - set(late), set(late) - self.late_bound()
        if missing or extra:
            raise GuardError(f"late_bound: missing {sorted(missing)}, not asked for {sorted(extra)}")
        columns = {k: (F.col(v) if isinstance(v, str) else v if isinstance(v, Column) else F.lit(v)).cast("double") for k, v in late.items()}
        for name in self.builtin_late_bound() - set(BUILTIN):
            if not name.startswith("$d_") or name[3:] not in df.columns:
                raise GuardError(f"late_bound: there is no {name}")
            columns[name] = F.col(name[3:]).cast("double")
        if self.root.late() & {"$x_min", "$x_max"}:
            df = df.crossJoin(F.broadcast(data_range(df, x).select(F.col("x_min").cast("double").alias("_x_min"), F.col("x_max").cast("double").alias("_x_max"))))  # one row
            columns |= {"$x_min": F.col("_x_min"), "$x_max": F.col("_x_max")}
        columns |= {"$x": F.col(x).cast("double"), "$X": F.col(x).cast("double")}
        return df, columns

    def _kind(self, df: DataFrame, x: str, p: str) -> str:
        kind = kinds.kind_of(df.schema[x])
        if kinds.kind_of(df.schema[p]) != kind:
            raise kinds.KindError(f"{x} and {p} have different types")
        return kind

    def _given(self, columns: Mapping[str, Column]) -> dict[str, Column]:
        """What functions of Arrow columns need besides the data."""
        return {k: columns[k] for k in sorted(self.root.late() - {"$x", "$X"})}

    # ---- checks

    def check_rows(self, df: DataFrame, x: str = "x", p: str = "p", late: Mapping[str, Any] | None = None, where: Column | None = None, index: Sequence[str] = (), by: Sequence[str] = (), shape: Sequence[int] | None = None, ok: str = "ok") -> DataFrame:
        """df with a boolean ``ok``; rows outside ``where`` pass, and so do those without a whole 'valid' neighbourhood."""
        names, kind = df.columns, self._kind(df, x, p)
        if self.root.around() and (len(index) > 1 or kind in ("int64", "uint64")):
            out = [T.StructField(ok, T.BooleanType())]
            root = self.root
            df = self._tiled(df, x, p, late or {}, index, by, shape, lambda area: {ok: area.ok(root)}, out)
            return df if where is None else df.withColumn(ok, ~F.coalesce(where, F.lit(False)) | F.col(ok)).select(*names, ok)
        df, columns = self._bound(df, x, late or {})
        if kind in ("int64", "uint64"):
            good = _correct.check_column(self.root, F.col(x), F.col(p), kind, self._given(columns))
        else:
            good, df = self._ok(df, self.root, x, p, columns, index, by, shape)
        good = F.when(F.col(x).isNull() | F.col(p).isNull(), F.lit(False)).otherwise(F.coalesce(good, F.lit(False)))
        if where is not None:
            good = ~F.coalesce(where, F.lit(False)) | good
        return df.withColumn(ok, good).select(*names, ok)

    def _ok(self, df: DataFrame, g: Guard, x: str, p: str, late: dict[str, Column], index: Sequence[str], by: Sequence[str], shape: Sequence[int] | None) -> tuple[Column, DataFrame]:
        if isinstance(g, Stencil):
            return self._stencil(df, g, x, p, late, index, by)
        if g.around():
            parts = []
            for k in g.guards:  # type: ignore[attr-defined]
                part, df = self._ok(df, k, x, p, late, index, by, shape)
                parts.append(part)
            if isinstance(g, Select):
                sel = g.choice(SPARK, lambda name, at: late[name])
                out = F.lit(False)
                for i, part in reversed(list(enumerate(parts))):
                    out = F.when(sel == i, part).otherwise(out)
                return out, df
            return (SPARK.either(*parts) if isinstance(g, Any_) else SPARK.both(*parts)), df
        return g.ok(SPARK, F.col(x).cast("double"), F.col(p).cast("double"), lambda name, at: late[name]), df

    def _stencil(self, df: DataFrame, g: Stencil, x: str, p: str, late: dict[str, Column], index: Sequence[str], by: Sequence[str]) -> tuple[Column, DataFrame]:
        """A neighbourhood along one axis: lagged columns."""
        if not index:
            raise GuardError("qoi_eb_stencil: the index columns are needed")
        axis = g.neighbourhood[0]
        tiles.axis_of(axis, len(index))
        if isinstance(axis.constant, str):
            axis = dataclasses.replace(axis, constant=late[axis.constant])
        offsets, constants = qoi.used(g.node)
        every = sorted({*offsets, (0,), *(o for _, o in constants)})
        mark = f"_g{len(df.columns)}"
        plain = {n for n, _ in constants if n not in ("$x", "$X")}
        for n in sorted(plain):
            df = df.withColumn(f"{mark}{n}", late[n])
        work = df.withColumn(f"{mark}x", F.col(x).cast("double")).withColumn(f"{mark}p", F.col(p).cast("double"))
        columns = [f"{mark}x", f"{mark}p", *[f"{mark}{n}" for n in sorted(plain)]]
        work = stencil.line(work, index[0], columns, axis, [o[0] for o in every], by)
        full = f"{mark}full"
        work = work.withColumnRenamed("_full", full)
        read = lambda c: lambda at: F.col(f"`{stencil.name_of(mark + c, at)}`")
        got = g.ok(SPARK, read("x"), read("p"), lambda name, at: read(name)(at) if name in plain else late[name])
        result = f"{mark}ok"
        work = work.withColumn(result, ~F.col(full) | got)
        return F.col(result), work.drop(*[c for c in work.columns if c.startswith(mark) and c != result])

    def check(self, df: DataFrame, **more: Any) -> bool:
        """Whether every row passes: one aggregate."""
        return bool(self.check_rows(df, **more).agg(F.coalesce(F.bool_and("ok"), F.lit(True)).alias("ok")).first()["ok"])

    def check_chunks(self, df: DataFrame, index: Sequence[str], sides: Sequence[int], x: str = "x", p: str = "p", late: Mapping[str, Any] | None = None, by: Sequence[str] = (), shape: Sequence[int] | None = None) -> DataFrame:
        """A row per chunk (``chunk``: its number along each axis) and whether it passes.  Each chunk is checked on its own, from
        its elements and their halo, and says what the whole array would."""
        root = self.root
        fields = [T.StructField("ok", T.BooleanType())]
        rows = self._tiled(df, x, p, late or {}, index, by, shape, lambda area: {"ok": area.ok(root)}, fields, sides)
        side = tiles.sides_for(len(index), tiles.reaches(root, len(index)), sides, tiles.TILE)
        number = F.array(*[F.floor(F.col(c) / s).cast("long") for c, s in zip(index, side, strict=True)])
        return rows.groupBy(*by, number.alias("chunk")).agg(F.bool_and("ok").alias("ok"))

    # ---- safe sets and corrections

    def _tiled(self, df: DataFrame, x: str, p: str | None, late: Mapping[str, Any], index: Sequence[str], by: Sequence[str], shape: Sequence[int] | None, run: Any, out: list[T.StructField], sides: Sequence[int] | None = None, extra: Mapping[str, str] | None = None) -> DataFrame:
        """df with the columns of ``out``, computed tile by tile."""
        if not index:
            raise GuardError("the index columns are needed")
        names = df.columns
        kind = kinds.kind_of(df.schema[x])
        work, columns = self._bound(df, x, late)
        given = self._given(columns)
        work = work.withColumns({f"_late{i}": c for i, c in enumerate(given.values())}) if given else work
        read = {"x": x, **({"p": p} if p else {}), **(extra or {}), **{k: f"_late{i}" for i, k in enumerate(given)}}
        plain = all(isinstance(f.dataType, (T.NumericType, T.StringType, T.BooleanType)) for f in df.schema.fields)
        done = tiles.over_tiles(work, self.root, index, shape, read, kind, run, out, names if plain else (), by, sides)
        if plain:
            return done.select(*names, *[f.name for f in out]).to(T.StructType([*df.schema.fields, *out]))
        keys = [*by, *index]
        found = done.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], *[f.name for f in out])
        on = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
        return df.join(found, on).select(*names, *[f.name for f in out])

    def safe_sets(self, df: DataFrame, x: str = "x", late: Mapping[str, Any] | None = None, index: Sequence[str] = (), by: Sequence[str] = (), shape: Sequence[int] | None = None, out: str = "safe") -> DataFrame:
        """df with ``out``, the values that each element may take: ARRAY<STRUCT<lo, hi>> of order keys (``operators.intervals``)."""
        root = self.root
        if root.around():
            return self._tiled(df, x, None, late or {}, index, by, shape, lambda area: {out: _correct.set_lists(area.safe(root))}, [T.StructField(out, _correct.SETS)])
        names, kind = df.columns, kinds.kind_of(df.schema[x])
        work, columns = self._bound(df, x, late or {})
        return work.withColumn(out, _correct.set_column(root, F.col(x), kind, self._given(columns))).select(*names, out)

    def correct(
        self, df: DataFrame, x: str = "x", p: str = "p", late: Mapping[str, Any] | None = None, index: Sequence[str] = (), by: Sequence[str] = (), shape: Sequence[int] | None = None, out: str = "x_sg",
        where: Column | None = None, sides: Sequence[int] | None = None, refine: bool = False, allow_corrected: bool = False,
    ) -> DataFrame:
        """df with the correction column ``out``, which carries the configuration in its metadata.

        sides: lengths of chunks along each axis (the result doesn't depend on them).  refine: elements keep p unless a check
        that reads them fails, so fewer are changed; takes rounds of checks, at most as many as a failing check has
        consequences.  where: only for guards of single elements.  Data or predictions that come from a correction are
        refused unless ``allow_corrected``."""
        if not allow_corrected and any((f.metadata or {}).get(META) for f in df.schema.fields if f.name in (x, p)):
            raise GuardError("data or prediction has been corrected already")
        kind = self._kind(df, x, p)
        narrow = kinds.correction_type(kind)
        if not self.root.around():
            names = df.columns
            work, columns = self._bound(df, x, late or {})
            fixed = work.withColumn(out, _correct.correction_column(self.root, F.col(x), F.col(p), kind, self._given(columns), where)).select(*names, out)
        elif where is not None:
            raise GuardError("where: not for neighbourhoods")
        elif self.check(df, x=x, p=p, late=late, index=index, by=by, shape=shape):
            fixed = df.withColumn(out, F.lit(0).cast(narrow))
        elif refine:
            fixed = self._refined(df, x, p, late or {}, index, by, shape, out, sides)
        else:
            root = self.root

            def run(area: tiles.Area) -> dict[str, Any]:
                return {out: _correct.difference(area.corrected(root).ravel(), area.values["p"][area.inner()].ravel())}

            fixed = self._tiled(df, x, p, late or {}, index, by, shape, run, [T.StructField(out, narrow)], sides)
        return fixed.withMetadata(out, {META: self.get_config(), **({kinds.DTYPE: kind} if kinds.DTYPE in (df.schema[x].metadata or {}) else {})})

    def _refined(self, df: DataFrame, x: str, p: str, late: Mapping[str, Any], index: Sequence[str], by: Sequence[str], shape: Sequence[int] | None, out: str, sides: Sequence[int] | None) -> DataFrame:
        """All elements of failing windows take their safe values, round by round.  A window that has taken them passes for
        good, so each fails at most once.  Rounds are settled, so that lineage doesn't grow."""
        root, kind = self.root, kinds.kind_of(df.schema[x])
        spare = [T.StructField("_spare", kinds.STORAGE[kind])]
        now = self._tiled(df, x, p, late, index, by, shape, lambda area: {"_spare": _correct.as_arrow(area.corrected(root).ravel(), kind)}, spare, sides)
        now = settled(now.withColumn("_taken", F.lit(0.0)))
        hat = F.when(F.col("_taken") > 0, F.col("_spare")).otherwise(F.col(p))
        meta = {k: v for k, v in (df.schema[x].metadata or {}).items() if k == kinds.DTYPE}
        fields = [T.StructField("_more", T.BooleanType())]

        def run(area: tiles.Area) -> dict[str, Any]:
            bad = np.zeros(area.size, bool)
            bad[area.inner(1)] = ~area.ok(root, "hat", 1) & _inside(area)
            return {"_more": tiles.inverse_footprint(area, root, bad)}

        while True:
            work = now.withColumn("_hat", hat).withMetadata("_hat", meta).withMetadata("_spare", meta)
            seen = self._tiled(work, x, p, late, index, by, shape, run, fields, sides, {"hat": "_hat"})
            after = settled(seen.withColumn("_taken", F.when(F.col("_more"), 1.0).otherwise(F.col("_taken"))).select(*now.columns))
            if after.agg(F.sum("_taken")).first()[0] == now.agg(F.sum("_taken")).first()[0]:
                break
            now = after
        spent = now.withColumn("_hat", hat)

        def diff(a: pa.Array, b: pa.Array) -> pa.Array:
            return pa.array(_correct.difference(_correct.numbers(a, kind), _correct.numbers(b, kind)))

        column = F.arrow_udf(_correct._typed(diff, 2), kinds.correction_type(kind))(F.col("_hat"), F.col(p))
        return spent.withColumn(out, column).select(*df.columns, out)

    # ---- chunks in numpy

    def halo(self, rank: int) -> list[tuple[int, bool]]:
        """Per axis: how many elements beyond a chunk its correction reads, and whether they wrap around."""
        return [(2 * r, w) for r, w in zip(tiles.reaches(self.root, rank), tiles.periodic(self.root, rank), strict=True)]

    def check_array(self, x: np.ndarray, p: np.ndarray, late: Mapping[str, np.ndarray] | None = None) -> np.ndarray:
        """Whether each element of an array passes."""
        return self._whole(x, p, late).ok(self.root)

    def correct_array(self, x: np.ndarray, p: np.ndarray, late: Mapping[str, np.ndarray] | None = None) -> np.ndarray:
        """The correction of an array."""
        area = self._whole(x, p, late)
        if area.ok(self.root).all():
            return np.zeros(x.shape, f"int{8 * x.itemsize}")
        return _correct.difference(area.corrected(self.root), np.ascontiguousarray(p))

    def check_chunk(self, area: tiles.Area) -> np.ndarray:
        """Whether each element of a chunk (with its halo) passes, as in the whole array."""
        return area.ok(self.root)

    def correct_chunk(self, area: tiles.Area, any_failed: bool) -> np.ndarray:
        """The correction of a chunk (with its halo); any_failed: whether any chunk fails its check, which is what decides
        whether elements that pass may stay as they are."""
        p = area.values["p"][area.inner()]
        return _correct.difference(area.corrected(self.root), np.ascontiguousarray(p)) if any_failed else np.zeros(p.shape, f"int{8 * p.itemsize}")

    def _whole(self, x: np.ndarray, p: np.ndarray, late: Mapping[str, np.ndarray] | None) -> tiles.Area:
        if x.dtype != p.dtype or x.shape != p.shape:
            raise ValueError("data and prediction must have the same type and shape")
        if x.dtype.name not in kinds.STORAGE:
            raise kinds.KindError(f"{x.dtype} is no type of elements")
        values = {k: np.broadcast_to(np.asarray(v), x.shape).astype(np.float64) for k, v in (late or {}).items()}
        missing = self.late_bound() - set(values)
        if missing or set(values) - self.late_bound():
            raise GuardError(f"late_bound: missing {sorted(missing)}, not asked for {sorted(set(values) - self.late_bound())}")
        plain = x[~np.isnan(x)] if x.dtype.kind == "f" else x.ravel()
        for name, f in (("$x_min", np.min), ("$x_max", np.max)):
            values[name] = np.full(x.shape, float(f(plain)) if plain.size else 0.0)
        for k, name in enumerate(n for n in self.builtin_late_bound() if n.startswith("$d_")):
            raise GuardError(f"late_bound: arrays have no coordinates ({name}, axis {k})")
        return tiles.Area.whole(self.root, {"x": x, "p": p, **values}, x.dtype.name)

    def evaluate(self, df: DataFrame, text: str, x: str = "x", late: Mapping[str, Any] | None = None) -> Column:
        """A pointwise quantity as a column."""
        late = {k: F.col(v) if isinstance(v, str) else F.lit(v) for k, v in (late or {}).items()}
        return qoi.evaluate(qoi.parse(text), SPARK, lambda at: F.col(x), lambda name, at: F.col(x) if name == "$x" else late[name])


def _inside(area: tiles.Area) -> np.ndarray:
    """Which centres around a core are places of the array (or copies on a periodic axis)."""
    return area.centres([Axis(k, 0, 0, "edge") for k in range(area.rank)])


def settled(df: DataFrame) -> DataFrame:
    """Cuts lineage in the folder that spark.checkpoint.dir names; sets one of its own only in local mode."""
    spark = df.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(named or "/tmp/tolera-checkpoints")
    return df.checkpoint()


def quantity(text: str, x: str = "x", late: Mapping[str, Any] | None = None) -> Column:
    """A pointwise quantity of interest as a column."""
    return Guards.evaluate(None, None, text, x, late)  # type: ignore[arg-type]


def register_quantity(spark: SparkSession, name: str, text: str) -> None:
    """Makes a pointwise quantity a function of SQL, of the data and then its late-bound constants in alphabetical order."""
    node = qoi.fold(qoi.parse(text))
    names = sorted({n for n, _ in qoi.used(node)[1] if n not in ("$x", "$X")})

    def run(*arrays: pa.Array) -> pa.Array:
        x, *rest = (a.to_numpy(zero_copy_only=False) for a in arrays)
        late = dict(zip(names, rest, strict=True))
        with np.errstate(all="ignore"):
            out = np.broadcast_to(np.asarray(qoi.evaluate(node, NUMPY, lambda at: x, lambda n, at: x if n in ("$x", "$X") else late[n]), np.float64), len(x))
        null = np.logical_or.reduce([a.is_null().to_numpy(zero_copy_only=False) for a in arrays])
        return pa.array(np.ascontiguousarray(out), mask=null, from_pandas=False)

    spark.udf.register(name, F.arrow_udf(_correct._typed(run, 1 + len(names)), T.DoubleType()))


def neighbourhood_quantity(df: DataFrame, text: str, axes: Sequence[Any], index: Sequence[str], x: str = "x", by: Sequence[str] = (), shape: Sequence[int] | None = None, late: Mapping[str, str] | None = None, out: str = "qoi") -> DataFrame:
    """df with a stencil quantity; null where a 'valid' neighbourhood doesn't fit.

    Along one axis: lagged columns over blocks, in the JVM.  Several axes: tiles with halos."""
    if len(index) > 1:
        guard = Stencil(text, list(axes), "abs", 0.0)

        def run(area: tiles.Area) -> dict[str, Any]:
            value = area.quantity(guard, "x", 0).ravel()
            return {out: pa.array(value, mask=~area.centres(guard.neighbourhood, 0).ravel(), from_pandas=False)}

        return Guards([guard])._tiled(df, x, None, late or {}, index, by, shape, run, [T.StructField(out, T.DoubleType())])
    node = qoi.parse(text, [(a.before, a.after) for a in axes])
    offsets, constants = qoi.used(node)
    every = sorted({*offsets, *(o for _, o in constants)})
    late = dict(late or {})
    names = df.columns
    axis = axes[0]
    if isinstance(axis.constant, str):
        axis = dataclasses.replace(axis, constant=F.col(late[axis.constant]))
    work = stencil.line(df, index[0], [x, *late.values()], axis, [o[0] for o in every], by)
    read = lambda c, at: F.col(f"`{stencil.name_of(c, at)}`")
    value = qoi.evaluate(node, SPARK, lambda at: read(x, at), lambda name, at: read(x if name in ("$x", "$X") else late[name], at))
    return work.withColumn(out, F.when(F.col("_full"), value)).select(*names, out)


def truncated(df: DataFrame, out: str = "qoi") -> DataFrame:
    """Only the elements whose neighbourhood is whole: the shape of the quantity."""
    return df.where(F.col(out).isNotNull())


def expanded(df: DataFrame, out: str = "qoi", fill: float = 0.0) -> DataFrame:
    """The shape of the data again: elements without a whole neighbourhood hold ``fill``."""
    return df.withColumn(out, F.coalesce(F.col(out), F.lit(fill)))


# ---- datasets: corrections beside their data --------------------------------------------------------------------


def guards_of(df: DataFrame) -> dict[str, Guards]:
    """The guards of every column that carries some, read back from its metadata."""
    return {f.name: Guards.from_config(f.metadata[META]) for f in df.schema.fields if (f.metadata or {}).get(META)}


def safeguarded(df: DataFrame) -> DataFrame:
    """Applies every correction column (``NAME_sg``, with its configuration) to the column NAME, which then carries it."""
    for f in df.schema.fields:
        if (f.metadata or {}).get(META) and f.name.endswith("_sg") and f.name[:-3] in df.columns:
            name = f.name[:-3]
            meta = {**{k: v for k, v in (df.schema[name].metadata or {}).items()}, META: f.metadata[META]}
            df = _correct.apply(df, name, f.name, "_hat").withColumn(name, F.col("_hat")).drop("_hat", f.name).withMetadata(name, meta)
    return df


def apply_correction(prediction: DataFrame, correction: DataFrame, index: Sequence[str], p: str = "p", sg: str = "x_sg", out: str = "x_hat") -> DataFrame:
    """A correction kept in a table of its own, applied to a prediction: joined on the index.

    The correction must carry its guards and be as wide as the prediction, which must not be corrected already; elements
    that only one of the two has are an error of the query."""
    if not (correction.schema[sg].metadata or {}).get(META):
        raise GuardError(f"{sg} is no correction: it carries no guards")
    if (prediction.schema[p].metadata or {}).get(META):
        raise GuardError(f"{p} has been corrected already")
    if correction.schema[sg].dataType != kinds.correction_type(kinds.kind_of(prediction.schema[p])):
        raise kinds.KindError(f"{sg} is not as wide as {p}")
    names = prediction.columns
    other = correction.select(*index, F.col(sg).alias("_sg"), F.lit(True).alias("_right"))
    both = prediction.withColumn("_left", F.lit(True)).join(other, list(index), "full")
    whole = F.col("_left").isNotNull() & F.col("_right").isNotNull()
    narrow = correction.schema[sg].dataType
    both = both.withColumn("_sg", F.when(whole, F.col("_sg")).otherwise(F.raise_error(F.lit("prediction and correction hold different elements")).cast(narrow)))
    meta = {META: correction.schema[sg].metadata[META], **{k: v for k, v in (prediction.schema[p].metadata or {}).items() if k == kinds.DTYPE}}
    fixed = _correct.apply(both.withMetadata(p, prediction.schema[p].metadata or {}), p, "_sg", out)
    return fixed.withMetadata(out, meta).select(*names, out)


__all__ = ["Guard", "GuardError", "Guards", "apply_correction", "data_range", "expanded", "guards_of", "neighbourhood_quantity", "quantity", "register", "register_quantity", "safeguarded", "settled", "truncated"]
