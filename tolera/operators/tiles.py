"""Tiles with halos: neighbourhood guards of arrays of any rank, one bounded tile at a time.

The table of elements is dealt into tiles of at most ``TILE`` elements.  An element also goes to the tiles whose halo it
lies in (on periodic axes under its place beyond the border), so a tile is checked, corrected or evaluated without its
neighbours, with the result that the whole array would give: a tile sees every window that holds one of its elements,
and all that these windows read.  One exchange deals the elements; nothing is joined back.

``Area`` is a tile in numpy: dense arrays that reach ``2 * reach`` beyond the tile's core on each side of each axis.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tolera.functions import kinds
from tolera.functions.ieee import NUMPY
from tolera.operators import guards as G
from tolera.operators.inverse import quantity_boxes
from tolera.operators.sets import Safe
from tolera.plans import qoi

#: Elements of a tile's core, about.
TILE = 1 << 16


def source(i: np.ndarray, n: int, border: str) -> np.ndarray:
    """Where a place on (or beyond) an axis of n elements reads; -1 for none."""
    inside = (i >= 0) & (i < n)
    if border in ("valid", "constant"):
        return np.where(inside, i, -1)
    if border == "edge":
        return np.clip(i, 0, n - 1)
    if border == "wrap":
        return i % n
    if border == "symmetric":
        m = i % (2 * n)
        return np.where(m < n, m, 2 * n - 1 - m)
    m = i % max(2 * (n - 1), 1)
    return np.zeros_like(i) if n == 1 else np.where(m < n, m, 2 * (n - 1) - m)


def stencils(g: G.Guard) -> list[G.Stencil]:
    return [g] if isinstance(g, G.Stencil) else [s for k in getattr(g, "guards", ()) for s in stencils(k)]


def axis_of(a: G.Axis, rank: int) -> int:
    """The axis that is meant, counted from the end if negative."""
    if not -rank <= a.axis < rank:
        raise G.GuardError(f"neighbourhood.axis: {a.axis} is out of range for {rank} axes")
    return a.axis % rank


def reaches(g: G.Guard, rank: int) -> list[int]:
    """How far any window reaches along each axis, to the farther side."""
    out = [0] * rank
    for s in stencils(g):
        for a in s.neighbourhood:
            out[axis_of(a, rank)] = max(out[axis_of(a, rank)], a.before, a.after)
    return out


def periodic(g: G.Guard, rank: int) -> list[bool]:
    out = [False] * rank
    for s in stencils(g):
        for a in s.neighbourhood:
            out[axis_of(a, rank)] |= a.border == "wrap"
    return out


@dataclass
class Area:
    """first, core: place and size of the core; shape: of the whole array; reach: per axis.  ``values`` are dense over
    core + 2 * reach on each side; places that no element was given for hold zeros and are never read."""

    first: tuple[int, ...]
    core: tuple[int, ...]
    shape: tuple[int, ...]
    reach: tuple[int, ...]
    kind: str
    values: dict[str, np.ndarray] = field(default_factory=dict)

    @property
    def rank(self) -> int:
        return len(self.shape)

    @property
    def size(self) -> tuple[int, ...]:
        return tuple(c + 4 * r for c, r in zip(self.core, self.reach, strict=True))

    def inner(self, margin: int = 0) -> tuple[slice, ...]:
        """The core, with ``margin`` reaches around it."""
        return tuple(slice((2 - margin) * r, (2 - margin) * r + c + 2 * margin * r) for c, r in zip(self.core, self.reach, strict=True))

    def places(self, axis: int) -> np.ndarray:
        return self.first[axis] - 2 * self.reach[axis] + np.arange(self.size[axis])

    @classmethod
    def whole(cls, g: G.Guard, arrays: Mapping[str, np.ndarray], kind: str) -> Area:
        """A whole array as one tile."""
        shape = next(iter(arrays.values())).shape
        area = cls((0,) * len(shape), shape, shape, tuple(reaches(g, len(shape))), kind)
        for k, v in arrays.items():
            area.put(k, v)
        return area

    def put(self, name: str, data: np.ndarray) -> None:
        """Values of the whole array, laid out around the core (periodic copies included)."""
        self.values[name] = self.cut(data)

    def cut(self, data: np.ndarray) -> np.ndarray:
        return data[np.ix_(*[self.places(k) % n for k, n in enumerate(self.shape)])]

    # ---- reading windows

    def padded(self, name: str, axes: Sequence[G.Axis]) -> np.ndarray:
        """Values with the borders that these axes ask for; axes are padded in their order."""
        out = self.values[name]
        for a in axes:
            k = axis_of(a, self.rank)
            at, n = self.places(k), self.shape[k]
            from_ = source(at, n, a.border)
            if a.border == "constant":
                beyond = from_ < 0
                if beyond.any():
                    constant = a.constant if not isinstance(a.constant, str) else float(self.values[a.constant].flat[0])
                    fill = np.zeros([1] * self.rank, out.dtype) + kinds.lossless(np.asarray(constant), out.dtype.name) if out.dtype.kind != "f" or np.asarray(constant).dtype.kind == "i" else np.asarray(constant, out.dtype)
                    out = np.where(beyond.reshape([-1 if j == k else 1 for j in range(self.rank)]), fill, out)
            elif a.border != "valid":
                here = from_ - self.first[k] + 2 * self.reach[k]
                if a.border == "wrap":  # periodic copies are in place
                    here = np.arange(len(at))
                out = out.take(np.clip(here, 0, len(at) - 1), axis=k)
        return out

    def window(self, padded: np.ndarray, axes: Sequence[G.Axis], offset: Sequence[int], margin: int = 1) -> np.ndarray:
        """What the windows centred in the core (and ``margin`` reaches around it) read at an offset."""
        return padded[self.moved(axes, offset, margin)]

    def moved(self, axes: Sequence[G.Axis], offset: Sequence[int], margin: int = 1) -> tuple[slice, ...]:
        at = list(self.inner(margin))
        for a, o in zip(axes, offset, strict=True):
            k = axis_of(a, self.rank)
            at[k] = slice(at[k].start + o, at[k].stop + o)
        return tuple(at)

    def centres(self, axes: Sequence[G.Axis], margin: int = 1) -> np.ndarray:
        """Which of these windows there are: centred on an element (or, on a periodic axis, on its copy), and whole if need be."""
        out = np.ones([1] * self.rank, bool)
        by = {axis_of(a, self.rank): a for a in axes}
        for k, s in enumerate(self.inner(margin)):
            i, n, a = self.places(k)[s], self.shape[k], by.get(k)
            ok = (i >= 0) & (i < n)
            if a is not None and a.border == "wrap":
                ok = np.ones(len(i), bool)
            elif a is not None and a.border == "valid":
                ok = (i - a.before >= 0) & (i + a.after < n)
            out = out & ok.reshape([-1 if j == k else 1 for j in range(self.rank)])
        return np.broadcast_to(out, [s.stop - s.start for s in self.inner(margin)])

    # ---- guards

    def _late(self, name: str, margin: int) -> np.ndarray:
        return self.values["x" if name in ("$x", "$X") else name][self.inner(margin)]

    def quantity(self, s: G.Stencil, of: str, margin: int) -> np.ndarray:
        pads: dict[str, np.ndarray] = {}

        def read(name: str, at: Sequence[int]) -> np.ndarray:
            if name not in pads:
                pads[name] = kinds.wide(self.padded(name, s.neighbourhood)) if name in ("x", "p") else self.padded(name, s.neighbourhood)
            return self.window(pads[name], s.neighbourhood, at, margin)

        with np.errstate(all="ignore"):
            value = s.value(NUMPY, lambda at: read(of, at), lambda name, at: read(of if name in ("$x", "$X") else name, at))
        return np.broadcast_to(np.asarray(value, np.float64), self.centres(s.neighbourhood, margin).shape)

    def ok(self, g: G.Guard, p: str = "p", margin: int = 0) -> np.ndarray:
        """Whether each element of the core (and ``margin`` reaches around) passes."""
        with np.errstate(all="ignore"):
            if isinstance(g, G.Stencil):
                eb = self._late(g.eb, margin) if isinstance(g.eb, str) else np.float64(g.eb)
                if isinstance(g.eb, str):
                    eb = G.error_bound(g.type, g.eb, g.kind, NUMPY, lambda name, at: eb)
                good = G.qoi_ok(g.type, NUMPY, self.quantity(g, "x", margin), self.quantity(g, p, margin), eb)
                return ~self.centres(g.neighbourhood, margin) | good
            if g.around():
                parts = [self.ok(k, p, margin) for k in g.guards]  # type: ignore[attr-defined]
                if isinstance(g, G.Select):
                    sel = np.broadcast_to(g.choice(NUMPY, lambda name, _: self._late(name, margin)), parts[0].shape)
                    return np.select([sel == i for i in range(len(parts))], parts)
                return np.logical_or.reduce(parts) if isinstance(g, G.Any_) else np.logical_and.reduce(parts)
            x, hat = (kinds.wide(self.values[c][self.inner(margin)]) for c in ("x", p))
            return np.broadcast_to(g.ok(NUMPY, x, hat, lambda name, _: self._late(name, margin)), x.shape)

    def safe(self, g: G.Guard, where: np.ndarray | None = None) -> Safe:
        """The safe set of each element of the core: what every window that holds it allows.  where: the centres (core and a
        reach around) that the guard is for."""
        n = int(np.prod(self.core))
        if isinstance(g, G.Stencil):
            return self._windows(g, where)[0]
        if not g.around():
            x = self.values["x"][self.inner()].ravel()
            out = g.safe(x, lambda name: self._late(name, 0).ravel())
            return out if where is None else out.only_where(self._core_of(where).ravel())
        every = np.ones([s.stop - s.start for s in self.inner(1)], bool) if where is None else where
        if isinstance(g, G.Select):
            sel = np.broadcast_to(g.choice(NUMPY, lambda name, _: self._late(name, 1)), every.shape)
            chosen = [every & (sel == i) for i in range(len(g.guards))]
        elif isinstance(g, G.Any_):
            width = np.stack([self._width(k) for k in g.guards])
            best = np.argmax(width, axis=0)
            chosen = [every & (best == i) for i in range(len(g.guards))]
        else:
            chosen = [every] * len(g.guards)  # type: ignore[attr-defined]
        out = Safe.full(self.kind, n)
        for k, mask in zip(g.guards, chosen, strict=True):  # type: ignore[attr-defined]
            if mask.any():
                out = out.intersect(self.safe(k, mask))
        return out

    def _core_of(self, around: np.ndarray) -> np.ndarray:
        return around[tuple(slice(r, r + c) for r, c in zip(self.reach, self.core, strict=True))]

    def _width(self, g: G.Guard) -> np.ndarray:
        """How much room a guard leaves at each centre (core and a reach around); of alternatives the widest is asked for."""
        if isinstance(g, G.Stencil):
            return self._windows(g, None)[1]
        if g.around():
            parts = [self._width(k) for k in g.guards]  # type: ignore[attr-defined]
            return np.max(parts, axis=0) if isinstance(g, G.Any_) else np.min(parts, axis=0)
        x = self.values["x"][self.inner(1)]
        return g.safe(x.ravel(), lambda name: self._late(name, 1).ravel()).width().reshape(x.shape)

    def _windows(self, s: G.Stencil, where: np.ndarray | None) -> tuple[Safe, np.ndarray]:
        """Safe sets of the core under a stencil, and the room at each centre."""
        axes = s.neighbourhood
        pads = {name: self.padded(name, axes) for name in {"x", *(n for n, _ in qoi.used(s.node)[1] if n not in ("$x", "$X"))}}
        active = self.centres(axes) & (True if where is None else where)
        eb = self._late(s.eb, 1) if isinstance(s.eb, str) else np.float64(s.eb)
        if isinstance(s.eb, str):
            eb = G.error_bound(s.type, s.eb, s.kind, NUMPY, lambda name, at: np.where(active, eb, 1.0))
        flat = lambda a: np.ascontiguousarray(a).ravel()
        read = lambda name, at: self.window(pads[name], axes, at)
        found = quantity_boxes(s.node, s.type, flat(np.broadcast_to(eb, active.shape)), lambda at: flat(kinds.wide(read("x", at))), lambda name, at: flat(read(name, at)), flat(active), s.qoi_dtype)
        least, most = kinds.key_range(self.kind)
        low, high = np.full(self.size, least, np.int64), np.full(self.size, most, np.int64)
        room = np.full(active.shape, np.inf)
        centre = (0,) * len(axes)
        for at, box in found.items():
            set_ = G.box_set(flat(read("x", at)), box.lo, box.hi)
            lo, hi = (np.where(flat(active), a, b).reshape(active.shape) for a, b in ((set_.lo[0], least), (set_.hi[0], most)))
            if at == centre or centre not in found:
                room = np.minimum(room, np.where(active, hi.astype(np.float64) - lo, np.inf))
            m = self.moved(axes, at)
            low[m] = np.maximum(low[m], lo)
            high[m] = np.minimum(high[m], hi)
        for a in reversed(axes):  # what is read beyond a border belongs to the element it stands for
            k = axis_of(a, self.rank)
            if a.border in ("edge", "reflect", "symmetric"):
                at, n = self.places(k), self.shape[k]
                beyond = np.flatnonzero((at < 0) | (at >= n))
                here = source(at[beyond], n, a.border) - self.first[k] + 2 * self.reach[k]
                for v, h in zip(beyond.tolist(), here.tolist(), strict=True):
                    if 0 <= h < len(at):
                        to, of = (tuple(i if j == k else slice(None) for j in range(self.rank)) for i in (h, v))
                        low[to] = np.maximum(low[to], low[of])
                        high[to] = np.minimum(high[to], high[of])
        own = kinds.key_of(self.values["x"][self.inner()].ravel())
        low, high = low[self.inner()].ravel(), high[self.inner()].ravel()
        return Safe.of(self.kind, (np.minimum(low, own), np.maximum(high, own)), n=len(own)), room

    def corrected(self, g: G.Guard, p: str = "p") -> np.ndarray:
        """Safe values next to p for the core."""
        hat = self.values[p][self.inner()]
        return self.safe(g).pick(hat.ravel()).reshape(hat.shape)


# ---- what depends on what --------------------------------------------------------------------------------------


def footprint(area: Area, g: G.Guard, changed: np.ndarray) -> np.ndarray:
    """Elements of the core whose check reads one of the ``changed`` elements (over the whole area)."""
    return _spread(area, g, changed, True)


def inverse_footprint(area: Area, g: G.Guard, failed: np.ndarray) -> np.ndarray:
    """Elements of the core that feed one of the ``failed`` checks (over the whole area)."""
    return _spread(area, g, failed, False)


def _spread(area: Area, g: G.Guard, flags: np.ndarray, forward: bool) -> np.ndarray:
    if isinstance(g, G.Stencil):
        axes = g.neighbourhood
        offsets, constants = qoi.used(g.node)
        offsets = sorted({*offsets, *(o for n, o in constants if n in ("$x", "$X")), (0,) * len(axes)})
        centres = area.centres(axes)
        if forward:
            for a in axes:  # a place beyond the ends holds an element only on a periodic axis
                if a.border != "wrap":
                    k = axis_of(a, area.rank)
                    inside = (area.places(k) >= 0) & (area.places(k) < area.shape[k])
                    flags = flags & inside.reshape([-1 if j == k else 1 for j in range(area.rank)])
            place = Area(area.first, area.core, area.shape, area.reach, area.kind, {"f": flags})
            padded = place.padded("f", [a if a.border != "constant" else G.Axis(a.axis, a.before, a.after, "valid") for a in axes])
            got = np.zeros(centres.shape, bool)
            for o in offsets:
                got |= area.window(padded, axes, o)
            return area._core_of(got & centres)
        out = np.zeros(area.size, bool)
        asked = flags[area.inner(1)] & centres
        for o in offsets:
            out[area.moved(axes, o)] |= asked
        for a in reversed(axes):
            k = axis_of(a, area.rank)
            if a.border in ("edge", "reflect", "symmetric"):
                at, n = area.places(k), area.shape[k]
                for v in np.flatnonzero((at < 0) | (at >= n)).tolist():
                    h = int(source(at[v : v + 1], n, a.border)[0]) - area.first[k] + 2 * area.reach[k]
                    if 0 <= h < len(at):
                        to, of = (tuple(i if j == k else slice(None) for j in range(area.rank)) for i in (h, v))
                        out[to] = out[to] | out[of]
        return out[area.inner()]
    if g.around():
        return np.logical_or.reduce([_spread(area, k, flags, forward) for k in g.guards])  # type: ignore[attr-defined]
    return flags[area.inner()]


def reads(df: DataFrame, axes: Sequence[G.Axis], index: Sequence[str], shape: Sequence[int], offsets: Sequence[Sequence[int]] | None = None) -> DataFrame:
    """A row per (window, position) and the element that it reads: the index columns, ``_offset`` and ``_source`` (places
    on each axis).  Read by ``_source`` it is the reverse neighbourhood; places that a border maps to the same element
    are rows of their own.  Positions that read no element (beyond a 'valid' or 'constant' border) are left out."""
    import itertools

    from tolera.operators.stencil import border

    offsets = offsets if offsets is not None else list(itertools.product(*[range(-a.before, a.after + 1) for a in axes]))
    out = df.select(*index, F.explode(F.array(*[F.array(*[F.lit(int(v)).cast("long") for v in o]) for o in offsets])).alias("_offset"))
    by = {axis_of(a, len(index)): (j, a) for j, a in enumerate(axes)}
    places = []
    for k, name in enumerate(index):
        i = F.col(name).cast("long")
        if k in by:
            j, a = by[k]
            i = border(i + F.col("_offset")[j], F.lit(int(shape[k])).cast("long"), a.border).cast("long")
        places.append(i)
    return out.withColumn("_source", F.array(*places)).where(~F.exists("_source", lambda v: v.isNull()))


# ---- tables of elements ----------------------------------------------------------------------------------------


def sides_for(rank: int, reach: Sequence[int], sizes: Sequence[int] | None, tile: int) -> list[int]:
    """Length of a tile along each axis; at least what lets a tile hold all that its borders mirror."""
    if sizes is not None:
        return [max(int(s), 4 * r + 1) for s, r in zip(sizes, reach, strict=True)]
    side = max(1, round(tile ** (1 / max(1, rank))))
    return [max(side, 4 * r + 1) for r in reach]


def with_shape(df: DataFrame, index: Sequence[str], shape: Sequence[int] | None, by: Sequence[str]) -> DataFrame:
    """df with ``_n0``, ``_n1``, ...: the array's size along each axis, counted (per group of ``by``) if no shape is given."""
    if shape is not None:
        return df.withColumns({f"_n{k}": F.lit(int(n)).cast("long") for k, n in enumerate(shape)})
    size = [(F.max(F.col(c).cast("long")) + 1).alias(f"_n{k}") for k, c in enumerate(index)]
    if by:
        return df.join(df.groupBy(*by).agg(*size), list(by))
    return df.crossJoin(F.broadcast(df.agg(*size)))  # one row


def _pairs(i: Column, n: Column, b: int, r: int, wrap: bool) -> Column:
    """The tiles t of length b along one axis that need element i, and its places g there."""
    if r == 0:
        return F.array(F.struct(F.floor(i / b).cast("long").alias("t"), i.alias("g")))
    last = F.floor((n - 1) / b).cast("long")
    copies = F.array(i)
    if wrap:
        first = F.ceil((F.lit(-2 * r) - i) / n).cast("long")
        final = F.floor((n - 1 + 2 * r - i) / n).cast("long")
        copies = F.transform(F.sequence(first, final), lambda c: i + c * n)

    def tiles(v: Column) -> Column:
        near = F.sequence(F.floor((v - 2 * r) / b).cast("long") - 1, F.floor((v + 2 * r) / b).cast("long") + 1)
        every = F.transform(near, lambda t: F.struct(t.alias("t"), v.alias("g")))
        return F.filter(every, lambda s: (s["t"] >= 0) & (s["t"] <= last) & (s["g"] >= s["t"] * b - 2 * r) & (s["g"] < F.least((s["t"] + 1) * b, n) + 2 * r))

    return F.flatten(F.transform(copies, tiles))


def deal(df: DataFrame, g: G.Guard, index: Sequence[str], sides: Sequence[int]) -> DataFrame:
    """df (from ``with_shape``) with ``_tile`` (its number along each axis) and ``_at`` (place on each axis), arrays of
    longs: a row for each tile that needs the element."""
    rank = len(index)
    reach, wraps = reaches(g, rank), periodic(g, rank)
    for k, name in enumerate(index):
        df = df.withColumn(f"_pair{k}", F.explode(_pairs(F.col(name).cast("long"), F.col(f"_n{k}"), int(sides[k]), reach[k], wraps[k])))
    t, g_ = (F.array(*[F.col(f"_pair{k}")[f] for k in range(rank)]) for f in ("t", "g"))
    return df.withColumn("_tile", t).withColumn("_at", g_).drop(*[f"_pair{k}" for k in range(rank)])


def area_of(table: pa.Table, g: G.Guard, sides: Sequence[int], columns: Mapping[str, str], kind: str) -> tuple[Area, np.ndarray]:
    """The tile that a table of dealt elements is, and each row's place in it."""
    rank = len(sides)
    reach, wraps = tuple(reaches(g, rank)), periodic(g, rank)
    number, shape = table.column("_tile")[0].as_py(), tuple(table.column(f"_n{k}")[0].as_py() for k in range(rank))
    first = tuple(t * s for t, s in zip(number, sides, strict=True))
    area = Area(first, tuple(min(s, n - f) for s, n, f in zip(sides, shape, first, strict=True)), shape, reach, kind)
    at = table.column("_at").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(table), rank)
    at = at - np.array(first) + 2 * np.array(reach)
    if ((at < 0) | (at >= np.array(area.size))).any():
        raise ValueError(f"an element lies outside of {shape}")
    place = np.ravel_multi_index(tuple(at.T), area.size)
    need = 1
    for k in range(rank):
        i = area.places(k)
        need *= len(i) if wraps[k] and reach[k] else int(((i >= 0) & (i < shape[k])).sum())
    if len(np.unique(place)) != len(place) or len(place) != need:
        raise ValueError(f"an element of {shape} is missing or repeated near {first}")
    for a, c in columns.items():
        column = table.column(c)
        if column.null_count:
            raise ValueError(f"{c} is null in {column.null_count} rows")
        data = kinds.from_storage(column, kind if a in ("x", "p", "hat") else "float64")
        area.values[a] = np.zeros(area.size, data.dtype)
        area.values[a].ravel()[place] = data
    return area, place


def over_tiles(
    df: DataFrame, g: G.Guard, index: Sequence[str], shape: Sequence[int] | None, columns: Mapping[str, str], kind: str, run: Callable[[Area], dict[str, Any]], out: Sequence[T.StructField],
    keep: Sequence[str] = (), by: Sequence[str] = (), sides: Sequence[int] | None = None, tile: int = TILE,
) -> DataFrame:
    """``run`` on each tile; a row per element with by, index, ``keep`` and the columns of ``out``.

    columns: name in the area -> column; kind: of x, p and hat (others are doubles).  run gives arrays (numpy or Arrow, flat
    or in the core's shape).  Elements must be 0-based and dense: missing, repeated and null ones are errors."""
    side = sides_for(len(index), reaches(g, len(index)), sides, tile)
    kept = list(dict.fromkeys([*by, *index, *keep]))
    names = list(dict.fromkeys([*kept, *columns.values()]))
    dealt = deal(with_shape(df.select(*names), index, shape, by), g, index, side)
    full = T.StructType([*df.select(*kept).schema.fields, *out])
    types = [to_arrow_type(f.dataType) for f in out]

    def work(table: pa.Table) -> pa.Table:
        area, place = area_of(table, g, side, columns, kind)
        order = np.full(area.size, -1, np.int64)
        order[area.inner()] = np.arange(int(np.prod(area.core))).reshape(area.core)
        pick = order.ravel()[place]
        own = table.filter(pa.array(pick >= 0)).select(kept)
        at = pa.array(pick[pick >= 0])
        got = run(area)
        for f, t in zip(out, types, strict=True):
            value = got[f.name]
            value = pa.array(np.ascontiguousarray(value).ravel(), t) if isinstance(value, np.ndarray) else value.cast(t)
            own = own.append_column(f.name, value.take(at))
        return own

    return dealt.groupBy(*by, "_tile").applyInArrow(work, full)
