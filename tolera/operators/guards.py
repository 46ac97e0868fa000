"""Guards: requirements that an approximation ``p`` of ``x`` must meet, element by element.

``ok`` is written once over the operations of ``functions.ieee``: with SPARK it is a column that Catalyst optimises, with
NUMPY it is what corrections are verified with.  ``env`` resolves late-bound names to values of the same kind.  ``safe`` is
the set of all values that an element may take (``sets.Safe``), from which corrections are chosen.  Own guards subclass
``Guard`` and are made known to configurations by ``register``.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import cached_property
from typing import Any

import numpy as np

from tolera.functions import kinds
from tolera.functions.ieee import NUMPY, Narrowed
from tolera.operators.sets import Safe
from tolera.plans import qoi

MAX = 1.7976931348623157e308
KINDS = ("abs", "rel", "ratio")
Env = Callable[[str, tuple[int, ...]], Any]


class GuardError(ValueError):
    """A guard that isn't valid; the message starts with the path of the parameter."""


def bound(value: Any, ops: Any, env: Env, at: tuple[int, ...] = ()) -> Any:
    return env(value, at) if isinstance(value, str) else ops.lit(value)


def error_bound(kind: str, value: Any, path: str, ops: Any, env: Env, at: tuple[int, ...] = ()) -> Any:
    """A bound as a value; a late-bound one that is not valid is an error of the query."""
    eb = bound(value, ops, env, at)
    if not isinstance(value, str):
        return eb
    valid = ops.both(ops.isfinite(eb), ops.le(ops.lit(1 if kind == "ratio" else 0), eb))
    return ops.fail(ops.no(valid), f"{path}.eb: {value} holds a value that is no bound for {kind}", eb)


def check_bound(kind: str, eb: Any, path: str) -> None:
    if kind not in KINDS:
        raise GuardError(f"{path}.type: unknown type {kind!r}")
    if not isinstance(eb, str) and not (math.isfinite(eb) and eb >= (1 if kind == "ratio" else 0)):
        raise GuardError(f"{path}.eb: {eb!r} is not a finite bound for {kind}")


def within(kind: str, ops: Any, x: Any, p: Any, eb: Any) -> Any:
    """Whether finite x and p differ by no more than the bound."""
    zero = ops.lit(0)
    if kind == "ratio":
        less = ops.lt(ops.abs(p), ops.abs(x))
        ratio = ops.where(less, ops.div(x, p), ops.div(p, x))
        both_zero = ops.both(ops.eq(x, zero), ops.eq(p, zero))
        signs = ops.eq(ops.sign(x), ops.sign(p))
        return ops.either(both_zero, ops.both(signs, ops.le(ratio, eb)))
    if kind == "rel":
        size = ops.mul(ops.abs(x), eb)
        size = ops.where(ops.isnan(size), zero, size)
        eb = ops.where(ops.lt(ops.lit(MAX), size), ops.lit(MAX), size)
    return ops.le(ops.abs(ops.sub(x, p)), eb)


def same_bits(ops: Any, x: Any, v: Any) -> Any:
    """Equal in all bits: the sign of zero counts, and so do the sign and the payload of NaN."""
    zero = ops.negative_zero
    sign = ops.either(ops.both(zero(x), zero(v)), ops.both(ops.no(zero(x)), ops.no(zero(v))))
    return ops.where(ops.both(ops.isnan(x), ops.isnan(v)), ops.equal_bits(x, v), ops.both(ops.eq(x, v), sign))


Late = Callable[[str], Any]


def of_late(value: Any, late: Late, n: int) -> np.ndarray:
    """A parameter as one number per element."""
    return np.broadcast_to(np.asarray(late(value) if isinstance(value, str) else value), n)


def near_key(o: np.ndarray, kind: str, up: bool, strict: bool) -> np.ndarray:
    """Key of the least number of ``kind`` above o (``up``), or the largest below; o itself counts unless ``strict``.

    One beyond the range if there is none.  Numbers are compared as values, so both zeros count as equal."""
    o = np.asarray(o)
    wide = o.astype(np.longdouble)
    low, high = kinds.key_range(kind) if np.dtype(kind).kind != "f" else tuple(int(kinds.key_of(np.array([s * np.inf], kind))[0]) for s in (-1, 1))
    with np.errstate(all="ignore"):
        at = kinds.key_of(kinds.from_wide(wide, kind))
    sign = 1 if up else -1
    value = lambda k: kinds.value_of(np.clip(k, low, high), kind).astype(np.longdouble)
    fits = (lambda v: v > wide if strict else v >= wide) if up else (lambda v: v < wide if strict else v <= wide)
    at = np.clip(at.astype(np.longdouble) - 3 * sign, low, high).astype(np.int64)
    for _ in range(6):  # the rounded value is next to o, and the zeros are two keys
        at = np.where(fits(value(at)) | (at == (high if up else low)), at, at + sign)
    none = ~fits(value(at))
    return np.where(none, 0, at), none


def between(x: np.ndarray, lo: tuple[np.ndarray, np.ndarray], hi: tuple[np.ndarray, np.ndarray]) -> Safe:
    """lo..hi as keys from ``near_key``; empty where an end doesn't exist."""
    none = lo[1] | hi[1]
    return Safe.of(x.dtype.name, (np.where(none, 1, lo[0]), np.where(none, 0, hi[0])), n=len(x))


def error_bound_set(kind: str, x: np.ndarray, eb: np.ndarray, equal_nan: bool) -> Safe:
    """All p within the bound of x, for finite x; its own bits for infinite x, and for NaN unless all NaNs are equal."""
    name, n = x.dtype.name, len(x)
    exact = Safe.exact(x)
    finite = np.isfinite(x) if x.dtype.kind == "f" else np.ones(n, bool)
    w = kinds.wide(np.where(finite, x, 0).astype(x.dtype))
    with np.errstate(all="ignore"):
        eb = eb.astype(w.dtype)
        if kind == "ratio":
            size = np.abs(w)
            lo, hi = np.where(w >= 0, size / eb, -size * eb), np.where(w >= 0, size * eb, -size / eb)
        else:
            by = eb if kind == "abs" else np.minimum(np.nan_to_num(np.abs(w) * eb, nan=0.0), np.asarray(MAX, w.dtype))
            lo, hi = w - by, w + by
        least, most = (kinds.value_of(np.int64(k), name).astype(w.dtype) for k in kinds.finite_range(name))
        ends = []
        for end, up in ((lo, True), (hi, False)):
            at, _ = near_key(np.clip(np.where(np.isnan(end), w, end), least, most), name, up, False)
            own = kinds.key_of(x)
            for _ in range(8):  # rounding may have gone beyond what the check allows
                ok = within(kind, NUMPY, w, kinds.wide(kinds.value_of(at, name)), eb)
                at = np.where(ok, at, at + np.sign(own - at))
            ends.append(np.where(within(kind, NUMPY, w, kinds.wide(kinds.value_of(at, name)), eb), at, own))
    out = Safe.of(name, tuple(ends), n=n).where(finite, exact)
    nan = np.isnan(x) if x.dtype.kind == "f" else np.zeros(n, bool)
    return Safe.nans(name, n).where(nan, out) if equal_nan else out


def sides(x: np.ndarray, o: np.ndarray) -> Safe:
    """All p on x's side of o; p equal to o where x is."""
    name = x.dtype.name
    low, high = np.float64(-np.inf), np.float64(np.inf)
    every = lambda v: near_key(np.full(len(x), v), name, v < 0, False)
    w, o_ = x.astype(np.longdouble), np.asarray(o).astype(np.longdouble)
    below = between(x, every(low), near_key(o, name, False, True))
    above = between(x, near_key(o, name, True, True), every(high))
    at = between(x, near_key(o, name, True, False), near_key(o, name, False, False))
    return below.where(w < o_, above.where(w > o_, at))


class Guard:
    kind = ""

    def ok(self, ops: Any, x: Any, p: Any, env: Env) -> Any:
        raise NotImplementedError

    def safe(self, x: np.ndarray, late: Late) -> Safe:
        """The values that each element may take, whatever its neighbours do; x itself always may."""
        raise NotImplementedError

    def late(self) -> set[str]:
        """Names that must be bound."""
        return set()

    def around(self) -> tuple[tuple[int, int], ...]:
        """(before, after) per axis; () for a pointwise guard."""
        return ()

    def config(self) -> dict:
        raise NotImplementedError

    def __and__(self, other: Guard) -> Guard:
        return All([self, other])

    def __or__(self, other: Guard) -> Guard:
        return Any_([self, other])


@dataclass
class ErrorBound(Guard):
    type: str
    eb: Any
    equal_nan: bool = False
    kind = "eb"

    def __post_init__(self) -> None:
        check_bound(self.type, self.eb, self.kind)

    def ok(self, ops: Any, x: Any, p: Any, env: Env) -> Any:
        fine = ops.both(ops.isfinite(p), within(self.type, ops, x, p, error_bound(self.type, self.eb, self.kind, ops, env)))
        other = same_bits(ops, x, p)
        if self.equal_nan:
            other = ops.where(ops.isnan(x), ops.isnan(p), other)
        return ops.where(ops.isfinite(x), fine, other)

    def safe(self, x: np.ndarray, late: Late) -> Safe:
        return error_bound_set(self.type, x, of_late(self.eb, late, len(x)), self.equal_nan)

    def late(self) -> set[str]:
        return {self.eb} if isinstance(self.eb, str) else set()

    def config(self) -> dict:
        return {"kind": self.kind, "type": self.type, "eb": self.eb, "equal_nan": self.equal_nan}


@dataclass
class Same(Guard):
    value: Any
    exclusive: bool = False
    kind = "same"

    def ok(self, ops: Any, x: Any, p: Any, env: Env) -> Any:
        v = bound(self.value, ops, env)
        a, b = same_bits(ops, x, v), same_bits(ops, p, v)
        keeps = ops.either(ops.no(a), b)
        return ops.both(keeps, ops.either(a, ops.no(b))) if self.exclusive else keeps

    def safe(self, x: np.ndarray, late: Late) -> Safe:
        name, n = x.dtype.name, len(x)
        v = of_late(self.value, late, n)
        with np.errstate(all="ignore"):
            own = v.astype(name)
            same = own.astype(np.longdouble) == v.astype(np.longdouble)
        known = same | ((v != v) & (own != own))  # else no number of this type is the value
        key, least, most = kinds.key_of(own), *kinds.key_range(name)
        is_v = known & (kinds.key_of(x) == key)
        rest = Safe.full(name, n)
        if self.exclusive:
            pieces = Safe.of(name, (np.where(key > least, least, 1), np.where(key > least, key - (key > least), 0)), (np.where(key < most, key + (key < most), 1), np.where(key < most, most, 0)), n=n)
            rest = pieces.where(known, rest)
        return Safe.of(name, (key, key), n=n).where(is_v, rest)

    def late(self) -> set[str]:
        return {self.value} if isinstance(self.value, str) else set()

    def config(self) -> dict:
        return {"kind": self.kind, "value": self.value, "exclusive": self.exclusive}


@dataclass
class Sign(Guard):
    offset: Any = 0
    kind = "sign"

    def __post_init__(self) -> None:
        if not isinstance(self.offset, str) and self.offset != self.offset:
            raise GuardError("sign.offset: can't be NaN")

    def ok(self, ops: Any, x: Any, p: Any, env: Env) -> Any:
        o = bound(self.offset, ops, env)
        if isinstance(self.offset, str):
            o = ops.fail(ops.isnan(o), f"sign.offset: {self.offset} holds NaN", o)
        return ops.where(
            ops.isnan(x),
            ops.where(ops.isnan(p), self._same_sign(ops, x, p), ops.isnan(p)),
            ops.where(ops.lt(x, o), ops.lt(p, o), ops.where(ops.lt(o, x), ops.lt(o, p), ops.eq(p, o))),
        )

    @staticmethod
    def _same_sign(ops: Any, x: Any, p: Any) -> Any:
        a, b = ops.negative(x), ops.negative(p)
        return ops.either(ops.both(a, b), ops.both(ops.no(a), ops.no(b)))

    def safe(self, x: np.ndarray, late: Late) -> Safe:
        name, n = x.dtype.name, len(x)
        nan = np.isnan(x) if x.dtype.kind == "f" else np.zeros(n, bool)
        out = sides(np.where(nan, 0, x).astype(name), of_late(self.offset, late, n))
        if not nan.any():
            return out
        minus = np.signbit(x)
        return Safe.nans(name, n, True, False).where(nan & minus, Safe.nans(name, n, False, True).where(nan, out))

    def late(self) -> set[str]:
        return {self.offset} if isinstance(self.offset, str) else set()

    def config(self) -> dict:
        return {"kind": self.kind, "offset": self.offset}


def check_dtype(name: str, path: str) -> None:
    if name not in ("lossless", "float64", "float32"):
        raise GuardError(f"{path}.qoi_dtype: quantities are computed in 'float64' (also called 'lossless') or 'float32', not in {name!r}")


def in_dtype(ops: Any, name: str) -> Any:
    """The operations that a quantity is computed with."""
    return Narrowed(ops) if name == "float32" else ops


def box_set(x: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> Safe:
    """The numbers of x's type within lo..hi; x itself always, and of a point only that (a zero keeps its sign)."""
    own = kinds.key_of(x)
    with np.errstate(all="ignore"):
        finite = (lo < hi) & np.isfinite(lo) & np.isfinite(hi) & (np.isfinite(x) if x.dtype.kind == "f" else True)
        low, _ = near_key(np.where(finite, lo, 0), x.dtype.name, True, False)
        high, _ = near_key(np.where(finite, hi, 0), x.dtype.name, False, False)
    return Safe.of(x.dtype.name, (np.where(finite, np.minimum(low, own), own), np.where(finite, np.maximum(high, own), own)), n=len(x))


def qoi_ok(kind: str, ops: Any, x: Any, p: Any, eb: Any) -> Any:
    """Quantities: infinite ones stay equal, NaN ones stay NaN, finite ones keep the bound."""
    fine = ops.both(ops.isfinite(p), within(kind, ops, x, p, eb))
    return ops.where(ops.isnan(x), ops.isnan(p), ops.where(ops.isinf(x), ops.eq(x, p), fine))


@dataclass
class Quantity(Guard):
    """Error bound on a pointwise quantity of interest."""

    qoi: str
    type: str
    eb: Any
    qoi_dtype: str = "lossless"
    kind = "qoi_eb_pw"

    def __post_init__(self) -> None:
        check_bound(self.type, self.eb, self.kind)
        check_dtype(self.qoi_dtype, self.kind)
        self.node  # noqa: B018

    @cached_property
    def node(self) -> qoi.Node:
        return qoi.parse(self.qoi)

    def value(self, ops: Any, x: Any, env: Env) -> Any:
        own = in_dtype(ops, self.qoi_dtype)
        read = ops.narrow if own is not ops else lambda v: v
        return qoi.evaluate(self.node, own, lambda at: read(x), lambda name, at: read(x if name == "$x" else env(name, at)))

    def ok(self, ops: Any, x: Any, p: Any, env: Env) -> Any:
        own = lambda name, at: x if name == "$x" else env(name, at)
        return qoi_ok(self.type, ops, self.value(ops, x, own), self.value(ops, p, own), error_bound(self.type, self.eb, self.kind, ops, own))

    def safe(self, x: np.ndarray, late: Late) -> Safe:
        from tolera.operators.inverse import quantity_boxes

        env = lambda name, at: of_late(name, late, len(x))
        eb = of_late(self.eb, late, len(x))
        found = quantity_boxes(self.node, self.type, eb, lambda at: kinds.wide(x), env, np.ones(len(x), bool), self.qoi_dtype)
        return box_set(x, *found[()])

    def late(self) -> set[str]:
        return {n for n, _ in qoi.used(self.node)[1]} | ({self.eb} if isinstance(self.eb, str) else set())

    def config(self) -> dict:
        return {"kind": self.kind, "qoi": self.qoi, "type": self.type, "eb": self.eb, "qoi_dtype": self.qoi_dtype}


@dataclass(frozen=True)
class Axis:
    """One axis of a neighbourhood."""

    axis: int
    before: int
    after: int
    border: str = "valid"
    constant: Any = None

    def __post_init__(self) -> None:
        if isinstance(self.constant, str) and self.constant in ("$x", "$X"):
            raise GuardError("neighbourhood.constant: can't be the data itself")
        if self.border not in ("valid", "constant", "edge", "reflect", "symmetric", "wrap"):
            raise GuardError(f"neighbourhood.border: unknown border {self.border!r}")
        if (self.border == "constant") != (self.constant is not None):
            raise GuardError("neighbourhood.constant: goes with the border 'constant', and only with it")
        if self.before < 0 or self.after < 0:
            raise GuardError("neighbourhood: before and after can't be negative")


@dataclass
class Stencil(Guard):
    """Error bound on a quantity over a neighbourhood; x, p and env are read at offsets."""

    qoi: str
    neighbourhood: Sequence[Axis]
    type: str
    eb: Any
    qoi_dtype: str = "lossless"
    kind = "qoi_eb_stencil"

    def __post_init__(self) -> None:
        check_bound(self.type, self.eb, self.kind)
        check_dtype(self.qoi_dtype, self.kind)
        if not self.neighbourhood or len({a.axis for a in self.neighbourhood}) != len(self.neighbourhood):
            raise GuardError("qoi_eb_stencil.neighbourhood: one entry per axis, at least one")
        self.node  # noqa: B018

    @cached_property
    def node(self) -> qoi.Node:
        return qoi.parse(self.qoi, [(a.before, a.after) for a in self.neighbourhood])

    def value(self, ops: Any, x: Callable[[tuple[int, ...]], Any], env: Env) -> Any:
        """The quantity of windows that ``x`` and ``env`` read."""
        own = in_dtype(ops, self.qoi_dtype)
        read = ops.narrow if own is not ops else lambda v: v
        return qoi.evaluate(self.node, own, lambda at: read(x(at)), lambda name, at: read(env(name, at)))

    def ok(self, ops: Any, x: Any, p: Any, env: Env) -> Any:
        own = lambda name, at: x(at) if name in ("$x", "$X") else env(name, at)
        centre = (0,) * len(self.neighbourhood)
        values = [self.value(ops, d, own) for d in (x, p)]
        return qoi_ok(self.type, ops, *values, error_bound(self.type, self.eb, self.kind, ops, own, centre))

    def late(self) -> set[str]:
        constants = {a.constant for a in self.neighbourhood if isinstance(a.constant, str)}
        return {n for n, _ in qoi.used(self.node)[1]} | ({self.eb} if isinstance(self.eb, str) else set()) | constants

    def around(self) -> tuple[tuple[int, int], ...]:
        return tuple((a.before, a.after) for a in self.neighbourhood)

    def config(self) -> dict:
        return {"kind": self.kind, "qoi": self.qoi, "neighbourhood": [a.__dict__ for a in self.neighbourhood], "type": self.type, "eb": self.eb, "qoi_dtype": self.qoi_dtype}


@dataclass
class _Many(Guard):
    guards: Sequence[Guard] = field(default_factory=list)

    def __post_init__(self) -> None:
        if not self.guards:
            raise GuardError(f"{self.kind}.guards: at least one is needed")

    def late(self) -> set[str]:
        return set().union(*(g.late() for g in self.guards))

    def around(self) -> tuple[tuple[int, int], ...]:
        found = [g.around() for g in self.guards if g.around()]
        return tuple((max(b for b, _ in a), max(c for _, c in a)) for a in zip(*found, strict=True)) if found else ()

    def config(self) -> dict:
        return {"kind": self.kind, "guards": [g.config() for g in self.guards]}


class All(_Many):
    kind = "all"

    def ok(self, ops: Any, x: Any, p: Any, env: Env) -> Any:
        return ops.both(*[g.ok(ops, x, p, env) for g in self.guards])

    def safe(self, x: np.ndarray, late: Late) -> Safe:
        out = self.guards[0].safe(x, late)
        for g in self.guards[1:]:
            out = out.intersect(g.safe(x, late))
        return out


class Any_(_Many):  # noqa: N801
    kind = "any"

    def ok(self, ops: Any, x: Any, p: Any, env: Env) -> Any:
        return ops.either(*[g.ok(ops, x, p, env) for g in self.guards])

    def safe(self, x: np.ndarray, late: Late) -> Safe:
        out = self.guards[0].safe(x, late)
        for g in self.guards[1:]:
            out = out.union(g.safe(x, late))
        return out


@dataclass
class Select(Guard):
    """The guard that the selector names, per element; a selector that names none is an error of the query."""

    selector: Any
    guards: Sequence[Guard]
    kind = "select"

    def __post_init__(self) -> None:
        if not self.guards:
            raise GuardError("select.guards: at least one is needed")
        if not isinstance(self.selector, str) and self.selector not in range(len(self.guards)):
            raise GuardError(f"select.selector: {self.selector!r} names none of {len(self.guards)} guards")

    def choice(self, ops: Any, env: Env, at: tuple[int, ...] = ()) -> Any:
        """The selector, checked."""
        sel = bound(self.selector, ops, env, at)
        if not isinstance(self.selector, str):
            return sel
        named = ops.either(*[ops.eq(sel, ops.lit(i)) for i in range(len(self.guards))])
        return ops.fail(ops.no(named), f"select.selector: {self.selector} holds a value that names none of {len(self.guards)} guards", sel)

    def safe(self, x: np.ndarray, late: Late) -> Safe:
        sel = np.broadcast_to(self.choice(NUMPY, lambda name, _: late(name)), len(x))
        out = self.guards[-1].safe(x, late)
        for i, g in enumerate(self.guards[:-1]):
            out = g.safe(x, late).where(sel == i, out)
        return out

    def ok(self, ops: Any, x: Any, p: Any, env: Env) -> Any:
        sel = self.choice(ops, env)
        out = ops.lt(ops.lit(1), ops.lit(0))
        for i, g in reversed(list(enumerate(self.guards))):
            out = ops.where(ops.eq(sel, ops.lit(i)), g.ok(ops, x, p, env), out)
        return out

    def late(self) -> set[str]:
        return set().union(*(g.late() for g in self.guards)) | ({self.selector} if isinstance(self.selector, str) else set())

    def around(self) -> tuple[tuple[int, int], ...]:
        return All(self.guards).around()

    def config(self) -> dict:
        return {"kind": self.kind, "selector": self.selector, "guards": [g.config() for g in self.guards]}


class AssumeSafe(Guard):
    kind = "assume_safe"

    def ok(self, ops: Any, x: Any, p: Any, env: Env) -> Any:
        return ops.le(ops.lit(0), ops.lit(1))

    def safe(self, x: np.ndarray, late: Late) -> Safe:
        return Safe.full(x.dtype.name, len(x))

    def config(self) -> dict:
        return {"kind": self.kind}


_KINDS: dict[str, Callable[..., Guard]] = {g.kind: g for g in (ErrorBound, Same, Sign, Quantity, Stencil, All, Any_, Select, AssumeSafe)}


def register(guard: type[Guard]) -> type[Guard]:
    """Makes a guard of one's own known to ``from_config`` by its ``kind``; use as a decorator."""
    if not guard.kind or guard.kind in _KINDS and _KINDS[guard.kind] is not guard:
        raise GuardError(f"kind: {guard.kind!r} is taken")
    _KINDS[guard.kind] = guard
    return guard


def from_config(c: dict | str, path: str = "guard") -> Guard:
    """A guard from its configuration; errors name the path of the parameter."""
    c = dict(json.loads(c) if isinstance(c, str) else c)
    kind = c.pop("kind", None)
    if kind not in _KINDS:
        raise GuardError(f"{path}.kind: unknown guard {kind!r}")
    if "guards" in c:
        c["guards"] = [from_config(g, f"{path}.guards[{i}]") for i, g in enumerate(c["guards"])]
    if "neighbourhood" in c:
        c["neighbourhood"] = [Axis(**a) for a in c["neighbourhood"]]
    try:
        return _KINDS[kind](**c)
    except TypeError as e:
        raise GuardError(f"{path}: {e}") from None
    except ValueError as e:
        raise GuardError(f"{path}: {e}") from e
