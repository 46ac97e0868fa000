"""Interval arithmetic behind the interface of ``ieee``: what a quantity can be while its inputs stay in boxes.

A box is a pair of arrays (lo, hi).  Results are rounded outward: what IEEE rounds correctly by one step to the side that
its rounding error lies on (exact results stay), library functions by ``SLACK`` steps to both sides, so that an enclosure
also holds for another library's logarithm.  NaN ends mean that
nothing is known.  Truth values are pairs (sure, possible).  Every operation is monotone under inclusion: a smaller box
has a smaller enclosure, which is what lets ``inverse`` search for the largest box.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

import numpy as np

SLACK = 4
#: Beyond this, arguments of periodic functions are too coarse to be reduced.
FAR = 2.0**40


class Box(NamedTuple):
    lo: np.ndarray
    hi: np.ndarray


class Truth(NamedTuple):
    sure: np.ndarray
    possible: np.ndarray


def out(lo: np.ndarray, hi: np.ndarray, steps: int) -> Box:
    for _ in range(steps):
        lo, hi = np.nextafter(lo, -np.inf), np.nextafter(hi, np.inf)
    return Box(lo, hi)


def _known(lo: np.ndarray, hi: np.ndarray) -> Box:
    """NaN in one end makes both unknown."""
    bad = np.isnan(lo) | np.isnan(hi)
    return Box(np.where(bad, np.nan, lo), np.where(bad, np.nan, hi))


def _toward(value: np.ndarray, error: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ends around a rounded value, from its error (exact less rounded); both are moved if the error isn't known."""
    unsure = ~np.isfinite(error) | (np.abs(value) < 1e-280) & (value != 0)
    return np.where(unsure | (error < 0), np.nextafter(value, -np.inf), value), np.where(unsure | (error > 0), np.nextafter(value, np.inf), value)


def _sum(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    s = a + b
    c = s - a
    return _toward(s, (a - (s - c)) + (b - c))


def _rest(a: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """a - x * y, where that is small: the product is split into halves whose products are exact."""
    half = lambda v: (h := v * 134217729.0, h - (h - v))[1]
    p, xh, yh = x * y, half(x), half(y)
    xl, yl = x - xh, y - yh
    return (a - p) - (((xh * yh - p) + xh * yl + xl * yh) + xl * yl)


def _product(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    p = a * b
    zero = (p == 0) & ((a == 0) | (b == 0))
    lo, hi = _toward(p, -_rest(p, a, b))
    lo, hi = np.where(p == 0, np.nextafter(p, -np.inf), lo), np.where(p == 0, np.nextafter(p, np.inf), hi)
    return np.where(zero, p, lo), np.where(zero, p, hi)


def _quotient(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    q = a / b
    lo, hi = _toward(q, _rest(a, q, b) * np.sign(b))
    lo, hi = np.where(q == 0, np.nextafter(q, -np.inf), lo), np.where(q == 0, np.nextafter(q, np.inf), hi)
    zero = (a == 0) & (b != 0)
    return np.where(zero, q, lo), np.where(zero, q, hi)


def _corners(f, a: Box, b: Box) -> Box:  # noqa: ANN001
    """Of a function that gives both ends of its value."""
    four = [f(x, y) for x in a for y in b]
    bad = reduce(np.logical_or, [np.isnan(v[0]) | np.isnan(v[1]) for v in four])
    lo, hi = reduce(np.minimum, [v[0] for v in four]), reduce(np.maximum, [v[1] for v in four])
    return Box(np.where(bad, np.nan, lo), np.where(bad, np.nan, hi))


def _holds(lo: np.ndarray, hi: np.ndarray, first: float, period: float) -> np.ndarray:
    """Whether lo..hi may hold a point first + k * period."""
    give = 1e-12 * (1 + np.maximum(np.abs(lo), np.abs(hi)))
    return np.floor((hi + give - first) / period) != np.floor((lo - give - first) / period)


class BoxOps:
    def lit(self, v: float) -> Box:
        return Box(np.float64(v), np.float64(v))

    def narrow(self, a: Box) -> Box:
        """Rounding to 32 bits keeps order, so it takes ends to ends."""
        with np.errstate(all="ignore"):
            return Box(*[np.asarray(v, np.float64).astype(np.float32).astype(np.float64) for v in a])

    def where(self, c: Truth, a, b):  # noqa: ANN001, ANN201
        pick = lambda x, y, f: np.where(c.sure, x, np.where(c.possible, f(x, y), y))
        if isinstance(a, Truth):
            return Truth(pick(a.sure, b.sure, np.logical_and), pick(a.possible, b.possible, np.logical_or))
        return Box(pick(a.lo, b.lo, np.minimum), pick(a.hi, b.hi, np.maximum))

    def number(self, c: Truth) -> Box:
        return Box(np.where(c.sure, 1.0, 0.0), np.where(c.possible, 1.0, 0.0))

    def both(self, *c: Truth) -> Truth:
        return Truth(reduce(np.logical_and, [x.sure for x in c]), reduce(np.logical_and, [x.possible for x in c]))

    def either(self, *c: Truth) -> Truth:
        return Truth(reduce(np.logical_or, [x.sure for x in c]), reduce(np.logical_or, [x.possible for x in c]))

    def no(self, c: Truth) -> Truth:
        return Truth(~c.possible, ~c.sure)

    def isnan(self, a: Box) -> Truth:
        """A NaN end means unknown; else there is none."""
        unknown = np.isnan(a.lo)
        return Truth(np.zeros_like(unknown), unknown)

    def isinf(self, a: Box) -> Truth:
        ends = np.isinf(a.lo) | np.isinf(a.hi) | np.isnan(a.lo)
        return Truth((a.lo == a.hi) & np.isinf(a.lo), ends)

    def isfinite(self, a: Box) -> Truth:
        return Truth(np.isfinite(a.lo) & np.isfinite(a.hi), ~((a.lo == a.hi) & np.isinf(a.lo)))

    def eq(self, a: Box, b: Box) -> Truth:
        unknown = np.isnan(a.lo) | np.isnan(b.lo)
        return Truth((a.lo == a.hi) & (b.lo == b.hi) & (a.lo == b.lo), unknown | ((a.lo <= b.hi) & (b.lo <= a.hi)))

    def lt(self, a: Box, b: Box) -> Truth:
        return Truth(a.hi < b.lo, np.isnan(a.lo) | np.isnan(b.lo) | (a.lo < b.hi))

    def le(self, a: Box, b: Box) -> Truth:
        return Truth(a.hi <= b.lo, np.isnan(a.lo) | np.isnan(b.lo) | (a.lo <= b.hi))

    # ---- arithmetic

    def add(self, a: Box, b: Box) -> Box:
        return _known(_sum(a.lo, b.lo)[0], _sum(a.hi, b.hi)[1])

    def sub(self, a: Box, b: Box) -> Box:
        return self.add(a, self.neg(b))

    def neg(self, a: Box) -> Box:
        return Box(-a.hi, -a.lo)

    def mul(self, a: Box, b: Box) -> Box:
        if a is b:
            x, y = _product(a.lo, a.lo), _product(a.hi, a.hi)
            inside = (a.lo <= 0) & (a.hi >= 0)
            return _known(np.where(inside, 0.0, np.minimum(x[0], y[0])), np.maximum(x[1], y[1]))
        return _corners(_product, a, b)

    def div(self, a: Box, b: Box) -> Box:
        through = (b.lo <= 0) & (b.hi >= 0) & ~((b.lo == b.hi) & (a.lo == a.hi))  # a point over zero is what IEEE says
        found = _corners(_quotient, a, b)
        return Box(np.where(through, np.nan, found.lo), np.where(through, np.nan, found.hi))

    def _even(self, a: Box, f, steps: int) -> Box:  # noqa: ANN001
        """A function that falls up to zero and rises from there."""
        x, y = f(a.lo), f(a.hi)
        inside = (a.lo < 0) & (a.hi > 0)
        bottom = f(np.zeros_like(a.lo))
        lo, hi = out(np.where(inside, bottom, np.minimum(x, y)), np.maximum(x, y), steps)
        return Box(np.maximum(lo, bottom), hi)

    def power(self, a: Box, b: Box) -> Box:
        point = b.lo == b.hi
        whole = point & (b.lo == np.rint(b.lo))
        even = whole & (np.mod(b.lo, 2) == 0)
        crosses = (a.lo < 0) & (a.hi > 0)
        plain = _corners(lambda x, y: (v := np.power(x, y), v), a, b)
        lo = np.where(even & crosses & (b.lo > 0), 0.0, plain.lo)
        bad = (crosses & whole & (b.lo < 0)) | ((a.lo < 0) & ~whole)
        return out(np.where(bad, np.nan, lo), np.where(bad, np.nan, plain.hi), SLACK)

    def abs(self, a: Box) -> Box:
        return self._even(a, np.abs, 0)

    def sqrt(self, a: Box) -> Box:
        ends = [_toward(r, _rest(v, r, r)) for v in a for r in (np.sqrt(v),)]
        return _known(np.where(a.lo == 0, 0.0, ends[0][0]), np.where(a.hi == 0, 0.0, ends[1][1]))

    def _step(self, f, a: Box) -> Box:  # noqa: ANN001
        return _known(f(a.lo), f(a.hi))

    def rint(self, a: Box) -> Box:
        return self._step(np.rint, a)

    def floor(self, a: Box) -> Box:
        return self._step(np.floor, a)

    def ceil(self, a: Box) -> Box:
        return self._step(np.ceil, a)

    def sign(self, a: Box) -> Box:
        return self._step(np.sign, a)

    def _rising(self, f, a: Box) -> Box:  # noqa: ANN001
        return out(*_known(f(a.lo), f(a.hi)), SLACK)

    def acos(self, a: Box) -> Box:
        return out(*_known(np.arccos(a.hi), np.arccos(a.lo)), SLACK)

    def cosh(self, a: Box) -> Box:
        return self._even(a, np.cosh, SLACK)

    def _wave(self, f, a: Box, top: float) -> Box:  # noqa: ANN001
        """top: a point of the largest value; the least is half a period away."""
        x, y = f(a.lo), f(a.hi)
        far = (a.hi - a.lo >= 6.3) | (np.maximum(np.abs(a.lo), np.abs(a.hi)) > FAR)
        lo, hi = out(*_known(np.minimum(x, y), np.maximum(x, y)), SLACK)
        hi = np.where(far | _holds(a.lo, a.hi, top, 2 * np.pi), 1.0, np.minimum(hi, 1.0))
        lo = np.where(far | _holds(a.lo, a.hi, top + np.pi, 2 * np.pi), -1.0, np.maximum(lo, -1.0))
        unknown = ~np.isfinite(a.lo) | ~np.isfinite(a.hi)
        return Box(np.where(unknown, np.nan, lo), np.where(unknown, np.nan, hi))

    def sin(self, a: Box) -> Box:
        return self._wave(np.sin, a, np.pi / 2)

    def cos(self, a: Box) -> Box:
        return self._wave(np.cos, a, 0.0)

    def tan(self, a: Box) -> Box:
        broken = (a.hi - a.lo >= 3.1) | (np.maximum(np.abs(a.lo), np.abs(a.hi)) > FAR) | _holds(a.lo, a.hi, np.pi / 2, np.pi)
        lo, hi = self._rising(np.tan, a)
        return Box(np.where(broken, np.nan, lo), np.where(broken, np.nan, hi))

    def exp10(self, a: Box) -> Box:
        return self._rising(lambda v: np.power(10.0, v), a)

    def __getattr__(self, name: str):  # noqa: ANN204
        if name not in _RISING:
            raise AttributeError(name)
        f = _RISING[name]
        return lambda a: self._rising(f, a)


_RISING = {
    "ln": np.log, "log2": np.log2, "log10": np.log10, "exp": np.exp, "exp2": np.exp2, "sinh": np.sinh, "tanh": np.tanh, "asin": np.arcsin, "atan": np.arctan,
    "asinh": np.arcsinh, "acosh": np.arccosh, "atanh": np.arctanh,
}
BOX = BoxOps()
