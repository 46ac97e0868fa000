"""Inverse bounds: how far a quantity's inputs may move while the quantity stays within its bounds.

The rules for each kind of node are those of interval arithmetic (``functions.enclosure``), read backwards by search:
boxes around the data are halved or grown on the scale of doubles until their enclosure just fits.  A box that fits
proves that every combination of values in it keeps the bound, so boxes of several windows may be intersected.  The
data's own box is a single point, which always fits, since the quantity is then what it was.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from typing import Any

import numpy as np

from tolera.functions.enclosure import BOX, Box
from tolera.functions.ieee import NUMPY
from tolera.operators import guards as G
from tolera.plans import qoi

#: Bits of a box's size that are searched for: its exponent and a few of its digits.
BITS = 26
_ONE = np.int64(1)


def bounds_of(kind: str, value: np.ndarray, eb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and the largest quantity within the bound of finite ``value``, as the check itself computes it."""
    with np.errstate(all="ignore"):
        value, eb = np.asarray(value, np.float64), np.broadcast_to(np.asarray(eb, np.float64), np.shape(value))
        if kind == "ratio":
            size = np.abs(value)
            lo = np.where(value >= 0, size / eb, -size * eb)
            hi = np.where(value >= 0, size * eb, -size / eb)
        else:
            by = eb if kind == "abs" else np.minimum(np.nan_to_num(np.abs(value) * eb, nan=0.0), G.MAX)
            lo, hi = value - by, value + by
        lo, hi = np.clip(lo, -G.MAX, G.MAX), np.clip(hi, -G.MAX, G.MAX)
        for _ in range(4):  # rounding may have gone beyond the bound
            lo = np.where(G.within(kind, NUMPY, value, lo, eb), lo, np.nextafter(lo, value))
            hi = np.where(G.within(kind, NUMPY, value, hi, eb), hi, np.nextafter(hi, value))
        lo = np.where(G.within(kind, NUMPY, value, lo, eb), lo, value)
        hi = np.where(G.within(kind, NUMPY, value, hi, eb), hi, value)
    return lo, hi


Leaves = Mapping[Any, np.ndarray]


def boxes(fits: Callable[[dict[Any, Box]], np.ndarray], leaves: Leaves, active: np.ndarray, sides: bool) -> dict[Any, Box]:
    """The largest boxes x - t .. x + t for which ``fits``, t being the same for all leaves of an element of the arrays; with
    ``sides``, each end is then moved out on its own.  Inactive elements keep the point x."""
    n = len(active)
    x = {k: np.asarray(v, np.float64) for k, v in leaves.items()}
    still = {k: np.isfinite(v) for k, v in x.items()}

    def search(box: Callable[[np.ndarray], dict[Any, Box]]) -> np.ndarray:
        """The largest size for which the box fits, to BITS bits; sizes are doubles, in the order of their bits."""
        size = np.zeros(n, np.int64)
        for bit in range(62, 62 - BITS, -1):
            more = size | (_ONE << bit)
            t = more.view(np.float64)
            ok = active & np.isfinite(t)
            if ok.any():
                with np.errstate(all="ignore"):
                    size = np.where(ok & fits(box(np.where(np.isfinite(t), t, 0.0))), more, size)
        return size.view(np.float64)

    grown = lambda k, lo, hi: Box(np.where(still[k], np.maximum(x[k] - lo, -G.MAX), x[k]), np.where(still[k], np.minimum(x[k] + hi, G.MAX), x[k]))
    t = search(lambda t: {k: grown(k, t, t) for k in x})
    down = up = t
    if sides:
        up = np.maximum(t, search(lambda u: {k: grown(k, t, np.maximum(u, t)) for k in x}))
        down = np.maximum(t, search(lambda u: {k: grown(k, np.maximum(u, t), up) for k in x}))
    with np.errstate(all="ignore"):
        found = {k: grown(k, down, up) for k in x}
        ok = active & fits(found)
        return {k: Box(np.where(ok, b.lo, x[k]), np.where(ok, b.hi, x[k])) for k, b in found.items()}


def quantity_boxes(node: qoi.Node, kind: str, eb: np.ndarray, x: Callable[[tuple[int, ...]], np.ndarray], env: Callable[[str, tuple[int, ...]], np.ndarray], active: np.ndarray, dtype: str = "float64") -> dict[tuple[int, ...], Box]:
    """For every offset that the quantity reads, the box of its data.  ``env`` gives constants, whose boxes are points."""
    is_data = lambda n: n in ("$x", "$X")
    plain, boxed = G.in_dtype(NUMPY, dtype), G.in_dtype(BOX, dtype)
    read = (lambda v: v) if plain is NUMPY else lambda v: (BOX if isinstance(v, Box) else NUMPY).narrow(v)
    offsets, constants = qoi.used(node)
    data = sorted({*offsets, *(o for n, o in constants if is_data(n))})
    leaves = {o: np.asarray(x(o), np.float64) for o in data}
    fixed = {(n, o): np.asarray(env(n, o), np.float64) for n, o in constants if not is_data(n)}
    with np.errstate(all="ignore"):
        value = np.broadcast_to(np.asarray(qoi.evaluate(node, plain, lambda o: read(leaves[o]), lambda n, o: read(leaves[o] if is_data(n) else fixed[n, o])), np.float64), active.shape)
    lo, hi = bounds_of(kind, np.where(np.isfinite(value), value, 0.0), eb)
    active = active & np.isfinite(value)

    def fits(box: dict[Any, Box]) -> np.ndarray:
        got = qoi.evaluate(node, boxed, lambda o: read(box[o]), lambda n, o: read(box[o] if is_data(n) else Box(fixed[n, o], fixed[n, o])))
        return np.broadcast_to((got.lo >= lo) & (got.hi <= hi), active.shape)

    return boxes(fits, leaves, active, sides=len(data) == 1)
