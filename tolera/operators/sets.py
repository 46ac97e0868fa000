"""Safe sets: for each element a union of closed intervals of order keys, as numpy arrays.

``lo`` and ``hi`` are (pieces, elements); an interval with lo > hi is empty.  The column form, an
ARRAY<STRUCT<lo: BIGINT, hi: BIGINT>>, and its algebra in Spark are in ``intervals``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from tolera.functions import kinds

_NONE = (1, 0)


@dataclass
class Safe:
    lo: np.ndarray
    hi: np.ndarray
    kind: str

    @classmethod
    def of(cls, kind: str, *pieces: tuple[np.ndarray, np.ndarray], n: int | None = None) -> Safe:
        """From (lo, hi) arrays or scalars; n: elements, where all are scalars."""
        size = n if n is not None else max(np.size(x) for p in pieces for x in p)
        spread = lambda x: np.broadcast_to(np.asarray(x, np.int64), size)
        return cls(np.stack([spread(a) for a, _ in pieces]), np.stack([spread(b) for _, b in pieces]), kind)

    @classmethod
    def full(cls, kind: str, n: int) -> Safe:
        return cls.of(kind, kinds.key_range(kind), n=n)

    @classmethod
    def empty(cls, kind: str, n: int) -> Safe:
        return cls.of(kind, _NONE, n=n)

    @classmethod
    def exact(cls, x: np.ndarray) -> Safe:
        k = kinds.key_of(x)
        return cls.of(x.dtype.name, (k, k), n=len(x))

    @classmethod
    def nans(cls, kind: str, n: int, negative: bool = True, positive: bool = True) -> Safe:
        """NaNs of either sign; nothing for integers."""
        if np.dtype(kind).kind != "f":
            return cls.empty(kind, n)
        low, high = kinds.key_range(kind)
        inf = int(kinds.key_of(np.array([np.inf], kind))[0])
        return cls.of(kind, (low, -inf - 2) if negative else _NONE, (inf + 1, high) if positive else _NONE, n=n)

    def __len__(self) -> int:
        return self.lo.shape[1]

    def where(self, mask: np.ndarray, other: Safe) -> Safe:
        """This where the mask is set, else ``other``."""
        k = max(len(self.lo), len(other.lo))
        pad = lambda a, v: np.concatenate((a, np.full((k - len(a), len(self)), v, np.int64)))
        return Safe(np.where(mask, pad(self.lo, 1), pad(other.lo, 1)), np.where(mask, pad(self.hi, 0), pad(other.hi, 0)), self.kind)

    def only_where(self, mask: np.ndarray) -> Safe:
        return self.where(mask, Safe.full(self.kind, len(self)))

    def intersect(self, other: Safe) -> Safe:
        lo = np.maximum(self.lo[:, None], other.lo[None]).reshape(-1, len(self))
        hi = np.minimum(self.hi[:, None], other.hi[None]).reshape(-1, len(self))
        return Safe(lo, hi, self.kind).tidy()

    def union(self, other: Safe) -> Safe:
        return Safe(np.concatenate((self.lo, other.lo)), np.concatenate((self.hi, other.hi)), self.kind).tidy()

    def tidy(self) -> Safe:
        """Sorted, disjoint and non-adjacent pieces, empty ones last, as few rows as are needed."""
        least, most = kinds.key_range(self.kind)
        gone = self.lo > self.hi
        order = np.argsort(np.where(gone, most, self.lo) + 0, axis=0, kind="stable")
        order = np.take_along_axis(order, np.argsort(np.take_along_axis(gone, order, 0), axis=0, kind="stable"), 0)
        lo, hi, gone = (np.take_along_axis(a, order, 0) for a in (self.lo, self.hi, gone))
        lo, hi = lo.copy(), hi.copy()
        at = np.zeros(len(self), np.int64)  # the piece that is being grown
        every = np.arange(len(self))
        for i in range(1, len(lo)):
            end = hi[at, every]
            touches = ~gone[i] & ((end == most) | (lo[i] <= np.where(end == most, end, end + 1)))
            hi[at, every] = np.where(touches, np.maximum(end, hi[i]), end)
            at = np.where(gone[i] | touches, at, at + 1)
            put = ~gone[i] & ~touches
            lo[at[put], every[put]], hi[at[put], every[put]] = lo[i][put], hi[i][put]
        pieces = np.where(gone[0], 0, at + 1) if len(lo) else np.zeros(len(self), np.int64)
        rows = np.arange(len(lo))[:, None]
        lo, hi = np.where(rows < pieces, lo, 1), np.where(rows < pieces, hi, 0)
        keep = max(1, int(pieces.max(initial=0)))
        return Safe(lo[:keep], hi[:keep], self.kind)

    def contains(self, key: np.ndarray) -> np.ndarray:
        return ((self.lo <= key) & (key <= self.hi)).any(axis=0)

    def width(self) -> np.ndarray:
        """Members less one, per element (as widest floats: up to 2**64 - 1 is exact); -1 if there are none."""
        long = np.where(self.lo <= self.hi, self.hi.astype(np.longdouble) - self.lo.astype(np.longdouble) + 1, 0)
        return long.sum(axis=0) - 1

    def lists(self) -> list[list[dict[str, int]]]:
        """As values of the column form."""
        t = self.tidy()
        return [[{"lo": int(a), "hi": int(b)} for a, b in zip(t.lo[:, i], t.hi[:, i], strict=True) if a <= b] for i in range(len(t))]

    # ---- choosing a member

    def pick(self, p: np.ndarray) -> np.ndarray:
        """p where it is safe, else the value of the nearest piece whose key differs from p's by the number with the
        most zero bits at its end: of the differences a..b that the piece allows, b with all bits below the highest
        one that b and a - 1 don't share set to zero."""
        if len(self.lo) > 1:
            self = self.tidy()  # noqa: PLW0642
        p_key = kinds.key_of(p)
        if (self.width() < 0).any():
            raise ValueError("an element has no safe value")
        gone, below = self.lo > self.hi, p_key < self.lo
        key = p_key.view(np.uint64)
        gap = np.where(below, self.lo.view(np.uint64) - key, key - self.hi.view(np.uint64))
        gap = np.where(gone, np.uint64(0xFFFFFFFFFFFFFFFF), gap)
        best, every = np.argmin(gap, axis=0), np.arange(len(self))
        lo, hi = self.lo[best, every], self.hi[best, every]
        up = p_key < lo
        with np.errstate(over="ignore"):
            least = np.where(up, lo.view(np.uint64) - key, key - hi.view(np.uint64))
            most = np.where(up, hi.view(np.uint64) - key, key - lo.view(np.uint64))
            step = round_bits(least, most)
            chosen = np.where(up, key + step, key - step).view(np.int64)
        out = kinds.value_of(np.where(self.contains(p_key), p_key, chosen), self.kind)
        return out

    def first(self) -> np.ndarray:
        """The least safe value."""
        t = self.tidy()
        return kinds.value_of(t.lo[0], self.kind)

    def sample(self, seed: int) -> np.ndarray:
        """A uniform member per element."""
        t, rng = self.tidy(), np.random.default_rng(seed)
        size = np.where(t.lo <= t.hi, t.hi.astype(object) - t.lo.astype(object) + 1, 0)
        out = np.empty(len(t), np.int64)
        for i in range(len(t)):
            at = int(rng.random() * (1 << 53)) * int(size[:, i].sum()) >> 53
            for lo, n in zip(t.lo[:, i], size[:, i], strict=True):
                if at < n:
                    out[i] = int(lo) + at
                    break
                at -= int(n)
        return kinds.value_of(out, self.kind)


def highest_bit(x: np.ndarray) -> np.ndarray:
    """Place of the highest set bit of unsigned 64-bit numbers; -1 for zero."""
    return 63 - leading_zeros(x)


def leading_zeros(x: np.ndarray) -> np.ndarray:
    """Zero bits above the highest set one, of 64."""
    x, n = x.astype(np.uint64), np.full(np.shape(x), 64, np.int64)
    for step in (32, 16, 8, 4, 2, 1):
        big = (x >> np.uint64(step)) > 0
        n -= step * big
        x = np.where(big, x >> np.uint64(step), x)
    return n - (x > 0)


def round_bits(least: np.ndarray, most: np.ndarray) -> np.ndarray:
    """The number within least..most (unsigned, least > 0) with the most zero bits at its end."""
    with np.errstate(over="ignore"):
        shift = highest_bit((least - np.uint64(1)) ^ most).astype(np.uint64)
        return (most >> shift) << shift
