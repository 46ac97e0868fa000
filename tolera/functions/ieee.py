"""IEEE-754 arithmetic on Spark columns and on numpy arrays, behind one interface.

Spark's own operators differ from IEEE at the edges (division by zero raises under ANSI, ln(0) is null, NaN equals
NaN and is the largest value, floor returns a bigint).  Each helper here is total and stays inside code generation.
The numpy twin is what corrections are verified with.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

_NAN, _INF = float("nan"), float("inf")


class SparkOps:
    """Doubles as columns; truth values are boolean columns."""

    def lit(self, v: float) -> Column:
        return F.lit(float(v))

    def where(self, c: Column, a: Column, b: Column) -> Column:
        return F.when(c, a).otherwise(b)

    def number(self, c: Column) -> Column:
        return F.when(c, 1.0).otherwise(0.0)

    def both(self, *c: Column) -> Column:
        return reduce(lambda a, b: a & b, c)

    def either(self, *c: Column) -> Column:
        return reduce(lambda a, b: a | b, c)

    def no(self, c: Column) -> Column:
        return ~c

    def isnan(self, a: Column) -> Column:
        return F.isnan(a)

    def isinf(self, a: Column) -> Column:
        return F.abs(a) == F.lit(_INF)

    def isfinite(self, a: Column) -> Column:
        return ~F.isnan(a) & (F.abs(a) < F.lit(_INF))

    def negative_zero(self, a: Column) -> Column:
        return (a == 0.0) & (F.pow(a, F.lit(-1.0)) < 0)

    def narrow(self, a: Column) -> Column:
        return a.cast("float").cast("double")

    def bits(self, a: Column) -> Column:
        """Raw bits, which tell NaNs apart.  By reflection and not compiled: for branches that few rows take."""
        return F.reflect(F.lit("java.lang.Double"), F.lit("doubleToRawLongBits"), F.coalesce(a.cast("double"), F.lit(0.0))).cast("long")

    def equal_bits(self, a: Column, b: Column) -> Column:
        return self.bits(a) == self.bits(b)

    def negative(self, a: Column) -> Column:
        """The sign bit."""
        return self.bits(a) < 0

    def fail(self, when: Column, what: str, otherwise: Column) -> Column:
        """``otherwise``, or an error of the query where ``when`` holds (or isn't known)."""
        return F.when(~F.coalesce(when, F.lit(True)), otherwise).otherwise(F.raise_error(F.lit(what)))

    # Spark has NaN equal to itself and above all else, so one side tells.

    def eq(self, a: Column, b: Column) -> Column:
        return (a == b) & ~F.isnan(b)

    def lt(self, a: Column, b: Column) -> Column:
        return (a < b) & ~F.isnan(b)

    def le(self, a: Column, b: Column) -> Column:
        return (a <= b) & ~F.isnan(b)

    def add(self, a: Column, b: Column) -> Column:
        return a + b

    def sub(self, a: Column, b: Column) -> Column:
        return a - b

    def mul(self, a: Column, b: Column) -> Column:
        return a * b

    def neg(self, a: Column) -> Column:
        return -a

    def div(self, a: Column, b: Column) -> Column:
        """Operands are named as rarely as can be, since a nested expression repeats whatever its operators do."""
        return F.coalesce(F.try_divide(a, b), a * F.pow(b, F.lit(-1.0)))  # null only over zero, whose reciprocal is infinite

    def power(self, a: Column, b: Column) -> Column:
        one = (a == 1.0) | ((a == -1.0) & (F.abs(b) == F.lit(_INF)))  # the JVM has NaN for 1**NaN and (-1)**inf
        return F.when(one, 1.0).otherwise(F.pow(a, b))

    def abs(self, a: Column) -> Column:
        return F.abs(a)

    def _log(self, f, a: Column) -> Column:  # noqa: ANN001
        return F.coalesce(f(a), F.sqrt(a) - F.lit(_INF))  # null up to zero: NaN below, and at zero -inf

    def ln(self, a: Column) -> Column:
        return self._log(F.log, a)

    def log2(self, a: Column) -> Column:
        return self._log(F.log2, a)

    def log10(self, a: Column) -> Column:
        return self._log(F.log10, a)

    def exp(self, a: Column) -> Column:
        return F.exp(a)

    def exp2(self, a: Column) -> Column:
        return F.pow(F.lit(2.0), a)

    def exp10(self, a: Column) -> Column:
        return F.pow(F.lit(10.0), a)

    def sqrt(self, a: Column) -> Column:
        return F.sqrt(a)

    def rint(self, a: Column) -> Column:
        return F.rint(a)

    def floor(self, a: Column) -> Column:
        return F.rint(a) - F.when(a < F.rint(a), 1.0).otherwise(0.0)

    def ceil(self, a: Column) -> Column:
        return -self.floor(-a)

    def sign(self, a: Column) -> Column:
        return F.signum(a) + 0.0

    def __getattr__(self, name: str):  # noqa: ANN204
        if name in _SAME:
            return getattr(F, name)
        raise AttributeError(name)


class NumpyOps:
    def lit(self, v: float) -> np.ndarray:
        return np.float64(v)

    where = staticmethod(np.where)
    isnan, isinf, isfinite = staticmethod(np.isnan), staticmethod(np.isinf), staticmethod(np.isfinite)
    add, sub, mul, neg = staticmethod(np.add), staticmethod(np.subtract), staticmethod(np.multiply), staticmethod(np.negative)
    div, power, abs = staticmethod(np.divide), staticmethod(np.power), staticmethod(np.abs)
    ln, log2, log10 = staticmethod(np.log), staticmethod(np.log2), staticmethod(np.log10)
    exp, exp2, sqrt = staticmethod(np.exp), staticmethod(np.exp2), staticmethod(np.sqrt)
    rint, floor, ceil = staticmethod(np.rint), staticmethod(np.floor), staticmethod(np.ceil)
    eq, lt, le, no = staticmethod(np.equal), staticmethod(np.less), staticmethod(np.less_equal), staticmethod(np.logical_not)

    def number(self, c: np.ndarray) -> np.ndarray:
        return np.where(c, 1.0, 0.0)

    def both(self, *c: np.ndarray) -> np.ndarray:
        return reduce(np.logical_and, c)

    def either(self, *c: np.ndarray) -> np.ndarray:
        return reduce(np.logical_or, c)

    def negative_zero(self, a: np.ndarray) -> np.ndarray:
        return (a == 0) & np.signbit(a)

    def narrow(self, a: np.ndarray) -> np.ndarray:
        with np.errstate(all="ignore"):
            return np.asarray(a, np.float64).astype(np.float32).astype(np.float64)

    def bits(self, a: np.ndarray) -> np.ndarray:
        return np.asarray(a, np.float64).view(np.int64)

    def equal_bits(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self.bits(a) == self.bits(b)

    def negative(self, a: np.ndarray) -> np.ndarray:
        return np.signbit(a)

    def fail(self, when: np.ndarray, what: str, otherwise: np.ndarray) -> np.ndarray:
        if np.any(when):
            raise ValueError(what)
        return otherwise

    def exp10(self, a: np.ndarray) -> np.ndarray:
        return np.power(10.0, a)

    def sign(self, a: np.ndarray) -> np.ndarray:
        return np.sign(a) + 0.0

    def __getattr__(self, name: str):  # noqa: ANN204
        if name in _SAME:
            return getattr(np, "arc" + name[1:] if name[0] == "a" else name)
        raise AttributeError(name)


class Narrowed:
    """Operations of another kind with every result rounded to floats of 32 bits, as arithmetic in that type does.

    Sums, products, quotients and square roots of such floats are exactly what that type gives, as doubles have more than
    twice the digits; other functions may differ from a library's own by a last digit."""

    _ROUNDED = {"lit", "add", "sub", "mul", "div", "power", "ln", "log2", "log10", "exp", "exp2", "exp10", "sqrt"}

    def __init__(self, ops: object):
        self._ops = ops

    def __getattr__(self, name: str):  # noqa: ANN204
        f = getattr(self._ops, name)
        if name not in self._ROUNDED and name not in _SAME:
            return f
        return lambda *a: self._ops.narrow(f(*a))  # type: ignore[attr-defined]


_SAME = {"sin", "cos", "tan", "asin", "acos", "atan", "sinh", "cosh", "tanh", "asinh", "acosh", "atanh"}
SPARK, NUMPY = SparkOps(), NumpyOps()
