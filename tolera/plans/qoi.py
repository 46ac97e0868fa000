"""Quantities of interest: a small expression language, compiled to column expressions.

Text is scanned, parsed by precedence climbing into nested tuples, and evaluated by any set of operations of
``functions.ieee``.  Arrays exist only while parsing; what is compiled is a scalar tree.

Nodes: ("num", value) | ("x", offset) | ("c", name, offset) | (operation, node, ...); an offset is a tuple with one entry
per axis of the neighbourhood, relative to the centre, or () for a pointwise quantity.
"""

from __future__ import annotations

import itertools
import math
import re
from collections.abc import Callable, Sequence
from fractions import Fraction
from typing import Any

import numpy as np

Node = tuple
_TOKEN = re.compile(r'\s+|#[^\n]*|(?P<num>\d+\.\d+(?:[eE][+-]?\d+)?|\d+(?:[eE][+-]?\d+)?)|(?P<name>[A-Za-z_]\w*)|(?P<str>"\$?[A-Za-z_]\w*")|(?P<op>\*\*|[<>=!]=|[-+*/<>()\[\],:;=.])')
UNARY = {"ln", "log2", "log10", "exp", "exp2", "exp10", "sqrt", "square", "reciprocal", "abs", "sign", "floor", "ceil", "trunc", "round_ties_even", "sin", "cos", "tan", "asin", "acos", "atan", "sinh", "cosh", "tanh", "asinh", "acosh", "atanh", "isfinite", "isinf", "isnan", "not"}
COMPARE = {"<": "lt", "<=": "le", "==": "eq", "!=": "ne", ">": "gt", ">=": "ge"}


class QoiError(ValueError):
    """A quantity of interest that can't be read; the message names line and column."""


class Array:
    """A rectangular array of nodes while parsing."""

    def __init__(self, shape: tuple[int, ...], flat: list[Node]):
        self.shape, self.flat = shape, flat

    @classmethod
    def stack(cls, items: list[Any]) -> Array:
        if not items:
            raise QoiError("an array may not be empty")
        shapes = {i.shape if isinstance(i, Array) else () for i in items}
        if len(shapes) > 1:
            raise QoiError("an array must be rectangular")
        shape = shapes.pop()
        return cls((len(items), *shape), [n for i in items for n in (i.flat if isinstance(i, Array) else [i])])

    def index(self, keys: Sequence[int | slice]) -> Any:
        if len(keys) > len(self.shape):
            raise QoiError("too many indices")
        axes = []
        for n, k in itertools.zip_longest(self.shape, keys, fillvalue=slice(None)):
            if isinstance(k, slice):
                axes.append(list(range(n))[k])
            elif -n <= k < n:
                axes.append([k % n])
            else:
                raise QoiError("an index is out of range")
        strides = [math.prod(self.shape[i + 1 :]) for i in range(len(self.shape))]
        flat = [self.flat[sum(a * s for a, s in zip(at, strides, strict=True))] for at in itertools.product(*axes)]
        shape = tuple(len(a) for a, k in itertools.zip_longest(axes, keys, fillvalue=slice(None)) if isinstance(k, slice))
        if not shape:
            return flat[0]
        if not flat:
            raise QoiError("an array may not be empty")
        return Array(shape, flat)

    @property
    def T(self) -> Array:  # noqa: N802
        back = self.shape[::-1]
        strides = [math.prod(self.shape[i + 1 :]) for i in range(len(self.shape))][::-1]
        return Array(back, [self.flat[sum(a * s for a, s in zip(at, strides, strict=True))] for at in itertools.product(*map(range, back))])


def num(v: float | Fraction | int) -> Node:
    return ("num", v)


def _int(n: Any) -> int | None:
    return n[1] if isinstance(n, tuple) and n[0] == "num" and isinstance(n[1], int) else None


def scalar(op: str, *args: Node) -> Node:
    """A node, with integers folded exactly; nothing else is rearranged."""
    ints = [_int(a) for a in args]
    if all(i is not None for i in ints):
        a, b = (ints + [None])[:2]
        if op == "neg":
            return num(-a)
        if op in ("add", "sub", "mul"):
            return num({"add": a + b, "sub": a - b, "mul": a * b}[op])
        if op == "div" and b:
            g = math.gcd(a, b) * (1 if b > 0 else -1)
            return num(a // g) if b // g == 1 else ("div", num(a // g), num(b // g))
        if op == "power" and 0 <= b <= 4096:
            return num(a**b)
    return (op, *args)


def over(op: str, *args: Any) -> Any:
    """Elementwise: scalars spread, shapes of arrays must be equal."""
    shapes = {a.shape for a in args if isinstance(a, Array)}
    if not shapes:
        return scalar(op, *args)
    if len(shapes) > 1:
        raise QoiError("arrays of different shapes")
    shape = shapes.pop()
    flats = [a.flat if isinstance(a, Array) else [a] * math.prod(shape) for a in args]
    return Array(shape, [scalar(op, *x) for x in zip(*flats, strict=True)])


def total(items: list[Node]) -> Node:
    out = items[0]
    for i in items[1:]:
        out = scalar("add", out, i)
    return out


def offsets_of(order: int, accuracy: int, kind: int) -> list[int]:
    """Grid offsets of a finite difference: forward, backward, or 0, 1, -1, 2, -2, ..."""
    if kind:
        return [kind * i for i in range(order + accuracy)]
    if accuracy % 2:
        raise QoiError("a central finite difference needs an even accuracy")
    p = (order + order % 2 - 2 + accuracy) // 2
    return [0] + [s * i for i in range(1, p + 1) for s in (1, -1)]


def weights(order: int, points: list[Any], zero: Any, one: Any, sub: Callable, mul: Callable, div: Callable, scale: Callable) -> list[Any]:
    """Weights of the derivative of ``order`` at zero from values at ``points`` (recursion over the points)."""
    c = [[one]]  # c[j][k]: weight of point j for derivative k
    product = one
    for n in range(1, len(points)):
        below = one
        row = []
        for j in range(n):
            gap = sub(points[n], points[j])
            below = mul(below, gap)
            old = c[j]
            at = lambda k, old=old: old[k] if k < len(old) else zero
            c[j] = [div(sub(mul(points[n], at(k)), scale(k, at(k - 1)) if k else zero), gap) for k in range(min(n, order) + 1)]
            if j == n - 1:
                last = old
        at = lambda k: last[k] if k < len(last) else zero
        row = [mul(div(product, below), sub(scale(k, at(k - 1)) if k else zero, mul(points[n - 1], at(k)))) for k in range(min(n, order) + 1)]
        c.append(row)
        product = below
    return [x[order] if order < len(x) else zero for x in c]


class Parser:
    """before/after: the neighbourhood of a stencil quantity, one pair per axis; None for a pointwise one."""

    def __init__(self, text: str, around: Sequence[tuple[int, int]] | None = None):
        self.text, self.around = text, around
        self.vars: dict[str, Any] = {}
        self.tokens: list[tuple[str, str, int]] = []
        at = 0
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise self.wrong(f"unexpected {text[at]!r}", at)
            if m.lastgroup:
                self.tokens.append((m.lastgroup, m.group(), at))
            at = m.end()
        self.tokens.append(("end", "", len(text)))
        self.at = 0

    def wrong(self, what: str, at: int | None = None) -> QoiError:
        at = self.tokens[self.at][2] if at is None else at
        line = self.text.count("\n", 0, at) + 1
        return QoiError(f"{what} at line {line}, column {at - (self.text.rfind(chr(10), 0, at) + 1) + 1}")

    def peek(self, value: str) -> bool:
        return self.tokens[self.at][1] == value and self.tokens[self.at][0] != "str"

    def take(self, value: str) -> bool:
        if self.peek(value):
            self.at += 1
            return True
        return False

    def need(self, value: str) -> None:
        if not self.take(value):
            raise self.wrong(f"expected {value!r}")

    def parse(self) -> Node:
        own = "v" if self.around is None else "V"
        returns = False
        while True:
            kind, name, _ = self.tokens[self.at]
            if kind == "name" and name == own and self._assigns():
                self.at += 2
                key = self._string()
                self.need("]"), self.need("=")
                if key in self.vars:
                    raise self.wrong(f"variable {key!r} is assigned twice")
                if key.startswith("$"):
                    raise self.wrong(f"variable {key!r} would be built-in")
                value = self.expr()
                self.need(";")
                self.vars[key] = value
                continue
            returns = self.take("return")
            break
        if self.vars and not returns:
            raise self.wrong("expected 'return'")
        out = self.expr()
        if returns:
            self.need(";")
        if self.tokens[self.at][0] != "end":
            raise self.wrong("expected the end")
        if isinstance(out, Array):
            raise QoiError("the quantity must be a scalar, not an array")
        if not any(n[0] == "x" for n in walk(out)):
            raise QoiError("the quantity must depend on the data")
        return out

    def _assigns(self) -> bool:
        t = [x[1] for x in self.tokens[self.at : self.at + 5]]
        return len(t) == 5 and t[1] == "[" and t[3] == "]" and t[4] == "="

    def _string(self) -> str:
        kind, value, _ = self.tokens[self.at]
        if kind != "str":
            raise self.wrong("expected a name in double quotes")
        self.at += 1
        return value[1:-1]

    def expr(self) -> Any:
        a = self.sum()
        for sign, op in COMPARE.items():
            if self.take(sign):
                out = over(op, a, self.sum())
                if self.tokens[self.at][1] in COMPARE:
                    raise self.wrong("comparisons can't be chained")
                return out
        return a

    def sum(self) -> Any:
        a = self.term()
        while True:
            if self.take("+"):
                a = over("add", a, self.term())
            elif self.take("-"):
                a = over("sub", a, self.term())
            else:
                return a

    def term(self) -> Any:
        a = self.unary()
        while True:
            if self.take("*"):
                a = over("mul", a, self.unary())
            elif self.take("/"):
                a = over("div", a, self.unary())
            else:
                return a

    def unary(self) -> Any:
        if self.take("-"):
            return over("neg", self.unary())
        if self.take("+"):
            return self.unary()
        a = self.postfix()
        return over("power", a, self.unary()) if self.take("**") else a

    def postfix(self) -> Any:
        a = self.atom()
        while True:
            if self.take("."):
                if not self.take("T"):
                    raise self.wrong("expected 'T'")
                a = a.T if isinstance(a, Array) else a
            elif self.take("["):
                keys = self._keys()
                if not isinstance(a, Array):
                    raise self.wrong("only an array has indices")
                try:
                    a = a.index(keys)
                except QoiError as e:
                    raise self.wrong(str(e)) from None
            else:
                return a

    def _keys(self) -> list[int | slice]:
        if self.around is not None and self.peek("I") and self.tokens[self.at + 1][1] == "]":
            self.at += 2
            return [b for b, _ in self.around]
        keys: list[int | slice] = []
        while not self.take("]"):
            part: list[int | None] = [None]
            while not (self.peek(",") or self.peek("]")):
                if self.take(":"):
                    part.append(None)
                else:
                    part[-1] = self._integer()
            keys.append(part[0] if len(part) == 1 else slice(*part))  # type: ignore[arg-type]
            if not self.take(",") and not self.peek("]"):
                raise self.wrong("expected ']'")
        if not keys or None in keys:
            raise self.wrong("expected an index")
        return keys

    def _integer(self) -> int:
        value = _int(self.sum())
        if value is None:
            raise self.wrong("expected an integer")
        return value

    def _grid(self, leaf: str, *name: str) -> Array:
        assert self.around is not None
        shape = tuple(b + 1 + a for b, a in self.around)
        centre = [b for b, _ in self.around]
        return Array(shape, [(leaf, *name, tuple(i - c for i, c in zip(at, centre, strict=True))) for at in itertools.product(*map(range, shape))])

    def atom(self) -> Any:
        kind, value, at = self.tokens[self.at]
        self.at += 1
        here = () if self.around is None else (0,) * len(self.around)
        if kind == "num":
            return num(float(value) if re.search("[.eE]", value) else int(value))
        if value == "(":
            a = self.expr()
            self.need(")")
            return a
        if value == "[":
            items = []
            while not self.take("]"):
                items.append(self.expr())
                if not self.take(",") and not self.peek("]"):
                    raise self.wrong("expected ']'")
            return Array.stack(items)
        if kind != "name":
            raise self.wrong(f"unexpected {value!r}" if value else "unexpected end", at)
        if value in ("Inf", "NaN"):
            return num(float(value))
        if value in ("pi", "e"):
            return num(math.pi if value == "pi" else math.e)
        if value == "x":
            return ("x", here)
        if value == "c":
            self.need("[")
            name = self._string()
            self.need("]")
            return ("c", name, here)
        if value in ("X", "C", "V", "I", "finite_difference") and self.around is None or value == "v" and self.around is not None:
            raise self.wrong(f"{value!r} is not available in this kind of quantity", at)
        if value == "X":
            return self._grid("x")
        if value == "C":
            self.need("[")
            name = self._string()
            self.need("]")
            return self._grid("c", name)
        if value == "I":
            return Array.stack([num(b) for b, _ in self.around or ()])
        if value in ("v", "V"):
            self.need("[")
            name = self._string()
            self.need("]")
            if name not in self.vars:
                raise self.wrong(f"variable {name!r} is not defined", at)
            return self.vars[name]
        self.need("(")
        if value == "finite_difference":
            return self._difference()
        args, base = [self.expr()], None
        while self.take(","):
            if self.peek(")"):
                break
            if value == "log" and self.take("base"):
                self.need("=")
                base = self.expr()
            else:
                args.append(self.expr())
        self.need(")")
        return self._call(value, args, base, at)

    def _call(self, name: str, args: list[Any], base: Any, at: int) -> Any:
        wants = {"where": 3, "matmul": 2}.get(name, 1)
        if len(args) != wants or (name == "log") != (base is not None):
            raise self.wrong(f"wrong arguments of {name!r}", at)
        a = args[0]
        flat = a.flat if isinstance(a, Array) else [a]
        if name in UNARY:
            return over(name, a)
        if name == "log":
            return over("div", over("ln", a), over("ln", base))
        if name == "where":
            return over("where", *args)
        if name in ("all", "any"):
            if len(flat) < 2:
                raise self.wrong(f"{name!r} needs an array of two or more", at)
            return ("both" if name == "all" else "either", *flat)
        if name == "sum":
            return total(flat)
        if name == "size":
            return num(len(flat))
        if name == "shape":
            if not isinstance(a, Array):
                raise self.wrong("a scalar has no shape", at)
            return Array.stack([num(n) for n in a.shape])
        if name == "matmul":
            b = args[1]
            if not (isinstance(a, Array) and isinstance(b, Array) and len(a.shape) == len(b.shape) == 2 and a.shape[1] == b.shape[0]):
                raise self.wrong("matmul needs two matrices of fitting shapes", at)
            (n, m), k = a.shape, b.shape[1]
            return Array((n, k), [total([scalar("mul", a.flat[i * m + j], b.flat[j * k + c]) for j in range(m)]) for i in range(n) for c in range(k)])
        raise self.wrong(f"unknown function {name!r}", at)

    def _difference(self) -> Node:
        start = self.tokens[self.at][2]
        body = self.expr()
        given: dict[str, Any] = {}
        while self.take(","):
            if self.peek(")"):
                break
            key = self.tokens[self.at][1]
            self.at += 1
            self.need("=")
            given[key] = self._integer() if key in ("order", "accuracy", "type", "axis") else self.expr()
        self.need(")")
        if not {"order", "accuracy", "type", "axis"} <= set(given) or ("grid_spacing" in given) == ("grid_centre" in given) or isinstance(body, Array):
            raise self.wrong("finite_difference needs a scalar, order, accuracy, type, axis and one of grid_spacing and grid_centre", start)
        order, accuracy, kind, axis = (given[k] for k in ("order", "accuracy", "type", "axis"))
        assert self.around is not None
        if order < 0 or accuracy < 1 or kind not in (-1, 0, 1) or not -len(self.around) <= axis < len(self.around):
            raise self.wrong("finite_difference has parameters out of range", start)
        axis %= len(self.around)
        period = given.get("grid_period")

        def shift(n: Any, by: int) -> Node:
            if n[0] in ("x", "c"):
                off = n[-1][:axis] + (n[-1][axis] + by,) + n[-1][axis + 1 :]
                before, after = self.around[axis]  # type: ignore[index]
                if not -before <= off[axis] <= after:
                    raise self.wrong("the neighbourhood is too small for this finite difference", start)
                return (*n[:-1], off)
            return n if n[0] == "num" else (n[0], *[shift(a, by) for a in n[1:]])

        steps = offsets_of(order, accuracy, kind)
        values = [shift(body, s) for s in steps]
        if "grid_spacing" in given:
            w = weights(order, [Fraction(s) for s in steps], Fraction(0), Fraction(1), lambda a, b: a - b, lambda a, b: a * b, lambda a, b: a / b, lambda k, a: k * a)
            spacing = given["grid_spacing"]
            out = total([scalar("mul", v, scalar("div", num(f.numerator), num(f.denominator))) for v, f in zip(values, w, strict=True)])
            return scalar("div", out, scalar("power", spacing, num(order))) if order else out
        centre = given["grid_centre"]
        gap = lambda s: scalar("sub", shift(centre, s), centre)
        points = [gap(s) if s else num(0) for s in steps]
        if period is not None:
            points = [("symmod", p, period) if p != num(0) else p for p in points]
        sub = lambda a, b: a if b == num(0) else scalar("sub", a, b)
        mul = lambda a, b: num(0) if num(0) in (a, b) else b if a == num(1) else a if b == num(1) else scalar("mul", a, b)
        div = lambda a, b: num(0) if a == num(0) else scalar("div", a, b)
        w = weights(order, points, num(0), num(1), sub, mul, div, lambda k, a: mul(num(k), a))
        return total([scalar("mul", v, f) for v, f in zip(values, w, strict=True)])


def walk(n: Node):  # noqa: ANN201
    yield n
    if n[0] not in ("num", "x", "c"):
        for a in n[1:]:
            yield from walk(a)


def parse(text: str, around: Sequence[tuple[int, int]] | None = None) -> Node:
    return Parser(text, around).parse()


def fold(node: Node) -> Node:
    """The same quantity with subtrees of constants computed once; equal to evaluating them."""
    from tolera.functions.ieee import NUMPY

    if node[0] in ("num", "x", "c"):
        return node
    parts = [fold(n) for n in node[1:]]
    if all(p[0] == "num" for p in parts):
        with np.errstate(all="ignore"):
            return num(float(evaluate((node[0], *parts), NUMPY, lambda at: None, lambda name, at: None)))
    return (node[0], *parts)


def used(node: Node) -> tuple[list[tuple[int, ...]], list[tuple[str, tuple[int, ...]]]]:
    """Offsets of the data and (name, offset) of the constants that a quantity reads."""
    return sorted({n[1] for n in walk(node) if n[0] == "x"}), sorted({(n[1], n[2]) for n in walk(node) if n[0] == "c"})


def evaluate(node: Node, ops: Any, x: Callable[[tuple[int, ...]], Any], c: Callable[[str, tuple[int, ...]], Any]) -> Any:
    """The value of a quantity, in the operations of ``functions.ieee``; equal subtrees are built once."""
    done: dict[int, Any] = {}

    def truth(a: Any) -> Any:
        return ops.no(ops.eq(a, ops.lit(0)))

    def go(n: Node) -> Any:
        if id(n) not in done:
            done[id(n)] = calc(n)
        return done[id(n)]

    def calc(n: Node) -> Any:
        op = n[0]
        if op == "num":
            return ops.lit(n[1])
        if op == "x":
            return x(n[1])
        if op == "c":
            return c(n[1], n[2])
        a = [go(k) for k in n[1:]]
        if op in ("eq", "lt", "le"):
            return ops.number(getattr(ops, op)(*a))
        if op in ("gt", "ge"):
            return ops.number((ops.lt if op == "gt" else ops.le)(a[1], a[0]))
        if op == "ne":
            return ops.number(ops.no(ops.eq(*a)))
        if op in ("both", "either"):
            return ops.number(getattr(ops, op)(*map(truth, a)))
        if op == "not":
            return ops.number(ops.eq(a[0], ops.lit(0)))
        if op == "where":
            return ops.where(truth(a[0]), a[1], a[2])
        if op in ("isfinite", "isinf", "isnan"):
            return ops.number(getattr(ops, op)(a[0]))
        if op == "square":
            return ops.mul(a[0], a[0])
        if op == "reciprocal":
            return ops.div(ops.lit(1), a[0])
        if op == "round_ties_even":
            return ops.rint(a[0])
        if op == "trunc":
            return ops.where(ops.lt(a[0], ops.lit(0)), ops.ceil(a[0]), ops.floor(a[0]))
        if op == "symmod":  # into [-q/2, q/2)
            half = ops.div(a[1], ops.lit(2))
            y = ops.add(a[0], half)
            return ops.sub(ops.sub(y, ops.mul(ops.floor(ops.div(y, a[1])), a[1])), half)
        return getattr(ops, op)(*a)

    try:
        return go(node)
    finally:  # these two name each other, and a cycle keeps its arrays until some later collection
        del go, calc
