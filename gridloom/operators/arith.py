"""Elementwise arithmetic with alignment, and comparisons without."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import options
from ..axis import plain
from .align import align

INF = float("inf")
NEGATIVE = "whole numbers have no negative whole powers"

#: NumPy's names of elementwise functions. Outside of their domain the result is missing.
UNARY = {
    "exp": F.exp, "expm1": F.expm1, "sqrt": lambda c: F.sqrt(F.when(c >= 0, c)), "log": lambda c: F.ln(F.when(c > 0, c)), "log10": lambda c: F.log10(F.when(c > 0, c)), "log2": lambda c: F.log2(F.when(c > 0, c)),
    "log1p": lambda c: F.log1p(F.when(c > -1, c)), "absolute": F.abs, "negative": lambda c: -c, "positive": lambda c: c, "sin": F.sin, "cos": F.cos, "tan": F.tan, "arctan": F.atan, "arcsin": lambda c: F.asin(F.when(F.abs(c) <= 1, c)), "arccos": lambda c: F.acos(F.when(F.abs(c) <= 1, c)),
    "sinh": F.sinh, "cosh": F.cosh, "tanh": F.tanh, "floor": lambda c: F.floor(c).cast("double"), "ceil": lambda c: F.ceil(c).cast("double"), "rint": lambda c: F.rint(c), "sign": F.signum, "square": lambda c: c * c, "deg2rad": F.radians, "rad2deg": F.degrees, "cbrt": F.cbrt,
}


def _divide(a: Column, b: Column) -> Column:
    """IEEE rules: x/0 is infinite with the sign of x, 0/0 is missing."""
    a, b = a.cast("double"), b.cast("double")
    return F.when(b != 0, a / F.when(b != 0, b)).when(a > 0, F.lit(INF)).when(a < 0, F.lit(-INF))


def _floor(whole: bool):
    def run(a: Column, b: Column) -> Column:
        if whole:  # integers: toward minus infinity, and 0 for a zero divisor
            q = F.floor(a.cast("decimal(38,0)") / F.when(b != 0, b).cast("decimal(20,0)")).cast("bigint")
            return F.when(b == 0, F.lit(0).cast("bigint")).otherwise(q)
        q = _divide(a, b)
        return F.when(F.abs(q) == INF, q).otherwise(F.floor(q).cast("double"))

    return run


def _power(whole: bool):
    def run(a: Column, b: Column) -> Column:
        one = F.lit(1.0)
        out = F.when(F.coalesce(a == 1, F.lit(False)) | F.coalesce(b == 0, F.lit(False)), one).otherwise(F.pow(a.cast("double"), b.cast("double")))
        return F.when(b < 0, F.raise_error(F.lit(NEGATIVE)).cast("bigint")).otherwise(out.cast("bigint")) if whole else out

    return run


def _without_nan(cells):
    """Results that are no number are missing."""
    v = F.col("value")
    return cells.withColumn("value", F.when(~F.isnan(v), v)) if dict(cells.dtypes)["value"] in ("double", "float") else cells


class ArithOps:
    def _join(self, other, right_name: str = "__r"):
        """Cells of both on shared dimensions: missing on either side is missing in the result, so rows of both sides meet."""
        cols = [c for a in self.axes for c in a.cols]
        shared = [c for a in other.axes for c in a.cols if c in cols]
        right = other.cells.withColumnRenamed("value", right_name)
        if not shared:
            return self.cells.crossJoin(right)  # the outer product is the result itself
        small = {c for a in other.axes for c in a.cols} < set(cols) and all(not a.is_open for a in other.axes) and other.size <= options.get_option("axis.broadcast_labels")
        return self.cells.join(F.broadcast(right) if small else right, shared)

    def _binary(self, op: str, other, swap: bool = False):
        if isinstance(other, np.ndarray) and other.ndim:
            names = self.axes[self.ndim - other.ndim :]
            other = type(self).from_values(self.spark, other, [(a.name, a.values) for a in names])
        if not isinstance(other, ArithOps):
            other = plain(other)
            if not isinstance(other, (int, float, bool)):
                return NotImplemented
            whole = isinstance(other, int) and self.dtype in ("bigint", "int")
            if op == "pow" and whole and not swap and other < 0:
                raise ValueError(NEGATIVE)
            x, y = F.col("value"), F.lit(other)
            f = self._function(op, whole)
            src = self.dense() if op == "pow" and other == (1 if swap else 0) else self  # 1 whatever the exponent, or the base
            return self.make(_without_nan(src.cells.withColumn("value", f(y, x) if swap else f(x, y))), self.axes, keep=False)
        if not options.get_option("op.reindex"):
            for d in set(self.dims) & set(other.dims):
                if self.axis(d) != other.axis(d):
                    raise ValueError(f"labels of {d!r} differ")
        if not options.get_option("op.broadcast") and self.dims != other.dims:
            raise ValueError("dimensions differ")
        left, right = align(self, other, join=options.get_option("align.join"))
        whole = left.dtype in ("bigint", "int") and right.dtype in ("bigint", "int")
        axes = [right.axis(a.name) if a.dummy and a.name in right.dims else a for a in left.axes] + [a for a in right.axes if a.name not in left.dims]
        if op == "pow":
            left, right = left.broadcast(axes).dense(), right.broadcast([a for a in axes if a.name in right.dims]).dense()
        f = self._function(op, whole)
        x, y = F.col("value"), F.col("__r")
        cells = _without_nan(left._join(right).withColumn("value", f(y, x) if swap else f(x, y)))
        return self.make(cells, axes, keep=False)

    @staticmethod
    def _function(op: str, whole: bool):
        plain_ops = {"add": lambda a, b: a + b, "sub": lambda a, b: a - b, "mul": lambda a, b: a * b, "div": _divide, "floor": _floor(whole), "pow": _power(whole)}
        return plain_ops[op]

    __add__ = lambda self, o: self._binary("add", o)
    __radd__ = lambda self, o: self._binary("add", o, True)
    __sub__ = lambda self, o: self._binary("sub", o)
    __rsub__ = lambda self, o: self._binary("sub", o, True)
    __mul__ = lambda self, o: self._binary("mul", o)
    __rmul__ = lambda self, o: self._binary("mul", o, True)
    __truediv__ = lambda self, o: self._binary("div", o)
    __rtruediv__ = lambda self, o: self._binary("div", o, True)
    __floordiv__ = lambda self, o: self._binary("floor", o)
    __rfloordiv__ = lambda self, o: self._binary("floor", o, True)
    __pow__ = lambda self, o: self._binary("pow", o)
    __rpow__ = lambda self, o: self._binary("pow", o, True)

    def __array_ufunc__(self, ufunc, method: str, *inputs, **kwargs):
        """NumPy functions on arrays, as Column expressions."""
        if method != "__call__" or kwargs:
            return NotImplemented
        name = ufunc.__name__
        if len(inputs) == 1 and name in UNARY:
            return self.apply(UNARY[name])
        op = {"add": "add", "subtract": "sub", "multiply": "mul", "divide": "div", "true_divide": "div", "floor_divide": "floor", "power": "pow"}.get(name)
        if len(inputs) == 2 and op:
            left, right = inputs
            return left._binary(op, right) if isinstance(left, ArithOps) else self._binary(op, left, True)
        return NotImplemented

    def __neg__(self):
        return self.make(self.cells.withColumn("value", -F.col("value")), self.axes, keep=False)

    def __pos__(self):
        return self.make(self.cells, self.axes, keep=False)

    def __invert__(self):
        return self.make(self.dense().cells.withColumn("value", ~F.coalesce("value", F.lit(False))), self.axes, keep=False)

    def _compare(self, op: str, other):
        """No alignment: axes must be equal. A missing cell compares false, and true for !=.

        Along an open axis cells without a row stay missing, which is false to a mask, but for !=.
        """
        f = {"eq": lambda a, b: a == b, "ne": lambda a, b: a != b, "lt": lambda a, b: a < b, "le": lambda a, b: a <= b, "gt": lambda a, b: a > b, "ge": lambda a, b: a >= b, "and": lambda a, b: a & b, "or": lambda a, b: a | b}[op]
        sparse = op != "ne" and any(a.is_open for a in self.axes)
        left = self if sparse else self.dense()
        if isinstance(other, ArithOps):
            if self.axes != other.axes:
                if op == "eq":
                    return False
                self._same_axes(other)
            cells, y = left._join(other if sparse else other.dense()), F.col("__r")
        else:
            cells, y = left.cells, F.lit(plain(other))
        got = F.coalesce(f(F.col("value"), y), F.lit(op == "ne"))
        return self.make(cells.withColumn("value", got), left.axes, keep=False)

    __eq__ = lambda self, o: self._compare("eq", o)
    __ne__ = lambda self, o: self._compare("ne", o)
    __lt__ = lambda self, o: self._compare("lt", o)
    __le__ = lambda self, o: self._compare("le", o)
    __gt__ = lambda self, o: self._compare("gt", o)
    __ge__ = lambda self, o: self._compare("ge", o)
    __and__ = lambda self, o: self._compare("and", o)
    __or__ = lambda self, o: self._compare("or", o)
    __hash__ = None

    def equals(self, other) -> bool:
        """Equal axes and cells; missing cells equal each other."""
        if self.axes != other.axes:
            return False
        mine, theirs = self.cells.where("value is not null"), other.cells.where("value is not null").select(*self.cells.columns)
        return mine.exceptAll(theirs).isEmpty() and theirs.exceptAll(mine).isEmpty()
