"""Reductions over one, several or all dimensions.

skipna=False: a missing cell makes the result missing, also where the cell has no row; the number of
cells expected comes from the axes, so nothing is filled in. skipna=True: missing cells are left out.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import options
from ..axis import Axis
from .ranks import percentiles


def _aggregate(op: str, v: Column, n: int | None, ddof: int, whole: bool = False) -> Column:
    if op in ("std", "var"):
        if ddof == 0:
            return F.stddev_pop(v) if op == "std" else F.var_pop(v)
        if ddof == 1:
            return F.stddev_samp(v) if op == "std" else F.var_samp(v)
        count = F.count(v)
        var = F.when(count > ddof, F.var_pop(v) * count / (count - ddof))
        return F.sqrt(var) if op == "std" else var
    if op == "prod" and whole:  # factors other than 0, 1 and -1: more than 63 of them are Spark's overflow error anyhow
        factors = F.aggregate(F.collect_list(F.when(F.abs(v) > 1, v)), F.lit(1).cast("bigint"), lambda x, y: x * y)
        sign = F.when(F.coalesce(F.count_if(v == -1), F.lit(0)) % 2 == 1, -1).otherwise(1)
        return F.when(F.count(v) == 0, F.lit(None).cast("bigint")).when(F.count_if(v == 0) > 0, F.lit(0).cast("bigint")).otherwise(factors * sign)
    return {"sum": F.sum, "prod": F.product, "mean": F.avg, "min": F.min, "max": F.max, "median": F.median, "ptp": lambda x: F.max(x) - F.min(x), "all": lambda x: F.bool_and(x), "any": lambda x: F.bool_or(x)}[op](v)


def _percentiles(values: DataFrame, shares: list[float], most: int) -> list[float | None]:
    """Percentiles of all values with linear interpolation, without a task that sees them all."""
    got = percentiles(values, [], shares, most).first()
    return list(got["value"]) if got and got["value"] else [None] * len(shares)


class ReduceOps:
    def reduce(self, op: str, axis=None, skipna: bool = False, ddof: int = 0, keepdims: bool = False):
        """The result over all dimensions is a plain value."""
        nos = self.axis_nos(axis)
        gone, rest = [self.axes[i] for i in nos], self.rest(*nos)
        n = math.prod(a.size for a in gone) if all(a.is_counted for a in gone) else None
        if n is None and not skipna:
            raise ValueError("an open axis has no known size: use skipna=True")
        kind = self.dtype
        most = options.get_option("reduce.sort_rows")
        if op == "median" and not rest and not keepdims and (n is None or n > most):
            return _percentiles(self.cells, [0.5], most)[0] if skipna or self.count() == n else None
        if op == "median" and rest and (n is None or n > most):
            return self._grouped([0.5], gone, rest, n, skipna, keepdims, nos)
        v = F.col("value")
        if op in ("all", "any") and kind != "boolean":
            v = v != 0
        if kind == "boolean" and op not in ("all", "any"):
            v, kind = v.cast("bigint"), "bigint"
        whole = kind in ("bigint", "int")
        got, full = _aggregate(op, v.cast("bigint") if whole and op == "prod" else v, n, ddof, whole), F.count(F.col("value")) == F.lit(n)
        neutral = {"sum": 0, "prod": 1, "all": True, "any": False}.get(op)  # of no cells
        fill = neutral
        if op == "all":
            got = F.coalesce(got, F.lit(True))
        elif op == "any":
            got = F.coalesce(got, F.lit(False)) if skipna else F.coalesce(got, F.lit(False)) | ~full
            fill = not skipna and n != 0
        else:
            if neutral is not None and (skipna or n == 0):
                got = F.coalesce(got, F.lit(neutral).cast(dict(self.cells.agg(got.alias("x")).dtypes)["x"]))
            if not skipna:
                got, fill = F.when(full, got), neutral if n == 0 else None
        cols = [c for a in rest for c in a.cols]
        cells = self.cells.groupBy(*[f"`{c}`" for c in cols]).agg(got.alias("value"))
        out = self.make(cells, rest)
        if fill is not None and rest and n is not None and not any(a.is_open for a in rest):
            out = out.make(out.dense().cells.withColumn("value", F.coalesce("value", F.lit(fill).cast(out.dtype))), rest)
        if keepdims:
            for i in nos:
                out = out.newaxis(self.axes[i].name, pos=i)
        return out if out.ndim else out.item()

    def _grouped(self, shares: list[float], gone: list[Axis], rest: list[Axis], n: int | None, skipna: bool, keepdims: bool, nos: list[int]):
        """The first of some percentiles along dimensions that may hold more cells than a task should sort."""
        keys = [c for a in rest for c in a.cols]
        got = percentiles(self.cells, keys, shares, options.get_option("reduce.sort_rows"))
        value = F.get("value", F.lit(0))
        out = self.make(got.withColumn("value", value if skipna else F.when(F.col("count") == F.lit(n), value)), rest)
        for i in nos if keepdims else ():
            out = out.newaxis(self.axes[i].name, pos=i)
        return out

    sum = lambda self, axis=None, skipna=False, **k: self.reduce("sum", axis, skipna, **k)
    prod = lambda self, axis=None, skipna=False, **k: self.reduce("prod", axis, skipna, **k)
    mean = lambda self, axis=None, skipna=False, **k: self.reduce("mean", axis, skipna, **k)
    std = lambda self, axis=None, skipna=False, ddof=0, **k: self.reduce("std", axis, skipna, ddof, **k)
    var = lambda self, axis=None, skipna=False, ddof=0, **k: self.reduce("var", axis, skipna, ddof, **k)
    min = lambda self, axis=None, skipna=False, **k: self.reduce("min", axis, skipna, **k)
    max = lambda self, axis=None, skipna=False, **k: self.reduce("max", axis, skipna, **k)
    ptp = lambda self, axis=None, skipna=False, **k: self.reduce("ptp", axis, skipna, **k)
    median = lambda self, axis=None, skipna=False, **k: self.reduce("median", axis, skipna, **k)
    all = lambda self, axis=None, skipna=False, **k: self.reduce("all", axis, skipna, **k)
    any = lambda self, axis=None, skipna=False, **k: self.reduce("any", axis, skipna, **k)

    def count(self, axis=None):
        """Number of cells that are not missing."""
        nos = self.axis_nos(axis)
        rest = self.rest(*nos)
        cells = self.cells.groupBy(*[f"`{c}`" for a in rest for c in a.cols]).agg(F.count("value").alias("value"))
        out = self.make(cells, rest)
        return out.make(out.dense().cells.fillna(0, ["value"]), rest) if rest else out.item()

    def _extreme(self, axis, skipna: bool, largest: bool):
        """Label of the first smallest or largest cell in the order of the dimensions as given."""
        nos = self.axis_nos(axis)
        for i in nos:
            self = self.ordered(i)
        gone, rest = [self.axes[i] for i in nos], self.rest(*nos)
        src = self if skipna else self.dense()
        cells = src.cells
        for a in gone:
            cells = self.with_pos(cells, a)
        cols = [c for a in gone for c in a.cols]
        pos = [p for a in gone for p in self.order(a)]
        one = len(nos) == 1 and len(cols) == 1
        label = F.col(f"`{cols[0]}`") if one else F.struct(*[F.col(f"`{c}`") for c in cols])
        at = [-p for p in pos] if largest else pos
        best = (F.max_by if largest else F.min_by)(label, F.when(F.col("value").isNotNull(), F.struct("value", *at)))
        if not skipna:
            hole = F.min_by(label, F.when(F.col("value").isNull(), F.struct(*pos)))
            best = F.coalesce(hole, best)
        out = cells.groupBy(*[f"`{c}`" for a in rest for c in a.cols]).agg(best.alias("value"))
        if rest:
            return self.make(out, rest)
        got = out.first()[0]
        got = tuple(got) if got is not None and not one else got
        levels = [m for a in gone for m in a.levels]
        if got is None:
            return None
        named = tuple((m.order.at([x])[0] if m.order else m.values[x]) if m.by_pos else x for m, x in zip(levels, got if not one else (got,), strict=True))
        return named[0] if one else named

    def argmin(self, axis=None, skipna: bool = False):
        return self._extreme(axis, skipna, False)

    def argmax(self, axis=None, skipna: bool = False):
        return self._extreme(axis, skipna, True)

    def apply_along_axis(self, f: Callable, axis, dtype: str = "double", same: bool | str = False):
        """A Python function on the values of each slice, in order; missing cells come as NaN.

        It gives one value, or with same=True as many as it gets, such as a cumulative function; then
        the axis stays; or with same="diff" one less, which belong to all labels but the first. Another number
        raises. Slices are grouped in Spark; each must fit a task.
        """
        nos = self.axis_nos(axis)
        gone, rest = [self.axes[i] for i in nos], self.rest(*nos)
        cells = self.dense().cells
        for a in gone:
            cells = self.with_pos(cells, a)
        order = [f"__pos_{m.name}" for a in gone for m in a.levels]
        cols = [c for a in rest for c in a.cols]

        def run(key, pdf):
            import pandas as pd

            return pd.DataFrame([[*key, f(pdf.sort_values(order)["value"].to_numpy())]], columns=[*cols, "value"])

        types = dict(self.cells.dtypes)
        if same:
            own = [c for a in gone for c in a.cols]

            less = int(same == "diff")
            if less and (len(nos) > 1 or gone[0].members):
                raise ValueError("differences run along one dimension")

            def along(pdf):
                pdf = pdf.sort_values(order)
                got = np.asarray(f(pdf["value"].to_numpy()))
                if got.shape != (len(pdf) - less,):
                    raise ValueError(f"the function gives {got.shape} of {len(pdf)} values")
                return pdf.iloc[less:].assign(value=got)[[*cols, *own, "value"]]

            schema = ", ".join([*[f"`{c}` {types[c]}" for c in [*cols, *own]], f"value {dtype}"])
            out = cells.groupBy(*[f"`{c}`" for c in cols]).applyInPandas(along, schema)
            if not less:
                return self.make(out, self.axes)
            a = gone[0]
            new = a.take(range(1, a.size))
            if a.by_pos or new.by_pos != a.by_pos:
                raise ValueError(f"labels of {a.name!r} repeat")
            return self.make(out, [new if x is a else x for x in self.axes])
        schema = ", ".join([*[f"`{c}` {types[c]}" for c in cols], f"value {dtype}"])
        out = self.make(cells.groupBy(*[f"`{c}`" for c in cols]).applyInPandas(run, schema), rest)
        return out if out.ndim else out.item()

    def percentile(self, pct, axis=0, newaxis: str | None = None, scale: float = 100.0, skipna: bool = False):
        """Linear interpolation. A list of percentages gives a new first dimension labelled by them."""
        i = self.axis_no(axis)
        a, rest = self.axes[i], self.rest(i)
        many = isinstance(pct, (list, tuple)) or hasattr(pct, "__len__")
        asked = [float(p) for p in (pct if many else [pct])]
        most = options.get_option("reduce.sort_rows")
        if not rest and (not a.is_counted or a.size > most):
            if not a.is_counted and not skipna:
                raise ValueError("an open axis has no known size: use skipna=True")
            found = _percentiles(self.cells, [p / scale for p in asked], most) if skipna or self.count() == a.size else [None] * len(asked)
            if not many:
                return found[0]
            own = Axis.of(newaxis or f"{a.name}_percentile", asked)
            rows = [(own.key(k), x) for k, x in enumerate(found)]
            return self.make(self.spark.createDataFrame(rows, f"`{own.name}` {own.key_type()}, value double"), [own], keep=False)
        keys = [c for x in rest for c in x.cols]
        shares = [p / scale for p in asked]
        if rest and (not a.is_counted or a.size > most):
            if not a.is_counted and not skipna:
                raise ValueError("an open axis has no known size: use skipna=True")
            found = percentiles(self.cells, keys, shares, most)
            got = F.col("value") if skipna else F.when(F.col("count") == a.size, F.col("value"))
            cells: DataFrame = found.select(*[f"`{c}`" for c in keys], got.alias("value"))
        else:
            got = F.percentile("value", F.array(*map(F.lit, shares)))
            if not skipna:
                got = F.when(F.count("value") == a.size, got)
            cells = self.cells.groupBy(*[f"`{c}`" for c in keys]).agg(got.alias("value"))
        if not many:
            out = self.make(cells.withColumn("value", F.get("value", F.lit(0))), rest, keep=False)
            return out if out.ndim else out.item()
        name = newaxis or f"{a.name}_percentile"
        labels = F.array(*[F.lit(p) for p in asked])
        cells = cells.select("*", F.posexplode("value").alias("__i", "__v")).withColumn(name, F.get(labels, F.col("__i"))).drop("value").withColumnRenamed("__v", "value")
        return self.make(cells, [Axis.of(name, asked), *rest], keep=False)

    def quantile(self, q, axis=0, newaxis: str | None = None, skipna: bool = False):
        return self.percentile(q, axis, newaxis or f"{self.axis(axis).name}_quantile", 1.0, skipna)
