"""Interpolation along axes."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import options
from ..axis import Axis, hinted, plain


@dataclass(frozen=True)
class Weights:
    """A sparse table of weights from the labels of an axis to new ones: old key, __new, __w, __n (old labels of a new one).

    It depends on the two axes alone, so it is made once and serves all arrays on the axis.
    """

    old: Axis
    new: Axis
    table: DataFrame
    rows: int
    ends: list[tuple]  # keys of new labels outside, and what they get

    def hinted(self, k: int | str = "") -> DataFrame:
        t = self.table.withColumnsRenamed({c: f"{c}{k}" for c in ("__new", "__w", "__n")})
        return F.broadcast(t) if self.rows <= options.get_option("axis.broadcast_labels") else t


def weigh(spark: SparkSession, a: Axis, values, left: float | None = None, right: float | None = None, method: str = "linear", extrapolate: bool = False) -> Weights:
    """The weights of new labels among those of an axis, piecewise linear between labels in ascending order, or of the nearest."""
    values = values.values if isinstance(values, Axis) else values
    new = replace(Axis.of(a.name, [float(plain(x)) if not isinstance(plain(x), int) else plain(x) for x in values], a.tol), attrs=dict(a.attrs))
    order = a.sorted_by()
    xs = [float(a.values[k]) for k in order]
    rows, ends = [], []
    for k, x in enumerate(new.values):
        if not extrapolate and not (xs and xs[0] <= x <= xs[-1]):
            ends.append((new.key(k), left if xs and x < xs[0] else right))
            continue
        if method == "nearest":
            j = bisect_right(xs, x)
            at = min((k_ for k_ in (j - 1, j) if 0 <= k_ < len(xs)), key=lambda k_: (abs(xs[k_] - x), k_))
            rows.append((a.key(order[at]), new.key(k), 1.0, 1))
            continue
        j = min(max(bisect_right(xs, x) - 1, 0), max(len(xs) - 2, 0))
        w = 0.0 if len(xs) == 1 else (x - xs[j]) / (xs[j + 1] - xs[j])
        if len(xs) > 1 and w == 1.0:
            j, w = j + 1, 0.0
        both = [(a.key(order[j]), new.key(k), 1 - w)] + ([(a.key(order[j + 1]), new.key(k), w)] if w else [])
        rows += [(*b, len(both)) for b in both]
    table = spark.createDataFrame(rows, f"`{a.name}` {a.key_type()}, __new {new.key_type()}, __w double, __n int")
    return Weights(a, new, table, len(rows), [(k, float(v)) for k, v in ends if v is not None])


class InterpOps:
    def interp_axis(self, values, axis=0, left: float | None = None, right: float | None = None, method: str = "linear", extrapolate: bool = False):
        """Piecewise linear between the labels in ascending order; outside: left, right or missing.

        The weights are worked out once on the axis: each new label takes one or two old ones. Cells
        then meet them by an equality join and are summed, so no range join is needed. values: labels,
        an axis, or the Weights for this axis.
        """
        i = self.axis_no(axis)
        if self.axes[i].is_open or isinstance(values, Axis) and values.is_open:
            return self.ordered(i)._interp_open(i, values if isinstance(values, Axis) else Axis.of(self.axes[i].name, list(values)), left, right, method, extrapolate)
        w = values if isinstance(values, Weights) else weigh(self.spark, self.axes[i], values, left, right, method, extrapolate)
        out = self._regrid([w])
        if w.ends:
            e = self.spark.createDataFrame(w.ends, f"`{w.new.name}` {w.new.key_type()}, value double")
            cells = out.cells.unionByName(self._grid(self.spark, self.rest(i)).crossJoin(hinted(e, len(w.ends))))
            out = out.make(cells, out.axes)
        return out

    def _regrid(self, weights: Sequence[Weights]):
        """Along several dimensions at once: a cell meets the weights of each, and one aggregation sums the products."""
        by = {w.old.name: (k, w) for k, w in enumerate(weights)}
        cells, value, n, renamed = self.cells, F.col("value"), F.lit(1), {}
        for d, (k, w) in by.items():
            if self.axis(d) != w.old:
                raise ValueError(f"these weights are of another axis {d!r}")
            cells = cells.join(w.hinted(k), d)
            value, n = value * F.col(f"__w{k}"), n * F.col(f"__n{k}")
            renamed[f"__new{k}"] = d
        others = [f"`{c}`" for x in self.axes if x.name not in by for c in x.cols]
        got = F.when(F.count("value") == F.max(n), F.sum(value))
        cells = cells.groupBy(*others, *renamed).agg(got.alias("value")).withColumnsRenamed(renamed)
        return self.make(cells, [by[x.name][1].new if x.name in by else x for x in self.axes])

    def regrid(self, weights: Sequence[Weights]):
        """Interpolated along the dimensions that it has of some weights."""
        mine = [w for w in weights if w.old.name in self.dims]
        if any(w.ends for w in mine):
            out = self
            for w in mine:
                out = out.interp_axis(w, w.old.name)
            return out
        return self._regrid(mine) if mine else self

    def _interp_open(self, i: int, new: Axis, left: float | None, right: float | None, method: str, extrapolate: bool):
        """interp_axis where the old or the new axis is open: an as-of join finds the labels around each new one."""
        a = self.axes[i]
        if not new.is_counted or a.by_pos or new.by_pos:
            raise ValueError("interpolation needs distinct labels in a table: use .ordered() on the other array")
        have, want = a.ordered(self.spark).ascending(), new.ordered(self.spark)
        met = have.neighbours(want.table.select("pos", "label"))
        x, low, high = F.col("label"), F.col("before.label"), F.col("after.label")
        if extrapolate and have.size > 1:  # outside, the first or last two labels
            first, second, last, before = have.at([0, 1, have.size - 1, have.size - 2])
            ends = F.when(low.isNull(), F.struct(F.lit(first).alias("l"), F.lit(second).alias("h"))).when(high.isNull(), F.struct(F.lit(before).alias("l"), F.lit(last).alias("h"))).otherwise(F.struct(low.alias("l"), high.alias("h")))
            met = met.withColumn("__ends", ends)
            low, high = F.col("__ends.l"), F.col("__ends.h")
        w = (x - low) / (high - low)
        pair = lambda k, weight, n: F.struct(k.alias("old"), weight.cast("double").alias("w"), F.lit(n).alias("n"))
        one = lambda k: F.array(pair(k, F.lit(1.0), 1))
        both = F.array(pair(low, 1 - w, 2), pair(high, w, 2))
        near = F.when(high - x < x - low, one(high)).otherwise(one(low))
        inside = low.isNotNull() & high.isNotNull()
        rows = F.when(x == low, one(low)).when(inside, near if method == "nearest" else both)
        t = met.select(x.alias("__new"), F.explode(rows).alias("p")).select(F.col("p.old").alias(a.name), "__new", F.col("p.w").alias("__w"), F.col("p.n").alias("__n"))
        t = F.broadcast(t) if want.small else t
        others = [c for x_ in self.rest(i) for c in x_.cols]
        got = F.when(F.count("value") == F.max("__n"), F.sum(F.col("value") * F.col("__w")))
        cells = self.cells.join(t, a.name).groupBy(*[f"`{c}`" for c in others], "__new").agg(got.alias("value")).withColumnRenamed("__new", a.name)
        for fill, off in ((left, F.col("before").isNull()), (right, F.col("after").isNull() & (F.col("before.label") != x))):
            if fill is not None and not extrapolate:
                keys = met.where(off).select(x.alias(a.name))
                cells = cells.unionByName(self._grid(self.spark, self.rest(i)).crossJoin(keys).withColumn("value", F.lit(float(fill))))
        return self.make(cells, [replace(new, name=a.name) if k == i else x_ for k, x_ in enumerate(self.axes)])

    def interp_like(self, other, **k):
        listed = [a for a in other.axes if a.name in self.dims and not a.is_open and not self.axis(a.name).is_open and a.numeric]
        out = self.regrid([weigh(self.spark, self.axis(a.name), a.values, **k) for a in listed])
        for a in other.axes:
            if a.name in self.dims and (a.is_open or self.axis(a.name).is_open):
                out = out.interp_axis(a, a.name, **k)
        return out

    def interp2d(self, newaxes, dims=(-2, -1), method: str = "linear", bounds_error: bool = True, fill_value: float | None = float("nan")):
        """Linear or nearest on the grid of two dimensions; fill_value=None extrapolates."""
        for values, d in zip(newaxes, dims, strict=True):
            old = self.axis(d).values
            if bounds_error and any(not min(old) <= x <= max(old) for x in values):
                raise ValueError(f"new labels are outside of {self.axis(d).name!r}")
        names = [self.axis(d).name for d in dims]
        fill = None if fill_value is None or fill_value != fill_value else fill_value
        made = [weigh(self.spark, self.axis(d), list(values), fill, fill, method, fill_value is None) for values, d in zip(newaxes, names, strict=True)]
        return self.regrid(made)
