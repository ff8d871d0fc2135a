"""Accumulation and differences along an axis."""

from __future__ import annotations

import pickle
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import options
from ..axis import Axis
from ..scratch import keep
from .ranks import sliding

#: What a product of whole numbers beyond 64 bits has become; only a zero ends it.
BEYOND = "beyond"


def exact_product(x, y):
    """Of whole numbers, exact or BEYOND."""
    if x == 0 or y == 0:
        return 0
    if BEYOND in (x, y):
        return BEYOND
    p = x * y
    return p if -(1 << 63) <= p < 1 << 63 else BEYOND


def in_range(x):
    if x == BEYOND:
        raise OverflowError("a product of whole numbers exceeds 64 bits")
    return x


class ScanOps:
    def _scan(self, axis, skipna: bool, product: bool):
        i = self.axis_no(axis)
        if not self.axes[i].is_counted:
            return self.ordered(i)._scan(i, skipna, product)
        if product and self.dtype in ("bigint", "int"):
            return self.accumulate(exact_product, i, "bigint", skipna, start=1, back=in_range)
        a = self.axes[i]
        cells = self.with_pos(self.dense().cells, a)
        neutral = 1 if product else 0
        cast = "bigint" if self.dtype in ("bigint", "int") else self.dtype
        v = F.coalesce(F.col("value"), F.lit(neutral).cast(self.dtype)) if skipna else F.col("value")
        total = F.product if product else F.sum
        others = [c for x in self.rest(i) for c in x.cols]
        by = [f"`{c}`" for c in others]
        block = options.get_option("scan.block")
        if a.size <= block:
            w = self.window(a).rowsBetween(Window.unboundedPreceding, 0)
            out = total(v).over(w).cast(cast)
            ok = F.count("value").over(w) == F.count(F.lit(1)).over(w)
            return self.make(cells.withColumn("value", out if skipna else F.when(ok, out)), self.axes)
        # long lines: totals of blocks first, then sums inside each block on top of them
        pos = self.order(a)
        cells = self._cut(cells, a, block)
        before = Window.partitionBy(*by).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
        sums = cells.groupBy(*by, "__block").agg(total(v).cast(cast).alias("__t"), (F.count("value") == F.count(F.lit(1))).alias("__ok"))
        sums = sums.select(*by, "__block", F.coalesce(total("__t").over(before).cast(cast), F.lit(neutral).cast(cast)).alias("__base"), F.coalesce(F.bool_and("__ok").over(before), F.lit(True)).alias("__fine"))
        w = Window.partitionBy(*by, "__block").orderBy(*pos).rowsBetween(Window.unboundedPreceding, 0)
        inner = total(v).over(w).cast(cast)
        ok = F.count("value").over(w) == F.count(F.lit(1)).over(w)
        cells = cells.withColumns({"__in": inner, "__all": ok}).join(sums, [*others, "__block"])
        out = F.col("__base") * F.col("__in") if product else F.col("__base") + F.col("__in")
        return self.make(cells.withColumn("value", out if skipna else F.when(F.col("__all") & F.col("__fine"), out)), self.axes)

    def _cut(self, cells, a: Axis, block: int):
        """cells with their position along the axis, flattened or not, and the block of so many positions that it is in."""
        at = F.lit(0).cast("bigint")
        for m, p in zip([m for m in a.levels if not m.dummy], self.order(a), strict=True):
            at = at * m.size + p
        return cells.withColumn("__at", at).withColumn("__block", F.expr(f"__at div {block}"))

    def _beside(self, cells, a: Axis, f, back: int = 0, ahead: int = 0):
        """cells with the value f(window), where the window looks so many cells back and ahead.

        Long lines are cut into blocks; a cell goes to the next block, or the one before, as well if windows there look at it.
        """
        block = max(options.get_option("scan.block"), back, ahead)
        if a.size <= block:
            return cells.withColumn("value", f(self.window(a)))
        cells = self._cut(cells, a, block).withColumnRenamed("__block", "__own")
        own, place = F.col("__own"), F.col("__at") % block
        seen = F.array(own, F.when(place >= block - back, own + 1), F.when(place < ahead, own - 1))
        cells = cells.withColumn("__block", F.explode(F.array_compact(seen)))
        others = [f"`{c}`" for x in self.axes if x is not a for c in x.cols]
        w = Window.partitionBy(*others, "__block").orderBy("__at")
        return cells.withColumn("value", f(w)).where("__block = __own")

    def accumulate(self, join: Callable, axis=-1, dtype: str | None = None, skipna: bool = False, start=None, of: Callable = lambda x: x, back: Callable = lambda x: x):
        """The running result of any associative function of two values, in order along an axis.

        Long lines are cut into blocks: each block gives its total, the totals before a block give what it begins
        with, and then each block runs on its own, so a line takes many tasks. join works on states:
        of(value) makes one and back(state) gives a value of type dtype. A missing cell makes all later ones
        missing; with skipna it is passed over, and start is the result before the first value.
        """
        i = self.axis_no(axis)
        if not self.axes[i].is_counted:
            return self.ordered(i).accumulate(join, i, dtype, skipna, start, of, back)
        a = self.axes[i]
        dtype = dtype or self.dtype
        cells = self._cut(self.with_pos(self.dense().cells, a), a, options.get_option("scan.block"))
        others, own = [c for x in self.rest(i) for c in x.cols], list(a.cols)
        kinds = dict(self.cells.dtypes)
        whole = self.dtype in ("bigint", "int")

        def run(state, values) -> list:
            """States after each value; None before the first, and for good after a missing one."""
            out, lost = [], state == "lost"
            for v in values:
                if v is None or v != v:
                    lost = lost or not skipna
                elif not lost:
                    x = of(int(v) if whole else v)
                    state = (x,) if state is None else (join(state[0], x),)
                out.append("lost" if lost else state)
            return out

        def plain(values: pd.Series) -> list:
            return [None if pd.isna(v) else v for v in values]

        by = [f"`{c}`" for c in others]
        named = [*by, "__block"]
        texts = cells.select(*named, "__at", *[f"`{c}`" for c in own], F.col("value").cast("string").alias("__v") if whole else F.col("value").alias("__v"))

        def total(pdf: pd.DataFrame) -> pd.DataFrame:
            last = run(None, plain(pdf.sort_values("__at")["__v"]))[-1]
            return pdf.head(1)[[*others, "__block"]].assign(__state=[pickle.dumps(last)])

        def carry(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("__block")
            state, before = None, []
            for x in pdf["__state"]:
                before.append(pickle.dumps(state))
                x = pickle.loads(x)
                state = "lost" if "lost" in (state, x) else x if state is None else state if x is None else (join(state[0], x[0]),)
            return pdf.assign(__state=before)

        def finish(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("__at")
            states = run(pickle.loads(pdf["__state"].iloc[0]), plain(pdf["__v"]))
            values = [None if s == "lost" else start if s is None else back(s[0]) for s in states]
            return pdf[[*others, *own]].assign(value=pd.Series(values, index=pdf.index, dtype=object))

        key = ", ".join([*[f"`{c}` {kinds[c]}" for c in others], "__block bigint", "__state binary"])
        sums = texts.groupBy(*named).applyInPandas(total, key)
        sums = keep(sums.groupBy(*by).applyInPandas(carry, key), "carry")  # a row for each block
        out = ", ".join([*[f"`{c}` {kinds[c]}" for c in [*others, *own]], f"value {dtype}"])
        done = texts.join(sums, [*others, "__block"]).groupBy(*named).applyInPandas(finish, out)
        return self.make(done, self.axes)

    def cumsum(self, axis=-1, skipna: bool = False):
        return self._scan(axis, skipna, False)

    def cumprod(self, axis=-1, skipna: bool = False):
        return self._scan(axis, skipna, True)

    def moving(self, op: str, width: int, axis=-1, skipna: bool = False):
        """sum, mean, min, max, std, var, median, rank, argmin or argmax over the last width cells; missing before the first full window.

        rank is the last cell's place in its window from -1 to 1; argmin and argmax count the cells back to the nearest such cell.
        """
        if op in ("median", "rank", "argmin", "argmax"):
            return self._moving_order(op, width, axis, skipna)
        i = self.axis_no(axis)
        if not self.axes[i].is_counted:
            return self.ordered(i).moving(op, width, i, skipna)
        a = self.axes[i]
        cells = self.with_pos(self.dense().cells, a)
        total = {"sum": F.sum, "mean": F.avg, "min": F.min, "max": F.max, "std": F.stddev_pop, "var": F.var_pop}[op]

        def over(w):
            w = w.rowsBetween(-(width - 1), 0)
            ok = (F.count(F.lit(1)).over(w) == width) & (F.lit(skipna) | (F.count("value").over(w) == width))
            return F.when(ok, total("value").over(w))

        return self.make(self._beside(cells, a, over, back=width - 1), self.axes)

    def _moving_order(self, op: str, width: int, axis, skipna: bool):
        """Windows that keep their cells in order, by blocks that also hold the cells that their windows look back at."""
        i = self.axis_no(axis)
        if not self.axes[i].is_counted:
            return self.ordered(i)._moving_order(op, width, i, skipna)
        a = self.axes[i]
        block = max(options.get_option("scan.block"), width)
        cells = self._cut(self.with_pos(self.dense().cells, a), a, block).withColumnRenamed("__block", "__own")
        cells = cells.withColumn("__block", F.explode(F.array_compact(F.array("__own", F.when(F.col("__at") % block >= block - width + 1, F.col("__own") + 1)))))
        others, own = [c for x in self.rest(i) for c in x.cols], list(a.cols)
        kinds = dict(self.cells.dtypes)

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("__at")
            got = sliding(op, pdf["value"].astype("float64").to_numpy(), width, skipna)
            pdf = pdf[[*others, *own, "__own", "__block", "__at"]].assign(value=got)
            return pdf[pdf["__own"] == pdf["__block"]][[*others, *own, "value"]]

        schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in [*others, *own]], "value double"])
        done = cells.select(*[f"`{c}`" for c in [*others, *own]], F.col("value").cast("double").alias("value"), "__at", "__own", "__block").groupBy(*[f"`{c}`" for c in others], "__block").applyInPandas(run, schema)
        return self.make(done.withColumn("value", F.when(~F.isnan("value"), F.col("value"))), self.axes)

    def diff(self, axis=-1, scheme: str = "backward", keepaxis: bool = False, n: int = 1):
        if n > 1:
            return self.diff(axis, scheme, keepaxis).diff(axis, scheme, keepaxis, n - 1)
        if scheme not in ("backward", "forward", "centered"):
            raise ValueError(f"no scheme {scheme!r}")
        if keepaxis and scheme == "centered":
            raise ValueError("centered differences have labels of their own")
        i = self.axis_no(axis)
        if self.axes[i].members:
            if scheme == "centered":
                raise ValueError("labels of several dimensions have no mean")
            return self.one_key(i).diff(i, scheme, keepaxis)
        if not self.axes[i].is_counted:
            return self.ordered(i).diff(i, scheme, keepaxis)
        a = self.axes[i]
        cells = self.with_pos(self.dense().cells, a)
        pos = self.order(a)[0]
        if scheme == "forward":
            cells = self._beside(cells, a, lambda w: F.lead("value").over(w) - F.col("value"), ahead=1)
        else:
            cells = self._beside(cells, a, lambda w: F.col("value") - F.lag("value").over(w), back=1)
        if keepaxis:
            if self.dtype in ("bigint", "int"):
                cells = cells.withColumn("value", F.col("value").cast("double"))
            return self.make(cells, self.axes)
        m = a.size
        if scheme == "forward":
            cells, new = cells.where(pos < m - 1), a.take(range(m - 1))
        elif scheme == "backward":
            cells, new = cells.where(pos > 0), a.take(range(1, m))
        else:
            cells, new = cells.where(pos > 0), a.midpoints()
        axes = [new if k == i else x for k, x in enumerate(self.axes)]
        if scheme == "forward" or (new.by_pos == a.by_pos and not new.by_pos and scheme == "backward"):
            if new.by_pos == a.by_pos:
                return self.make(cells, axes)
        first = 0 if scheme == "forward" else 1
        keys = new.hinted(self.spark).withColumn("__pos", F.col("__pos") + first).withColumnsRenamed({"__pos": f"__pos_{a.name}"})
        return self.make(cells.drop(a.name).join(keys, f"__pos_{a.name}"), axes)
