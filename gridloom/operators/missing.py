"""Missing values."""

from __future__ import annotations

import math
from dataclasses import replace

from pyspark.sql import functions as F

from ..axis import plain


class MissingOps:
    def setna(self, value):
        """Cells that equal a value (or one of a list), or where a mask holds, become missing."""
        cells, hit = self.cells, F.lit(False)
        for k, x in enumerate(value if isinstance(value, list) else [value]):
            if isinstance(x, type(self)):
                self._same_axes(x)
                cols = [c for a in self.axes for c in a.cols]
                cells = cells.join(x.cells.withColumnRenamed("value", f"__m{k}"), cols, "left")
                hit = hit | F.coalesce(f"__m{k}", F.lit(False))
            else:
                hit = hit | F.coalesce(F.col("value") == F.lit(plain(x)), F.lit(False))
        return self.make(cells.withColumn("value", F.when(~hit, F.col("value"))), self.axes)

    def fillna(self, value):
        """Missing cells get a value; fills the grid."""
        kind = "double" if isinstance(value, float) and self.dtype in ("bigint", "int") else self.dtype
        return self.make(self.dense().cells.withColumn("value", F.coalesce(F.col("value").cast(kind), F.lit(value).cast(kind))), self.axes)

    def isna(self):
        return self.make(self.dense().cells.withColumn("value", F.col("value").isNull()), self.axes, keep=False)

    def dropna(self, axis=0, minvalid: int | None = None):
        """Labels whose slice has a missing cell go, or those with fewer than minvalid cells. One job finds them."""
        i = self.axis_no(axis)
        if self.axes[i].members:
            return self.one_key(i).dropna(i, minvalid)
        if self.axes[i].is_open:
            return self._dropna_open(self.ordered(i), i, minvalid)
        a = self.axes[i]
        others = 1
        for x in self.rest(i):
            others *= x.size
        need = others if minvalid is None else minvalid
        good = self.cells.groupBy(f"`{a.name}`").agg(F.count("value").alias("n")).where(F.col("n") >= need)
        keys = {r[0] for r in good.select(f"`{a.name}`").collect()}
        at = [k for k in range(a.size) if a.key(k) in keys or need <= 0]
        return self._pick(i, at)

    @staticmethod
    def _dropna_open(src, i: int, minvalid: int | None):
        """Along an open axis the labels that stay are a table too."""
        a = src.axes[i]
        need = math.prod(x.size for x in src.rest(i)) if minvalid is None else minvalid
        if need <= 0:
            return src
        good = src.cells.groupBy(F.col(f"`{a.name}`").alias("label")).agg(F.count("value").alias("n")).where(F.col("n") >= need)
        new = replace(a, order=a.order.kept(good))
        return src.make(new.order.joined(src.cells, a.name, "left_semi"), [new if x is a else x for x in src.axes])
