"""LabelArray: an N-dimensional array with named, labelled dimensions over a Spark DataFrame.

Cells are rows (one key column a dimension, value). A cell that is absent or null is missing, so
arrays may be sparse; operations that turn missing cells into values fill the grid first. The order
of dimensions and the axes are metadata on the driver: nothing moves to transpose, flatten or rename.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Sequence
from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import options
from .axis import Axis, as_axes, plain
from .operators.align import AlignOps
from .operators.arith import ArithOps
from .operators.index import IndexOps
from .operators.interp import InterpOps
from .operators.missing import MissingOps
from .operators.reduce import ReduceOps
from .operators.scan import ScanOps
from .operators.shape import ShapeOps
from .scratch import keep


def clean(value: Column, kind: str) -> Column:
    """NaN becomes null at the door."""
    return F.when(F.isnan(value), F.lit(None)).otherwise(value) if kind in ("double", "float") else value


def without_nan(cells: DataFrame) -> DataFrame:
    """Results that are no number are missing as well."""
    return cells.withColumn("value", clean(F.col("value"), dict(cells.dtypes)["value"]))


class LabelArray(IndexOps, AlignOps, ArithOps, ReduceOps, ScanOps, InterpOps, MissingOps, ShapeOps):
    def __init__(self, cells: DataFrame, axes: Sequence[Axis], attrs: dict | None = None, by: str | None = None):
        self.axes = tuple(axes)
        self.cells = cells.select(*[F.col(f"`{c}`") for a in self.axes for c in a.cols], "value")
        self.attrs = dict(attrs or {})
        self.by = by or options.get_option("indexing.by")

    # -- constructors -------------------------------------------------------------------------

    @classmethod
    def from_dataframe(cls, df: DataFrame, dims: Sequence[str], value: str = "value", axes: dict | None = None, listed: bool | str = True, attrs: dict | None = None, aggregate: Callable[[Column], Column] | None = None) -> LabelArray:
        """From rows with one column a dimension; the dims must identify a row, or rows are aggregated first.

        aggregate: a function of the value column, such as F.sum; where labels are to be found as well, the
        aggregated cells are written once to the shared folder, so that the rows are read once, whatever
        is asked of the array. Rows with a null label are left out.

        axes: known labels by dimension; other axes list the sorted distinct labels found (one job
        for all), or stay open with listed=False; with listed="ordered" open axes get a table of labels at once. Rows with labels off a given axis are left out.
        """
        kind = dict(df.dtypes)[value]
        cells = df.select(*[F.col(f"`{d}`") for d in dims], clean(F.col(f"`{value}`"), kind).alias("value")).dropna(subset=list(dims)) if dims else df.select(clean(F.col(f"`{value}`"), kind).alias("value"))
        if aggregate is not None:
            cells = cells.groupBy(*[f"`{d}`" for d in dims]).agg(aggregate(F.col("value")).alias("value"))
        axes = dict(axes or {})
        ask = [d for d in dims if d not in axes and listed is True]
        if aggregate is not None and (ask or listed == "ordered"):
            cells = keep(cells, "cells")
        if ask:
            found = cells.select(*[F.array_sort(F.collect_set(d)).alias(d) for d in ask]).first()
            axes |= {d: found[d] for d in ask}
        out = []
        for d in dims:
            a = axes.get(d)
            a = a if isinstance(a, Axis) else Axis.of(d, a)
            if d not in ask and a.labels is not None:
                cells = cells.where(F.col(d).isin(*a.labels)) if a.size <= 1000 else cells.join(a.hinted(cells.sparkSession).select(d), d, "left_semi")
            out.append(a)
        made = cls(cells, out, attrs)
        for i in range(made.ndim if listed == "ordered" else 0):
            made = made.ordered(i)
        return made

    @classmethod
    def from_values(cls, spark: SparkSession, values, axes=None, dims: Sequence[str] | None = None, attrs: dict | None = None, **more) -> LabelArray:
        """From a NumPy array, masked array or nested list; small arrays only."""
        mask = np.ma.getmaskarray(values) if isinstance(values, np.ma.MaskedArray) else None
        values = np.asarray(values)
        axes = as_axes(axes, dims, values.shape)
        axes = [Axis.of(a.name, range(n)) if a.labels is None and not a.dummy else a for a, n in zip(axes, values.shape, strict=True)]
        if tuple(a.size for a in axes) != values.shape:
            raise ValueError(f"values have shape {values.shape}, axes {tuple(a.size for a in axes)}")
        kind = {"i": "bigint", "u": "bigint", "f": "double", "b": "boolean"}.get(values.dtype.kind, "string")
        rows = []
        for at, v in np.ndenumerate(values):
            v = None if mask is not None and mask[at] else plain(v)
            v = None if isinstance(v, float) and math.isnan(v) else v if kind != "string" or v is None else str(v)
            rows.append((*[a.key(i) for a, i in zip(axes, at, strict=True)], v))
        schema = ", ".join([*[f"`{a.name}` {a.key_type()}" for a in axes], f"value {kind}"])
        return cls(spark.createDataFrame(rows, schema), axes, (attrs or {}) | more)

    @classmethod
    def from_nested(cls, spark: SparkSession, nested, labels: Sequence | None = None, dims: Sequence[str] | None = None, align: bool = True) -> LabelArray:
        """From nested dicts and lists; dict keys are labels, and unequal ones are aligned."""
        cells: dict[tuple, object] = {}
        found: list[dict] = []

        def walk(x, at: tuple):
            items = list(x.items()) if isinstance(x, dict) else list(enumerate(x)) if isinstance(x, (list, tuple, np.ndarray)) else None
            if items is None:
                cells[at] = plain(x)
                return
            if len(found) <= len(at):
                found.append({})
            for k, v in items:
                found[len(at)].setdefault(plain(k))
                walk(v, (*at, plain(k)))

        walk(nested, ())
        axes = [Axis.of(dims[i] if dims else f"x{i}", labels[i] if labels else list(f)) for i, f in enumerate(found)]
        if not align and len(cells) != math.prod(a.size for a in axes):
            raise ValueError("the parts have unequal labels")
        names = [{k: a.values[j] for j, k in enumerate(f)} for a, f in zip(axes, found, strict=True)]
        shape = tuple(a.size for a in axes)
        out = np.full(shape, np.nan, dtype=object)
        for at, v in cells.items():
            out[tuple(a.places[n[k]] for a, n, k in zip(axes, names, at, strict=True))] = v
        full = len(cells) == out.size
        return cls.from_values(spark, np.array(out.tolist()) if full else out.astype(float), axes)

    @classmethod
    def constant(cls, spark: SparkSession, value, axes=None, dims=None, shape=None, attrs: dict | None = None) -> LabelArray:
        axes = as_axes(axes, dims, shape)
        out = cls._grid(spark, axes).withColumn("value", F.lit(value))
        return cls(out, axes, attrs)

    @classmethod
    def from_pandas(cls, spark: SparkSession, data: pd.Series | pd.DataFrame, dims: Sequence[str] | None = None) -> LabelArray:
        s = data.stack(future_stack=True) if isinstance(data, pd.DataFrame) else data
        names = list(dims or [n or f"x{i}" for i, n in enumerate(s.index.names)])
        if s.index.nlevels == 1:
            return cls.from_values(spark, s.to_numpy(), [(names[0], list(s.index))])
        levels = [list(dict.fromkeys(s.index.get_level_values(i))) for i in range(s.index.nlevels)]
        return cls.from_values(spark, s.reindex(pd.MultiIndex.from_product(levels)).to_numpy().reshape([len(x) for x in levels]), list(zip(names, levels, strict=True)))

    @classmethod
    def from_json(cls, spark: SparkSession, data: str | dict) -> LabelArray:
        from .sources.jsons import load

        return load(spark, data)

    @classmethod
    def from_json_column(cls, df: DataFrame, column: str, dims: Sequence[str], keep: Sequence[str] = (), kinds: dict[str, str] | None = None, value: str = "double", **how) -> LabelArray:
        """From a column of nested JSON texts, one or many a table; nothing of it passes the driver but the labels.

        keep: columns of df that are dimensions too, before dims, the levels of the JSON. Other arguments as for from_dataframe.
        """
        from .sources.jsons import cells_of

        return cls.from_dataframe(cells_of(df, column, dims, keep, kinds, value), [*keep, *dims], **how)

    # -- description --------------------------------------------------------------------------

    spark = property(lambda self: self.cells.sparkSession)
    dims = property(lambda self: tuple(a.name for a in self.axes))
    labels = property(lambda self: tuple(a.values for a in self.axes))
    ndim = property(lambda self: len(self.axes))
    shape = property(lambda self: tuple(a.size for a in self.axes))
    size = property(lambda self: math.prod(self.shape))
    dtype = property(lambda self: dict(self.cells.dtypes)["value"])

    def __getattr__(self, name: str):
        if name.startswith("_") or name == "axes":
            raise AttributeError(name)
        for a in self.axes:
            if a.name == name:
                return AxisValues(a)
        if name in self.__dict__.get("attrs", {}):
            return self.attrs[name]
        raise AttributeError(name)

    def axis(self, which) -> Axis:
        return self.axes[self.axis_no(which)]

    def axis_no(self, which) -> int:
        if isinstance(which, (int, np.integer)):
            return range(self.ndim)[which]
        if which not in self.dims:
            raise ValueError(f"no dimension {which!r}; there are {self.dims}")
        return self.dims.index(which)

    def axis_nos(self, which) -> list[int]:
        """Of one axis, a tuple of them, or all for None."""
        return list(range(self.ndim)) if which is None else [self.axis_no(x) for x in which] if isinstance(which, (tuple, list)) else [self.axis_no(which)]

    def rest(self, *gone: int) -> list[Axis]:
        return [a for i, a in enumerate(self.axes) if i not in gone]

    def make(self, cells: DataFrame, axes: Sequence[Axis], keep: bool = True) -> LabelArray:
        return type(self)(cells, axes, self.attrs if keep else None, self.by)

    def copy(self, shallow: bool = False) -> LabelArray:
        from copy import deepcopy

        return type(self)(self.cells, self.axes if shallow else deepcopy(self.axes), self.attrs if shallow else deepcopy(self.attrs), self.by)

    def __repr__(self) -> str:
        return "\n".join([f"labelled array of {self.dtype}", *map(self._axis_line, range(self.ndim))])

    def _axis_line(self, i: int) -> str:
        a = self.axes[i]
        return f"{i} / {a.name} (" + (f"{a.size}, " if a.order else "") + "open)" if a.is_open else f"{i} / {a.name} ({a.size})" + (f": {a.values[0]} to {a.values[-1]}" if a.size else "")

    def summary(self) -> str:
        """The repr with counts of cells and with attributes; runs a job."""
        n = self.cells.agg(F.count("value")).first()[0]
        head = f"{n} non-null elements" + (f" ({self.size - n} null)" if all(a.is_counted for a in self.axes) else "")
        lines = [head, *map(self._axis_line, range(self.ndim)), *[f"{k}: {v!r}" for k, v in self.attrs.items()]]
        if all(a.is_counted for a in self.axes) and self.size <= options.get_option("display.max"):
            lines.append(repr(self.values))
        return "\n".join(lines)

    # -- cells --------------------------------------------------------------------------------

    @staticmethod
    def _grid(spark: SparkSession, axes: Sequence[Axis]) -> DataFrame:
        """All combinations of the axes' keys: the grid itself is what is asked for here."""
        out = spark.range(1).select()
        for a in (m for x in axes if not x.dummy for m in x.levels):
            out = out.crossJoin(a.hinted(spark).select(a.name))
        return out

    def dense(self) -> LabelArray:
        """With a row for every cell of the grid, null where missing."""
        if not all(a.is_counted for a in self.axes):
            out = self
            for i in range(self.ndim):
                out = out.ordered(i)
            return out.dense()
        cols = [c for a in self.axes for c in a.cols]
        if not cols:
            return self
        grid = self._grid(self.spark, self.axes)
        return self.make(grid.join(self.cells, cols, "left"), self.axes)

    def with_pos(self, cells: DataFrame, axis: Axis, prefix: str = "__pos_") -> DataFrame:
        """cells with the position on each level of the axis."""
        for a in () if axis.dummy else axis.levels:
            name = f"{prefix}{a.name}"
            if a.by_pos:
                cells = cells.withColumn(name, F.col(f"`{a.name}`"))
            elif a.order:
                cells = cells.join(a.hinted(self.spark, pos=name), a.name)
            elif a.kind == "int" and a.size and a.values == tuple(range(a.values[0], a.values[0] + a.size)):
                cells = cells.withColumn(name, F.col(f"`{a.name}`") - a.values[0])
            else:
                cells = cells.join(a.hinted(self.spark, pos=name), a.name)
        return cells

    def order(self, axis: Axis, prefix: str = "__pos_") -> list[Column]:
        return [F.col(f"`{prefix}{a.name}`") for a in axis.levels if not a.dummy]

    def one_key(self, i: int):
        """The same cells with a flattened axis keyed by position on its own, and tuples as labels."""
        a = self.axes[i]
        if not a.members:
            return self
        cells = self.with_pos(self.cells, a)
        at = F.lit(0).cast("bigint")
        for m, p in zip(a.members, self.order(a), strict=True):
            at = at * m.size + p
        new = replace(Axis.of(a.name, a.values, a.tol), attrs=dict(a.attrs))
        return self.make(cells.withColumn(a.name, at), [new if x is a else x for x in self.axes])

    def window(self, axis: Axis):
        others = [c for a in self.axes if a is not axis for c in a.cols]
        w = Window.partitionBy(*[f"`{c}`" for c in others]) if others else Window.partitionBy()
        return w.orderBy(*self.order(axis))

    def to_dataframe(self, dense: bool = False) -> DataFrame:
        """Rows of labels and value."""
        src = self.dense() if dense else self
        out = src.cells
        names = []
        for a in (m for x in self.axes for m in x.levels if not x.dummy):
            if not a.by_pos:
                names.append(a.name)
            elif a.order:  # tuples as well: a struct with a field for each dimension
                t = a.hinted(self.spark, label="__label")
                parts = [f.name for f in t.schema["__label"].dataType.fields]
                out = out.join(t, a.name).drop(a.name, "__pos").select("*", *[F.col(f"__label.`{p}`").alias(p) for p in parts]).drop("__label")
                names += parts
            elif a.kind == "tuple":  # a column for each dimension of such labels
                parts = a.name.split(",")
                own = parts if len(parts) == len(a.values[0]) else [f"{a.name}_{i}" for i in range(len(a.values[0]))]
                t = a.parts(self.spark, [f"__label_{n}" for n in own])
                out = out.join(t, a.name).drop(a.name).withColumnsRenamed({f"__label_{n}": n for n in own})
                names += own
            else:
                t = a.hinted(self.spark, label="__label")
                out = out.join(t, a.name).drop(a.name, "__pos").withColumnRenamed("__label", a.name)
                names.append(a.name)
        return out.select(*[F.col(f"`{c}`") for c in names], "value")

    @property
    def values(self) -> np.ndarray:
        """The cells on the driver as a NumPy array; missing numbers are NaN."""
        cells = self.cells
        for a in self.axes:
            cells = self.with_pos(cells, a)
        pdf = cells.select(*[c for a in self.axes for c in self.order(a)], "value").toPandas()
        levels = [m for a in self.axes if not a.dummy for m in a.levels]
        full = len(pdf) == math.prod(m.size for m in levels) and pdf["value"].notna().all()
        kind = {"bigint": "int64", "int": "int64", "boolean": "bool"}.get(self.dtype, "float64" if self.dtype in ("double", "float") else "object")
        out = np.full([m.size for m in levels], np.nan if kind != "object" else None, dtype=kind if full or kind == "object" else "float64")
        if not levels:
            found = pdf["value"].dropna()
            only = np.asarray(found.iloc[0] if len(found) else np.nan)
            return only.reshape(self.shape) if self.ndim else only[()]
        if len(pdf):
            out[tuple(pdf[f"__pos_{m.name}"].to_numpy(dtype="int64") for m in levels)] = pdf["value"].to_numpy()
        return out.reshape(self.shape)

    def item(self):
        if self.size != 1:
            raise ValueError("more than one cell")
        return plain(np.asarray(self.values).reshape(-1)[0])

    def __float__(self) -> float:
        return float(self.item())

    def __int__(self) -> int:
        return int(self.item())

    def __bool__(self) -> bool:
        return bool(self.item())

    def __contains__(self, value) -> bool:
        return not self.cells.where(F.col("value") == value).isEmpty()

    def __len__(self) -> int:
        return self.shape[0]

    def to_pandas(self):
        v = self.values
        if self.ndim == 1:
            a = self.axes[0]
            index = pd.MultiIndex.from_tuples(a.values, names=[m.name for m in a.members]) if a.members else pd.Index(a.values, name=a.name)
            return pd.Series(v, index=index)
        if self.ndim == 2:
            return pd.DataFrame(v, index=pd.Index(self.labels[0], name=self.dims[0]), columns=pd.Index(self.labels[1], name=self.dims[1]))
        return pd.Series(v.reshape(-1), index=pd.MultiIndex.from_product(self.labels, names=self.dims))

    def to_masked(self) -> np.ma.MaskedArray:
        v = self.values
        return np.ma.masked_invalid(v) if v.dtype.kind == "f" else np.ma.array(v)

    def to_list(self, axis=0) -> list:
        return [x for _, x in self.iter(axis)]

    def to_json(self, **k) -> str:
        from .sources.jsons import dump

        return dump(self, **k)

    def iter(self, axis=0, keepdims: bool = False) -> Iterable[tuple]:
        """(label, slice) along an axis; one query a label, so for small axes."""
        i = self.axis_no(axis)
        for at, label in enumerate(self.axes[i].values):
            yield label, self.take([at] if keepdims else at, axis=i, indexing="position")

    def __iter__(self):
        return self.iter()

    def to_dataset(self, axis=0):
        from .dataset import Dataset

        return Dataset({str(k): v for k, v in self.iter(axis)})

    def apply(self, f: Callable, dtype: str | None = None) -> LabelArray:
        """Elementwise. f maps a Column to a Column; with dtype it is a vectorised Python function on pandas Series instead."""
        if dtype:
            f = F.pandas_udf(f, dtype)
        return self.make(without_nan(self.cells.withColumn("value", f(F.col("value")))), self.axes, keep=False)

    def write(self, path: str, mode: str = "w", name: str = "value", **how):
        from .sources.store import write_array

        return write_array(self, path, mode, name, **how)

    def __setattr__(self, name: str, value) -> None:
        """Unknown names are attributes of the array; dims, labels and the name of a dimension change the axes in place."""
        if name == "dims":
            new = self.rename(**dict(zip(self.dims, value, strict=True)))
            self.cells, self.axes = new.cells, new.axes
        elif name == "labels" or name in [a.name for a in self.__dict__.get("axes", ())]:
            new = self
            for d, labels in zip(self.dims, value, strict=True) if name == "labels" else [(name, value)]:
                new = new.set_axis(list(labels), axis=d)
            self.cells, self.axes = new.cells, new.axes
        elif name in ("axes", "cells", "attrs", "by") or name.startswith("_"):
            object.__setattr__(self, name, value)
        else:
            self.attrs[name] = value

    def rename(self, **names: str) -> LabelArray:
        """Dimensions by new names."""
        cells, axes = self.cells, []
        for a in self.axes:
            new = names.get(a.name, a.name)
            if not a.members and not a.dummy and new != a.name:
                cells = cells.withColumnRenamed(a.name, new)
            axes.append(replace(a, name=new))
        return self.make(cells, axes)


class AxisValues(np.ndarray):
    """Labels of an axis as a NumPy array, for a[a.x0 > 0]."""

    def __new__(cls, axis: Axis):
        return np.array(axis.values, dtype=object if axis.kind in ("str", "time", "date") else None).view(cls)
