"""Alignment: common axes, reindexing, broadcasting, stacking and concatenation."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace
from functools import reduce

from pyspark.sql import functions as F

from .. import options
from ..axis import Axis, as_axis, hinted, plain


class AlignOps:
    def _same_axes(self, other) -> None:
        if self.axes != other.axes:
            raise ValueError(f"axes differ: {self.dims} and {other.dims}, or their labels")

    def _rekey(self, i: int, new: Axis):
        """The same cells on an axis with other labels: those that new lacks go, the others keep their label."""
        a = self.axes[i]
        axes = [new if k == i else x for k, x in enumerate(self.axes)]
        if a.labels is None or a.labels == new.labels:
            return self.make(self.cells, axes)
        if not a.by_pos and not new.by_pos and a.key_type() == new.key_type():
            gone = set(a.values) - set(new.values)
            return self.make(self.cells, axes) if not gone else self.reindex_axis(new.values, a.name).make(self._reindexed(i, new).cells, axes)
        return self.make(self._reindexed(i, new).cells, axes)

    def _reindexed(self, i: int, new: Axis, find=None):
        a = self.axes[i]
        find = find or a.places.get
        pairs = [(a.key(p), new.key(k)) for k, x in enumerate(new.values) if (p := find(x)) is not None]
        t = self.spark.createDataFrame(pairs, f"`{a.name}` {a.key_type()}, __new {new.key_type()}")
        return self.make(self.cells.join(hinted(t, len(pairs)), a.name).drop(a.name).withColumnRenamed("__new", new.name), [new if k == i else x for k, x in enumerate(self.axes)])

    def reindex_axis(self, values, axis=0, fill_value=None, raise_error: bool = False, method: str | None = None):
        """The array on new labels; those it lacks are missing, or fill_value.

        method left: the first label at or after the asked one, right: the first after it; both the
        largest label where there is none.
        """
        new = values if isinstance(values, Axis) else None
        i = self.axis_no(new.name if new and isinstance(axis, int) else axis)
        if self.axes[i].is_open or new is not None and new.is_open:
            return self.ordered(i)._reindex_open(i, new if new is not None else Axis.of(self.axes[i].name, [plain(x) for x in values]), fill_value, raise_error, method)
        a = self.axes[i]
        if a.members:
            return self.one_key(i).reindex_axis(new.values if new else values, i, fill_value, raise_error, method)
        new = replace(new, name=a.name) if new else replace(Axis.of(a.name, [plain(x) for x in values], a.tol), attrs=dict(a.attrs))
        if method not in (None, "left", "right"):
            raise ValueError(f"no method {method!r}")
        if raise_error and method is None and (lost := [x for x in new.values if x not in a.places]):
            raise IndexError(f"labels {lost} are not on axis {a.name!r}")
        out = self._reindexed(i, new, (lambda x: a.search(x, method)) if method else None)
        holes = method is None and any(x not in a.places for x in new.values)
        if holes and fill_value is None and self.dtype in ("bigint", "int"):
            out = out.make(out.cells.withColumn("value", F.col("value").cast("double")), out.axes)
        if holes and fill_value is not None:
            absent = [new.key(k) for k, x in enumerate(new.values) if x not in a.places]
            filled = out.dense().cells
            kind = "double" if isinstance(fill_value, float) and self.dtype in ("bigint", "int") else self.dtype
            out = out.make(filled.withColumn("value", F.when(F.col(f"`{a.name}`").isin(*absent), F.lit(fill_value).cast(kind)).otherwise(F.col("value").cast(kind))), out.axes)
        return out

    def _reindex_open(self, i: int, new: Axis, fill_value, raise_error: bool, method: str | None):
        """reindex_axis where the old or the new axis is open: labels meet by a join of their tables, or by an as-of join."""
        a = self.axes[i]
        if method not in (None, "left", "right", "nearest"):
            raise ValueError(f"no method {method!r}")
        if a.members or a.by_pos:
            raise ValueError(f"labels of {a.name!r} repeat or are tuples")
        have = a.ordered(self.spark)
        if new.is_open and new.order is None:
            raise ValueError(f"axis {new.name!r} is open without a table: use .ordered() on its array")
        want = new.ordered(self.spark)
        key = F.col("pos" if new.by_pos else "label").alias("__new")
        lost = want.table.join(have.table.select("label"), "label", "left_anti").limit(1).collect() if method is None else []
        if raise_error and lost:
            raise IndexError(f"label {lost[0].label!r} and others are not on axis {a.name!r}")
        if method is None:
            pairs = want.table.select(key, F.col("label").cast(have.sql_type).alias(a.name)) if have.kind == want.kind else want.table.select(key, F.col("label").alias(a.name))
        else:
            met = have.ascending().neighbours(want.table.select("pos", "label"))
            same = F.col("before.label") == F.col("label")
            last = have.ascending().at([have.size - 1])[0] if have.size else None
            if method == "nearest":
                down, up = F.col("label") - F.col("before.label"), F.col("after.label") - F.col("label")
                tie = F.when(F.lit(have.way < 0), F.col("after.label")).otherwise(F.col("before.label"))
                found = F.when(up.isNull() | (down < up), F.col("before.label")).when(down.isNull() | (up < down), F.col("after.label")).otherwise(tie)
            else:
                found = F.coalesce(F.when(same & F.lit(method == "left"), F.col("before.label")), F.col("after.label"), F.lit(last))
            pairs = met.select(key, found.alias(a.name))
        pairs = pairs.where(F.col(f"`{a.name}`").isNotNull())
        pairs = F.broadcast(pairs) if want.small else pairs
        cells = self.cells.join(pairs, a.name).drop(a.name).withColumnRenamed("__new", a.name)
        kind = self.dtype
        if lost and (fill_value is None or isinstance(fill_value, float)) and kind in ("bigint", "int"):
            kind = "double"
        out = self.make(cells.withColumn("value", F.col("value").cast(kind)), [replace(new, name=a.name) if x is a else x for x in self.axes])
        if lost and fill_value is not None:
            gone = want.table.join(have.table.select("label"), "label", "left_anti").select(key.alias(a.name), F.lit(True).alias("__gone"))
            filled = out.dense().cells.join(gone, a.name, "left")
            out = out.make(filled.withColumn("value", F.when(F.col("__gone"), F.lit(fill_value).cast(kind)).otherwise(F.col("value"))), out.axes)
        return out

    def reindex_like(self, other, **k):
        out = self
        for a in other.axes:
            if a.name in self.dims:
                out = out.reindex_axis(a if a.is_open or out.axis(a.name).is_open else a.values, a.name, **k)
        return out

    def broadcast(self, other):
        """With the dimensions of other (an array or axes) too, in its order."""
        axes = list(getattr(other, "axes", other))
        out = self
        for a in axes:
            if a.name not in out.dims:
                out = out.newaxis(a.name, None if a.dummy else a.values)
            elif out.axis(a.name).dummy and not a.dummy:
                out = out.repeat(a.values, a.name)
        extra = [d for d in out.dims if d not in {a.name for a in axes}]
        return out.transpose(*[a.name for a in axes], *extra)


def common_axis(axes: Sequence[Axis], join: str) -> Axis:
    """Folded from the right."""
    real = [a for a in axes if not a.dummy]
    if not real:
        return axes[0]
    return reduce(lambda acc, a: a.union(acc) if join == "outer" else a.intersection(acc), reversed(real[:-1]), real[-1])


def align(*arrays, join: str | None = None, axis=None, sort: bool = False, strict: bool = False) -> list:
    """The arrays on common axes: union of labels for outer, intersection for inner.

    Only the axes' lists are merged; outer alignment moves no cell, since absent cells are missing.
    """
    arrays = list(arrays[0]) if len(arrays) == 1 and isinstance(arrays[0], (list, tuple)) else list(arrays)
    join = join or options.get_option("align.join")
    if join not in ("outer", "inner"):
        raise ValueError(f"no join {join!r}")
    dims = list(dict.fromkeys(d for a in arrays for d in a.dims))
    for d in dims if axis is None else [axis]:
        have = [i for i, a in enumerate(arrays) if d in a.dims]
        if strict and len(have) < len(arrays):
            raise ValueError(f"dimension {d!r} is not in all arrays")
        axes = [arrays[i].axis(d) for i in have]
        if all(not a.is_counted for a in axes):
            continue  # labels are those of the cells, and meet there
        if any(a.is_open for a in axes):
            arrays = [x.ordered(d) if k in have else x for k, x in enumerate(arrays)]
            _align_open(arrays, have, d, join, sort)
            continue
        new = common_axis(axes, join)
        if sort:
            new = new.take(new.sorted_by())
        for i in have:
            a = arrays[i].axis(d)
            if a.dummy or a == new:
                continue
            grown = set(new.values) - set(a.values)
            out = arrays[i]._rekey(arrays[i].axis_no(d), replace(new, name=d))
            if grown and out.dtype in ("bigint", "int"):
                out = out.make(out.cells.withColumn("value", F.col("value").cast("double")), out.axes)
            arrays[i] = out
    return arrays


def _align_open(arrays: list, have: list[int], d: str, join: str, sort: bool) -> None:
    """Axes of which one is open at least, on a table of common labels; outer alignment moves no cell here either."""
    new = common_axis([arrays[i].axis(d) for i in have], join)
    if sort:
        new = new.sort()
    for i in have:
        x = arrays[i]
        a = x.axis(d)
        if a.dummy or a.order is new.order:
            continue
        if a.by_pos:
            raise ValueError(f"labels of {d!r} repeat or are tuples: they can't be aligned with an open axis")
        axes = [replace(new, name=d) if y is a else y for y in x.axes]
        cells = x.cells.withColumn(d, F.col(f"`{d}`").cast(new.key_type()))
        if join == "inner" and new.size < a.size:
            cells = new.order.joined(cells, d, "left_semi")
        elif join == "outer" and new.size > a.size and x.dtype in ("bigint", "int"):
            cells = cells.withColumn("value", F.col("value").cast("double"))
        arrays[i] = x.make(cells, axes)


def align_dims(*arrays) -> list:
    """All dimensions on every array, in one order; those an array lacks are dummies."""
    dims = list(dict.fromkeys(d for a in arrays for d in a.dims))
    out = []
    for a in arrays:
        for d in dims:
            if d not in a.dims:
                a = a.newaxis(d)
        out.append(a.transpose(*dims))
    return out


def broadcast_arrays(*arrays) -> list:
    """All arrays on all dimensions; shared dimensions must have equal labels."""
    full: dict[str, Axis] = {}
    for a in arrays:
        for x in a.axes:
            if not x.dummy and full.setdefault(x.name, x) != x:
                raise ValueError(f"labels of {x.name!r} differ")
            full.setdefault(x.name, x)
    return [a.broadcast(list(full.values())) for a in arrays]


def _named(arrays, keys):
    if isinstance(arrays, dict):
        return list(arrays.values()), list(keys or arrays)
    return list(arrays), list(keys if keys is not None else range(len(arrays)))


def stack(arrays, axis: str | None = None, keys=None, align_: bool = False, sort: bool = False, join: str = "outer"):
    """Along a new first dimension. Other axes must be equal unless align_."""
    arrays, keys = _named(arrays, keys)
    dims = {d for a in arrays for d in a.dims}
    name = axis
    if name is None:
        name = next(n for n in ["unnamed", *[f"unnamed_{i}" for i in range(1, len(dims) + 2)]] if n not in dims)
    if name in dims:
        raise ValueError(f"dimension {name!r} exists")
    if align_:
        arrays = align(arrays, join=join, sort=sort, strict=True)
    for a in arrays[1:]:
        arrays[0]._same_axes(a)
    new = as_axis((name, keys))
    kind = "double" if len({a.dtype for a in arrays}) > 1 else arrays[0].dtype
    parts = [a.cells.select(F.lit(new.key(k)).cast(new.key_type()).alias(name), *[f"`{c}`" for x in a.axes for c in x.cols], F.col("value").cast(kind).alias("value")) for k, a in enumerate(arrays)]
    return arrays[0].make(reduce(lambda x, y: x.unionByName(y), parts), [new, *arrays[0].axes], keep=False)


def concatenate(arrays, axis=0, align_: bool = False, sort: bool = False, join: str = "outer"):
    """Along an existing dimension; labels are appended and may repeat."""
    arrays = list(arrays)
    i = arrays[0].axis_no(axis)
    d = arrays[0].dims[i]
    if align_:
        for other in [x for x in arrays[0].dims if x != d]:
            arrays = align(arrays, join=join, axis=other, sort=sort, strict=True)
    for a in arrays[1:]:
        if a.dims != arrays[0].dims or a.rest(a.axis_no(d)) != arrays[0].rest(i):
            raise ValueError("secondary axes differ: align them first")
    new = Axis.of(d, [x for a in arrays for x in a.axis(d).values])
    kind = "double" if len({a.dtype for a in arrays}) > 1 else arrays[0].dtype
    parts, at = [], 0
    for a in arrays:
        old = a.axis(d)
        cells = a.cells
        if new.by_pos or old.key_type() != new.key_type():
            t = a.spark.createDataFrame([(old.key(k), new.key(at + k)) for k in range(old.size)], f"`{d}` {old.key_type()}, __new {new.key_type()}")
            cells = cells.join(hinted(t, old.size), d).drop(d).withColumnRenamed("__new", d)
        parts.append(cells.withColumn("value", F.col("value").cast(kind)))
        at += old.size
    axes = [new if k == i else x for k, x in enumerate(arrays[0].axes)]
    return arrays[0].make(reduce(lambda x, y: x.unionByName(y), parts), axes, keep=False)


def array(data, keys=None, axis: str | None = None, align_: bool = True, broadcast: bool = True, join: str = "outer"):
    """A list or dict of arrays: aligned and broadcast, then stacked."""
    arrays, keys = _named(data, keys)
    if align_:
        arrays = align(arrays, join=join)
    if broadcast:
        arrays = broadcast_arrays(*arrays)
    return stack(arrays, axis, keys)
