"""Indexing: labels by default, positions, nearest labels, masks, points; assignment."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import replace

import numpy as np
from pyspark.sql import functions as F

from .. import options
from ..axis import Axis, hinted, plain
from ..ordered import Labels, number


def _is_bool(x) -> bool:
    return isinstance(x, (list, tuple, np.ndarray)) and len(x) > 0 and all(isinstance(v, (bool, np.bool_)) for v in x)


class Indexer:
    def __init__(self, array, how: str, tol: float | None = None):
        self.array, self.how, self.tol = array, how, tol

    def __getitem__(self, key):
        return self.array.take(key, indexing=self.how, tol=self.tol)

    def __setitem__(self, key, value):
        self.array.put(key, value, indexing=self.how, tol=self.tol, inplace=True)


class IndexOps:
    ix = property(lambda self: Indexer(self, "position" if self.by == "label" else "label"))
    iloc = property(lambda self: Indexer(self, "position"))
    loc = property(lambda self: Indexer(self, "label"))
    nloc = property(lambda self: Indexer(self, "label", float("inf")))

    def __getitem__(self, key):
        return self.take(key)

    def __setitem__(self, key, value):
        self.put(key, value, inplace=True)

    def sel(self, tol: float | None = None, **by):
        return self.take(by, indexing="label", tol=tol)

    def isel(self, **by):
        return self.take(by, indexing="position")

    # -- resolving ----------------------------------------------------------------------------

    def _by_axis(self, key, axis) -> dict[int, object]:
        if isinstance(key, dict):
            return {self.axis_no(k): v for k, v in key.items()}
        if isinstance(key, tuple) and axis is None or isinstance(axis, (tuple, list)):
            key = list(key)
            if any(k is Ellipsis for k in key):
                at = next(i for i, k in enumerate(key) if k is Ellipsis)
                key[at : at + 1] = [slice(None)] * (self.ndim - len(key) + 1)
            if len(key) > self.ndim:
                raise IndexError("more indices than dimensions")
            nos = self.axis_nos(axis) if axis is not None else range(len(key))
            return dict(zip(nos, key, strict=False))
        if key is Ellipsis:
            return {}
        return {self.axis_no(0 if axis is None else axis): key}

    @staticmethod
    def _positions(a: Axis, key, how: str, tol: float | None):
        """An int, or a list of positions; of a slice of an open axis a range."""
        key = plain(key)
        n = a.size
        if isinstance(key, slice):
            run = range(n)[key] if how == "position" else a.locate_slice(key)
            return run if a.order else list(run)
        if _is_bool(key):
            if len(key) != n:
                raise IndexError(f"the mask has {len(key)} entries, axis {a.name!r} {n} labels")
            return [i for i, k in enumerate(key) if k]
        if isinstance(key, (list, np.ndarray, range)):
            keys = [plain(k) for k in (key.tolist() if isinstance(key, np.ndarray) else key)]
            return a.locate_all(keys, tol) if a.order and how != "position" else [IndexOps._positions(a, k, how, tol) for k in keys]
        if how == "position":
            if not -n <= key < n:
                raise IndexError(f"position {key} is off axis {a.name!r} of size {n}")
            return key % n
        return a.locate(key, tol)

    def take(self, indices, axis=None, indexing: str | None = None, tol: float | None = None, keepdims: bool = False, broadcast: bool = False):
        """A scalar index drops its dimension, a list or slice keeps it; lists on several dimensions act independently.

        broadcast=True: lists on several dimensions are points, along a new dimension named after them.
        """
        how = indexing or self.by
        if isinstance(indices, type(self)) and indices.dtype == "boolean" and indices.ndim == self.ndim:
            if self.ndim > 1 or self.axes[0].is_open:
                return self.compress(indices)
            indices = indices.values
        asked = self._by_axis(indices, axis)
        if broadcast and sum(isinstance(k, (list, np.ndarray)) for k in asked.values()) > 1:
            return self._points(asked, how, tol)
        out = self
        for i in sorted(asked, reverse=True):
            a, key = self.axes[i], asked[i]
            if isinstance(key, slice) and key == slice(None):
                continue
            if a.is_open and not a.is_counted:
                if how == "label" and tol is None and a.tol is None and not (isinstance(key, slice) and key.step not in (None, 1)) and not _is_bool(key):
                    out = out._open_take(i, key)
                    continue
                out = out.ordered(i)
                a = out.axes[i]
            at = self._positions(a, key, how, tol)
            out = out._pick(i, [at] if keepdims and isinstance(at, int) else at)
        return out if out.ndim else out.item_or_none()

    def item_or_none(self):
        got = self.cells.select("value").head(1)
        return plain(got[0][0]) if got else None

    def _open_take(self, i: int, key):
        """Labels of an open axis without a table: filters that reach the scan, and a job that tells whether asked labels are there."""
        a, c = self.axes[i], F.col(f"`{self.axes[i].name}`")
        if isinstance(key, slice):
            cond = F.lit(True)
            for bound, keep in ((key.start, c >= key.start), (key.stop, c <= key.stop)):
                cond = cond & keep if bound is not None else cond
            return self.make(self.cells.where(cond), self.axes)
        many = isinstance(key, (list, np.ndarray, range))
        asked = [plain(k) for k in key] if many else [plain(key)]
        cells = self.cells.where(c.isin(*asked))
        there = {r[0] for r in cells.select(c).distinct().collect()}  # as many as were asked for at most
        if lost := [k for k in asked if k not in there]:
            raise IndexError(f"no label {lost[0]!r} on axis {a.name!r}")
        if not many:
            return self.make(cells, self.rest(i))
        return self.make(cells, [Axis.of(a.name, list(there)) if x is a else x for x in self.axes])._pick(i, [list(there).index(k) for k in asked])

    def ordered(self, axis=0):
        """The array with the labels of an open axis in a table: sorted, those that its cells have now."""
        i = self.axis_no(axis)
        a = self.axes[i]
        if a.members or a.is_counted:
            return self
        return self.make(self.cells, [replace(a, order=Labels.found(self.cells, a.name)) if x is a else x for x in self.axes])

    def _pick_run(self, i: int, steps: range):
        """Evenly spaced positions of an open axis: a range of keys where they are neighbours, else a join with their table."""
        a = self.axes[i]
        new = a.take(steps)
        axes = [new if x is a else x for x in self.axes]
        c = F.col(f"`{a.name}`")
        if a.by_pos:
            cells = self.cells.where(c.between(min(steps[0], steps[-1]), max(steps[0], steps[-1])) & ((c - steps.start) % steps.step == 0)) if len(steps) else self.cells.limit(0)
            return self.make(cells.withColumn(a.name, F.expr(f"(`{a.name}` - {steps.start}) div {steps.step}")), axes)
        if not len(steps):
            return self.make(self.cells.where(F.lit(False)), axes)
        if abs(steps.step) == 1 and a.order.way:
            ends = sorted(a.order.at([steps[0], steps[-1]]))
            return self.make(self.cells.where(c.between(*ends)), axes)
        return self.make(new.order.joined(self.cells, a.name, "left_semi"), axes)

    def _pick(self, i: int, at):
        """Keep positions of one axis; filters on keys where it can, so that they reach the scan."""
        a = self.axes[i]
        if isinstance(at, range):
            return self._pick_run(i, at)
        if isinstance(at, int):
            cells = self.cells
            if a.members:
                for m, k in zip(a.members, self._unravel(a, at), strict=True):
                    cells = cells.where(F.col(f"`{m.name}`") == m.key(k))
            elif not a.dummy:
                key = a.order.at([at])[0] if a.order and not a.by_pos else a.key(at)
                cells = cells.where(F.col(f"`{a.name}`") == F.lit(key).cast(a.key_type()))
            return self.make(cells, self.rest(i))
        if a.members:
            rows = [(j, *[m.key(p) for m, p in zip(a.members, self._unravel(a, k), strict=True)]) for j, k in enumerate(at)]
            t = self.spark.createDataFrame(rows, ", ".join([f"`{a.name}` bigint", *[f"`{m.name}` {m.key_type()}" for m in a.members]]))
            values = a.values
            new = Axis(a.name, tuple(values[k] for k in at), dict(a.attrs), by_pos=True)
            return self.make(self.cells.join(hinted(t, len(at)), [m.name for m in a.members]), [new if x is a else x for x in self.axes])
        new, whole = a.take(at), not a.order
        if a.order and not a.by_pos:  # a few of very many
            a = replace(Axis.of(a.name, list(dict.fromkeys(new.values)), a.tol), attrs=dict(a.attrs))
            at = [a.places[x] for x in new.values]
        axes = [new if k == i else x for k, x in enumerate(self.axes)]
        c = F.col(f"`{a.name}`")
        if not a.by_pos and not new.by_pos:
            keys = list(new.values)
            run = whole and a.direction() and at == list(range(at[0], at[-1] + 1)) if at else False
            if run and a.kind != "str":
                cells = self.cells.where(c.between(min(keys[0], keys[-1]), max(keys[0], keys[-1])))
            elif len(keys) <= 1000:
                cells = self.cells.where(c.isin(*keys))
            else:
                cells = self.cells.join(new.hinted(self.spark).select(a.name), a.name, "left_semi")
            return self.make(cells, axes)
        t = hinted(self.spark.createDataFrame([(a.key(p), new.key(k)) for k, p in enumerate(at)], f"`{a.name}` {a.key_type()}, __new {new.key_type()}"), len(at))
        return self.make(self.cells.join(t, a.name).drop(a.name).withColumnRenamed("__new", a.name), axes)

    @staticmethod
    def _unravel(a: Axis, at: int) -> list[int]:
        out = []
        for m in reversed(a.members):
            at, k = divmod(at, m.size)
            out.append(k)
        return out[::-1]

    def _points(self, asked: dict[int, object], how: str, tol: float | None):
        """Sample points: equal-length lists on several dimensions, joined on all their keys at once."""
        lists = {i: self._positions(self.axes[i], list(k), how, tol) for i, k in asked.items() if isinstance(k, (list, np.ndarray))}
        others = {self.dims[i]: k for i, k in asked.items() if i not in lists}
        if len({len(v) for v in lists.values()}) != 1:
            raise IndexError("point lists need equal lengths")
        nos = sorted(lists)
        axes = [self.axes[i] for i in nos]
        labels = [tuple(a.values[lists[i][k]] for i, a in zip(nos, axes, strict=True)) for k in range(len(lists[nos[0]]))]
        name = ",".join(a.name for a in axes)
        new = Axis(name, tuple(labels), by_pos=True)
        rows = [(k, *[a.key(lists[i][k]) for i, a in zip(nos, axes, strict=True)]) for k in range(len(labels))]
        t = self.spark.createDataFrame(rows, ", ".join([f"`{name}` bigint", *[f"`{a.name}` {a.key_type()}" for a in axes]]))
        together = nos == list(range(nos[0], nos[0] + len(nos)))
        rest = self.rest(*nos)
        at = nos[0] if together else 0
        out = self.make(self.cells.join(hinted(t, len(rows)), [a.name for a in axes]), [*rest[:at], new, *rest[at:]])
        return out.take(others, indexing=how, tol=tol) if others else out

    def take_axis(self, indices, axis=0, indexing: str = "label", mode: str = "raise"):
        """Gather along one axis. mode: raise; wrap or clip for positions; clip for labels takes the next label, or the last."""
        i = self.axis_no(axis)
        a = self.axes[i]
        one = not isinstance(indices, (list, tuple, np.ndarray, range))
        asked = [plain(x) for x in ([indices] if one else indices)]
        if indexing == "position":
            at = [k % a.size if mode == "wrap" or -a.size <= k < 0 else min(max(k, 0), a.size - 1) if mode == "clip" else self._positions(a, k, "position", None) for k in asked]
        else:
            at = [a.search(k, "left") if mode == "clip" else a.locate(k) for k in asked]
        return self._pick(i, at[0] if one else at)

    def compress(self, mask):
        """Cells where an N-dimensional mask holds, along one dimension named after all, in row-major order.

        The labels of the hits are tuples. They are listed up to the option axis.list_hits; beyond it, or where
        a dimension is open, they are a table: the hits are numbered in order by ranges.
        """
        self._same_axes(mask)
        cols = [c for a in self.axes for c in a.cols]
        hit = mask.cells.where("value").select(*[f"`{c}`" for c in cols])
        name, most = ",".join(self.dims), options.get_option("axis.list_hits")
        levels = [m for a in self.axes for m in a.levels if not m.dummy]
        keys = [] if any(m.is_open for m in levels) else [r[:] for r in hit.limit(most + 1).collect()]
        if len(keys) > most or any(m.is_open for m in levels):
            return self._compress_open(hit, levels, name)
        at = sorted(tuple(k if m.by_pos else m.places[k] for m, k in zip(levels, key, strict=True)) for key in keys)
        rows = [(i, *[m.key(p) for m, p in zip(levels, x, strict=True)]) for i, x in enumerate(at)]
        t = self.spark.createDataFrame(rows, ", ".join([f"`{name}` bigint", *[f"`{m.name}` {m.key_type()}" for m in levels]])) if len(levels) > 1 else None
        if t is None:  # one dimension: its own labels
            return self._pick(next(i for i, a in enumerate(self.axes) if not a.dummy), [x[0] for x in at])
        new = Axis(name, tuple(tuple(m.values[p] for m, p in zip(levels, x, strict=True)) for x in at), by_pos=True)
        return self.make(self.cells.join(hinted(t, len(rows)), cols).select(name if "," not in name else f"`{name}`", "value"), [new])

    def _compress_open(self, hit, levels: list[Axis], name: str):
        src = self
        for i, a in enumerate(self.axes):
            src = src.ordered(i)
        levels = [m for a in src.axes for m in a.levels if not m.dummy]
        if len(levels) == 1 and not levels[0].by_pos:
            a = levels[0]
            new = replace(a, labels=None, order=a.ordered(self.spark).kept(hit.withColumnRenamed(a.name, "label")))
            return self.make(self.cells.join(hit, a.name, "left_semi"), [new])
        cells = hit
        for m in levels:
            cells = self.with_pos(cells, m)
        label = []
        for m in levels:  # positions give their labels, other keys are labels
            if m.by_pos:
                cells = cells.join(m.hinted(self.spark, pos="__none", label=f"__label_{m.name}").drop("__none"), m.name)
            label.append(F.col(f"`__label_{m.name}`" if m.by_pos else f"`{m.name}`").alias(m.name))
        rows = cells.select(*[f"`__pos_{m.name}`" for m in levels], *[f"`{m.name}`" for m in levels], F.struct(*label).alias("label"))
        table, n = number(rows, [f"`__pos_{m.name}`" for m in levels])
        cols = [m.name for m in levels]
        met = self.cells.join(table.select(*[f"`{c}`" for c in cols], F.col("pos").alias(name)), cols)
        return self.make(met.select(f"`{name}`", "value"), [Axis(name, None, by_pos=True, order=Labels(table.select("pos", "label"), n, 0))])

    def compress_axis(self, mask: Sequence[bool], axis=0):
        return self._pick(self.axis_no(axis), [k for k, m in enumerate(mask) if m])

    # -- assignment ---------------------------------------------------------------------------

    def put(self, indices, values, axis=None, indexing: str | None = None, tol: float | None = None, cast: bool = False, inplace: bool = False):
        """Assign a number or an aligned array at an index; a new array unless inplace.

        Without cast, values take the array's type.
        """
        if not isinstance(indices, type(self)) and (flat := [i for i in self._by_axis(indices, axis) if self.axes[i].members]):
            out = self
            for i in flat:
                out = out.one_key(i)
            out = out.put(indices, values, axis, indexing, tol, cast)
            if inplace:
                self.cells, self.axes = out.cells, out.axes
                return None
            return out
        how = indexing or self.by
        src = self.dense() if isinstance(indices, type(self)) else self._grown(self._by_axis(indices, axis), how, tol)
        value = values if isinstance(values, type(self)) else None
        kind = self.dtype
        if cast and value is None and isinstance(plain(values), float) and kind in ("bigint", "int"):
            kind = "double"
        if isinstance(indices, type(self)) and indices.dtype == "boolean":
            cols = [c for a in self.axes for c in a.cols]
            cells = src.cells.join(indices.dense().cells.withColumnRenamed("value", "__hit"), cols, "left")
            hit = F.coalesce("__hit", F.lit(False))
        else:
            cells, hit = src.cells, F.lit(True)
            for i, key in self._by_axis(indices, axis).items():
                a = self.axes[i]
                at = self._positions(a, key, how, tol)
                hit = hit & F.col(f"`{a.name}`").isin(*[a.key(k) for k in ([at] if isinstance(at, int) else at)])
        if value is not None:
            cols = [c for a in value.axes for c in a.cols]
            right = value.cells.withColumnRenamed("value", "__new")
            cells = cells.join(right, cols, "left") if cols else cells.crossJoin(right)
            new = F.col("__new").cast("double" if cast and value.dtype != kind else kind)
            kind = "double" if cast and value.dtype != kind else kind
        else:
            new = F.lit(plain(values)).cast(kind)
        out = self.make(cells.withColumn("value", F.when(hit, new).otherwise(F.col("value").cast(kind))), self.axes)
        if inplace:
            self.cells = out.cells
            return None
        return out

    def _grown(self, asked: dict[int, object], how: str, tol: float | None):
        """With a row for each cell of the grid that the index selects."""
        cols = [c for a in self.axes for c in a.cols]
        if not cols:
            return self
        axes = list(self.axes)
        for i, key in asked.items():
            at = self._positions(axes[i], key, how, tol)
            a = axes[i]
            some = [at] if isinstance(at, int) else at
            axes[i] = replace(a, labels=tuple(some), by_pos=True) if a.by_pos else a.take(some)
        grid = None
        for i, a in enumerate(axes):
            if a.dummy:
                continue
            for m in a.levels:
                keys = self.spark.createDataFrame([(k,) for k in m.labels], f"`{m.name}` bigint") if m is a and a.by_pos and i in asked else m.hinted(self.spark).select(m.name)
                grid = keys if grid is None else grid.crossJoin(keys)
        return self.make(self.cells.join(grid, cols, "full"), self.axes)

    def fill(self, value):
        self.put(Ellipsis, value, inplace=True)

    # -- order and names ----------------------------------------------------------------------

    def sort_axis(self, axis=0, key: Callable | dict | None = None):
        i = self.axis_no(axis)
        if self.axes[i].is_open and key is None:
            out = self.ordered(i)
            return out.make(out.cells, [x.sort() if k == i else x for k, x in enumerate(out.axes)])
        return self._pick_order(i, self.axes[i].sorted_by(key))

    def _pick_order(self, i: int, at: list[int]):
        a = self.axes[i]
        return self._pick(i, at) if a.by_pos else self.make(self.cells, [a.take(at) if x is a else x for x in self.axes])

    def set_axis(self, values=None, axis=0, name: str | None = None):
        """New labels (a list, a mapping or a function of the old ones) and, if given, a new name."""
        i = self.axis_no(axis)
        if self.axes[i].members:
            return self.one_key(i).set_axis(values, i, name)
        a = self.axes[i]
        new = a.relabel(values, name)
        axes = [new if x is a else x for x in self.axes]
        if new.values == a.values and new.by_pos == a.by_pos:
            return self.make(self.cells.withColumnRenamed(a.name, new.name), axes)
        t = self.spark.createDataFrame([(a.key(k), new.key(k)) for k in range(a.size)], f"`{a.name}` {a.key_type()}, __new {new.key_type()}")
        return self.make(self.cells.join(hinted(t, a.size), a.name).drop(a.name).withColumnRenamed("__new", new.name), axes)
