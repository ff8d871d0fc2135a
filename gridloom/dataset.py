"""Datasets: named arrays that share axes."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from copy import deepcopy
from dataclasses import fields, replace

import numpy as np
from pyspark.sql import functions as F

from .array import LabelArray
from .axis import Axis
from .operators import align as al
from .operators.interp import weigh


class SharedAxis(Axis):
    """An axis of a dataset: a new name, new labels or another attribute goes to all its arrays."""

    def __setattr__(self, key: str, value) -> None:
        owner = self.__dict__.get("_owner")
        if owner is None or key not in ("name", "labels", "values", "attrs"):
            super().__setattr__(key, value)
            return
        owner._change(self.name, replace(self.plain(), attrs=dict(value)) if key == "attrs" else self.plain().relabel(None, value) if key == "name" else self.plain().relabel(list(value)))
        found = owner.axis(value if key == "name" else self.name)
        self.__dict__.update({f.name: getattr(found, f.name) for f in fields(Axis)})

    def plain(self) -> Axis:
        return Axis(**{f.name: getattr(self, f.name) for f in fields(Axis)})


class SharedAxes(list):
    """The axes of a dataset, by position or name; assigning one changes it in all arrays, at the same size."""

    def __init__(self, owner: Dataset, axes: Iterable[Axis]):
        super().__init__(SharedAxis(**{f.name: getattr(a, f.name) for f in fields(Axis)}) for a in axes)
        self.owner = owner
        for a in self:
            a.__dict__["_owner"] = owner

    def _place(self, k) -> int:
        names = [a.name for a in self]
        if isinstance(k, str) and k not in names:
            raise IndexError(f"no axis {k!r}; there are {names}")
        return names.index(k) if isinstance(k, str) else k

    def __getitem__(self, k):
        return super().__getitem__(k if isinstance(k, slice) else self._place(k))

    def __setitem__(self, k, new) -> None:
        at = self._place(k)
        old = super().__getitem__(at)
        new = new if isinstance(new, Axis) else Axis.of(old.name, list(new), old.tol, **old.attrs)
        if new.size != old.size:
            raise ValueError(f"axis {old.name!r} has {old.size} labels, not {new.size}")
        self.owner._change(old.name, new)
        super().__setitem__(at, SharedAxes(self.owner, [new])[0])

    def __reduce__(self):
        return list, (list(self),)


class Dataset:
    """Arrays by name. The constructor aligns them (outer); assignment asks for equal axes."""

    def __init__(self, data: dict | None = None, attrs: dict | None = None, **more: LabelArray):
        data = dict(data or {}) | more
        arrays = al.align(list(data.values()), join="outer") if data else []
        self.variables: dict[str, LabelArray] = dict(zip(data, arrays, strict=True))
        self.attrs = dict(attrs or {})

    # -- structure ----------------------------------------------------------------------------

    @property
    def axes(self) -> SharedAxes:
        found: dict[str, Axis] = {}
        for v in self.variables.values():
            for a in v.axes:
                found.setdefault(a.name, a)
        return SharedAxes(self, found.values())

    def _change(self, name: str, new: Axis) -> None:
        """Another axis in place of one, in the arrays themselves."""
        if new.name != name and new.name in self.dims:
            raise ValueError(f"dimension {new.name!r} exists")
        for v in self.variables.values():
            if name in v.dims:
                out = v.set_axis(list(new.values), name, new.name) if not v.axis(name).is_open else v.rename(**{name: new.name})
                v.cells, v.axes = out.cells, tuple(replace(x, attrs=dict(new.attrs), tol=new.tol) if x.name == new.name else x for x in out.axes)

    dims = property(lambda self: tuple(a.name for a in self.axes))
    labels = property(lambda self: tuple(a.values for a in self.axes))

    def axis(self, which) -> Axis:
        return self.axes[which].plain()

    def keys(self):
        return self.variables.keys()

    def values(self):
        return self.variables.values()

    def items(self):
        return self.variables.items()

    def __iter__(self):
        return iter(self.variables)

    def __len__(self) -> int:
        return len(self.variables)

    def __contains__(self, name) -> bool:
        return name in self.variables

    def __getitem__(self, name):
        if name in self.variables:
            return self.variables[name]
        if name in self.dims and self.variables:
            a = self.axis(name)
            spark = next(iter(self.variables.values())).spark
            return LabelArray(a.table(spark, label="value"), [a])
        raise KeyError(name)

    def __setitem__(self, name: str, array: LabelArray) -> None:
        for a in array.axes:
            if name not in self.variables or len(self.variables) > 1:
                for other in [v for k, v in self.variables.items() if k != name]:
                    if a.name in other.dims and other.axis(a.name) != a:
                        raise ValueError(f"axis {a.name!r} differs from the dataset's: align first")
        self.variables[name] = array

    def __delitem__(self, name: str) -> None:
        del self.variables[name]

    def __repr__(self) -> str:
        lines = [f"dataset of {len(self)} arrays"]
        lines += [f"{i} / {a.name}" + ("" if a.is_open or not a.size else f" ({a.size}): {a.values[0]} to {a.values[-1]}") for i, a in enumerate(self.axes)]
        return "\n".join(lines + [f"{k}: {v.dims}" for k, v in self.items()])

    def summary(self) -> str:
        return "\n".join([repr(self), *[f"{k}: {v!r}" for k, v in self.attrs.items()]])

    def to_dict(self) -> dict[str, LabelArray]:
        return dict(self.variables)

    def copy(self) -> Dataset:
        out = Dataset(attrs=deepcopy(self.attrs))
        out.variables = dict(self.variables)
        return out

    def _with(self, arrays: dict[str, LabelArray]) -> Dataset:
        """A variable reduced to a number stays an array, without dimensions."""
        out = Dataset(attrs=self.attrs)
        spark = next((v.spark for v in self.values()), None)
        out.variables = {k: v if isinstance(v, LabelArray) else LabelArray.from_values(spark, np.array(np.nan if v is None else v)) for k, v in arrays.items()}
        return out

    def equals(self, other) -> bool:
        return isinstance(other, Dataset) and set(self) == set(other) and all(v.equals(other.variables[k]) for k, v in self.items())

    __eq__ = equals
    __hash__ = None

    def rename_keys(self, names: dict | Callable) -> Dataset:
        f = names if callable(names) else lambda k: names.get(k, k)
        return self._with({f(k): v for k, v in self.items()})

    def rename_axes(self, names: dict | Callable) -> Dataset:
        f = names if callable(names) else lambda k: names.get(k, k)
        return self._with({k: v.rename(**{d: f(d) for d in v.dims}) for k, v in self.items()})

    def set_axis(self, values=None, axis=0, name: str | None = None) -> Dataset:
        d = self.axis(axis).name
        return self._each(d, lambda v: v.set_axis(values, d, name))

    # -- per variable -------------------------------------------------------------------------

    def _each(self, d: str, f: Callable[[LabelArray], LabelArray]) -> Dataset:
        """f for the variables that have the dimension; the others pass."""
        return self._with({k: f(v) if d in v.dims else v for k, v in self.items()})

    def take(self, indices=None, axis=None, names: Iterable[str] | None = None, indexing: str = "label", tol: float | None = None, keepdims: bool = False) -> Dataset:
        """The same index on each variable, for the dimensions it has."""
        if not isinstance(indices, dict):
            indices = {} if indices is None else {self.axis(axis if axis is not None else 0).name: indices}
        out = {}
        for k in names or self:
            v = self.variables[k]
            mine = {d: i for d, i in indices.items() if d in v.dims}
            out[k] = v.take(mine, indexing=indexing, tol=tol, keepdims=keepdims) if mine else v
        return self._with(out)

    def sel(self, tol: float | None = None, **by) -> Dataset:
        return self.take(by, tol=tol)

    def isel(self, **by) -> Dataset:
        return self.take(by, indexing="position")

    loc = property(lambda self: _Indexer(self, "label"))
    iloc = property(lambda self: _Indexer(self, "position"))
    ix = property(lambda self: _Indexer(self, "position"))
    nloc = property(lambda self: _Indexer(self, "label", float("inf")))

    def take_axis(self, indices, axis=0, indexing: str = "label", mode: str = "raise") -> Dataset:
        d = self.axis(axis).name
        return self._each(d, lambda v: v.take_axis(indices, d, indexing, mode))

    def sort_axis(self, axis=0, key=None) -> Dataset:
        d = self.axis(axis).name
        return self._each(d, lambda v: v.sort_axis(d, key))

    def reindex_axis(self, values, axis=0, **k) -> Dataset:
        d = self.axis(axis).name
        return self._each(d, lambda v: v.reindex_axis(values, d, **k))

    def reindex_like(self, other, **k) -> Dataset:
        return self._with({n: v.reindex_like(other, **k) for n, v in self.items()})

    def interp_axis(self, values, axis=0, **k) -> Dataset:
        """The weights are made once, for all variables on the axis."""
        a = self.axis(axis)
        if a.is_open or isinstance(values, Axis) and values.is_open:
            return self._each(a.name, lambda v: v.interp_axis(values, a.name, **k))
        w = weigh(next(iter(self.values())).spark, a, values, **k)
        return self._each(a.name, lambda v: v.interp_axis(w, a.name))

    def interp_like(self, other, **k) -> Dataset:
        """One table of weights a dimension, and one join with all of them for each variable."""
        mine = {a.name: a for a in self.axes}
        if any(a.is_open or mine[a.name].is_open for a in other.axes if a.name in mine):
            return self._with({n: v.interp_like(other, **k) for n, v in self.items()})
        spark = next(iter(self.values())).spark
        weights = [weigh(spark, mine[a.name], a.values, **k) for a in other.axes if a.name in mine and a.numeric]
        return self._with({n: v.regrid(weights) for n, v in self.items()})

    def reduce(self, op: str, axis=0, skipna: bool = False, **k) -> Dataset:
        d = self.axis(axis).name
        return self._each(d, lambda v: v.reduce(op, d, skipna, **k))

    mean = lambda self, axis=0, **k: self.reduce("mean", axis, **k)
    sum = lambda self, axis=0, **k: self.reduce("sum", axis, **k)
    std = lambda self, axis=0, **k: self.reduce("std", axis, **k)
    var = lambda self, axis=0, **k: self.reduce("var", axis, **k)
    median = lambda self, axis=0, **k: self.reduce("median", axis, **k)

    def reduce_axis(self, f: Callable, axis=0, keepdims: bool = False, dtype: str = "double") -> Dataset:
        """A Python reducer on each slice; with keepdims also on the axis's labels."""
        d = self.axis(axis).name

        def run(v: LabelArray) -> LabelArray:
            out = v.apply_along_axis(f, d, dtype)
            return out.newaxis(d, [f(list(v.axis(d).values))], v.axis_no(d)) if keepdims else out

        return self._each(d, run)

    def to_array(self, axis: str = "variable", keys: Iterable[str] | None = None) -> LabelArray:
        """Variables along a new first dimension, on the dimensions of all."""
        keys = list(keys or self)
        return al.stack(al.broadcast_arrays(*[self.variables[k] for k in keys]), axis, keys)

    def _binary(self, op: str, other, swap: bool = False) -> Dataset:
        if isinstance(other, Dataset):
            return self._with({k: v._binary(op, other.variables[k]) for k, v in self.items() if k in other.variables})
        if isinstance(other, LabelArray):
            raise TypeError("a dataset combines with a dataset or a number")
        return self._with({k: v._binary(op, other, swap) for k, v in self.items()})

    __add__ = lambda self, o: self._binary("add", o)
    __radd__ = lambda self, o: self._binary("add", o, True)
    __sub__ = lambda self, o: self._binary("sub", o)
    __rsub__ = lambda self, o: self._binary("sub", o, True)
    __mul__ = lambda self, o: self._binary("mul", o)
    __rmul__ = lambda self, o: self._binary("mul", o, True)
    __truediv__ = lambda self, o: self._binary("div", o)
    __rtruediv__ = lambda self, o: self._binary("div", o, True)
    __floordiv__ = lambda self, o: self._binary("floor", o)
    __pow__ = lambda self, o: self._binary("pow", o)

    def __neg__(self) -> Dataset:
        return self._with({k: -v for k, v in self.items()})

    def write(self, path: str, mode: str = "w", **how) -> None:
        from .sources.store import write_dataset

        write_dataset(self, path, mode, **how)

    def to_dataframe(self):
        """One wide frame with a column a variable, for variables on the same dimensions."""
        first = next(iter(self.variables.values()))
        if any(set(v.dims) != set(first.dims) for v in self.values()):
            raise ValueError("variables have different dimensions")
        out = None
        for k, v in self.items():
            df = v.to_dataframe().withColumnRenamed("value", k)
            out = df if out is None else out.join(df, list(first.dims), "full")
        return out.select(*[F.col(f"`{c}`") for c in [*first.dims, *self]])


class _Indexer:
    def __init__(self, ds: Dataset, how: str, tol: float | None = None):
        self.ds, self.how, self.tol = ds, how, tol

    def __getitem__(self, key) -> Dataset:
        return self.ds.take(key, indexing=self.how, tol=self.tol)


def _together(datasets: list[Dataset], f: Callable[[list], LabelArray]) -> Dataset:
    names = list(datasets[0])
    if any(set(d) != set(names) for d in datasets):
        raise ValueError("the datasets have different variables")
    return Dataset({n: f([d.variables[n] for d in datasets]) for n in names})


def stack_ds(datasets, axis: str | None = None, keys=None, align: bool = False, sort: bool = False, join: str = "outer") -> Dataset:
    datasets, keys = al._named(datasets, keys)
    return _together(datasets, lambda vs: al.stack(vs, axis, keys, align, sort, join))


def concatenate_ds(datasets, axis, align: bool = False, sort: bool = False, join: str = "outer") -> Dataset:
    """Variables without the dimension must be equal and stay as they are."""
    return _together(list(datasets), lambda vs: al.concatenate(vs, axis, align, sort, join) if axis in vs[0].dims else vs[0])
