"""Axes: named, ordered label lists kept on the driver.

An axis is metadata. The cells of an array carry a key for each axis: the label itself, or the
position where labels repeat (keyed="pos"). An axis without labels (labels=None) is open, for
dimensions too large to list: its labels stay in the cells, or in a table that gives them in order
with their positions (``order``). What needs order or number makes that table first; what needs
the list raises.
"""

from __future__ import annotations

import datetime as dt
import math
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field, replace
from functools import cached_property
from itertools import product

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import options
from .ordered import Labels

_TYPES = {"bool": "boolean", "int": "bigint", "float": "double", "str": "string", "time": "timestamp", "date": "date"}


def plain(x):
    """A NumPy scalar as a Python value; arrays of one dimension or more stay as they are."""
    return x.item() if hasattr(x, "item") and not isinstance(x, (str, bytes)) and getattr(x, "ndim", 0) == 0 else x


def kind_of(labels: Iterable) -> str:
    """bool, int, float, str, time, date or tuple (labels of several dimensions); mixed numbers are float, any other mixture is str."""
    kinds = {"tuple" if isinstance(x, tuple) else "bool" if isinstance(x, bool) else "int" if isinstance(x, int) else "float" if isinstance(x, float) else "time" if isinstance(x, dt.datetime) else "date" if isinstance(x, dt.date) else "str" for x in labels}
    if not kinds:
        return "float"
    return kinds.pop() if len(kinds) == 1 else "float" if kinds == {"int", "float"} else "str"


def uniform(labels: Iterable) -> list:
    labels = [plain(x) for x in labels]
    kind = kind_of(labels)
    return [float(x) for x in labels] if kind == "float" and labels else [str(x) for x in labels] if kind == "str" else labels


@dataclass(frozen=True)
class Axis:
    name: str
    labels: tuple | None = None
    attrs: dict = field(default_factory=dict)
    tol: float | None = None
    members: tuple[Axis, ...] = ()
    dummy: bool = False
    by_pos: bool = False
    order: Labels | None = None

    @staticmethod
    def of(name: str, labels: Sequence | None = None, tol: float | None = None, **attrs) -> Axis:
        if not isinstance(name, str) or not name:
            raise ValueError("an axis needs a name")
        if labels is not None:
            labels = tuple(uniform(labels))
        return Axis(name, labels, attrs, tol, by_pos=labels is not None and (len(set(labels)) < len(labels) or kind_of(labels) == "tuple"))

    @property
    def values(self) -> tuple:
        if self.members:
            return tuple(product(*(m.values for m in self.members)))
        if self.dummy:
            return (None,)
        if self.labels is None:
            raise ValueError(f"axis {self.name!r} is open: its labels are not listed")
        return self.labels

    @property
    def levels(self) -> tuple[Axis, ...]:
        return self.members or (self,)

    @property
    def cols(self) -> list[str]:
        """The columns of the cells that hold the axis's keys."""
        return [] if self.dummy else [m.name for m in self.members] if self.members else [self.name]

    @property
    def size(self) -> int:
        return math.prod(m.size for m in self.members) if self.members else self.order.size if self.order else len(self.values)

    @property
    def is_open(self) -> bool:
        return any(m.is_open for m in self.members) if self.members else not self.dummy and self.labels is None

    @property
    def is_counted(self) -> bool:
        """False for open axes without a table of labels."""
        return all(m.is_counted for m in self.members) if self.members else not self.is_open or self.order is not None

    @property
    def kind(self) -> str:
        return self.order.kind if self.order else kind_of(self.values)

    def ordered(self, spark: SparkSession) -> Labels:
        """The labels as a table; of an axis that lists them too."""
        return self.order or Labels.listed(spark, self.values, _TYPES[self.kind], self.direction())

    @property
    def numeric(self) -> bool:
        return self.kind in ("int", "float")

    def direction(self) -> int:
        """1 or -1 if strictly monotonic, 0 if not; 1 for fewer than two labels."""
        if self.order:
            return self.order.way
        v = self.values
        if len(v) < 2:
            return 1
        try:
            return 1 if all(a < b for a, b in zip(v, v[1:], strict=False)) else -1 if all(a > b for a, b in zip(v, v[1:], strict=False)) else 0
        except TypeError:
            return 0

    @cached_property
    def places(self) -> dict:
        """First position of each label."""
        out: dict = {}
        for i, x in enumerate(self.values):
            out.setdefault(x, i)
        return out

    @cached_property
    def ascending(self) -> tuple[list, list[int]]:
        """Labels in ascending order and their positions."""
        order = self.sorted_by()
        return [self.values[i] for i in order], order

    def is_monotonic(self) -> bool:
        return self.direction() != 0

    def take(self, positions: Sequence[int]) -> Axis:
        if self.order and isinstance(positions, range):
            return replace(self, order=self.order.stepped(positions))
        if self.order:
            return replace(Axis.of(self.name, self.order.at(list(positions)), self.tol), attrs=dict(self.attrs))
        return replace(Axis.of(self.name, [self.values[i] for i in positions], self.tol), attrs=dict(self.attrs))

    def relabel(self, labels, name: str | None = None) -> Axis:
        if isinstance(labels, dict):
            labels = [labels.get(x, x) for x in self.values]
        elif isinstance(labels, Callable):
            labels = [labels(x) for x in self.values]
        elif labels is None:
            labels = self.values
        if len(labels) != self.size:
            raise ValueError(f"axis {self.name!r} has {self.size} labels, not {len(labels)}")
        return replace(Axis.of(name or self.name, labels, self.tol), attrs=dict(self.attrs))

    def __len__(self) -> int:
        return self.size

    def __getitem__(self, at):
        """A label for a position, an axis for a slice or list of positions."""
        if isinstance(at, slice):
            return self.take(range(self.size)[at])
        return self.values[at] if isinstance(at, int) else self.take(list(at))

    def copy(self) -> Axis:
        return replace(self, attrs=dict(self.attrs))

    def sort(self, key=None) -> Axis:
        if self.members:
            raise NotImplementedError("flattened axes have the order of their members")
        if self.order and key is None:
            return replace(self, order=self.order.ascending())
        return self.take(self.sorted_by(key))

    def cast(self, kind: str) -> Axis:
        """Labels as bool, int, float or str."""
        f = {"bool": bool, "int": int, "float": float, "str": str}[kind]
        return self.relabel([f(x) for x in self.values])

    def put(self, position: int, label) -> Axis:
        """With one label replaced; labels of another kind change the kind of all."""
        labels = list(self.values)
        labels[position] = plain(label)
        return self.relabel(labels)

    def to_pandas(self):
        import pandas as pd

        return pd.MultiIndex.from_tuples(self.values, names=[m.name for m in self.members]) if self.members else pd.Index(self.values, name=self.name)

    @staticmethod
    def from_pandas(index, name: str | None = None) -> Axis:
        """A MultiIndex of all combinations becomes a flattened axis."""
        if index.nlevels == 1:
            return Axis.of(name or index.name or "x0", list(index))
        levels = tuple(Axis.of(n or f"x{i}", list(dict.fromkeys(index.get_level_values(i)))) for i, n in enumerate(index.names))
        out = Axis(",".join(m.name for m in levels), members=levels)
        if out.values != tuple(index):
            raise ValueError("the index does not hold all combinations in order")
        return out

    def sorted_by(self, key=None) -> list[int]:
        """Positions in order of the labels, or of a function or mapping of them."""
        f = (lambda x: key[x]) if isinstance(key, dict) else key or (lambda x: x)
        return sorted(range(self.size), key=lambda i: f(self.values[i]))

    def __eq__(self, other) -> bool:
        alike = isinstance(other, Axis) and self.name == other.name and self.dummy == other.dummy and self.members == other.members and self.labels == other.labels
        if alike and (self.order or other.order):
            return bool(self.order and other.order) and self.order.same(other.order)
        return alike

    def __hash__(self) -> int:
        return hash((self.name, self.labels, self.members))

    # -- set operations -----------------------------------------------------------------------

    def union(self, other: Axis) -> Axis:
        """Sorted if both run the same way strictly; otherwise left labels and then unseen right ones."""
        if self.order or other.order:
            spark = (self.order or other.order).table.sparkSession
            return replace(self, labels=None, by_pos=False, order=self.ordered(spark).union(other.ordered(spark)))
        a, b = self.values, other.values
        if a == b or not b:
            return self
        if not a:
            return replace(other, name=self.name, attrs=dict(self.attrs))
        da, db = (self.direction() if len(a) > 1 else other.direction()), (other.direction() if len(b) > 1 else self.direction())
        alike = kind_of([*a, *b]) != "str" or self.kind == other.kind == "str"
        if da and da == db and alike:
            return replace(Axis.of(self.name, sorted({*a, *b}, reverse=da < 0), self.tol), attrs=dict(self.attrs))
        seen = set(a)
        return replace(Axis.of(self.name, [*a, *dict.fromkeys(x for x in b if x not in seen)], self.tol), attrs=dict(self.attrs))

    def intersection(self, other: Axis) -> Axis:
        """Left order, left repeats."""
        if self.order or other.order:
            spark = (self.order or other.order).table.sparkSession
            return replace(self, labels=None, by_pos=False, order=self.ordered(spark).intersection(other.ordered(spark)))
        there = set(other.values)
        return replace(Axis.of(self.name, [x for x in self.values if x in there], self.tol), attrs=dict(self.attrs))

    # -- lookup -------------------------------------------------------------------------------

    def locate(self, label, tol: float | None = None) -> int:
        """Position of a label; with tol the nearest one, the first of equals, if it is near enough."""
        label = plain(label)
        if self.order:
            return self.locate_all([label], tol)[0]
        v = self.values
        if isinstance(label, str) and self.kind in ("time", "date"):
            label = dt.datetime.fromisoformat(label) if self.kind == "time" else dt.date.fromisoformat(label)
        tol = self.tol if tol is None else tol
        if tol is not None and self.numeric:
            if not v:
                raise IndexError(f"axis {self.name!r} is empty")
            labels, order = self.ascending
            k = bisect_left(labels, label)
            near = [j for j in (k - 1, k) if 0 <= j < len(labels)]
            near = [j for j in near if abs(labels[j] - label) == min(abs(labels[x] - label) for x in near)]
            at = min(self.places[labels[j]] for j in near)
            if abs(v[at] - label) > tol:
                raise IndexError(f"no label of {self.name!r} within {tol} of {label!r}")
            return at
        try:
            return self.places[label]
        except (KeyError, TypeError):
            raise IndexError(f"no label {label!r} on axis {self.name!r}") from None

    def locate_all(self, labels: list, tol: float | None = None) -> list[int]:
        """Positions of several labels of an open axis, in one job."""
        tol = self.tol if tol is None else tol
        if self.kind in ("time", "date"):
            of = dt.datetime if self.kind == "time" else dt.date
            labels = [of.fromisoformat(x) if isinstance(x, str) else x for x in labels]
        if tol is not None and self.numeric:
            found = self.order.nearest(labels)
            for x, got in zip(labels, found, strict=True):
                if got is None or abs(got[1] - x) > tol:
                    raise IndexError(f"no label of {self.name!r} within {tol} of {x!r}")
            return [got[0] for got in found]
        places = self.order.places(labels)
        if lost := [x for x in labels if x not in places]:
            raise IndexError(f"no label {lost[0]!r} on axis {self.name!r}")
        return [places[x] for x in labels]

    def locate_slice(self, s: slice) -> Sequence[int]:
        """Positions of a label slice, both ends inclusive.

        On a monotonic numeric axis the ends are a bounding box and need not be labels; elsewhere they
        must be, and the slice runs by position between them.
        """
        n, step = self.size, s.step or 1
        lo, hi = plain(s.start), plain(s.stop)
        way = self.direction() if self.numeric else 0
        if way:
            if any(isinstance(x, str) for x in (lo, hi)):
                raise TypeError("a numeric axis takes a numeric slice")
            first, last = (lo, hi) if step > 0 else (hi, lo)
            if self.order:
                span = self.order.span(*((first, last) if way > 0 else (last, first)))
                run = range(span[0], span[1] + 1) if span else range(0)
                return (run if step > 0 else run[::-1])[:: abs(step)]
            inside = [i for i, x in enumerate(self.values) if (first is None or way * (x - first) >= 0) and (last is None or way * (x - last) <= 0)]
            return (inside if step > 0 else inside[::-1])[:: abs(step)]
        begin = (0 if step > 0 else n - 1) if lo is None else self.locate(lo)
        end = (n - 1 if step > 0 else 0) if hi is None else self.locate(hi)
        run = range(begin, end + (1 if step > 0 else -1), step)
        return run if self.order else list(run)

    def midpoints(self) -> Axis:
        """The means of neighbouring labels."""
        if self.order:
            return replace(self, order=self.order.midpoints())
        return Axis.of(self.name, [(x + y) / 2 for x, y in zip(self.values, self.values[1:], strict=False)], self.tol)

    def search(self, label, side: str) -> int:
        """Position of the first label at (left) or after (right) label in sorted order; the last if there is none."""
        labels, order = self.ascending
        k = (bisect_left if side == "left" else bisect_right)(labels, label)
        return order[min(k, len(order) - 1)]

    # -- cells --------------------------------------------------------------------------------

    def key(self, position: int):
        return position if self.by_pos else self.values[position]

    def key_type(self) -> str:
        return "bigint" if self.by_pos else self.order.sql_type if self.order else _TYPES[self.kind]

    def table(self, spark: SparkSession, pos: str = "__pos", label: str | None = None) -> DataFrame:
        """Rows of position, key (named like the axis) and, if asked for, label."""
        if self.order:
            own = F.col("pos" if self.by_pos else "label").alias(self.name)
            return self.order.table.select(F.col("pos").alias(pos), own, *([F.col("label").alias(label)] if label else []))
        extra = [(label, _TYPES[self.kind])] if label else []
        rows = [(i, self.key(i), *[self.values[i]] * len(extra)) for i in range(self.size)]
        return spark.createDataFrame(rows, ", ".join(f"`{n}` {t}" for n, t in [(pos, "bigint"), (self.name, self.key_type()), *extra]))

    def parts(self, spark: SparkSession, names: Sequence[str]) -> DataFrame:
        """Rows of key and the parts of labels that are tuples, one column each."""
        kinds = [_TYPES[kind_of(x[i] for x in self.values)] for i in range(len(names))]
        rows = [(self.key(k), *x) for k, x in enumerate(self.values)]
        return hinted(spark.createDataFrame(rows, ", ".join(f"`{n}` {t}" for n, t in zip([self.name, *names], ["bigint", *kinds], strict=True))), self.size)

    def hinted(self, spark: SparkSession, **names) -> DataFrame:
        """The table, to be broadcast while it is small."""
        return hinted(self.table(spark, **names), self.size)


def hinted(t: DataFrame, rows: int) -> DataFrame:
    """A table of labels, to be broadcast while it is small."""
    return F.broadcast(t) if rows <= options.get_option("axis.broadcast_labels") else t


def as_axis(x, name: str | None = None) -> Axis:
    if isinstance(x, Axis):
        return x
    if isinstance(x, tuple) and len(x) == 2 and isinstance(x[0], str):
        return Axis.of(x[0], x[1])
    if isinstance(x, int):
        return Axis.of(name or "x0", range(x))
    if isinstance(x, str):
        return Axis.of(x, None)
    return Axis.of(name or "x0", x)


def as_axes(axes, dims: Sequence[str] | None = None, shape: Sequence[int] | None = None) -> list[Axis]:
    """Axes from a list of axes, (name, labels) pairs, label lists or names, or from a dict."""
    if axes is None:
        axes = [range(n) for n in shape or ()]
    if isinstance(axes, dict):
        axes = [(d, axes[d]) for d in dims or axes]
    out = []
    for i, x in enumerate(axes):
        if isinstance(x, str) and shape is not None:
            x = (x, range(shape[i]))
        a = as_axis(x, dims[i] if dims else f"x{i}")
        out.append(replace(a, name=dims[i]) if dims else a)
    if len({a.name for a in out}) < len(out):
        raise ValueError("axes need distinct names")
    return out
