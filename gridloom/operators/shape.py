"""Shape operators: metadata, but for repeats along new labels."""

from __future__ import annotations

from ..axis import Axis


class ShapeOps:
    def transpose(self, *dims):
        if len(dims) == 1 and isinstance(dims[0], (list, tuple)):
            dims = tuple(dims[0])
        if not dims:
            if self.ndim > 2:
                raise ValueError("name the dimensions of an array of three or more")
            dims = self.dims[::-1]
        nos = [self.axis_no(d) for d in dims]
        if sorted(nos) != list(range(self.ndim)):
            raise ValueError("each dimension once, please")
        return self.make(self.cells, [self.axes[i] for i in nos])

    T = property(lambda self: self.transpose())

    def swapaxes(self, one, two):
        nos = list(range(self.ndim))
        i, j = self.axis_no(one), self.axis_no(two)
        nos[i], nos[j] = j, i
        return self.transpose(*nos)

    def rollaxis(self, axis, start=0):
        nos = list(range(self.ndim))
        i = self.axis_no(axis)
        start = self.axis_no(start) if not isinstance(start, int) or start < self.ndim else start
        nos.remove(i)
        nos.insert(start - (start > i), i)
        return self.transpose(*nos)

    def newaxis(self, name: str, values=None, pos: int = 0):
        """A dimension of size one without a label, or repeated along values."""
        if name in self.dims:
            raise ValueError(f"dimension {name!r} exists")
        axes = list(self.axes)
        axes.insert(pos, Axis(name, None, dummy=True))
        out = self.make(self.cells, axes)
        return out if values is None else out.repeat(values, name)

    def repeat(self, values, axis):
        """A dimension of size one along several labels."""
        i = self.axis_no(axis)
        a = self.axes[i]
        if a.size != 1:
            raise ValueError(f"only dimensions of size one can be repeated; {a.name!r} has {a.size}")
        new = Axis.of(a.name, range(values) if isinstance(values, int) else list(values))
        cells = self.cells if a.dummy else self.cells.drop(a.name)
        return self.make(cells.crossJoin(new.hinted(self.spark).select(a.name)), [new if x is a else x for x in self.axes])

    def squeeze(self, axis=None):
        nos = [i for i, a in enumerate(self.axes) if not a.is_open and a.size == 1] if axis is None else self.axis_nos(axis)
        if any(self.axes[i].size != 1 for i in nos):
            raise ValueError("only dimensions of size one can be dropped")
        return self.make(self.cells, self.rest(*nos))

    def flatten(self, *dims, insert: int | None = None, reverse: bool = False):
        """Several dimensions as one, in row-major order of the names given; a set keeps the array's order. reverse: all but those given."""
        if reverse:
            given = dims[0] if len(dims) == 1 and isinstance(dims[0], (set, frozenset, list, tuple)) else dims
            dims = tuple(d for i, d in enumerate(self.dims) if i not in {self.axis_no(x) for x in given})
        if len(dims) == 1 and isinstance(dims[0], (set, frozenset)):
            dims = tuple(d for d in self.dims if d in dims[0])
        elif len(dims) == 1 and isinstance(dims[0], (list, tuple)):
            dims = tuple(dims[0])
        nos = [self.axis_no(d) for d in dims or self.dims]
        parts = [self.axes[i] for i in nos]
        out = self
        if any(a.dummy for a in parts):
            for a in [a for a in parts if a.dummy]:
                out = out.repeat([0], a.name)
            return out.flatten(*[a.name for a in parts], insert=insert)
        group = Axis(",".join(a.name for a in parts), members=tuple(m for a in parts for m in a.levels))
        rest = self.rest(*nos)
        at = min(nos) if insert is None else insert
        return self.make(self.cells, [*rest[:at], group, *rest[at:]])

    def unflatten(self, axis=None):
        nos = [i for i, a in enumerate(self.axes) if a.members] if axis is None else self.axis_nos(axis)
        return self.make(self.cells, [m for i, a in enumerate(self.axes) for m in (a.members if i in nos and a.members else (a,))])

    group, ungroup = flatten, unflatten

    def reshape(self, *names, transpose: bool = True):
        """By names: 'a,b' flattens, unknown names are new dimensions of size one, those left out must have size one."""
        if len(names) == 1 and isinstance(names[0], (list, tuple)):
            names = tuple(names[0])
        out = self.unflatten()
        wanted = [n for x in names for n in x.split(",")]
        for d in [d for d in out.dims if d not in wanted]:
            out = out.squeeze(d)
        for n in wanted:
            if n not in out.dims:
                out = out.newaxis(n, pos=out.ndim)
        if not transpose and [d for d in out.dims if d in self.dims] != [n for n in wanted if n in self.dims]:
            raise ValueError("this order needs a transpose")
        out = out.transpose(*wanted)
        for x in names:
            if "," in x:
                out = out.flatten(*x.split(","))
        return out
