"""Slabs of netCDF classic files by byte ranges.

A Python data source plans partitions over the first dimension of a variable: the header and the
coordinate variables are read by range, label filters pick positions, and each partition reads
only the ranges of its own rows, so a large file is read by many tasks and a slab costs its own
bytes. Files are opened through Arrow's file systems; paths that only Spark reaches take the way of
whole binary rows in ``netcdf``.
"""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as arrow_fs
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

from .classic import Header, as_text

NAME = "gridloom_slabs"


def opened(path: str):
    """A file for reading by range, or None where Arrow does not reach it."""
    try:
        if "://" in path:
            system, at = arrow_fs.FileSystem.from_uri(path)
        elif path.startswith("file:"):
            system, at = arrow_fs.LocalFileSystem(), path.removeprefix("file:")
        else:
            system, at = arrow_fs.LocalFileSystem(), path
        return system.open_input_file(at) if system.get_file_info(at).is_file else None
    except (OSError, pa.ArrowInvalid, pa.ArrowNotImplementedError):
        return None


def ranges_of(path: str) -> Callable[[int, int], bytes]:
    file = opened(path)
    if file is None:
        raise FileNotFoundError(path)
    return lambda at, n: file.read_at(n, at)


@dataclass
class Slab(InputPartition):
    """Rows of the first dimension, and from which to which entry of each other dimension."""

    rows: list[int]
    box: list[tuple[int, int]]


def runs(positions: Sequence[int]) -> list[tuple[int, int]]:
    """First and last of each stretch of neighbouring positions, which ascend."""
    at = np.asarray(positions)
    cuts = np.flatnonzero(np.diff(at) != 1) + 1
    return [(int(x[0]), int(x[-1])) for x in np.split(at, cuts)] if len(at) else []


def chosen(labels: pa.Array, asked: list[Filter]) -> np.ndarray:
    """Positions of the labels that the filters leave; a filter of another kind leaves all."""
    keep = np.ones(len(labels), bool)
    for f in asked:
        compare = {EqualTo: pc.equal, GreaterThan: pc.greater, GreaterThanOrEqual: pc.greater_equal, LessThan: pc.less, LessThanOrEqual: pc.less_equal}.get(type(f))
        if compare:
            keep &= compare(labels, pa.scalar(f.value, labels.type)).to_numpy(zero_copy_only=False)
        elif isinstance(f, In):
            keep &= pc.is_in(labels, pa.array([x for x in f.value if x is not None], labels.type)).to_numpy(zero_copy_only=False)
    return np.flatnonzero(keep)


def reads(header: Header, name: str, slab: Slab) -> list[tuple[int, int, int, int]]:
    """(byte, bytes, first row, rows) of each range that a slab reads, in order of the rows.

    Rows that lie together and are wanted whole are one range; otherwise each row is read from the
    first to the last wanted entry of the second dimension.
    """
    v = header.variables[name]
    shape, size = header.shape(name), header.cell_bytes(name)
    inner = int(np.prod(shape[2:], dtype=int)) * size
    row = int(np.prod(shape[1:], dtype=int)) * size
    stride = header.stride if header.grows(name) else row
    low, high = slab.box[0] if slab.box else (0, 0)
    start, length = (low * inner, (high - low + 1) * inner) if slab.box else (0, row)
    out = []
    for first, last in runs(slab.rows):
        if stride == row == length:
            out.append((v["begin"] + first * stride, (last - first + 1) * row, first, last - first + 1))
        else:
            out += [(v["begin"] + r * stride + start, length, r, 1) for r in range(first, last + 1)]
    return out


def plan(header: Header, name: str, picked: list[np.ndarray], most: int) -> list[Slab]:
    """Partitions of about ``most`` bytes over the rows that are wanted."""
    if any(not len(p) for p in picked):
        return []
    box = [(int(p[0]), int(p[-1])) for p in picked[1:]]
    if not picked:
        return [Slab([0], [])]
    shape, size = header.shape(name), header.cell_bytes(name)
    row = size * int(np.prod([b - a + 1 for a, b in box[:1]], dtype=int)) * int(np.prod(shape[2:], dtype=int))
    each = max(1, most // max(1, row))
    return [Slab(picked[0][i : i + each].tolist(), box) for i in range(0, len(picked[0]), each)]


class SlabReader(DataSourceReader):
    def __init__(self, schema: StructType, about: dict):
        self.schema, self.about, self.asked = schema, about, []
        self.dims = about["dims"]

    def pushFilters(self, filters: list[Filter]):
        """Label filters choose what is read; Spark applies all of them again."""
        self.asked = [f for f in filters if len(getattr(f, "attribute", ())) == 1 and f.attribute[0] in self.dims]
        return filters

    def labels(self, header: Header, read: Callable[[int, int], bytes]) -> list[pa.Array]:
        """The keys of each dimension as they are in the cells: labels, or positions where they repeat."""
        out = []
        for d, by_pos in zip(self.dims, self.about["by_pos"], strict=True):
            values = list(range(header.dims[d])) if by_pos else header.labels(d, read)
            if values and isinstance(values[0], dt.datetime):
                out.append(pc.cast(pc.assume_timezone(pa.array(values, pa.timestamp("us")), self.about["zone"]), pa.timestamp("us", "UTC")))
            else:
                kind = {"bigint": pa.int64(), "double": pa.float64(), "string": pa.string()}[self.schema[d].dataType.simpleString()]
                out.append(pa.array(values).cast(kind) if len(values) else pa.array([], kind))
        return out

    def partitions(self) -> list[InputPartition]:
        read = ranges_of(self.about["path"])
        header = Header.of(read)
        picked = [chosen(x, [f for f in self.asked if f.attribute[0] == d]) for d, x in zip(self.dims, self.labels(header, read), strict=True)]
        return plan(header, self.about["name"], picked, self.about["most"]) or [Slab([], [])]

    def read(self, slab: InputPartition) -> Iterator[pa.RecordBatch]:
        if not slab.rows:
            return
        read = ranges_of(self.about["path"])
        header = Header.of(read)
        labels = self.labels(header, read)
        for at, n, first, rows in reads(header, self.about["name"], slab):
            yield self.batch(header, labels, slab, read(at, n), first, rows)

    def batch(self, header: Header, labels: list[pa.Array], slab: Slab, raw: bytes, first: int, rows: int) -> pa.RecordBatch:
        """The cells of a range; the fill value and NaN are missing."""
        name = self.about["name"]
        shape = header.shape(name)
        low, high = slab.box[0] if slab.box else (0, 0)
        box = [rows, *([high - low + 1] if slab.box else []), *shape[2:]] if self.dims else []
        kind = np.dtype(header.variables[name]["type"])
        if kind.kind == "S":
            value = pa.array(as_text(raw, header.cell_bytes(name)), pa.string())
        else:
            flat = np.frombuffer(raw, kind)
            flat = flat.astype("float64" if kind.kind == "f" else "int64")
            gone = np.isnan(flat) if kind.kind == "f" else np.zeros(len(flat), bool)
            if self.about["fill"] is not None:
                gone |= flat == (np.float64(kind.type(self.about["fill"])) if kind.kind == "f" else self.about["fill"])
            value = pa.array(flat, mask=gone)
        places = np.indices(box).reshape(len(box), -1) if box else []
        starts = [first, low, *[0] * len(shape)]
        keys = [x.take(pa.array(p + s)) for x, p, s in zip(labels, places, starts, strict=False)]
        keep = None
        for p, s, (a, b) in zip(places[2:] if len(box) > 2 else [], [0] * len(box), slab.box[1:], strict=False):
            inside = (p + s >= a) & (p + s <= b)
            keep = inside if keep is None else keep & inside
        out = pa.RecordBatch.from_arrays([*keys, value], names=[*self.dims, "value"])
        return out if keep is None else out.filter(pa.array(keep))


class SlabSource(DataSource):
    """Options: about, a JSON object of path, name, dims, by_pos, fill, zone and most (bytes of a partition)."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def reader(self, schema: StructType) -> SlabReader:
        return SlabReader(schema, json.loads(self.options["about"]))
