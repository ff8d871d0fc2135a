"""netCDF classic files (CDF-1, CDF-2 and the 64-bit data of CDF-5), without a netCDF library.

Files are read by byte ranges, several tasks a file and only what label filters leave, where
Arrow's file systems reach them (``slabs``); elsewhere by Spark as binary rows, one task a file. The header and
coordinate variables of the files are looked at first; values are read when the array is used.
Files of the HDF5-based version 4 have another format and are refused.
"""

from __future__ import annotations

import datetime as dt
import json
import struct
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..array import LabelArray
from ..axis import Axis
from ..dataset import Dataset
from .cf import infer_datetime_units, parse_units
from .classic import ATTRIBUTE, DIMENSION, VARIABLE, Header, as_text
from .slabs import SlabSource, opened, ranges_of
from .store import _path


class Classic(Header):
    """A whole file in memory, of paths that only Spark reaches."""

    def __init__(self, raw: bytes):
        super().__init__(raw)
        self.bytes = raw

    def read(self, at: int, n: int) -> bytes:
        return self.bytes[at : at + n]

    def labels(self, dim: str, read=None) -> list:
        return super().labels(dim, read or self.read)

    def values(self, name: str) -> np.ndarray:
        v, shape, size = self.variables[name], self.shape(name), self.cell_bytes(name)
        one = int(np.prod(shape[1:] if self.grows(name) else shape, dtype=int)) * size
        raw = b"".join(self.read(v["begin"] + i * self.stride, one) for i in range(self.records)) if self.grows(name) else self.read(v["begin"], one)
        if v["type"] == "S1":
            return np.array(as_text(raw, size), dtype=object).reshape(shape)
        data = np.frombuffer(raw, np.dtype(v["type"])).reshape(shape)
        return data.astype(data.dtype.newbyteorder("="))


def _out(x):
    return x.isoformat() if isinstance(x, dt.datetime) else x


def _describe(c: Header, read) -> dict:
    names = [n for n in c.variables if n not in c.dims]
    dims = [d for d in c.dims if d not in c.text_dims()]
    labels = {d: c.labels(d, read) for d in dims}
    axes = {d: {"labels": [_out(x) for x in labels[d]], "time": any(isinstance(x, dt.datetime) for x in labels[d][:1]), "attrs": c.variables.get(d, {}).get("attrs", {})} for d in dims}
    return {"attrs": c.attrs, "axes": axes, "variables": {n: {"dims": [d for d in c.variables[n]["dims"] if d in dims], "attrs": c.variables[n]["attrs"], "kind": np.dtype(c.variables[n]["type"]).kind} for n in names}}


def open_file(spark: SparkSession, path: str, slab_bytes: int = 32 << 20) -> Dataset:
    """A dataset over one file; the values are read when used.

    Where Arrow reaches the file it is read by ranges, about slab_bytes a task, and label filters
    decide which; else it is one binary row, and the filters are applied in the task that reads it.
    """
    if (file := opened(path)) is not None:
        file.close()
        read = ranges_of(path)
        about, files = _describe(Header.of(read), read), None
        spark.dataSource.register(SlabSource)
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    else:
        files = spark.read.format("binaryFile").load(path).select("content")

        def look(batches: Iterable[pd.DataFrame]):
            for pdf in batches:
                whole = [Classic(bytes(c)) for c in pdf["content"]]
                yield pd.DataFrame({"d": [json.dumps(_describe(c, c.read)) for c in whole]})

        found = files.mapInPandas(look, "d string").collect()
        if len(found) != 1:
            raise ValueError(f"{len(found)} files at {path}")
        about = json.loads(found[0].d)
    axes = {d: Axis.of(d, [dt.datetime.fromisoformat(x) for x in a["labels"]] if a["time"] else a["labels"], **a["attrs"]) for d, a in about["axes"].items()}
    ds = Dataset(attrs=about["attrs"])
    for name, v in about["variables"].items():
        mine = [axes[d] for d in v["dims"]]
        kind = {"f": "double", "S": "string"}.get(v["kind"], "bigint")
        schema = ", ".join([*[f"`{a.name}` {a.key_type()}" for a in mine], f"value {kind}"])
        fill = v["attrs"].get("_FillValue", v["attrs"].get("missing_value"))
        if files is None:
            plan = {"path": path, "name": name, "dims": v["dims"], "by_pos": [a.by_pos for a in mine], "fill": fill, "zone": spark.conf.get("spark.sql.session.timeZone"), "most": slab_bytes}
            cells = spark.read.format(SlabSource.name()).schema(schema).option("about", json.dumps(plan)).load()
        else:
            cells = files.mapInPandas(_whole_cells(name, mine, kind, fill), schema)
        ds.variables[name] = LabelArray(cells, mine, v["attrs"])
    return ds


def summary(spark: SparkSession, path: str) -> str:
    """What a file holds, from its header and coordinates alone."""
    ds = open_file(spark, path)
    return "\n".join([ds.summary(), *[f"    {n}: {v.dtype} {v.dims} {v.attrs}" for n, v in ds.items()]])


def _whole_cells(name: str, mine: list[Axis], kind: str, fill):
    def cells(batches: Iterable[pd.DataFrame]):
        for pdf in batches:
            for raw in pdf["content"]:
                values = Classic(bytes(raw)).values(name)
                step = max(1, 100_000 // max(1, int(np.prod(values.shape[1:], dtype=int)))) if values.ndim else 1
                for lo in range(0, values.shape[0] if values.ndim else 1, step):
                    part = values[lo : lo + step] if values.ndim else values
                    at = np.indices(part.shape).reshape(part.ndim, -1)
                    flat = pd.Series(part.reshape(-1)).astype({"double": "float64", "bigint": "int64"}.get(kind, "object"))
                    flat = flat.where(flat != fill) if fill is not None else flat
                    keys = {a.name: [a.key(int(k) + (lo if j == 0 else 0)) for k in at[j]] for j, a in enumerate(mine)}
                    yield pd.DataFrame(keys | {"value": flat.astype(object).where(flat.notna(), None)})

    return cells


def _padded(raw: bytes) -> bytes:
    return raw + b"\0" * (-len(raw) % 4)


def _name(s: str) -> bytes:
    raw = s.encode()
    return struct.pack(">i", len(raw)) + _padded(raw)


def _attributes(attrs: dict) -> bytes:
    out, n = b"", 0
    for k, v in attrs.items():
        if isinstance(v, (bool, np.bool_)):
            v = int(v)
        values = v if isinstance(v, (list, tuple)) else [v]
        if isinstance(v, str):
            body, kind, count = v.encode(), 2, len(v.encode())
        elif all(isinstance(x, int) for x in values):
            body, kind, count = np.array(values, ">i4").tobytes(), 4, len(values)
        elif all(isinstance(x, (int, float)) for x in values):
            body, kind, count = np.array(values, ">f8").tobytes(), 6, len(values)
        else:
            continue
        out += _name(k) + struct.pack(">ii", kind, count) + _padded(body)
        n += 1
    return struct.pack(">ii", ATTRIBUTE if n else 0, n) + out


def _coded(values: np.ndarray) -> tuple[int, np.ndarray]:
    if values.dtype.kind in "OU":
        flat = [str("" if x is None else x).encode() for x in values.reshape(-1)]
        width = max([1, *map(len, flat)])
        return 2, np.array([np.frombuffer(x.ljust(width, b"\0"), "S1") for x in flat]).reshape(*values.shape, width)
    if values.dtype.kind in "iub":
        wide = values.size and (abs(int(values.min())) > 2**31 - 1 or abs(int(values.max())) > 2**31 - 1)
        return (6, values.astype(">f8")) if wide else (4, values.astype(">i4"))
    return 6, values.astype(">f8")


def coordinate(a: Axis, labels: list | None = None) -> tuple[str, list[str], dict, np.ndarray]:
    """The coordinate variable of an axis, or of some of its labels: name, dims, attrs, values."""
    labels, attrs = list(a.values if labels is None else labels), dict(a.attrs)
    if a.kind in ("time", "date"):
        times = [x if isinstance(x, dt.datetime) else dt.datetime(x.year, x.month, x.day) for x in labels]
        attrs["units"] = infer_datetime_units(times) if len(times) > 1 else f"days since {times[0]:%Y-%m-%d %H:%M:%S}"
        step, ref = parse_units(attrs["units"])
        labels = [(t - ref) / dt.timedelta(microseconds=step) for t in times]
    return a.name, [a.name], attrs, np.array(labels, dtype=object if a.kind == "str" else None)


def encode(dims: dict[str, int], variables: list[tuple[str, list[str], dict, np.ndarray]], attrs: dict) -> bytes:
    """A CDF-2 file of (name, dims, attrs, values)."""
    dims, coded = dict(dims), []
    for n, d, own, values in variables:
        kind, out = _coded(values)
        if kind == 2:
            width = f"{n}_length"
            dims[width] = out.shape[-1]
            d = [*d, width]
        coded.append((n, d, own, kind, out))
    order = list(dims)
    head = b"CDF\x02" + struct.pack(">i", 0)
    head += struct.pack(">ii", DIMENSION if dims else 0, len(dims)) + b"".join(_name(d) + struct.pack(">i", dims[d]) for d in order)
    head += _attributes(attrs)
    entries = [(_name(n) + struct.pack(f">i{len(d)}i", len(d), *map(order.index, d)) + _attributes(own), kind, _padded(out.tobytes())) for n, d, own, kind, out in coded]
    begin = len(head) + 8 + sum(len(e) + 16 for e, _, _ in entries)
    head += struct.pack(">ii", VARIABLE if entries else 0, len(entries))
    for e, kind, body in entries:
        head += e + struct.pack(">iiq", kind, len(body), begin)
        begin += len(body)
    return head + b"".join(body for _, _, body in entries)


def to_bytes(data: LabelArray | Dataset, name: str = "value") -> bytes:
    """A CDF-2 file of small arrays, collected on the driver; missing cells are NaN."""
    ds = data if isinstance(data, Dataset) else Dataset({name: data})
    variables = [coordinate(a) for a in ds.axes] + [(n, list(v.dims), v.attrs, np.asarray(v.values)) for n, v in ds.items()]
    return encode({a.name: a.size for a in ds.axes}, variables, ds.attrs)


def write_slabs(a: LabelArray, folder: str, axis=0, labels: int = 1000, name: str = "value") -> None:
    """An array as one file for so many labels of an axis, each written by the task that holds its cells.

    The files are part-000000.nc and so on and read back together, concatenated along the axis. A
    slab must fit a task; a task that is run again writes the same file. The folder must be
    one that Arrow reaches from every executor.
    """
    i = a.axis_no(axis)
    a = a.transpose(a.dims[i], *[d for k, d in enumerate(a.dims) if k != i])
    if any(x.members or x.dummy for x in a.axes):
        raise ValueError("flattened and empty dimensions have no coordinate variable")
    along, rest, attrs = a.axes[0], a.axes[1:], a.attrs
    kind = a.dtype
    cells = a.cells
    for x in a.axes:
        cells = a.with_pos(cells, x)
    where = [f"__pos_{d}" for d in a.dims]
    cells = cells.select(F.expr(f"`{where[0]}` div {labels}").alias("slab"), *[f"`{w}`" for w in where], "value")
    every = a.spark.range((along.size + labels - 1) // labels).select(F.col("id").alias("slab"))  # slabs without a cell as well
    target, system = _arrow_folder(folder)

    def write(pdf: pd.DataFrame) -> pd.DataFrame:
        slab = int(pdf["slab"].iloc[0])
        some = list(along.values[slab * labels : (slab + 1) * labels])
        shape = [len(some), *[x.size for x in rest]]
        pdf = pdf[pdf["value"].notna()]
        whole = kind in ("bigint", "int", "boolean") and len(pdf) == int(np.prod(shape))
        values = np.full(shape, None if kind == "string" else np.nan, dtype=object if kind == "string" else float)
        at = [pdf[where[0]].to_numpy(dtype="int64") - slab * labels, *[pdf[w].to_numpy(dtype="int64") for w in where[1:]]]
        values[tuple(at)] = pdf["value"].to_numpy()
        values = values.astype("int64") if whole else values
        dims = dict(zip([along.name, *[x.name for x in rest]], shape, strict=True))
        body = encode(dims, [coordinate(along, some), *[coordinate(x) for x in rest], (name, list(dims), attrs, values)], {})
        with system.open_output_stream(f"{target}/part-{slab:06d}.nc") as out:
            out.write(body)
        return pd.DataFrame({"slab": [slab], "bytes": [len(body)]})

    system.create_dir(target, recursive=True)
    every.join(cells, "slab", "left").groupBy("slab").applyInPandas(write, "slab bigint, bytes bigint").agg(F.sum("bytes")).collect()


def _arrow_folder(folder: str):
    from pyarrow import fs

    if "://" in folder:
        system, target = fs.FileSystem.from_uri(folder)
        return target, system
    return folder.removeprefix("file:"), fs.LocalFileSystem()


def write_file(data: LabelArray | Dataset, path: str, name: str = "value", clobber: bool = True) -> None:
    spark = (data if isinstance(data, LabelArray) else next(iter(data.values()))).spark
    fs, p = _path(spark, path)
    out = fs.create(p, clobber)
    out.write(bytearray(to_bytes(data, name)))
    out.close()


def read_files(spark: SparkSession, path: str, names=None, indices: dict | None = None, axis: str | None = None, keys=None, align: bool = False, sort: bool = False, join: str = "outer", **how):
    """One file or a sorted pattern of files: with axis among the dimensions concatenated, else stacked by file stems."""
    from ..dataset import concatenate_ds, stack_ds

    fs, p = _path(spark, path)
    found = sorted(str(f.getPath()) for f in fs.globStatus(p) or [])
    if not found:
        raise FileNotFoundError(path)
    parts = [open_file(spark, f) for f in found]
    wanted = [names] if isinstance(names, str) else names
    parts = [d.take(indices or {}, names=wanted, **how) for d in parts]
    if len(parts) == 1 and not any(c in path for c in "*?["):
        out = parts[0]
    elif axis in parts[0].dims:
        out = concatenate_ds(parts, axis, align, sort, join)
    else:
        out = stack_ds(parts, axis, keys or [f.rsplit("/", 1)[-1].rsplit(".", 1)[0] for f in found], align, sort, join)
    return out[names] if isinstance(names, str) else out
