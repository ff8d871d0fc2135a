"""Arrays and datasets as Parquet with a small JSON descriptor.

A store is a folder: Parquet tables of each variable (label columns and value), and for each version
of the store a folder _meta-<number> whose one text file describes axes, attributes and which tables
hold the cells. It is written and read by Spark alone, so it can be in any file system that Spark
reaches. Opening reads the newest complete descriptor only; label filters and the choice of variables
reach the Parquet scan.

Nothing is written over: each write makes a table of its own, and the new descriptor, written
last, brings it in. A write that fails leaves the version before as it was. A variable may be cut into tiles;
then a partial write makes only the tiles anew that it touches, and the descriptor says for each
tile which table has it. Older versions can be opened until they are vacuumed.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Sequence
from functools import reduce
from itertools import product

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..array import LabelArray
from ..axis import Axis
from ..dataset import Dataset, concatenate_ds, stack_ds
from .jsons import axis_from, axis_to

MODES = ("w", "w-", "a", "a+", "r")


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _exists(spark: SparkSession, path: str) -> bool:
    fs, p = _path(spark, path)
    return fs.exists(p)


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the complete versions, ascending."""
    fs, p = _path(spark, path)
    if not fs.exists(p):
        return []
    names = [f.getPath().getName() for f in fs.listStatus(p)]
    return sorted(int(n[6:]) for n in names if n.startswith("_meta-") and _exists(spark, f"{path}/{n}/_SUCCESS"))


def _meta(spark: SparkSession, path: str, version: int | None = None) -> dict:
    known = versions(spark, path)
    if not known or version is not None and version not in known:
        raise FileNotFoundError(f"{path}, version {version}" if known else path)
    n = known[-1] if version is None else version
    return json.loads("\n".join(r.value for r in spark.read.text(f"{path}/_meta-{n:08d}").collect()))


def _commit(spark: SparkSession, path: str, meta: dict) -> None:
    """The next version. Of two writers at once the second finds the number taken and fails."""
    n = (versions(spark, path) or [0])[-1] + 1
    spark.createDataFrame([(json.dumps(meta, default=str),)], "value string").coalesce(1).write.text(f"{path}/_meta-{n:08d}")


def _tile(a: LabelArray, tiles: dict[str, int]):
    """The cells with __tile, the place of their tile along each tiled dimension."""
    cells = a.cells
    for d in tiles:
        cells = a.with_pos(cells, a.axis(d))
    parts = [F.expr(f"`__pos_{d}` div {n}").cast("string") for d, n in tiles.items()]
    return cells.withColumn("__tile", F.concat(F.lit("t"), F.concat_ws("_", *parts))).select(*a.cells.columns, "__tile")


def _write_cells(a: LabelArray, path: str, name: str, tiles: dict[str, int] | None, fill_value: float | None, partition_by: str | None, only: Sequence[str] | None = None) -> dict:
    """A table of its own for the cells; the part of the descriptor that says where they are. only: these tiles, even those without a cell left."""
    folder = f"{name}/v-{uuid.uuid4().hex}"
    src = a.dense() if fill_value is not None else a
    if fill_value is not None:
        src = src.make(src.cells.withColumn("value", F.coalesce("value", F.lit(fill_value).cast(a.dtype))), src.axes)
    if not tiles:
        w = src.cells.write
        (w.partitionBy(partition_by) if partition_by in a.dims else w).parquet(f"{path}/{folder}")
        return {"folders": [folder]}
    cells = _tile(src, tiles)
    cells = cells.where(F.col("__tile").isin(*only)) if only is not None else cells
    cells.repartition("__tile").write.partitionBy("__tile").parquet(f"{path}/{folder}")
    there = only if only is not None else [r[0] for r in a.spark.read.schema("__tile string").parquet(f"{path}/{folder}").select("__tile").distinct().collect()]
    return {"tiles": dict.fromkeys(there, folder)}


def write_dataset(ds: Dataset, path: str, mode: str = "w", fill_value: float | None = None, partition_by: str | None = None, tiles: dict[str, int] | None = None) -> None:
    """Modes: w overwrites, w- must not exist, a adds to an existing store, a+ creates or adds.

    fill_value is written in place of missing cells and read back as missing. partition_by: a
    dimension whose labels become folders, for partition pruning. tiles: labels of a tile by dimension; their
    number is metadata, like that of labels.
    """
    if mode not in MODES or mode == "r":
        raise ValueError(f"cannot write in mode {mode!r}")
    if not ds.variables:
        raise ValueError("an empty dataset has nothing to write")
    spark = next(iter(ds.values())).spark
    there = bool(versions(spark, path))
    if mode == "w-" and there:
        raise FileExistsError(path)
    if mode == "a" and not there:
        raise FileNotFoundError(path)
    old = _meta(spark, path) if there and mode in ("a", "a+") else {"variables": {}, "attrs": {}}
    for name, v in ds.items():
        known = {a["name"]: a for x in old["variables"].values() for a in x["axes"]}
        for a in v.axes:
            if a.name in known and axis_from(known[a.name]) != a:
                import warnings

                warnings.warn(f"axis {a.name!r} differs from the one stored", stacklevel=2)
        cut = {d: n for d, n in (tiles or {}).items() if d in v.dims}
        place = _write_cells(v, path, name, cut, fill_value, partition_by)
        old["variables"][name] = {"axes": [axis_to(a) for a in v.axes], "attrs": v.attrs, "dtype": v.dtype, "fill_value": fill_value, "cut": cut, "partition_by": partition_by, **place}
    old["attrs"] |= ds.attrs
    _commit(spark, path, old)


def write_array(a: LabelArray, path: str, mode: str = "w", name: str = "value", **how) -> None:
    write_dataset(Dataset({name: a}), path, mode, **how)


def append(a: LabelArray, path: str, name: str, axis: str) -> None:
    """Add cells along a growing dimension: the new labels must not be there yet."""
    meta = _meta(a.spark, path)
    var = meta["variables"][name]
    axes = [axis_from(x) for x in var["axes"]]
    i = [x.name for x in axes].index(axis)
    new = a.axis(axis)
    if set(new.values) & set(axes[i].values):
        raise ValueError(f"labels of {axis!r} are stored already")
    whole = Axis.of(axis, [*axes[i].values, *new.values])
    grown = [whole if k == i else x for k, x in enumerate(axes)]
    part = a.transpose(*[x.name for x in axes])
    var["axes"][i] = axis_to(whole)
    if var["cut"]:  # tiles that hold old and new labels are made anew
        part = part.make(part.cells, grown)
        both = {r[0] for r in _tile(part, var["cut"]).select("__tile").distinct().collect()}
        mixed = [t for t in both if t in var["tiles"]]
        if mixed:
            held = Store(a.spark, path)._cells(name, var, mixed)
            part = part.make(part.cells.unionByName(held), grown)
        var["tiles"] |= _write_cells(part, path, name, var["cut"], None, None, sorted(both))["tiles"]
    else:
        var["folders"] += _write_cells(part, path, name, None, None, var["partition_by"])["folders"]
    _commit(a.spark, path, meta)


class Store:
    """A lazy handle on a version, the newest if none is named: variables are un-triggered scans."""

    def __init__(self, spark: SparkSession, path: str, version: int | None = None):
        self.spark, self.path, self.meta = spark, path, _meta(spark, path, version)

    def keys(self) -> list[str]:
        return list(self.meta["variables"])

    def summary(self) -> str:
        return "\n".join(f"{k}: {tuple(a['name'] for a in v['axes'])} {v['dtype']}" for k, v in self.meta["variables"].items())

    def _cells(self, name: str, var: dict, tiles: Sequence[str] | None = None):
        """The cells of a variable, or of some of its tiles."""
        axes = [axis_from(a) for a in var["axes"]]
        schema = ", ".join([*[f"`{m.name}` {m.key_type()}" for a in axes if not a.dummy for m in a.levels], f"value {var['dtype']}"])
        read = self.spark.read.schema(schema + ", __tile string" * bool(var["cut"]))
        if not var["cut"]:
            return read.parquet(*[f"{self.path}/{f}" for f in var["folders"]])
        held: dict[str, list[str]] = {}
        for tile, folder in var["tiles"].items():
            if tiles is None or tile in tiles:
                held.setdefault(folder, []).append(tile)
        parts = []
        for folder, some in held.items():  # tiles are folders, so what the other tables have by now is not read
            cells = read.parquet(f"{self.path}/{folder}")
            mine = self.spark.createDataFrame([(t,) for t in some], "__tile string")
            parts.append((cells.where(F.col("__tile").isin(*some)) if len(some) <= 1000 else cells.join(F.broadcast(mine), "__tile", "left_semi")).drop("__tile"))
        return reduce(lambda x, y: x.unionByName(y), parts) if parts else self.spark.createDataFrame([], schema)

    def __getitem__(self, name: str) -> LabelArray:
        return self._array(name)

    def _array(self, name: str, tiles: Sequence[str] | None = None) -> LabelArray:
        var = self.meta["variables"][name]
        cells = self._cells(name, var, tiles)
        if var.get("fill_value") is not None:
            cells = cells.withColumn("value", F.when(F.col("value") != F.lit(var["fill_value"]), F.col("value")))
        return LabelArray(cells, [axis_from(a) for a in var["axes"]], var["attrs"])

    def read(self, names: str | Iterable[str] | None = None, indices: dict | None = None, indexing: str = "label", tol: float | None = None, keepdims: bool = False):
        """A name gives an array, a list or nothing a dataset."""
        one = isinstance(names, str)
        ds = Dataset(attrs=self.meta["attrs"])
        ds.variables = {n: self[n] for n in ([names] if one else names or self.keys())}
        if indices:
            ds = ds.take(indices, indexing=indexing, tol=tol, keepdims=keepdims)
        return ds[names] if one else ds

    def write(self, name: str, a: LabelArray, **how) -> None:
        write_array(a, self.path, "a", name, **how)
        self.meta = _meta(self.spark, self.path)

    def put(self, name: str, indices, values, indexing: str | None = None, tol: float | None = None, **how) -> None:
        """A partial write: a table with the tiles that are touched, or of an uncut variable with all its cells, once."""
        var = self.meta["variables"][name]
        cut, touched = var["cut"], None
        whole = self[name]
        if cut and not isinstance(indices, LabelArray):
            asked = whole._by_axis(indices, None)
            at = {whole.dims[i]: whole._positions(whole.axes[i], k, indexing or whole.by, tol) for i, k in asked.items()}
            places = [sorted({p // n for p in ([at[d]] if isinstance(at.get(d), int) else at.get(d, range(whole.axis(d).size)))}) for d, n in cut.items()]
            touched = ["t" + "_".join(map(str, x)) for x in product(*places)]
            whole = self._array(name, touched)
        new = whole.put(indices, values, indexing=indexing, tol=tol, **how)
        if not cut:
            var |= _write_cells(new, self.path, name, None, var.get("fill_value"), var["partition_by"])
        elif touched is None:
            var |= _write_cells(new, self.path, name, cut, None, None)
        else:
            var["tiles"] |= _write_cells(new, self.path, name, cut, None, None, touched)["tiles"]
        var["dtype"] = new.dtype
        _commit(self.spark, self.path, self.meta)

    def vacuum(self) -> list[str]:
        """Delete the tables and descriptors of older versions; the folders that went."""
        known = versions(self.spark, self.path)
        newest = _meta(self.spark, self.path)
        kept = {f for v in newest["variables"].values() for f in [*v.get("folders", []), *v.get("tiles", {}).values()]}
        fs, p = _path(self.spark, self.path)
        old = [f"_meta-{n:08d}" for n in known[:-1]]
        for status in fs.listStatus(p):
            name = status.getPath().getName()
            if status.isDirectory() and not name.startswith("_"):
                old += [f"{name}/{x.getPath().getName()}" for x in fs.listStatus(status.getPath()) if f"{name}/{x.getPath().getName()}" not in kept]
        for x in old:
            fs.delete(_path(self.spark, f"{self.path}/{x}")[1], True)
        return old


def open_store(spark: SparkSession, path: str, version: int | None = None) -> Store:
    return Store(spark, path, version)


def read(spark: SparkSession, path: str | list[str], names=None, indices: dict | None = None, axis: str | None = None, keys=None, align: bool = False, sort: bool = False, join: str = "outer", **how):
    """One store, or several (a list or a pattern): with axis among the dimensions they are concatenated, else stacked.

    keys: labels of the new dimension; the stores' names by default.
    """
    if isinstance(path, str) and any(c in path for c in "*?["):
        fs, p = _path(spark, path)
        found = fs.globStatus(p)
        path = sorted(str(f.getPath()) for f in found or [])
        if not path:
            raise FileNotFoundError("no store fits the pattern")
    if isinstance(path, str):
        return Store(spark, path).read(names, indices, **how)
    parts = [Store(spark, p).read([names] if isinstance(names, str) else names, indices, **how) for p in path]
    if axis in parts[0].dims:
        out = concatenate_ds(parts, axis, align, sort, join)
    else:
        out = stack_ds(parts, axis, keys or [p.rstrip("/").rsplit("/", 1)[-1].rsplit(".", 1)[0] for p in path], align, sort, join)
    return out[names] if isinstance(names, str) else out
