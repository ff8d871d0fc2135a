"""Arrays as JSON, small ones on the driver and columns of texts in the executors; axes as dicts."""

from __future__ import annotations

import datetime as dt
import json

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..axis import Axis


def _out(x):
    return x.isoformat() if isinstance(x, (dt.date, dt.datetime)) else x


def axis_to(a: Axis) -> dict:
    return {"name": a.name, "kind": None if a.is_open or a.members or a.dummy else a.kind, "labels": None if a.labels is None else [_out(x) for x in a.labels], "attrs": a.attrs, "tol": a.tol, "members": [axis_to(m) for m in a.members], "dummy": a.dummy, "by_pos": a.by_pos}


def axis_from(d: dict) -> Axis:
    labels = d["labels"]
    if labels is not None and d["kind"] in ("time", "date"):
        labels = [(dt.datetime if d["kind"] == "time" else dt.date).fromisoformat(x) for x in labels]
    return Axis(d["name"], None if labels is None else tuple(labels), d["attrs"], d["tol"], tuple(axis_from(m) for m in d["members"]), d["dummy"], d["by_pos"])


def to_dict(a) -> dict:
    values = a.values
    if values.dtype.kind == "f":
        values = np.where(np.isnan(values), None, values.astype(object))
    return {"values": values.tolist(), "dims": list(a.dims), "labels": [[_out(x) for x in v] for v in a.labels], "shape": list(a.shape), "ndim": a.ndim, "meta": a.attrs}


def dump(a, **k) -> str:
    return json.dumps(to_dict(a), **k)


def load(spark: SparkSession, data: str | dict):
    from ..array import LabelArray

    d = json.loads(data) if isinstance(data, str) else data
    flat = np.array(d["values"], dtype=object)
    holes = any(x is None for x in flat.reshape(-1))
    values = flat.astype(float) if holes else np.array(d["values"])
    return LabelArray.from_values(spark, values.reshape(d["shape"]), list(zip(d["dims"], d["labels"], strict=True)), attrs=d.get("meta"))


def cells_of(df: DataFrame, column: str, dims: Sequence[str], keep: Sequence[str] = (), kinds: dict[str, str] | None = None, value: str = "double") -> DataFrame:
    """Rows of keep, dims and value from a column of nested JSON texts, or of variants, walked level by level in Spark.

    The keys of an object, or the places in a list, are the labels of a level; after as many levels as dims
    there are values, of which those that are no ``value`` are missing. kinds: SQL types of labels other than
    string; keys that are no such label, null texts and texts that are no JSON give no cell, and
    neither do branches that end early. Columns of df but those in keep are not used.
    """
    names = [f"__d{i}" for i in range(len(dims))]
    kind = dict(df.dtypes)[column]
    source = F.col(f"`{column}`") if kind == "variant" else F.try_parse_json(F.col(f"`{column}`"))
    rows = df.select(*[F.col(f"`{k}`").alias(f"__k{i}") for i, k in enumerate(keep)], source.alias("__v"))
    carried = [f"__k{i}" for i in range(len(keep))]
    for n, d in zip(names, dims, strict=True):
        step = df.sparkSession.tvf.variant_explode(F.col("__v").outer()).select(F.coalesce("key", F.col("pos").cast("string")).alias(n), F.col("value").alias("__next"))
        rows = rows.lateralJoin(step).select(*carried, F.col(n).try_cast((kinds or {}).get(d, "string")).alias(n), F.col("__next").alias("__v")).where(F.col(n).isNotNull())
        carried.append(n)
    got = F.try_variant_get("__v", "$", value)
    return rows.select(*[F.col(c).alias(d) for c, d in zip(carried, [*keep, *dims], strict=True)], got.alias("value"))
