"""More queries over the cubes: constructors, shapes, axes, datasets, files and exact corner cases."""

from __future__ import annotations

import re
import uuid

import numpy as np
from pyspark.sql import functions as F

import gridloom as gl

from ..array import LabelArray
from ..axis import Axis
from ..dataset import Dataset
from ..sources import cf, netcdf
from ..scratch import RUN, shared_folder
from .queries import ev, li, od, od_count, pt, pt3, query


def _rows(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


# -- constructors and conversions -------------------------------------------------------------


@query("SELECT * FROM ev WHERE day <= 4")
def from_nested(spark, sf):
    found = ev(spark, sf).sel(day=slice(None, 4)).to_dataframe().collect()
    nested: dict = {}
    for r in found:
        nested.setdefault(r.event_type, {})[r.day] = r.value
    return LabelArray.from_nested(spark, nested, dims=["event_type", "day"])


@query("SELECT 'most' AS stat, event_type, max(value) AS value FROM ev GROUP BY ALL UNION ALL SELECT 'all', event_type, sum(value) FROM ev GROUP BY ALL", 2)
def array_of_arrays(spark, sf):
    a = ev(spark, sf)
    return gl.array({"most": a.max("day"), "all": a.sum("day")}, axis="stat")


@query("SELECT o_orderpriority, o_orderstatus, year, 2 * value + 1 AS value FROM odc")
def constants_like(spark, sf):
    a = od_count(spark, sf)
    return a + gl.ones_like(a) + gl.zeros_like(a) + gl.full(spark, 1, list(a.axes), dtype="bigint") * a


@query("SELECT * FROM grid3", dense=True)
def pandas_round_trip(spark, sf):
    return LabelArray.from_pandas(spark, pt3(spark, sf).to_pandas())


@query("SELECT * FROM grid3", dense=True)
def json_round_trip(spark, sf):
    return LabelArray.from_json(spark, pt3(spark, sf).to_json())


@query("SELECT p_size, count(value) AS n, sum(value) AS value FROM grid3 GROUP BY p_size", 4, True)
def masked_array(spark, sf):
    a = pt3(spark, sf)
    m = a.to_masked()
    return _rows(spark, [(s, int(m[:, k].count()), float(m[:, k].sum()) if m[:, k].count() else None) for k, s in enumerate(a.labels[1])], "p_size long, n long, value double")


@query("SELECT o_orderpriority, sum(value)::BIGINT AS value FROM odc GROUP BY ALL")
def iterate(spark, sf):
    return _rows(spark, [(label, x.sum()) for label, x in od_count(spark, sf).iter("o_orderpriority")], "o_orderpriority string, value long")


@query("SELECT o_orderstatus, year, value FROM odc WHERE o_orderpriority = '1-URGENT'")
def list_of_slices(spark, sf):
    return od_count(spark, sf).to_list("o_orderpriority")[0]


@query("SELECT event_type, day, 2 * value AS value FROM ev", 2)
def repeated_cells(spark, sf):
    t = ev(spark, sf).to_dataframe()
    return LabelArray.from_dataframe(t.union(t), ["event_type", "day"], aggregate=F.sum)


@query("SELECT event_type, sum(value) AS value FROM ev WHERE day > 10 GROUP BY ALL", 2)
def null_labels(spark, sf):
    t = ev(spark, sf).to_dataframe().withColumn("day", F.when(F.col("day") > 10, F.col("day")))
    return LabelArray.from_dataframe(t, ["event_type", "day"]).sum("day")


# -- indexing ---------------------------------------------------------------------------------


@query("SELECT event_type, day, value FROM ev WHERE day IN (30, 2)")
def take_axis_modes(spark, sf):
    return ev(spark, sf).take_axis([99, 1.5], axis="day", mode="clip")


@query("SELECT DISTINCT event_type, value FROM ev WHERE day = 3 ORDER BY 1")
def axis_loc(spark, sf):
    a = ev(spark, sf)
    at = a.axis("day").locate(3)
    return a.isel(day=at)


@query("SELECT event_type, day, value, (row_number() OVER (PARTITION BY event_type ORDER BY day DESC) - 1)::BIGINT AS pos FROM ev", 2)
def sort_axis(spark, sf):
    a = ev(spark, sf).sort_axis("day", key=lambda d: -d)
    return a.with_pos(a.cells, a.axis("day")).withColumnRenamed("__pos_day", "pos").select("event_type", "day", F.col("pos").cast("bigint").alias("pos"), "value")


@query("SELECT p_brand, p_size, CASE WHEN p_size = 7 AND p_brand = 'Brand#1' THEN 1.0 ELSE value END AS value FROM grid3 WHERE value IS NOT NULL OR (p_size = 7 AND p_brand = 'Brand#1')")
def put_one_cell(spark, sf):
    return pt3(spark, sf).put({"p_brand": "Brand#1", "p_size": 7}, 1.0)


@query("SELECT p_brand, p_size, CASE WHEN value > 950 THEN 0.0 ELSE value END AS value FROM grid3", dense=True)
def put_mask(spark, sf):
    a = pt3(spark, sf)
    return a.put(a > 950, 0.0)


# -- arithmetic -------------------------------------------------------------------------------


@query("SELECT o_orderpriority, o_orderstatus, year, 1000 - value AS value FROM odc")
def reflected(spark, sf):
    return 1000 - od_count(spark, sf)


@query("SELECT p_brand, p_size, NOT coalesce(value > 950, false) AS value FROM grid3")
def unary_not(spark, sf):
    return ~(pt3(spark, sf) > 950)


@query("SELECT event_type, day, -value AS value FROM ev", 2)
def unary_minus(spark, sf):
    return -ev(spark, sf)


@query("SELECT event_type, day, sqrt(value * value + 1) AS value FROM ev", 6)
def numpy_functions(spark, sf):
    return np.sqrt(np.add(np.square(ev(spark, sf)), 1))


@query("SELECT p_brand, p_size, coalesce(value > 930 AND value < 960, false) AS value FROM grid3")
def logical_and(spark, sf):
    a = pt3(spark, sf)
    return (a > 930) & (a < 960)


@query("SELECT p_brand, p_size, coalesce(value < 930 OR value > 960, false) AS value FROM grid3")
def logical_or(spark, sf):
    a = pt3(spark, sf)
    return (a < 930) | (a > 960)


@query("SELECT p_brand, p_size, coalesce(floor(value / 10) <> 95.0, true) AS value FROM grid3")
def not_equal(spark, sf):
    return pt3(spark, sf) // 10 != 95.0


@query("SELECT event_type, day, value * (day + 0.5) AS value FROM ev", 4)
def array_with_ndarray(spark, sf):
    a = ev(spark, sf)
    return a * (np.array(a.labels[1]) + 0.5)


@query("SELECT p_brand, p_size, p_size::DOUBLE AS value FROM grid3")
def power_zero(spark, sf):
    return pt3(spark, sf) ** 0 * np.arange(1, 51)


@query("SELECT p_size, count(*) FILTER (WHERE value < 950) AS value FROM grid3 GROUP BY p_size")
def count_missing(spark, sf):
    a = pt3(spark, sf)
    inf = a.apply(lambda v: F.when(v < 950, v).otherwise(F.lit(float("inf"))))
    return (inf - inf).count("p_brand")


@query("SELECT o_orderpriority, product(value::HUGEINT::DOUBLE) > 9e15 AS large, value FROM (SELECT o_orderpriority, value FROM odc WHERE o_orderstatus = 'F' AND year = 1995) x GROUP BY ALL UNION ALL SELECT 'three', true, 50031545098999707")
def prod_exact(spark, sf):
    a = od_count(spark, sf).take({"o_orderstatus": "F", "year": slice(1995, 1995)}).prod("year")
    three = LabelArray.from_values(spark, np.full(35, 3)).prod()
    out = a.to_dataframe().select("o_orderpriority", (F.col("value") > 9_000_000_000_000_000).alias("large"), "value")
    return out.union(_rows(spark, [("three", three > 9_000_000_000_000_000, three)], "o_orderpriority string, large boolean, value long"))


@query("SELECT (k - 1)::BIGINT AS x0, list_reduce(list_transform(range(k), lambda i: 3::BIGINT), lambda x, y: x * y) AS value FROM range(1, 36) r(k)")
def cumprod_exact(spark, sf):
    return LabelArray.from_values(spark, np.full(35, 3)).cumprod()


# -- alignment and shape ----------------------------------------------------------------------


@query("SELECT year, o_orderpriority, o_orderstatus, value FROM od")
def transpose(spark, sf):
    return od(spark, sf).transpose("year", "o_orderpriority", "o_orderstatus")


@query("SELECT o_orderstatus, o_orderpriority, year, sum(value) OVER (PARTITION BY o_orderstatus, o_orderpriority ORDER BY year) AS value FROM od", 2)
def swap_and_roll(spark, sf):
    a = od(spark, sf).swapaxes(0, 1).rollaxis("year")
    return a.cumsum(0).rollaxis(0, 3)


@query("SELECT o_orderpriority, value FROM odc WHERE o_orderstatus = 'F' AND year = 1996")
def squeeze(spark, sf):
    return od_count(spark, sf).take({"o_orderstatus": ["F"], "year": [1996]}).squeeze()


@query("SELECT o_orderpriority, o_orderstatus, year, value FROM od")
def flatten_unflatten(spark, sf):
    return od(spark, sf).flatten("o_orderpriority", "year", insert=0).unflatten().transpose("o_orderpriority", "o_orderstatus", "year")


@query("SELECT o_orderstatus, max(value) AS value FROM od GROUP BY ALL", 2)
def flatten_reverse(spark, sf):
    return od(spark, sf).flatten("o_orderstatus", reverse=True).max("o_orderpriority,year")


@query("SELECT o_orderpriority, o_orderstatus, year, value FROM od")
def reshape(spark, sf):
    return od(spark, sf).reshape("o_orderstatus,year", "o_orderpriority", "one").squeeze("one").ungroup()


@query("SELECT o_orderstatus, year, value - lag(value) OVER (ORDER BY o_orderstatus, year) AS value FROM odc WHERE o_orderpriority = '1-URGENT' QUALIFY row_number() OVER (ORDER BY o_orderstatus, year) > 1")
def flatten_diff(spark, sf):
    return od_count(spark, sf).sel(o_orderpriority="1-URGENT").flatten().diff(0)


@query("SELECT p_brand, p_size, value FROM grid3 WHERE value IS NOT NULL")
def flatten_dropna(spark, sf):
    a = pt3(spark, sf).flatten()
    out = a.dropna(0)
    return out.fillna(-1.0)


@query("SELECT * FROM (VALUES ('Brand#10', 3::BIGINT), ('Brand#1', 50), ('none', 1)) k(p_brand, p_size) LEFT JOIN grid3 USING (p_brand, p_size)", dense=True)
def flatten_reindex(spark, sf):
    return pt3(spark, sf).flatten().reindex_axis([("Brand#10", 3), ("Brand#1", 50), ("none", 1)])


@query("SELECT p_brand, p_size, CASE WHEN p_brand = 'Brand#10' AND p_size = 3 THEN 5.0 ELSE value END AS value FROM grid3 WHERE value IS NOT NULL OR (p_brand = 'Brand#10' AND p_size = 3)")
def flatten_put(spark, sf):
    return pt3(spark, sf).flatten().put([("Brand#10", 3)], 5.0)


@query("SELECT row_number() OVER (ORDER BY o_orderstatus, year) - 1 AS k, value FROM odc WHERE o_orderpriority = '1-URGENT'")
def flatten_set_axis(spark, sf):
    a = od_count(spark, sf).sel(o_orderpriority="1-URGENT").flatten()
    return a.set_axis(list(range(a.size)), axis=0, name="k")


@query("SELECT o_orderpriority, o_orderstatus, b.year, a.value + b.value AS value FROM (SELECT o_orderpriority, o_orderstatus, sum(value) AS value FROM odc GROUP BY ALL) a CROSS JOIN (SELECT year, sum(value) AS value FROM odc GROUP BY ALL) b")
def align_dims(spark, sf):
    a = od_count(spark, sf)
    x, y = gl.align_dims(a.sum("year"), a.sum(("o_orderpriority", "o_orderstatus")))
    return (x.broadcast(y) + y.broadcast(x)).transpose("o_orderpriority", "o_orderstatus", "year")


@query("SELECT event_type, day, value - min(value) OVER w AS value FROM ev WINDOW w AS (PARTITION BY event_type ORDER BY day ROWS UNBOUNDED PRECEDING)", 4)
def apply_cumulative(spark, sf):
    return ev(spark, sf).apply_along_axis(lambda v: v - np.minimum.accumulate(v), "day", same=True)


# -- interpolation ----------------------------------------------------------------------------


@query("SELECT a.event_type, d.x AS day, (a.value + b.value) / 2 AS value FROM (VALUES (4.5::DOUBLE), (9.5::DOUBLE)) d(x) JOIN ev a ON a.day = floor(d.x) JOIN ev b ON b.event_type = a.event_type AND b.day = a.day + 1", 6)
def interp_like(spark, sf):
    a = ev(spark, sf)
    return a.interp_like(gl.zeros(spark, [("day", [4.5, 9.5])]))


@query("SELECT event_type, d.x AS day, value FROM (VALUES (4.2::DOUBLE), (9.9::DOUBLE)) d(x) JOIN ev ON ev.day = round(d.x)")
def interp1d_nearest(spark, sf):
    return gl.interp1d(ev(spark, sf), [4.2, 9.9], "day", method="nearest")


# -- datasets ---------------------------------------------------------------------------------


def _set(spark, sf) -> Dataset:
    a = ev(spark, sf)
    return Dataset({"daily": a, "top": a.max("day"), "low": a.min("day")})


@query("SELECT event_type, daily.value AS daily, top.value AS top FROM (SELECT * FROM ev WHERE day = 9) daily JOIN (SELECT event_type, max(value) AS value FROM ev GROUP BY ALL) top USING (event_type)")
def dataset_take(spark, sf):
    return _set(spark, sf).take({"day": 9}, names=["daily", "top"]).to_dataframe()


@query("SELECT event_type, max(value) AS value FROM ev GROUP BY ALL")
def dataset_item(spark, sf):
    ds = _set(spark, sf)
    ds["copy"] = ds["top"]
    del ds["low"]
    return ds.copy()["copy"]


@query("SELECT event_type AS kind, max(value) AS top, min(value) AS low FROM ev GROUP BY ALL")
def dataset_rename_axes(spark, sf):
    return Dataset({k: v for k, v in _set(spark, sf).items() if k != "daily"}).rename_axes({"event_type": "kind"}).to_dataframe()


@query("SELECT event_type, day, value FROM ev WHERE day IN (5, 6)")
def dataset_take_axis(spark, sf):
    return _set(spark, sf).take_axis([5, 6], "day")["daily"]


@query("SELECT event_type, d.day, value FROM (SELECT DISTINCT event_type FROM ev) CROSS JOIN (VALUES (5::BIGINT), (99::BIGINT)) d(day) LEFT JOIN ev USING (event_type, day)", dense=True)
def dataset_reindex(spark, sf):
    return _set(spark, sf).reindex_axis([5, 99], "day")["daily"]


@query("SELECT a.event_type, d.x AS day, a.value + 0.25 * (b.value - a.value) AS value FROM (VALUES (4.25::DOUBLE)) d(x) JOIN ev a ON a.day = floor(d.x) JOIN ev b ON b.event_type = a.event_type AND b.day = a.day + 1", 6)
def dataset_interp(spark, sf):
    return _set(spark, sf).interp_axis([4.25], "day")["daily"]


@query("SELECT event_type, max(value) - min(value) AS value FROM ev GROUP BY ALL", 2)
def dataset_reduce_axis(spark, sf):
    return _set(spark, sf).reduce_axis(lambda v: float(v.max() - v.min()), "day")["daily"]


@query("SELECT 'a' AS run, event_type, max(value) AS value FROM ev GROUP BY ALL UNION ALL SELECT 'b', event_type, 2 * max(value) FROM ev GROUP BY ALL", 2)
def stack_datasets(spark, sf):
    ds = Dataset({"top": ev(spark, sf).max("day")})
    return gl.stack_ds({"a": ds, "b": ds * 2}, axis="run")["top"]


@query("SELECT event_type, day, value FROM ev WHERE day < 3 UNION ALL SELECT event_type, day, value FROM ev WHERE day > 28")
def concatenate_datasets(spark, sf):
    ds = Dataset({"daily": ev(spark, sf)})
    return gl.concatenate_ds([ds.sel(day=slice(None, 2)), ds.sel(day=slice(29, None))], "day")["daily"]


# -- axes -------------------------------------------------------------------------------------


@query("SELECT day AS label, day - 1 AS pos, day % 7 = 0 AS week FROM (SELECT DISTINCT day FROM ev)")
def axis_labels(spark, sf):
    a = ev(spark, sf).axis("day")
    again = Axis.from_pandas(a.copy().to_pandas())
    if again != a or not a.is_monotonic() or a.cast("float").kind != "float":
        raise AssertionError("an axis does not come back from pandas")
    return a.table(spark, pos="pos", label="label").select("label", "pos", (F.col("label") % 7 == 0).alias("week"))


@query("SELECT event_type, (100 * day)::BIGINT AS day, value FROM ev")
def axis_in_place(spark, sf):
    a = ev(spark, sf)
    a.day = [100 * d for d in a.labels[1]]
    return a


@query("SELECT CASE WHEN l_linestatus = 'F' THEN 'done' ELSE l_linestatus END AS l_linestatus, l_returnflag, month, value FROM li")
def set_axis_mapping(spark, sf):
    return li(spark, sf).set_axis({"F": "done"}, axis="l_linestatus")


@query("SELECT p_brand, 51 - p_size AS p_size, value FROM grid3 WHERE value IS NOT NULL")
def axis_function_order(spark, sf):
    return pt3(spark, sf).set_axis(lambda s: 51 - s, axis="p_size").sort_axis("p_size")


@query("SELECT count(value) AS n, 150 - count(value) AS missing, 3::BIGINT AS brands, 50::BIGINT AS sizes FROM grid3")
def summary_counts(spark, sf):
    """The numbers as the summary gives them."""
    lines = pt3(spark, sf).summary().split("\n")
    n, missing = (int(x) for x in re.findall(r"(\d+)", lines[0]))
    brands, sizes = (int(re.search(r"\((\d+)\)", x)[1]) for x in lines[1:3])
    return _rows(spark, [(n, missing, brands, sizes)], "n long, missing long, brands long, sizes long")


@query("SELECT count(*) > 0 AS found, (SELECT sum(value)::BIGINT FROM odc) AS total FROM odc WHERE value = (SELECT max(value) FROM odc)")
def scalar_conversions(spark, sf):
    a = od_count(spark, sf)
    return _rows(spark, [(a.max() in a, int(a.sum()))], "found boolean, total long")


# -- files ------------------------------------------------------------------------------------


@query("SELECT * FROM grid3 WHERE p_size BETWEEN 11 AND 30", dense=True)
def netcdf_round_trip(spark, sf):
    """A file for each 16 sizes, written by the tasks that hold their cells and read back by ranges."""
    path = f"{shared_folder(spark)}/{RUN}/prices-{uuid.uuid4().hex}"
    netcdf.write_slabs(pt3(spark, sf), path, "p_size", 16, "price")
    return netcdf.read_files(spark, f"{path}/*.nc", "price", axis="p_size").sel(p_size=slice(11, 30)).transpose("p_brand", "p_size")


@query("SELECT event_type, day, CASE WHEN day = 30 THEN value * 2 ELSE value END AS value FROM ev WHERE day > 20", 2)
def store_append_and_put(spark, sf):
    path = f"{shared_folder(spark)}/gridloom-grow-{uuid.uuid4().hex}"
    a = ev(spark, sf)
    a.sel(day=slice(21, 29)).write(path, "w", "amount")
    gl.sources.store.append(a.sel(day=slice(30, 30)), path, "amount", "day")
    gl.open_store(spark, path).put("amount", {"day": 30}, a.sel(day=slice(30, 30)) * 2)
    return gl.read(spark, path, "amount")


@query("SELECT o_orderkey, o_orderkey IS NOT NULL AS same, round(date_diff('second', TIMESTAMP '1990-01-01 00:00:00', o_orderdate::TIMESTAMP) / 86400.0, 6)::DOUBLE AS value FROM orders")
def cf_times(spark, sf):
    utc = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"), F.lit("Z")).cast("timestamp")  # whatever the session's zone
    t = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", utc.alias("t"), cf.encode_datetime(utc, "days since 1990-01-01").alias("days"))
    return t.select("o_orderkey", (cf.decode_datetime(F.col("days"), "days since 1990-01-01") == F.col("t")).alias("same"), F.round("days", 6).alias("value"))


@query("SELECT DISTINCT p_brand, p_size, value FROM grid3 WHERE value IS NOT NULL")
def read_many_files(spark, sf):
    root = f"{shared_folder(spark)}/gridloom-many-{uuid.uuid4().hex}"
    a = pt(spark, sf)
    for k in range(3):
        a.isel(p_brand=[k]).write(f"{root}/{k}", "w", "price")
    return gl.read(spark, [f"{root}/{k}" for k in range(3)], "price", axis="p_brand")


_LEAP = "(CASE WHEN y % 4 = 0 AND (y % 100 <> 0 OR y % 400 = 0) THEN 1 ELSE 0 END)"
_PASSED = "(CASE WHEN m > 2 THEN 1 ELSE 0 END)"


@query(f"""SELECT o_orderkey,
  CASE WHEN NOT (m = 2 AND d = 29) THEN 365 * (y - 1990) + doy - 1 - {_LEAP} * {_PASSED} END::DOUBLE AS noleap,
  (366 * (y - 1990) + doy - 1 + (1 - {_LEAP}) * {_PASSED})::DOUBLE AS all_leap,
  CASE WHEN d <= 30 THEN 360 * (y - 1990) + 30 * (m - 1) + d - 1 END::DOUBLE AS days360,
  (date_diff('day', DATE '1990-01-01', t) + (y - 1) // 100 - (y - 1) // 400 - 15 + CASE WHEN y % 100 = 0 AND y % 400 <> 0 THEN {_PASSED} ELSE 0 END)::DOUBLE AS julian,
  date_diff('day', DATE '1990-01-01', t)::DOUBLE AS standard,
  true AS back
FROM (SELECT o_orderkey, o_orderdate::DATE AS t, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS d, dayofyear(o_orderdate) AS doy FROM orders)""")
def cf_calendars(spark, sf):
    """Order dates counted in each calendar, and read back from the numbers."""
    names = {"noleap": "noleap", "all_leap": "all_leap", "days360": "360_day", "julian": "julian", "standard": "standard"}
    t = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", F.year("o_orderdate").alias("y"), F.month("o_orderdate").alias("m"), F.day("o_orderdate").alias("d"))
    units, zero = "days since 1990-01-01", F.lit(0).cast("bigint")
    t = t.select("*", *[cf.encode_calendar(F.col("y"), F.col("m"), F.col("d"), zero, units, c).alias(n) for n, c in names.items()])
    back = F.lit(True)
    for n, c in names.items():
        x = cf.decode_calendar(F.col(n), units, c)
        back = back & (F.col(n).isNull() | ((x.year == F.col("y")) & (x.month == F.col("m")) & (x.day == F.col("d")) & (x.micros == 0)))
    return t.select("o_orderkey", *names, back.alias("back"))


@query("SELECT * FROM ev")
def json_column(spark, sf):
    """A JSON text for each event type, nested by weeks and days, walked by the executors."""
    t = ev(spark, sf).to_dataframe()
    week = t.groupBy("event_type", F.expr("day div 7").alias("week")).agg(F.map_from_entries(F.collect_list(F.struct(F.col("day").cast("string"), "value"))).alias("days"))
    texts = week.groupBy("event_type").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(F.col("week").cast("string"), "days")))).alias("text"))
    a = LabelArray.from_json_column(texts, "text", ["week", "day"], keep=["event_type"], kinds={"day": "bigint"})
    return a.sum("week", skipna=True)  # a day is in one week


@query("SELECT event_type, day, CASE WHEN event_type = 'click' AND day BETWEEN 9 AND 17 THEN 0.0 ELSE value END AS value FROM ev")
def put_tile(spark, sf):
    """A partial write into two of five tiles, and another that is undone by opening the version before it."""
    path = f"{shared_folder(spark)}/{RUN}/tiles-{uuid.uuid4().hex}"
    ev(spark, sf).write(path, "w", "amount", tiles={"day": 6})
    s = gl.open_store(spark, path)
    s.put("amount", {"event_type": "click", "day": slice(9, 17)}, 0.0)
    s.put("amount", {"day": slice(20, None)}, -1.0)
    return gl.open_store(spark, path, version=2)["amount"]


@query("SELECT p_brand, p_size, value, 'USD' AS unit, 'mean price' AS title FROM grid3 WHERE value IS NOT NULL")
def attrs_and_fill_on_disk(spark, sf):
    """Missing cells written as a fill value, and attributes, come back."""
    path = f"{shared_folder(spark)}/{RUN}/attrs-{uuid.uuid4().hex}"
    a = pt3(spark, sf)
    a.unit = "USD"
    gl.Dataset({"price": a}, attrs={"title": "mean price"}).write(path, "w", fill_value=-999.0)
    ds = gl.read(spark, path)
    return ds["price"].to_dataframe().where("value is not null").select("*", F.lit(ds["price"].unit).alias("unit"), F.lit(ds.attrs["title"]).alias("title"))


@query("SELECT year, sum(value) AS value, 'kept' AS by_selection, 'kept' AS by_reduction, 'dropped' AS by_arithmetic FROM od GROUP BY year", 2)
def attrs_propagation(spark, sf):
    a = od(spark, sf)
    a.unit = "USD"
    total = a.sum(("o_orderpriority", "o_orderstatus"))
    said = lambda x: F.lit("kept" if x.attrs.get("unit") == "USD" else "dropped")
    return total.to_dataframe().select("*", said(a.sel(year=slice(1995, 1996))).alias("by_selection"), said(total).alias("by_reduction"), said(a + a).alias("by_arithmetic"))
