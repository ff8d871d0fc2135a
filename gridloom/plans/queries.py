"""Queries that run each family of operators over cubes of the sample tables, and their SQL."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import gridloom as gl

from ..array import LabelArray
from ..dataset import Dataset
from ..scratch import shared_folder


Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


# -- cubes ------------------------------------------------------------------------------------


def _cents(c):
    return F.round(F.sum(c), 2)


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def li(spark: SparkSession, sf: str) -> LabelArray:
    """Revenue by return flag, line status and ship month."""
    t = _table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", (F.year("l_shipdate") * 100 + F.month("l_shipdate")).cast("bigint").alias("month"), "l_extendedprice")
    return LabelArray.from_dataframe(t, ["l_returnflag", "l_linestatus", "month"], "l_extendedprice", aggregate=_cents)


def pt(spark: SparkSession, sf: str) -> LabelArray:
    """Mean price by brand and size; sizes are 1 to 50, and many cells have no part."""
    t = _table(spark, sf, "part").groupBy("p_brand", F.col("p_size").cast("bigint").alias("p_size")).agg(F.round(F.avg("p_retailprice"), 4).alias("value"))
    return LabelArray.from_dataframe(t, ["p_brand", "p_size"], axes={"p_size": range(1, 51)})


def pt3(spark: SparkSession, sf: str) -> LabelArray:
    """Three brands of pt: some sizes have a part of each, others do not."""
    return pt(spark, sf).isel(p_brand=slice(0, 3))


def od(spark: SparkSession, sf: str) -> LabelArray:
    """Order value by priority, status and year."""
    t = _table(spark, sf, "orders").select("o_orderpriority", "o_orderstatus", F.year("o_orderdate").cast("bigint").alias("year"), "o_totalprice")
    return LabelArray.from_dataframe(t, ["o_orderpriority", "o_orderstatus", "year"], "o_totalprice", aggregate=_cents)


def od_count(spark: SparkSession, sf: str) -> LabelArray:
    t = _table(spark, sf, "orders").select("o_orderpriority", "o_orderstatus", F.year("o_orderdate").cast("bigint").alias("year"), F.lit(1).cast("bigint").alias("value"))
    return LabelArray.from_dataframe(t, ["o_orderpriority", "o_orderstatus", "year"], aggregate=F.count)


def ev(spark: SparkSession, sf: str) -> LabelArray:
    """Event values by type and day of month."""
    t = _table(spark, sf, "events").select("event_type", F.dayofmonth("ts").cast("bigint").alias("day"), "value")
    return LabelArray.from_dataframe(t, ["event_type", "day"], aggregate=_cents)


def by_user(spark: SparkSession, sf: str) -> LabelArray:
    """Event values by type, day and user; users stay an open axis."""
    t = _table(spark, sf, "events").groupBy("event_type", F.dayofmonth("ts").cast("bigint").alias("day"), "user_id").agg(F.round(F.sum("value"), 2).alias("value"))
    return LabelArray.from_dataframe(t, ["event_type", "day", "user_id"], listed=False)


def emb(spark: SparkSession, sf: str) -> LabelArray:
    """Components of the vectors."""
    t = _table(spark, sf, "embeddings").select("vec_id", F.posexplode("embedding").alias("k", "v")).select("vec_id", F.col("k").cast("bigint").alias("component"), F.round(F.col("v").cast("double"), 6).alias("value"))
    return LabelArray.from_dataframe(t, ["vec_id", "component"], axes={"component": range(64)}, listed=False)


CTE = """WITH li AS (SELECT l_returnflag, l_linestatus, (year(l_shipdate) * 100 + month(l_shipdate))::BIGINT AS month, round(sum(l_extendedprice), 2) AS value FROM lineitem GROUP BY ALL),
pt AS (SELECT p_brand, p_size::BIGINT AS p_size, round(avg(p_retailprice), 4) AS value FROM part GROUP BY ALL),
sizes AS (SELECT unnest(range(1, 51))::BIGINT AS p_size), brands AS (SELECT DISTINCT p_brand FROM pt),
grid AS (SELECT p_brand, p_size, value FROM brands CROSS JOIN sizes LEFT JOIN pt USING (p_brand, p_size)),
brands3 AS (SELECT p_brand FROM brands ORDER BY p_brand LIMIT 3), grid3 AS (SELECT * FROM grid WHERE p_brand IN (SELECT p_brand FROM brands3)),
od AS (SELECT o_orderpriority, o_orderstatus, year(o_orderdate)::BIGINT AS year, round(sum(o_totalprice), 2) AS value FROM orders GROUP BY ALL),
odc AS (SELECT o_orderpriority, o_orderstatus, year(o_orderdate)::BIGINT AS year, count(*) AS value FROM orders GROUP BY ALL),
ev AS (SELECT event_type, day(ts)::BIGINT AS day, round(sum(value), 2) AS value FROM events GROUP BY ALL),
us AS (SELECT event_type, day(ts)::BIGINT AS day, user_id, round(sum(value), 2) AS value FROM events GROUP BY ALL)
"""


def query(sql: str, digits: int | None = None, dense: bool = False):
    """Register a function that returns an array (or a frame) under its name."""

    def add(f):
        def run(spark: SparkSession, sf: str) -> DataFrame:
            out = f(spark, sf)
            out = out.to_dataframe(dense) if isinstance(out, LabelArray) else out
            out = out if dense or "value" not in out.columns else out.where("value is not null")
            return out.withColumn("value", F.round("value", digits)) if digits is not None else out

        Q[f.__name__] = run
        SQL[f.__name__] = CTE + (f"SELECT * REPLACE (round(value, {digits}) AS value) FROM ({sql})" if digits is not None else sql) + ("" if dense else "")
        return f

    return add


# -- reductions -------------------------------------------------------------------------------

_AGG = {"sum": "sum(value)", "mean": "avg(value)", "min": "min(value)", "max": "max(value)", "std": "stddev_pop(value)", "var": "var_pop(value)", "ptp": "max(value) - min(value)", "median": "median(value)"}


def _reductions() -> None:
    for op, agg in _AGG.items():
        digits = 2 if op in ("sum", "min", "max", "ptp") else 3 if op != "var" else 0

        def months(spark, sf, op=op):
            return li(spark, sf).reduce(op, "month", skipna=True)

        months.__name__ = f"reduce_{op}_months"
        query(f"SELECT l_returnflag, l_linestatus, {agg} AS value FROM li GROUP BY ALL", digits)(months)
        digits = 4 if op in ("sum", "min", "max", "ptp") else 9 if op != "var" else 6

        def skip(spark, sf, op=op):
            return pt(spark, sf).reduce(op, "p_brand", skipna=True)

        skip.__name__ = f"reduce_{op}_skipna"
        zero = "coalesce(sum(value), 0)" if op == "sum" else agg
        query(f"SELECT p_size, {zero} AS value FROM grid GROUP BY p_size" + ("" if op == "sum" else " HAVING count(value) > 0"), digits)(skip)

        def strict(spark, sf, op=op):
            return pt3(spark, sf).reduce(op, "p_brand")

        strict.__name__ = f"reduce_{op}_strict"
        query(f"SELECT p_size, CASE WHEN count(value) = 3 THEN {agg} END AS value FROM grid3 GROUP BY p_size", digits, True)(strict)


_reductions()


@query("SELECT o_orderpriority, product(value)::BIGINT AS value FROM odc WHERE o_orderstatus = 'F' AND year < 1998 GROUP BY ALL")
def reduce_prod(spark, sf):
    return od_count(spark, sf).take({"o_orderstatus": "F", "year": slice(None, 1997)}).prod("year")


@query("SELECT p_size, count(value) = 3 AS value FROM grid3 GROUP BY p_size")
def reduce_all_present(spark, sf):
    return (pt3(spark, sf) > 0).all("p_brand")


@query("SELECT p_size, bool_or(coalesce(value > 970, false)) AS value FROM grid3 GROUP BY p_size")
def reduce_any(spark, sf):
    return (pt3(spark, sf) > 970).any("p_brand")


@query("SELECT year, sum(value) AS value FROM od GROUP BY year", 2)
def reduce_two_dims(spark, sf):
    return od(spark, sf).sum(("o_orderpriority", "o_orderstatus"))


@query("SELECT round(sum(value), 1) AS total, round(avg(value), 4) AS mean FROM od")
def reduce_all_dims(spark, sf):
    a = od(spark, sf)
    return spark.createDataFrame([(a.sum(), a.mean())], "total double, mean double").select(F.round("total", 1).alias("total"), F.round("mean", 4).alias("mean"))


@query("SELECT event_type, day, sum(value) AS value FROM us GROUP BY ALL", 2)
def reduce_open_axis(spark, sf):
    return by_user(spark, sf).sum("user_id", skipna=True)


@query("SELECT p_brand, arg_max(p_size, (value, -p_size)) AS value FROM pt GROUP BY p_brand")
def argmax_label(spark, sf):
    return pt(spark, sf).argmax("p_size", skipna=True)


@query("SELECT p_brand, coalesce(min(p_size) FILTER (WHERE value IS NULL), arg_min(p_size, (value, p_size))) AS value FROM grid GROUP BY p_brand")
def argmin_strict(spark, sf):
    return pt(spark, sf).argmin("p_size")


@query(" UNION ALL ".join(f"SELECT {p}.0::DOUBLE AS day_percentile, event_type, quantile_cont(value, {p / 100}) AS value FROM ev GROUP BY ALL" for p in (10, 50, 90)), 4)
def percentile_axis(spark, sf):
    return gl.percentile(ev(spark, sf), [10, 50, 90], axis="day")


@query("SELECT event_type, quantile_cont(value, 0.25) AS value FROM ev GROUP BY ALL", 4)
def quantile_axis(spark, sf):
    return gl.quantile(ev(spark, sf), 0.25, axis="day")


# -- accumulation -----------------------------------------------------------------------------


@query("SELECT event_type, day, sum(value) OVER (PARTITION BY event_type ORDER BY day) AS value FROM ev", 2)
def cumsum_axis(spark, sf):
    return ev(spark, sf).cumsum("day")


@query("SELECT p_brand, p_size, sum(coalesce(value, 0)) OVER (PARTITION BY p_brand ORDER BY p_size) AS value FROM grid", 4, True)
def cumsum_skipna(spark, sf):
    return pt(spark, sf).cumsum("p_size", skipna=True)


@query("SELECT p_brand, p_size, CASE WHEN count(value) OVER w = count(*) OVER w THEN sum(value) OVER w END AS value FROM grid WINDOW w AS (PARTITION BY p_brand ORDER BY p_size)", 4, True)
def cumsum_strict(spark, sf):
    return pt(spark, sf).cumsum("p_size")


@query("SELECT o_orderpriority, o_orderstatus, year, product(value::DOUBLE) OVER (PARTITION BY o_orderpriority, o_orderstatus ORDER BY year)::BIGINT AS value FROM odc WHERE o_orderstatus = 'O' AND year < 1999")
def cumprod_axis(spark, sf):
    return od_count(spark, sf).take({"o_orderstatus": ["O"], "year": slice(None, 1998)}).cumprod("year")


@query("SELECT p_brand, p_size, value - lag(value) OVER (PARTITION BY p_brand ORDER BY p_size) AS value FROM grid QUALIFY p_size > 1", 4, True)
def diff_backward(spark, sf):
    return pt(spark, sf).diff("p_size")


@query("SELECT p_brand, p_size, lead(value) OVER (PARTITION BY p_brand ORDER BY p_size) - value AS value FROM grid QUALIFY p_size < 50", 4, True)
def diff_forward(spark, sf):
    return pt(spark, sf).diff("p_size", scheme="forward")


@query("SELECT p_brand, p_size - 0.5::DOUBLE AS p_size, value - lag(value) OVER (PARTITION BY p_brand ORDER BY p_size) AS value FROM grid QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY grid.p_size) > 1", 4, True)
def diff_centered(spark, sf):
    return pt(spark, sf).diff("p_size", scheme="centered")


@query("SELECT p_brand, p_size, value - lag(value) OVER (PARTITION BY p_brand ORDER BY p_size) AS value FROM grid", 4, True)
def diff_keepaxis(spark, sf):
    return pt(spark, sf).diff("p_size", keepaxis=True)


@query("SELECT event_type, day, value - 2 * lag(value) OVER w + lag(value, 2) OVER w AS value FROM ev WINDOW w AS (PARTITION BY event_type ORDER BY day) QUALIFY row_number() OVER w > 2", 2)
def diff_second(spark, sf):
    return ev(spark, sf).diff("day", n=2)


@query("SELECT event_type, day, CASE WHEN count(*) OVER w = 7 THEN avg(value) OVER w END AS value FROM ev WINDOW w AS (PARTITION BY event_type ORDER BY day ROWS 6 PRECEDING)", 5, True)
def moving_mean(spark, sf):
    return ev(spark, sf).moving("mean", 7, "day")


# -- indexing ---------------------------------------------------------------------------------


@query("SELECT l_linestatus, month, value FROM li WHERE l_returnflag = 'A'")
def sel_scalar(spark, sf):
    return li(spark, sf).sel(l_returnflag="A")


@query("SELECT * FROM od WHERE o_orderpriority IN ('1-URGENT', '5-LOW') AND year IN (1996, 1999)")
def sel_list(spark, sf):
    return od(spark, sf).take({"o_orderpriority": ["5-LOW", "1-URGENT"], "year": [1999, 1996]})


@query("SELECT * FROM li WHERE month BETWEEN 199603 AND 199711")
def sel_slice_inclusive(spark, sf):
    return li(spark, sf).sel(month=slice(199603, 199711))


@query("SELECT li.* FROM li JOIN (SELECT month, row_number() OVER (ORDER BY month) - 1 AS pos FROM (SELECT DISTINCT month FROM li)) USING (month) WHERE pos >= 10 AND pos < 40 AND (pos - 10) % 3 = 0")
def isel_slice_step(spark, sf):
    return li(spark, sf).isel(month=slice(10, 40, 3))


@query("SELECT event_type, value FROM ev WHERE day = 17")
def sel_nearest(spark, sf):
    return ev(spark, sf).nloc[{"day": 17.4}]


@query("SELECT * FROM pt WHERE value > 950")
def mask_cells(spark, sf):
    a = pt(spark, sf)
    return a[a > 950]


@query("SELECT avg(value) AS value, count(*) AS n FROM pt WHERE value > 950", 6)
def mask_strict_mean(spark, sf):
    a = pt(spark, sf)
    hits = a[a > 950]
    return spark.createDataFrame([(hits.mean(), hits.shape[0])], "value double, n long")


@query("SELECT * FROM pt WHERE p_size > 40")
def mask_1d(spark, sf):
    a = pt(spark, sf).transpose()
    return a[a.p_size > 40]


@query("SELECT * FROM pt WHERE p_size > 40 AND p_brand IN ('Brand#1', 'Brand#11')")
def mask_mixed(spark, sf):
    import numpy as np

    a = pt(spark, sf)
    return a[np.array(["Brand#11", "Brand#1"]), a.p_size > 40]


@query("SELECT * FROM ev WHERE day IN (3, 11, 30)")
def take_numpy(spark, sf):
    import numpy as np

    return ev(spark, sf).take(np.array([30, 3, 11]), axis="day")


@query("SELECT * FROM pt WHERE p_size > 40")
def mask_axis(spark, sf):
    a = pt(spark, sf)
    return a.compress_axis(a.p_size > 40, axis="p_size")


@query("SELECT event_type, day, value FROM ev WHERE (event_type, day) IN (('click', 3), ('view', 5))")
def pointwise(spark, sf):
    a = ev(spark, sf)
    types = [t for t in ("click", "view") if t in a.labels[0]]
    return a.take((types, [3, 5][: len(types)]), broadcast=True)


@query("SELECT * FROM us WHERE user_id = 7")
def sel_open_axis(spark, sf):
    return by_user(spark, sf).take({"user_id": [7]})


@query("SELECT p_brand, p_size, CASE WHEN p_size <= 5 THEN 0.0 ELSE value END AS value FROM grid", dense=True)
def put_where(spark, sf):
    return pt(spark, sf).put({"p_size": slice(None, 5)}, 0.0)


@query("SELECT 'size ' || p_size AS p_size, p_brand, value FROM pt")
def set_axis_labels(spark, sf):
    return pt(spark, sf).set_axis(lambda x: f"size {x}", axis="p_size")


# -- alignment and arithmetic -----------------------------------------------------------------


@query("SELECT a.event_type, day, a.value + b.value AS value FROM ev a JOIN ev b USING (event_type, day) WHERE day BETWEEN 10 AND 20", 2)
def binop_outer_align(spark, sf):
    a = ev(spark, sf)
    return a.sel(day=slice(None, 20)) + a.sel(day=slice(10, None))


@query("SELECT o_orderpriority, o_orderstatus, year, value / total AS value FROM od JOIN (SELECT year, sum(value) AS total FROM od GROUP BY year) USING (year)", 9)
def binop_broadcast_dims(spark, sf):
    a = od(spark, sf)
    return a / a.sum(("o_orderpriority", "o_orderstatus"))


@query("SELECT p_brand, p_size, (value - 1000) * 2 AS value FROM pt", 4)
def binop_scalar(spark, sf):
    return (pt(spark, sf) - 1000) * 2


@query("SELECT o_orderpriority, o_orderstatus, year, floor(value / -7.0)::BIGINT AS value FROM odc")
def floor_division(spark, sf):
    return od_count(spark, sf) // -7


@query("SELECT o_orderpriority, o_orderstatus, year, (value * value)::BIGINT AS value FROM odc")
def power(spark, sf):
    return od_count(spark, sf) ** 2


@query("SELECT a.event_type, b.o_orderstatus, a.value * b.value AS value FROM (SELECT event_type, max(value) AS value FROM ev GROUP BY ALL) a, (SELECT o_orderstatus, max(value) AS value FROM odc GROUP BY ALL) b", 2)
def outer_product(spark, sf):
    return ev(spark, sf).max("day") * od_count(spark, sf).max(("o_orderpriority", "year"))


@query("SELECT p_brand, p_size, coalesce(value >= 950, false) AS value FROM grid")
def compare(spark, sf):
    return pt(spark, sf) >= 950


@query("SELECT a.event_type, a.day, b.value IS NULL AS value FROM ev a LEFT JOIN ev b ON a.event_type = b.event_type AND a.day = b.day AND b.day <= 15")
def align_outer(spark, sf):
    a = ev(spark, sf)
    _, cut = gl.align(a, a.sel(day=slice(None, 15)))
    return cut.isna()


@query("SELECT * FROM ev WHERE day BETWEEN 5 AND 12")
def align_inner(spark, sf):
    a = ev(spark, sf)
    return gl.align(a.sel(day=slice(5, None)), a.sel(day=slice(None, 12)), join="inner")[0]


@query("SELECT event_type, d.day, coalesce(value, -1.0) AS value FROM (SELECT DISTINCT event_type FROM ev) CROSS JOIN (VALUES (28::BIGINT), (2::BIGINT), (99::BIGINT)) d(day) LEFT JOIN ev USING (event_type, day)")
def reindex_fill(spark, sf):
    return ev(spark, sf).reindex_axis([28, 2, 99], "day", fill_value=-1.0)


def _search(strict: bool) -> str:
    return f"SELECT event_type, d.day, arg_min(value, e.day) FILTER (WHERE e.day {'>' if strict else '>='} d.day) AS value FROM ev e, (VALUES (2.5::DOUBLE), (7::DOUBLE), (11.2::DOUBLE)) d(day) GROUP BY ALL"


@query(_search(False))
def reindex_left(spark, sf):
    return ev(spark, sf).reindex_axis([2.5, 7, 11.2], "day", method="left")


@query(_search(True))
def reindex_right(spark, sf):
    return ev(spark, sf).reindex_axis([2.5, 7, 11.2], "day", method="right")


@query("SELECT * FROM ev WHERE day % 2 = 1 AND day <= 29")
def reindex_like(spark, sf):
    a = ev(spark, sf)
    return a.reindex_like(a.isel(day=slice(0, 29, 2)))


@query("SELECT 'lo' AS half, event_type, day % 10 AS day, value FROM ev WHERE day BETWEEN 1 AND 9 UNION ALL SELECT 'hi', event_type, day % 10, value FROM ev WHERE day BETWEEN 11 AND 19")
def stack(spark, sf):
    a = ev(spark, sf)
    hi = a.sel(day=slice(11, 19)).set_axis(lambda d: d % 10, axis="day")
    return gl.stack({"lo": a.sel(day=slice(1, 9)), "hi": hi}, axis="half")


@query("SELECT event_type, day, value FROM ev WHERE day > 25 UNION ALL SELECT event_type, day, value FROM ev WHERE day <= 5 UNION ALL SELECT event_type, day, value FROM ev WHERE day <= 1")
def concatenate(spark, sf):
    a = ev(spark, sf)
    return gl.concatenate([a.sel(day=slice(26, None)), a.sel(day=slice(None, 5)), a.sel(day=slice(None, 1))], axis="day")


@query("SELECT event_type, o_orderstatus, a.value FROM (SELECT event_type, sum(value) AS value FROM ev GROUP BY ALL) a CROSS JOIN (SELECT DISTINCT o_orderstatus FROM od) b", 2)
def broadcast_arrays(spark, sf):
    return gl.broadcast_arrays(ev(spark, sf).sum("day"), od(spark, sf).sum(("o_orderpriority", "year")))[0]


# -- interpolation ----------------------------------------------------------------------------


@query(
    "SELECT a.event_type, d.x AS day, a.value + (d.x - a.day) * (coalesce(b.value, a.value) - a.value) AS value FROM (VALUES (1.25::DOUBLE), (3.0::DOUBLE), (14.6::DOUBLE)) d(x) JOIN ev a ON a.day = floor(d.x) LEFT JOIN ev b ON b.event_type = a.event_type AND b.day = a.day + 1",
    6,
)
def interp_axis(spark, sf):
    return ev(spark, sf).interp_axis([1.25, 3.0, 14.6], "day")


@query("SELECT event_type, d.x AS day, d.v AS value FROM (SELECT DISTINCT event_type FROM ev) CROSS JOIN (VALUES (-5.0::DOUBLE, 0.0::DOUBLE), (77.5::DOUBLE, 9.0::DOUBLE)) d(x, v)")
def interp_outside(spark, sf):
    return ev(spark, sf).interp_axis([-5.0, 77.5], "day", left=0.0, right=9.0)


@query(
    """SELECT x.x AS size2, y.y AS year, sum(a.value * (1 - abs(a.k - x.x)) * (1 - abs(a.year - y.y))) AS value
    FROM (SELECT row_number() OVER (PARTITION BY year ORDER BY o_orderpriority) - 1 AS k, year, value FROM (SELECT o_orderpriority, year, sum(value) AS value FROM odc GROUP BY ALL)) a
    JOIN (VALUES (0.5::DOUBLE), (2.25::DOUBLE)) x(x) ON abs(a.k - x.x) < 1 JOIN (VALUES (1996.5::DOUBLE), (1998.75::DOUBLE)) y(y) ON abs(a.year - y.y) < 1 GROUP BY ALL""",
    6,
)
def interp2d(spark, sf):
    a = od_count(spark, sf).sum("o_orderstatus")
    a = a.set_axis(range(a.shape[0]), axis="o_orderpriority", name="size2")
    return a.interp2d([[0.5, 2.25], [1996.5, 1998.75]], dims=("size2", "year"))


# -- missing values and shape -----------------------------------------------------------------


@query("SELECT * FROM pt WHERE value <= 960")
def setna_mask(spark, sf):
    a = pt(spark, sf)
    return a.setna(a > 960)


@query("SELECT p_brand, p_size, coalesce(value, -1.0) AS value FROM grid")
def fillna(spark, sf):
    return pt(spark, sf).fillna(-1.0)


@query("SELECT * FROM grid3 WHERE p_size IN (SELECT p_size FROM grid3 GROUP BY p_size HAVING count(value) = 3)")
def dropna(spark, sf):
    return pt3(spark, sf).dropna("p_size")


@query("SELECT * FROM pt WHERE p_size IN (SELECT p_size FROM pt GROUP BY p_size HAVING count(*) >= 20)")
def dropna_minvalid(spark, sf):
    return pt(spark, sf).dropna("p_size", minvalid=20)


@query("SELECT l_returnflag, avg(value) AS value FROM li GROUP BY ALL", 3)
def flatten_mean(spark, sf):
    return li(spark, sf).flatten("l_linestatus", "month").mean("l_linestatus,month", skipna=True)


@query("SELECT s.s AS scenario, event_type, sum(value) AS value FROM ev, (VALUES ('a'), ('b')) s(s) GROUP BY ALL", 2)
def newaxis_repeat(spark, sf):
    return ev(spark, sf).sum("day").newaxis("scenario", ["a", "b"])


@query("SELECT event_type, max(CASE WHEN day = 1 THEN value END) AS d1, max(CASE WHEN day = 2 THEN value END) AS d2 FROM ev GROUP BY ALL")
def to_dataset(spark, sf):
    ds = ev(spark, sf).take({"day": [1, 2]}).to_dataset("day")
    return ds.rename_keys(lambda k: f"d{k}").to_dataframe()


@query("SELECT 'high' AS variable, event_type, max(value) AS value FROM ev GROUP BY ALL UNION ALL SELECT 'low', event_type, min(value) FROM ev GROUP BY ALL")
def to_array(spark, sf):
    a = ev(spark, sf)
    return Dataset({"high": a.max("day"), "low": a.min("day")}).to_array("variable")


@query("SELECT a.event_type, a.value AS mean, b.value AS plain FROM (SELECT event_type, round(avg(value), 5) AS value FROM ev GROUP BY ALL) a JOIN (SELECT event_type, max(value) AS value FROM ev GROUP BY ALL) b USING (event_type)")
def dataset_mean(spark, sf):
    a = ev(spark, sf)
    return Dataset({"mean": a, "plain": a.max("day")}).mean("day").to_dataframe().withColumn("mean", F.round("mean", 5))


@query("SELECT event_type, round(max(value) - min(value), 2) AS x FROM ev GROUP BY ALL")
def dataset_arithmetic(spark, sf):
    a = ev(spark, sf)
    out = Dataset({"x": a.max("day"), "y": a.max("day")}) - Dataset({"x": a.min("day")})
    return out.to_dataframe().withColumn("x", F.round("x", 2))


@query("SELECT event_type, day, ln(value) AS value FROM ev WHERE value > 0", 9)
def apply_function(spark, sf):
    a = ev(spark, sf)
    return a.setna(a <= 0).apply(F.ln)


@query("SELECT event_type, max(value) - min(value) AS value FROM ev GROUP BY ALL", 2)
def apply_along_axis(spark, sf):
    return ev(spark, sf).apply_along_axis(lambda v: float(v.max() - v.min()), "day")


@query("SELECT k::BIGINT AS component, value FROM (SELECT k, avg(round(embedding[k + 1]::DOUBLE, 6)) AS value FROM embeddings, range(64) t(k) GROUP BY k)", 6)
def embedding_mean(spark, sf):
    return emb(spark, sf).mean("vec_id", skipna=True)


@query("SELECT event_type, day, value FROM ev WHERE day >= 20")
def store_round_trip(spark, sf):
    path = f"{shared_folder(spark)}/gridloom-store-{uuid.uuid4().hex}"
    ev(spark, sf).write(path, "w", "amount")
    return gl.read(spark, path, "amount", {"day": slice(20, None)})


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Revenue of returned lines: mean over the months, by status."""
    return li(spark, sf).sel(l_returnflag="A").mean("month", skipna=True).to_dataframe()
