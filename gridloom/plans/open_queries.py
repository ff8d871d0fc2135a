"""Queries along open axes: order keys and users, whose labels are tables in order and never listed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import gridloom as gl

from ..array import LabelArray
from ..operators.ranks import percentiles
from .queries import CTE, SQL, by_user, ev, query


def totals(spark: SparkSession, sf: str) -> LabelArray:
    """Order value by order key, the table's own key."""
    t = spark.read.parquet(f"{sf}/orders.parquet").groupBy("o_orderkey").agg(F.round(F.sum("o_totalprice"), 2).alias("value"))
    return LabelArray.from_dataframe(t.withColumnRenamed("o_orderkey", "key"), ["key"], listed="ordered")


def shipped(spark: SparkSession, sf: str) -> LabelArray:
    """Extended price by order key, of the orders with a key that 3 divides."""
    t = spark.read.parquet(f"{sf}/lineitem.parquet").where("l_orderkey % 3 = 0").groupBy("l_orderkey").agg(F.round(F.sum("l_extendedprice"), 2).alias("value"))
    return LabelArray.from_dataframe(t.withColumnRenamed("l_orderkey", "key"), ["key"], listed="ordered")


def urgent(spark: SparkSession, sf: str) -> LabelArray:
    """Order value of urgent orders by key."""
    t = spark.read.parquet(f"{sf}/orders.parquet").where("o_orderpriority = '1-URGENT'").groupBy("o_orderkey").agg(F.round(F.sum("o_totalprice"), 2).alias("value"))
    return LabelArray.from_dataframe(t.withColumnRenamed("o_orderkey", "key"), ["key"], listed="ordered")


TABLES = """, tot AS (SELECT o_orderkey AS key, round(sum(o_totalprice), 2) AS value FROM orders GROUP BY ALL),
shp AS (SELECT l_orderkey AS key, round(sum(l_extendedprice), 2) AS value FROM lineitem WHERE l_orderkey % 3 = 0 GROUP BY ALL),
urg AS (SELECT o_orderkey AS key, round(sum(o_totalprice), 2) AS value FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY ALL),
tot_at AS (SELECT *, row_number() OVER (ORDER BY key) - 1 AS pos, count(*) OVER () AS n FROM tot),
user_at AS (SELECT user_id, row_number() OVER (ORDER BY user_id) - 1 AS pos FROM (SELECT DISTINCT user_id FROM us))
"""


def open_query(sql: str, digits: int | None = None, dense: bool = False):
    """query, with the tables above beside the cubes."""

    def add(f):
        query(sql, digits, dense)(f)
        SQL[f.__name__] = CTE + TABLES + SQL[f.__name__].removeprefix(CTE)
        return f

    return add


@open_query("SELECT event_type, day, value FROM us JOIN user_at USING (user_id) WHERE pos = 4")
def open_isel(spark, sf):
    return by_user(spark, sf).isel(user_id=4)


@open_query("SELECT us.* FROM us JOIN user_at USING (user_id) WHERE pos IN (0, 7, (SELECT max(pos) FROM user_at))")
def open_isel_list(spark, sf):
    return by_user(spark, sf).isel(user_id=[7, 0, -1])


@open_query("SELECT key, value FROM tot_at WHERE pos >= 10 AND pos < n - 10 AND (pos - 10) % 7 = 0")
def open_isel_step(spark, sf):
    return totals(spark, sf).isel(key=slice(10, -10, 7))


@open_query("SELECT key, value FROM tot WHERE key BETWEEN 1000 AND 9000 AND (SELECT count(*) FROM tot t WHERE t.key >= 1000 AND t.key < tot.key) % 5 = 0")
def open_sel_step(spark, sf):
    return totals(spark, sf).sel(key=slice(1000, 9000, 5))


@open_query("SELECT key, value FROM urg WHERE key IN (SELECT arg_min(key, (abs(key - x), key)) FROM urg, (VALUES (0), (5000), (7777), (1000000000)) v(x) GROUP BY x)")
def open_sel_nearest(spark, sf):
    return urgent(spark, sf).sel(key=[7777, 0, 5000, 1_000_000_000], tol=float("inf"))


@open_query("SELECT key, (sum(round(value * 100)) OVER (ORDER BY key))::BIGINT AS value FROM tot")
def open_cumsum(spark, sf):
    return totals(spark, sf).apply(lambda c: F.round(c * 100).cast("bigint")).cumsum("key")


@open_query("SELECT key, value - lag(value) OVER (ORDER BY key) AS value FROM tot QUALIFY row_number() OVER (ORDER BY key) > 1", 2)
def open_diff(spark, sf):
    return totals(spark, sf).diff("key")


@open_query("SELECT (key + lead(key) OVER (ORDER BY key)) / 2 AS key, lead(value) OVER (ORDER BY key) - value AS value FROM tot QUALIFY row_number() OVER (ORDER BY key DESC) > 1", 2)
def open_diff_centered(spark, sf):
    return totals(spark, sf).diff("key", "centered")


@open_query("SELECT key, CASE WHEN count(*) OVER w = 30 THEN avg(value) OVER w END AS value FROM tot WINDOW w AS (ORDER BY key ROWS 29 PRECEDING)", 3, True)
def open_moving_mean(spark, sf):
    return totals(spark, sf).moving("mean", 30, "key")


@open_query("SELECT 'a' AS part, key, u.value FROM (SELECT key FROM urg UNION SELECT key FROM shp) LEFT JOIN urg u USING (key) UNION ALL SELECT 'b', key, s.value FROM (SELECT key FROM urg UNION SELECT key FROM shp) LEFT JOIN shp s USING (key)", dense=True)
def open_align_outer(spark, sf):
    return gl.stack(gl.align(urgent(spark, sf), shipped(spark, sf)), "part", ["a", "b"])


@open_query("SELECT key, u.value / s.value AS value FROM urg u JOIN shp s USING (key)", 9)
def open_align_inner(spark, sf):
    a, b = gl.align(urgent(spark, sf), shipped(spark, sf), join="inner")
    return a.isel(key=slice(None)) / b


@open_query("SELECT key, coalesce(t.value, -1.0) AS value FROM shp LEFT JOIN urg t USING (key)")
def open_reindex(spark, sf):
    return urgent(spark, sf).reindex_like(shipped(spark, sf), fill_value=-1.0)


@open_query("SELECT s.key, coalesce(u.value, (SELECT arg_max(value, key) FROM urg)) AS value FROM shp s ASOF LEFT JOIN urg u ON s.key <= u.key")
def open_reindex_left(spark, sf):
    return urgent(spark, sf).reindex_like(shipped(spark, sf), method="left")


@open_query("SELECT s.key, coalesce(u.value, (SELECT arg_max(value, key) FROM urg)) AS value FROM shp s ASOF LEFT JOIN urg u ON s.key < u.key")
def open_reindex_right(spark, sf):
    return urgent(spark, sf).reindex_like(shipped(spark, sf), method="right")


_AROUND = "around AS (SELECT s.key, l.key AS low, l.value AS low_value, h.key AS high, h.value AS high_value FROM shp s ASOF LEFT JOIN urg l ON s.key >= l.key ASOF LEFT JOIN urg h ON s.key <= h.key)"


@open_query(f"SELECT key, CASE WHEN low IS NULL OR high - key < key - low THEN high_value ELSE low_value END AS value FROM (WITH {_AROUND} SELECT * FROM around)")
def open_reindex_nearest(spark, sf):
    return urgent(spark, sf).reindex_like(shipped(spark, sf), method="nearest")


@open_query(f"SELECT key, CASE WHEN low = high THEN low_value ELSE low_value * (1 - (key - low) / (high - low)) + high_value * ((key - low) / (high - low)) END AS value FROM (WITH {_AROUND} SELECT * FROM around) WHERE low IS NOT NULL AND high IS NOT NULL", 7)
def open_interp(spark, sf):
    return urgent(spark, sf).interp_like(shipped(spark, sf))


@open_query("SELECT * FROM us WHERE value > 180")
def mask_cells_open(spark, sf):
    a = by_user(spark, sf)
    return a[a > 180.0]


@open_query("SELECT key, value FROM (SELECT *, row_number() OVER (ORDER BY key) - 1 AS pos FROM tot WHERE value > 200000) WHERE pos % 2 = 1")
def mask_1d_open(spark, sf):
    a = totals(spark, sf)
    return a[a > 200_000.0].isel(key=slice(1, None, 2))


@open_query("SELECT * FROM us WHERE user_id IN (SELECT user_id FROM us GROUP BY user_id HAVING count(value) >= 50)")
def open_dropna(spark, sf):
    return by_user(spark, sf).dropna("user_id", minvalid=50)


@open_query("SELECT event_type, day, arg_max(user_id, (value, -user_id)) AS value FROM us GROUP BY ALL")
def open_argmax(spark, sf):
    return by_user(spark, sf).argmax("user_id", skipna=True)


@open_query("SELECT round(sum(value), 1) AS total, count(*) AS n, max(key) AS last FROM tot", None)
def open_shape(spark, sf) -> DataFrame:
    a = totals(spark, sf)
    last = a.isel(key=slice(-1, None)).cells.first()["key"]
    return spark.range(1).select(F.round(F.lit(a.sum()), 1).alias("total"), F.lit(a.shape[0]).cast("bigint").alias("n"), F.lit(last).cast("bigint").alias("last"))


# -- order statistics and scans over blocks -----------------------------------------------------


@open_query("SELECT l_returnflag, quantile_cont(l_extendedprice, 0.1) AS low, quantile_cont(l_extendedprice, 0.5) AS mid, quantile_cont(l_extendedprice, 0.999) AS high, count(*) AS n FROM lineitem GROUP BY ALL")
def percentiles_narrowed(spark, sf):
    """A few groups that hold all line items: ranks are narrowed, no group is sorted in a task."""
    cells = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_returnflag", F.col("l_extendedprice").alias("value"))
    got = percentiles(cells, ["l_returnflag"], [0.1, 0.5, 0.999], most=1000)
    return got.select("l_returnflag", *[F.get("value", F.lit(i)).alias(n) for i, n in enumerate(("low", "mid", "high"))], F.col("count").alias("n"))


@open_query("SELECT event_type, CASE WHEN count(value) > 0 THEN median(value) END AS value FROM us GROUP BY ALL", 6)
def median_two_dims(spark, sf):
    """Along a listed and an open dimension."""
    return by_user(spark, sf).median(("day", "user_id"), skipna=True)


_W = "FROM tot WINDOW w AS (ORDER BY key ROWS 29 PRECEDING)"


@open_query(f"SELECT key, CASE WHEN count(*) OVER w = 30 THEN median(value) OVER w END AS value {_W}", 3, True)
def moving_median(spark, sf):
    return totals(spark, sf).moving("median", 30, "key")


@open_query(f"SELECT key, CASE WHEN len(l) = 30 THEN 2 * (len(list_filter(l, lambda x: x < value)) + (len(list_filter(l, lambda x: x = value)) + 1) / 2 - 1) / 29 - 1 END AS value FROM (SELECT key, value, list(value) OVER w AS l {_W})", 6, True)
def moving_rank(spark, sf):
    return totals(spark, sf).moving("rank", 30, "key")


@open_query(f"SELECT key, CASE WHEN len(l) = 30 THEN 30 - list_position(l, list_max(l)) END::DOUBLE AS value FROM (SELECT key, list(value) OVER w AS l {_W})", None, True)
def moving_argmax(spark, sf):
    return totals(spark, sf).moving("argmax", 30, "key")


@open_query("SELECT key, (product(CASE WHEN key % 5000 = 0 THEN -3.0 WHEN key % 3 = 0 THEN -1.0 ELSE 1.0 END) OVER (ORDER BY key))::BIGINT AS value FROM tot")
def cumprod_blocks(spark, sf):
    """Exact products of whole numbers along a line of several blocks."""
    a = totals(spark, sf)
    t = a.cells.select("key", F.when(F.col("key") % 5000 == 0, -3).when(F.col("key") % 3 == 0, -1).otherwise(1).cast("bigint").alias("value"))
    return a.make(t, a.axes).cumprod("key")


@open_query("SELECT key, max(value) OVER (ORDER BY key) AS value FROM tot")
def accumulate_max(spark, sf):
    return totals(spark, sf).accumulate(max, "key")


_NEW = "(VALUES (1.0), (2.5), (17.25), (30.0)) t(day)"


@open_query(f"""WITH n AS (SELECT day AS x, floor(day)::BIGINT AS lo, ceil(day)::BIGINT AS hi FROM {_NEW})
SELECT 'sold' AS name, a.event_type, n.x::DOUBLE AS day, (a.value * (1 - (n.x - n.lo)) + b.value * (n.x - n.lo))::DOUBLE AS value FROM n, ev a, ev b WHERE a.day = n.lo AND b.day = n.hi AND a.event_type = b.event_type
UNION ALL SELECT 'twice', a.event_type, n.x, 2 * (a.value * (1 - (n.x - n.lo)) + b.value * (n.x - n.lo)) FROM n, ev a, ev b WHERE a.day = n.lo AND b.day = n.hi AND a.event_type = b.event_type""", 4)
def dataset_weights(spark, sf):
    """Two variables by one table of weights."""
    a = ev(spark, sf)
    ds = gl.Dataset({"sold": a, "twice": a * 2}).interp_axis([1.0, 2.5, 17.25, 30.0], "day")
    return gl.stack({k: ds[k] for k in ds}, "name")
