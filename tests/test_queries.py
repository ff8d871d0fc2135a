"""Queries over the sample tables: they say something, and the corner cases they were made for hold."""

import numpy as np
import pytest

import __spark_entry__ as entry
from gridloom import LabelArray

SF = "/root/testdata/sf0.01"
TELLING = ["reduce_sum_strict", "reduce_median_strict", "reduce_all_present", "reduce_any", "mask_cells", "mask_1d", "mask_mixed", "take_numpy", "compare", "setna_mask", "dropna", "flatten_diff", "flatten_dropna", "flatten_reindex", "count_missing", "prod_exact", "open_cumsum", "open_align_outer", "open_reindex_nearest", "mask_cells_open", "moving_rank", "cumprod_blocks", "json_column", "put_tile"]


@pytest.mark.parametrize("name", TELLING)
def test_queries_are_not_constant(spark, name):
    rows = entry.queries()[name](spark, SF).collect()
    assert len({r.value for r in rows}) > 1
    if name.endswith("_strict") or name == "flatten_reindex":
        assert {r.value is None for r in rows} == {True, False}


def test_each_query_has_sql():
    assert {n for n in entry.queries() if not n.startswith("op") and n != "pipeline"} <= set(entry.oracle_sql())


@pytest.fixture(scope="module")
def a(spark):
    return LabelArray.from_values(spark, np.arange(12.0).reshape(4, 3), [("t", [1950, 1951, 1952, 1953]), ("lat", [-90.0, 0.0, 90.0])])


def test_masks(spark, a):
    hits = a[a > 3]
    assert hits.shape == (8,) and hits.mean() == 7.5 and hits.labels[0][0] == (1951, 0.0) and hits.values.tolist() == list(range(4, 12))
    assert a[a.t > 1951].labels[0] == (1952, 1953)
    assert a[np.array([1953, 1950]), a.lat > -1].values.tolist() == [[10, 11], [1, 2]]
    one = a.sel(lat=0.0)
    assert one[one > 2].labels[0] == (1951, 1952, 1953)


def test_open_hits(spark, a):
    import gridloom as gl

    gl.set_option("axis.list_hits", 3)
    try:
        assert a[a > 3].sum(skipna=True) == 60.0
    finally:
        gl.reset_options()


def test_flattened_axes(spark, a):
    f = a.flatten()
    assert f.diff(0).values.tolist() == [1.0] * 11 and f.diff(0).labels[0][0] == (1950, 0.0)
    assert f.set_axis([str(i) for i in range(12)]).labels[0][3] == "3"
    assert f.reindex_axis([(1951, 90.0), (1, 1.0)]).values.tolist()[0] == 5.0
    assert f.put([(1951, 90.0)], -1.0).values.tolist()[5] == -1.0
    holes = a.setna(4.0).flatten()
    assert holes.dropna(0).shape == (11,) and holes.dropna(0).labels[0][4] == (1951, 90.0)


def test_whole_products(spark):
    a = LabelArray.from_values(spark, np.full(35, 3))
    assert a.prod() == 3**35 and a.cumprod().values.tolist() == [3**k for k in range(1, 36)]
    b = LabelArray.from_values(spark, np.array([[2, -1, 0], [-3, -1, 5]]))
    assert b.prod(1).values.tolist() == [0, 15] and b.cumprod(1).values.tolist() == [[2, -2, 0], [-3, 3, 15]]


def test_late_nan_and_powers(spark):
    a = LabelArray.from_values(spark, np.array([np.inf, 1.0, np.nan]))
    assert int((a - a).count()) == 1 and (a**0).values.tolist() == [1.0, 1.0, 1.0] and (1**a).values.tolist() == [1.0, 1.0, 1.0]
    assert (a - a).sum(skipna=True) == 0.0


def test_clean_doors(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("x", 1.0), (None, 5.0), ("x", 2.0), ("y", 3.0)], "k string, v double")
    a = LabelArray.from_dataframe(df, ["k"], "v", aggregate=F.sum)
    assert a.labels[0] == ("x", "y") and a.values.tolist() == [3.0, 3.0] and a.sum() == 6.0


def test_types_of_constants(spark):
    import gridloom as gl

    model = LabelArray.from_values(spark, np.array([1, 2]))
    assert gl.zeros_like(model).dtype == "bigint" and gl.ones(spark, shape=(2,), dtype="int").dtype == "int" and gl.nans_like(model, "double").dtype == "double"
