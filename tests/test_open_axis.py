"""Axes whose labels are a table: positions, slices, scans, alignment, as-of joins and masks, against the same operators on listed axes."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import gridloom as gl
from gridloom import LabelArray, scratch


def pair(spark, labels, values=None, name="t", kind="long"):
    """The same cells along an open axis and along a listed one."""
    values = values or [float(10 * i + 1) for i in range(len(labels))]
    df = spark.createDataFrame(list(zip(labels, values)), f"`{name}` {kind}, value double").repartition(3)
    return LabelArray.from_dataframe(df, [name], listed=False), LabelArray.from_dataframe(df, [name])


def cells(x):
    return sorted(map(tuple, x.to_dataframe().where("value is not null").collect()))


def labels(a):
    return [r.label for r in a.axes[0].order.table.orderBy("pos").collect()]


@pytest.fixture(scope="module")
def both(spark):
    return pair(spark, [1, 2, 3, 4, 5, 8, 13])


@pytest.mark.parametrize("key", [1, -1, [4, 0, -1], [2, 2], slice(1, 3), slice(None, None, 2), slice(5, 1, -2), slice(None, None, -1), slice(3, 3), [True, False, True, False, False, False, True]])
def test_positions(both, key):
    open_, listed = both
    got, want = open_.isel(t=key), listed.isel(t=key)
    assert got == want if not hasattr(want, "cells") else (cells(got) == cells(want) and got.shape == want.shape and got.values.tolist() == want.values.tolist())


@pytest.mark.parametrize("key", [3, [13, 1], slice(2, 5), slice(2, 9, 2), slice(9, 0, -1), slice(None, 4), slice(6, 7), slice(20, None)])
def test_labels(both, key):
    open_, listed = both
    for a in (open_, open_.ordered()):
        got, want = a.sel(t=key), listed.sel(t=key)
        assert got == want if not hasattr(want, "cells") else cells(got) == cells(want)


def test_nearest(both):
    open_, listed = both
    for x in (0, 6, 6.5, 10.5, 11, 99):  # 6.5 and 10.5 lie between two labels: the first of them
        assert open_.nloc[x] == listed.nloc[x]
    assert cells(open_.sel(t=[6, 99], tol=float("inf"))) == cells(listed.sel(t=[6, 99], tol=float("inf")))
    assert open_.ordered().isel(t=slice(None, None, -1)).nloc[6.5] == listed.isel(t=slice(None, None, -1)).nloc[6.5]


@pytest.mark.parametrize("ask", [lambda a: a.sel(t=99), lambda a: a.sel(t=[1, 99]), lambda a: a.isel(t=7), lambda a: a.isel(t=[0, -8]), lambda a: a.sel(t=6, tol=0.5), lambda a: a[[True, False]]])
def test_what_is_not_there(both, ask):
    for a in both:
        with pytest.raises(IndexError):
            ask(a)
    with pytest.raises(ValueError):
        both[0].labels


def test_strings(spark):
    open_, listed = pair(spark, list("bdac"), kind="string")
    assert cells(open_.sel(t=slice("b", "d"))) == cells(listed.sel(t=slice("b", "d"))) and cells(open_.isel(t=slice(1, 3))) == cells(listed.isel(t=slice(1, 3)))
    with pytest.raises(IndexError):
        open_.ordered().sel(t=slice("aa", "d"))


@pytest.mark.parametrize("block", [3, 10_000])
def test_scans(both, block):
    gl.set_option("scan.block", block)
    try:
        for f in (lambda a: a.cumsum("t"), lambda a: a.cumprod("t"), lambda a: a.diff("t"), lambda a: a.diff("t", "forward"), lambda a: a.diff("t", "centered"), lambda a: a.diff("t", keepaxis=True), lambda a: a.diff("t", n=2), lambda a: a.moving("max", 3, "t")):
            got, want = f(both[0]), f(both[1])
            assert cells(got) == cells(want) and got.shape == want.shape
    finally:
        gl.reset_options()


def test_sizes_and_strict_reductions(both):
    open_ = both[0].ordered()
    assert open_.shape == (7,) and open_.sum() == both[1].sum() and open_.median() == both[1].median() and open_.percentile(30, "t") == both[1].percentile(30, "t")
    assert open_.argmax() == both[1].argmax() == both[0].argmax()
    assert "7, open" in repr(open_) and "(open)" in repr(both[0])
    with pytest.raises(ValueError):
        both[0].sum()


def test_alignment(spark, both):
    other = pair(spark, [3, 4, 7, 9])
    for join in ("outer", "inner"):
        x, y = gl.align(both[0].ordered(), other[0], join=join)
        u, v = gl.align(*[p[1] for p in (both, other)], join=join)
        assert labels(x) == list(u.labels[0]) and cells(x) == cells(u) and cells(y) == cells(v) and x.axes == y.axes
        mixed = gl.align(both[0].ordered(), other[1], join=join)
        assert labels(mixed[1]) == list(u.labels[0]) and cells(mixed[1]) == cells(v)
    down = both[0].ordered().isel(t=slice(None, None, -1))
    x, _ = gl.align(down, other[0])
    u, _ = gl.align(both[1].isel(t=slice(None, None, -1)), other[1])
    assert labels(x) == list(u.labels[0])  # two directions: left labels, then unseen right ones
    x, _ = gl.align(down, other[0].ordered().isel(t=slice(None, None, -1)))
    assert labels(x) == sorted({1, 2, 3, 4, 5, 8, 13, 7, 9}, reverse=True)
    assert cells(both[0].ordered() * other[0]) == cells(both[1] * other[1])
    assert both[0].ordered().axes != other[0].ordered().axes and both[0].ordered().axes == both[0].ordered().axes


@pytest.mark.parametrize("method", [None, "left", "right"])
def test_reindexing(spark, both, method):
    new = [9, 1, 0, 4, 20, 3, 6]
    want = both[1].reindex_axis(new, "t", method=method)
    assert cells(both[0].reindex_axis(new, "t", method=method)) == cells(want)
    target = pair(spark, new)
    got = both[0].reindex_like(target[0].ordered(), method=method)
    assert cells(got) == cells(want) and got.shape == (7,)
    assert cells(both[1].reindex_axis(target[0].ordered().axes[0], method=method)) == cells(want)
    if method is None:
        assert cells(both[0].reindex_axis(new, "t", fill_value=-1.0)) == cells(both[1].reindex_axis(new, "t", fill_value=-1.0))
        with pytest.raises(IndexError):
            both[0].reindex_axis(new, "t", raise_error=True)


@pytest.mark.parametrize("how", [{}, {"left": -5.0, "right": 5.0}, {"extrapolate": True}, {"method": "nearest"}])
def test_interpolation(spark, both, how):
    new = [9, 1, 0, 4, 20, 3, 6, 13]
    got, want = cells(both[0].interp_axis(new, "t", **how)), cells(both[1].interp_axis(new, "t", **how))
    assert [k for k, _ in got] == [k for k, _ in want] and np.allclose([v for _, v in got], [v for _, v in want])
    assert np.allclose([v for _, v in cells(both[0].interp_like(pair(spark, new)[0].ordered(), **how))], [v for _, v in want])


def test_as_of_join_over_many_ranges(spark):
    """Ranges without a label of one side, or of either, look across the ranges beside them."""
    r = random.Random(2)
    have, asked = sorted(r.sample(range(5000), 40)), r.sample(range(5000), 600)
    a = pair(spark, have)[0].ordered()
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "37")
    try:
        met = a.axes[0].order.neighbours(spark.createDataFrame(list(enumerate(asked)), "pos long, label long")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(met) == 600
    for x in met:
        low, high = [h for h in have if h <= x.label], [h for h in have if h > x.label]
        assert (x.before and x.before.label) == (low[-1] if low else None) and (x.after and x.after.label) == (high[0] if high else None)


def test_masks_beyond_the_list(spark):
    a = LabelArray.from_values(spark, np.arange(12.0).reshape(3, 4), [("t", [3, 1, 2]), ("s", ["a", "a,b", "c", "b,c"])])
    small = a[a > 4]
    gl.set_option("axis.list_hits", 2)
    try:
        large = a[a > 4]
    finally:
        gl.reset_options()
    assert large.shape == small.shape == (7,) and large.values.tolist() == small.values.tolist() and large.mean() == small.mean() == 8
    assert cells(large) == cells(small) and cells(large.isel(**{"t,s": slice(1, 4)})) == cells(small.isel(**{"t,s": slice(1, 4)}))
    assert large.cumsum(skipna=True).values.tolist() == small.cumsum(skipna=True).values.tolist()
    b = pair(spark, [1, 5, 9])[0]
    hit = b[b > 1.0]
    assert cells(hit) == [(5, 11.0), (9, 21.0)] and hit.shape == (2,)


def test_missing_cells(spark):
    df = spark.createDataFrame([(1, "x", 1.0), (1, "y", 2.0), (2, "x", 3.0), (4, "x", None), (4, "y", 5.0), (5, "x", 5.0), (5, "y", 9.0)], "t long, s string, value double")
    open_, listed = (LabelArray.from_dataframe(df, ["t", "s"], axes={"s": ["x", "y"], **extra}, listed=False) for extra in ({}, {"t": [1, 2, 4, 5]}))
    for f in (lambda a: a.dropna("t"), lambda a: a.dropna("t", minvalid=1), lambda a: a.fillna(0.0), lambda a: a.cumsum("t"), lambda a: a.cumsum("t", skipna=True), lambda a: a.sum("t", skipna=True), lambda a: a.ordered("t").sum("t"), lambda a: a != 5.0):
        assert cells(f(open_)) == cells(f(listed))
    assert open_.dropna("t").shape == (2, 2)


def test_a_single_label_and_none(spark):
    one, none = pair(spark, [7])[0].ordered(), pair(spark, [7])[0].sel(t=slice(9, None)).ordered()
    assert one.isel(t=0) == 1.0 and one.nloc[100] == 1.0 and none.shape == (0,) and none.sum() == 0 and none.prod() == 1 and none.all() is True and none.any() is False
    with pytest.raises(IndexError):
        none.isel(t=0)
    assert labels(gl.align(one, none)[1]) == [7] and cells(none.cumsum("t")) == []
    assert cells(none.reindex_axis([1, 2], "t", method="left")) == [] and cells(one.reindex_axis([1, 9], "t", method="left")) == [(1, 1.0), (9, 1.0)]


def test_empty_axes_and_powers(spark):
    a = LabelArray.from_values(spark, np.array([[1, 2, 3], [4, 5, 6]]), [("t", [1, 2]), ("s", [1, 2, 3])])
    none = a.isel(t=slice(0, 0))
    for skipna in (False, True):
        assert none.sum("t", skipna).values.tolist() == [0, 0, 0] and none.prod("t", skipna).values.tolist() == [1, 1, 1]
        assert none.all("t", skipna).values.tolist() == [True] * 3 and none.any("t", skipna).values.tolist() == [False] * 3
    assert np.isnan(none.mean("t").values).all() and none.sum() == 0
    with pytest.raises(ValueError):
        a**-1
    with pytest.raises(Exception, match="negative"):
        (a ** (a - 3)).values  # noqa: B018
    assert np.allclose((a ** -1.0).values, a.values**-1.0)


def test_ten_million_labels(spark):
    """Nothing is listed: positions, sums and as-of joins stay in tables of many partitions."""
    n = 10_000_000
    a = LabelArray.from_dataframe(spark.range(0, 3 * n, 3, 16).select(F.col("id").alias("t"), F.lit(1.0).alias("value")), ["t"], listed="ordered")
    b = a.isel(t=slice(5, n - 5, 1000))
    assert a.shape == (n,) and b.shape == (9_999 + 1,) and b.sum() == 10_000
    assert a.isel(t=1234567) == 1.0 and a.axes[0].order.at([1234567]) == [3 * 1234567]
    gl.set_option("axis.broadcast_labels", 100)
    try:
        assert b.cumsum("t").isel(t=-1) == 10_000
    finally:
        gl.reset_options()


def test_scratch_is_cleared(spark):
    from pathlib import Path

    pair(spark, [1, 2])[0].ordered()
    here = Path(scratch.shared_folder(spark).removeprefix("file://")) / scratch.RUN
    assert any(here.iterdir()) and scratch.clear(spark) and not here.exists()
