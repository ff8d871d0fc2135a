"""Reductions, accumulation, indexing, alignment and arithmetic against NumPy on small arrays."""

import numpy as np
import pytest

import gridloom as gl
from gridloom import Axis, LabelArray

T, LAT = [1950, 1951, 1952, 1953], [-90.0, 0.0, 90.0]


def same(a, b):
    np.testing.assert_allclose(np.asarray(a, dtype=float), np.asarray(b, dtype=float), equal_nan=True)


@pytest.fixture(scope="module")
def holes():
    v = np.arange(12.0).reshape(4, 3)
    v[1, 2] = v[3, 2] = np.nan
    return v


@pytest.fixture(scope="module")
def a(spark, holes):
    return LabelArray.from_values(spark, holes, [("time", T), ("lat", LAT)], attrs={"units": "K"})


def test_round_trip(a, holes):
    same(a.values, holes)
    assert a.dims == ("time", "lat") and a.shape == (4, 3) and a.attrs["units"] == "K" and "time (4): 1950 to 1953" in repr(a)
    same(a.T.values, holes.T)


@pytest.mark.parametrize("op", ["sum", "prod", "mean", "std", "var", "min", "max", "ptp", "median"])
@pytest.mark.parametrize("axis", [0, 1])
def test_reduce(a, holes, op, axis):
    plain = {"ptp": lambda v, axis: np.max(v, axis) - np.min(v, axis), "median": np.median}.get(op) or getattr(np, op)
    lenient = {"ptp": lambda v, axis: np.nanmax(v, axis) - np.nanmin(v, axis)}.get(op) or getattr(np, "nan" + op)
    same(getattr(a, op)(axis=axis).values, plain(holes, axis=axis))
    got = getattr(a, op)(axis=axis, skipna=True)
    same(got.values, lenient(holes, axis=axis))
    assert got.attrs == {"units": "K"}


def test_reduce_all_and_empty(spark, a, holes):
    assert a.sum(skipna=True) == np.nansum(holes) and np.isnan(a.sum())
    assert a.mean(axis=("time", "lat"), skipna=True) == np.nanmean(holes)
    void = LabelArray.from_values(spark, np.full((2, 2), np.nan))
    same(void.sum(axis=0, skipna=True).values, [0, 0])
    same(void.prod(axis=0, skipna=True).values, [1, 1])
    same(void.mean(axis=0, skipna=True).values, [np.nan, np.nan])
    same(a.std(axis=0, skipna=True, ddof=1).values, np.nanstd(holes, axis=0, ddof=1))
    assert bool((a > 3).any()) and not bool((a >= 0).all())


def test_argminmax(a):
    assert a.argmax(axis="time", skipna=True).to_pandas().tolist() == [1953, 1953, 1952]
    assert a.argmax() == (1951, 90.0) and a.argmin(skipna=True) == (1950, -90.0)
    assert a.argmin(axis="lat").to_pandas().tolist() == [-90.0, 90.0, -90.0, 90.0]


def test_scans(a, holes):
    same(a.cumsum(axis=0).values, np.cumsum(holes, 0))
    same(a.cumsum(axis=0, skipna=True).values, np.nancumsum(holes, 0))
    same(a.cumprod(axis=1, skipna=True).values, np.nancumprod(holes, 1))
    same(a.diff(axis=0).values, np.diff(holes, axis=0))
    assert a.diff(axis="time").labels[0] == (1951, 1952, 1953) and a.diff(axis="time", scheme="forward").labels[0] == (1950, 1951, 1952)
    assert a.diff(axis="time", scheme="centered").labels[0] == (1950.5, 1951.5, 1952.5)
    same(a.diff(axis="time", scheme="centered").values, np.diff(holes, axis=0))
    same(a.diff(axis=0, n=2).values, np.diff(holes, axis=0, n=2))
    same(a.diff(axis=0, keepaxis=True).values[1:], np.diff(holes, axis=0))


def test_long_line(spark):
    gl.set_option("scan.block", 3)
    v = np.array([1.0, 2, 3, 4, np.nan, 6, 7])
    line = LabelArray.from_values(spark, v)
    same(line.cumsum().values, np.cumsum(v))
    same(line.cumsum(skipna=True).values, np.nancumsum(v))
    same(line.cumprod(skipna=True).values, np.nancumprod(v))
    grid = LabelArray.from_values(spark, np.stack([v, v[::-1], v * 2]), [("k", list("abc")), ("t", list(range(7)))])
    try:
        for one in (line, grid):
            raw = one.values
            same(one.cumsum(skipna=True).values, np.nancumsum(raw, -1))
            same(one.cumsum().values, np.cumsum(raw, -1))
            same(one.diff().values, np.diff(raw))
            same(one.diff(scheme="forward").values, np.diff(raw))
            same(one.diff(scheme="centered").values, np.diff(raw))
            for width in (1, 2, 3, 5):
                want = np.full(raw.shape, np.nan)
                want[..., width - 1 :] = np.lib.stride_tricks.sliding_window_view(raw, width, axis=-1).sum(-1)
                same(one.moving("sum", width).values, want)
        flat = grid.flatten()
        same(flat.cumsum(skipna=True).values, np.nancumsum(grid.values.reshape(-1)))
        same(flat.diff().values, np.diff(grid.values.reshape(-1)))
        plan = line.diff().cells._jdf.queryExecution().optimizedPlan().toString()
        assert "__block" in plan and "windowspecdefinition(__block" in plan
    finally:
        gl.reset_options()


@pytest.mark.parametrize("values", [np.r_[np.arange(40.0), np.nan], np.r_[np.zeros(30), 1, 2, np.ones(20), np.nan], np.full(9, 4.0), np.r_[-5.0, np.full(25, 3.0), 7]])
def test_percentiles_of_all(spark, values):
    """Ranks narrowed by bounds give what a sort of all values gives, ties included."""
    gl.set_option("reduce.sort_rows", 4)
    try:
        a = LabelArray.from_values(spark, values)
        q = [0, 10, 33, 50, 90, 100]
        same(gl.percentile(a, q, axis=0, skipna=True).values, np.nanpercentile(values, q))
        assert a.median(skipna=True) == np.nanmedian(values)
        assert (a.median() is None) == bool(np.isnan(values).any())
    finally:
        gl.reset_options()
    assert gl.percentile(a, q, axis=0, skipna=True).labels[0] == tuple(q)


def test_percentiles_of_nothing(spark):
    gl.set_option("reduce.sort_rows", 4)
    try:
        a = LabelArray.from_values(spark, np.full(9, np.nan))
        assert a.median(skipna=True) is None and gl.percentile(a, 50, axis=0, skipna=True) is None
    finally:
        gl.reset_options()


def test_percentile(spark, a):
    v = np.arange(12.0).reshape(4, 3)
    b = LabelArray.from_values(spark, v, [("time", T), ("lat", LAT)])
    same(gl.percentile(b, [10, 50], axis="time").values, np.percentile(v, [10, 50], axis=0))
    same(gl.quantile(b, 0.3, axis=1).values, np.quantile(v, 0.3, axis=1))
    assert gl.percentile(a, [50], axis="time").dims == ("time_percentile", "lat")


def test_indexing(spark):
    a = LabelArray.from_values(spark, np.arange(1.0, 9).reshape(4, 2), [("x0", list("abcd")), ("x1", [10.0, 20.0])])
    assert a["a", 20.0] == 2.0 and a.ix[-1, 0] == 7.0 and a.sel(x0="b", x1=10.0) == 3.0
    same(a["b":"c"].values, [[3, 4], [5, 6]])
    same(a[["d", "a", "d"], 10.0].values, [7, 1, 7])
    same(a.take(["a"], axis="x0").values, [[1, 2]])
    same(a[..., 20.0].values, [2, 4, 6, 8])
    same(a.nloc[{"x1": 17.0}].values, [2, 4, 6, 8])
    same(a.compress_axis(a.x1 > 15, axis="x1").values, [[2], [4], [6], [8]])
    picked = a[a > 5]
    assert picked.dims == ("x0,x1",) and sorted(r.value for r in picked.cells.collect()) == [6, 7, 8]
    same(a.take((["a", "d"], [10.0, 20.0]), broadcast=True).values, [1, 8])
    same(a.take_axis([0, 5], axis=0, indexing="position", mode="wrap").values, [[1, 2], [3, 4]])
    with pytest.raises(IndexError):
        a["z"]
    b = a.put({"x0": "a"}, 0.0)
    same(b.values[0], [0, 0])
    same(a.put(a > 5, -1.0).values, [[1, 2], [3, 4], [5, -1], [-1, -1]])


@pytest.mark.parametrize("labels,cut,want", [([1.5, 2.5, 3.5], slice(1.5, 2.7), [1, 2]), ([3.5, 2.5, 1.5], slice(3.0, 1.0), [2, 3]), ([2.5, 3.5, 1.5], slice(2.5, 3.5), [1, 2]), ([1.5, 2.5, 3.5], slice(3.5, 1.5, -1), [3, 2, 1]), (["c", "a", "b"], slice("c", "a"), [1, 2]), ([1.5, 2.5, 3.5], slice(None, None, 2), [1, 3])])
def test_slices(spark, labels, cut, want):
    same(LabelArray.from_values(spark, np.array([1.0, 2, 3]), [("d", labels)])[cut].values, want)


def test_axis_sets():
    up, more = Axis.of("d", [1, 2, 3]), Axis.of("d", [2, 3, 4])
    assert up.union(more).values == (1, 2, 3, 4) and up.intersection(more).values == (2, 3)
    assert Axis.of("d", [3, 2, 1]).union(Axis.of("d", [4, 3, 2])).values == (4, 3, 2, 1)
    assert Axis.of("d", [1, 2, 4]).union(Axis.of("d", [3, 4, 1])).values == (1, 2, 4, 3)
    assert Axis.of("d", [5]).union(Axis.of("d", [1, 2])).values == (1, 2, 5)


def test_align_and_arithmetic(spark):
    a = LabelArray.from_values(spark, np.array([1.0, 2, 3, 4]), [("d", [1, 2, 3, 4])])
    b = LabelArray.from_values(spark, np.array([0.0, 2, 4, 6]), [("d", [0, 2, 4, 6])])
    x, y = gl.align(a, b)
    assert x.labels[0] == (0, 1, 2, 3, 4, 6)
    same(x.values, [np.nan, 1, 2, 3, 4, np.nan])
    assert gl.align(a, b, join="inner")[1].labels[0] == (2, 4)
    same((a + b).values, [np.nan, np.nan, 4, np.nan, 8, np.nan])
    c = LabelArray.from_values(spark, np.array([10.0, 20]), [("e", [1, 2])])
    same((a * c).values, np.outer([1, 2, 3, 4], [10, 20]))
    same((2 / a).values, 2 / np.array([1.0, 2, 3, 4]))
    same((-7 // LabelArray.from_values(spark, np.array([2, 0, -2]))).values, [-4, 0, 3])
    same((a / (a - 1)).values, [np.inf, 2, 1.5, 4 / 3])
    n = LabelArray.from_values(spark, np.array([1.0, np.nan, 2.0]))
    m = LabelArray.from_values(spark, np.array([np.nan, 0.0, 3.0]))
    same((n**m).values, [1, 1, 8])
    same((n != n).values, [0, 1, 0])
    assert (a == b) is False
    with pytest.raises(ValueError):
        a < b  # noqa: B015


def test_stack_concatenate(spark):
    a = LabelArray.from_values(spark, np.array([1, 2, 3]))
    b = LabelArray.from_values(spark, np.array([33, 11]), [("x0", [2, 0])])
    s = gl.stack({"a": a, "b": b}, axis="k", align_=True, sort=True)
    same(s.values, [[1, 2, 3], [11, np.nan, 33]])
    c = gl.concatenate([a, a])
    assert c.labels[0] == (0, 1, 2, 0, 1, 2)
    same(c.values, [1, 2, 3, 1, 2, 3])
    same(c.cumsum().values, [1, 3, 6, 7, 9, 12])
    same(c.diff().values, [1, 1, -2, 1, 1])
    same(c.ix[2:4].values, [3, 1])
    with pytest.raises(ValueError):
        gl.stack([a, b])


def test_reindex_interp(spark):
    a = LabelArray.from_values(spark, np.array([1, 2, 3]), [("x", [1, 2, 4])])
    same(a.reindex_axis([4, 3, 1, 1]).values, [3, np.nan, 1, 1])
    same(a.reindex_axis([3, 4], fill_value=0).values, [0, 3])
    same(a.reindex_axis([2, 3, 9], method="left").values, [2, 3, 3])
    same(a.reindex_axis([2, 3, 9], method="right").values, [3, 3, 3])
    u = LabelArray.from_values(spark, np.array([1.0, 4, 3, 2]), [("x", [1.0, 4.0, 3.0, 2.0])])
    same(u.interp_axis([0.5, 1.0, 2.25, 4.0, 5.0]).values, [np.nan, 1, 2.25, 4, np.nan])
    same(u.interp_axis([0.5, 5.0], left=-1, right=9).values, [-1, 9])
    g = LabelArray.from_values(spark, np.array([[0.0, 1], [2, 3]]), [("x", [0, 1]), ("y", [0, 1])])
    same(g.interp2d([[0.5], [0.25, 1.0]]).values, [[1.25, 2.0]])
    with pytest.raises(ValueError):
        g.interp2d([[2.0], [0.0]])


def test_missing_and_shape(a, holes):
    same(a.fillna(-1.0).values, np.where(np.isnan(holes), -1, holes))
    same(a.setna(0.0).values[0], [np.nan, 1, 2])
    assert a.dropna("time").labels[0] == (1950, 1952) and a.dropna("lat", minvalid=2).shape == (4, 3)
    f = a.flatten("lat", "time")
    assert f.dims == ("lat,time",) and f.labels[0][1] == (-90.0, 1951)
    same(f.values, holes.T.reshape(-1))
    assert f.unflatten().dims == ("lat", "time")
    r = a.newaxis("k", [1, 2])
    assert r.dims == ("k", "time", "lat") and r.shape == (2, 4, 3)
    assert a.reshape("lat", "z", "time").dims == ("lat", "z", "time") and a.reshape("lat", "z", "time").squeeze().dims == ("lat", "time")
    assert a.rollaxis("lat").dims == ("lat", "time") and a.swapaxes(0, 1).dims == ("lat", "time")
    same(f.mean(skipna=True), np.nanmean(holes))


def test_udf_and_exports(a, holes):
    from pyspark.sql import functions as F

    same(a.apply(F.exp).values, np.exp(holes))
    same(a.apply_along_axis(np.nanmax, "time").values, np.nanmax(holes, 0))
    same(a.moving("sum", 2, axis="time").values[1:], holes[1:] + holes[:-1])
    same(LabelArray.from_json(a.spark, a.to_json()).values, holes)
    same(LabelArray.from_pandas(a.spark, a.to_pandas()).values, holes)
    same(a.to_masked().sum(), np.nansum(holes))
    same(LabelArray.from_nested(a.spark, {"u": [1, 2], "v": [3, 4]}).values, [[1, 2], [3, 4]])
    assert "10 non-null elements (2 null)" in a.summary()


def test_numpy_functions_and_names(spark, a, holes):
    same(np.exp(a).values, np.exp(holes))
    same((np.float64(2) * a).values, 2 * holes)
    same(np.add(a, 1).values, holes + 1)
    b = a.copy()
    b.dims = ("year", "lat")
    b.year = [1, 2, 3, 4]
    b.note = "renamed"
    assert b.dims == ("year", "lat") and b.labels[0] == (1, 2, 3, 4) and b.attrs["note"] == "renamed" and "note" not in a.attrs
    same(b.values, holes)


def test_axis_methods():
    x = Axis.of("d", [3, 1, 2])
    assert x[0] == 3 and x[1:].values == (1, 2) and x.sort().values == (1, 2, 3) and x.cast("str").values == ("3", "1", "2") and x.put(0, 1.5).values == (1.5, 1.0, 2.0)
    assert Axis.from_pandas(x.to_pandas()) == x and len(x) == 3 and not x.is_monotonic()
    two = Axis("a,b", members=(Axis.of("a", [0, 1]), Axis.of("b", ["u", "v"])))
    assert Axis.from_pandas(two.to_pandas()) == two and two.values[1] == (0, "v")


def test_axes_shared_by_a_dataset(spark):
    v = lambda x, *axes: LabelArray.from_values(spark, np.array(x), list(axes))
    x, y = ("x", [11.0, 22.0, 33.0]), ("y", ["a", "b"])
    ds = gl.Dataset(v0=v([1.0, 2, 3], x), v1=v([4, 5], y), v2=v([[1, 2], [3, 4], [5, 6]], x, y))
    ds.axes["x"] = Axis.of("x", [22.0, 44.0, 66.0], units="m")
    assert ds["v0"].labels[0] == ds["v2"].labels[0] == (22.0, 44.0, 66.0) and ds["v2"].axes[0].attrs == {"units": "m"}
    assert ds["v0"].sel(x=44.0) == 2.0 and ds["v2"].sel(x=66.0, y="b") == 6
    ds.axes[0].name = "z"
    assert ds.dims == ("z", "y") and ds["v0"].dims == ("z",) and ds["v2"].sel(z=66.0).values.tolist() == [5, 6] and ds["v1"].dims == ("y",)
    ds.axes["y"].labels = ["c", "d"]
    ds.axes["y"].attrs = {"long": "letters"}
    assert ds["v1"].sel(y="d") == 5 and ds["v2"].labels[1] == ("c", "d") and ds["v1"].axes[0].attrs == {"long": "letters"}
    with pytest.raises(ValueError):
        ds.axes["y"] = ["only one"]
    with pytest.raises(ValueError):
        ds.axes["y"].name = "z"
    with pytest.raises(IndexError):
        ds.axes["none"]
    assert [a.name for a in ds.axes] == ["z", "y"] and ds.axes[0] == ds["v0"].axes[0] and (ds * 2)["v0"].sum() == 12


def test_functions_along_an_axis_by_shape(spark):
    a = LabelArray.from_values(spark, np.array([[1.0, 4, 9], [2, 2, 5]]), [("g", ["p", "q"]), ("t", [10, 20, 30])])
    d = a.apply_along_axis(np.diff, "t", same="diff")
    assert d.labels[1] == (20, 30) and d.values.tolist() == [[3, 5], [0, 3]]
    assert a.apply_along_axis(np.cumsum, "t", same=True).values.tolist() == [[1, 5, 14], [2, 4, 9]]
    with pytest.raises(Exception, match="gives"):
        a.apply_along_axis(lambda x: x[:1], "t", same=True).values  # noqa: B018


def test_rows_are_read_once_for_labels_and_cells(spark, tmp_path):
    from pyspark.sql import functions as F

    spark.createDataFrame([("a", 1, 2.0), ("a", 1, 3.0), ("b", 2, 4.0)], "k string, t long, v double").write.parquet(f"{tmp_path}/rows")
    a = LabelArray.from_dataframe(spark.read.parquet(f"{tmp_path}/rows"), ["k", "t"], "v", aggregate=F.sum)
    assert a.labels == (("a", "b"), (1, 2)) and all("/rows/" not in f for f in a.cells.inputFiles()) and a.sum(skipna=True) == 9.0
