"""Order statistics of large groups, scans of associative functions by blocks, moving order statistics and shared weights."""

import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

import gridloom as gl
from gridloom import Dataset, LabelArray
from gridloom.operators import interp, ranks


@pytest.fixture
def small(request):
    """Options that make small arrays take the ways of large ones."""
    gl.set_option("reduce.sort_rows", 40)
    gl.set_option("scan.block", 7)
    yield
    gl.reset_options()


def cube():
    rng = np.random.default_rng(0)
    v = rng.normal(size=(5, 1500)).round(1)
    v[1], v[2, :1000], v[3, 5], v[4] = 7.0, 3.0, np.nan, np.nan
    return v


def test_percentiles_of_groups(spark, small):
    v = cube()
    a = LabelArray.from_values(spark, v, [("rank", list("abcde")), ("n", range(1500))])  # dimensions called like columns in there
    shares = [0, 10, 33.3, 50, 99.9, 100]
    with np.errstate(all="ignore"):
        want = np.nanpercentile(v, shares, axis=1)
    np.testing.assert_allclose(a.percentile(shares, "n", skipna=True).values, want)
    np.testing.assert_array_equal(a.median("n").values, [*np.median(v[:3], axis=1), np.nan, np.nan])
    np.testing.assert_array_equal(a.quantile(0.25, "n").values, [*np.quantile(v[:3], 0.25, axis=1), np.nan, np.nan])
    np.testing.assert_array_equal(a.median(("n", "rank"), skipna=True), np.nanmedian(v))
    assert a.isel(rank=0).median() == np.median(v[0]) and a.isel(rank=1).percentile(5, "n") == 7.0
    assert a.median("n", skipna=True, keepdims=True).dims == ("rank", "n")


def test_the_way_does_not_change_the_result(spark):
    r = random.Random(4)
    rows = [(r.choice("aab"), r.choice([r.gauss(0, 1e9), 5.0, -0.0])) for _ in range(3000)]
    df = spark.createDataFrame(rows, "k string, value double").repartition(6)
    got = [{x.k: (x["count"], list(x.value)) for x in ranks.percentiles(df, ["k"], [0.0, 0.01, 0.5, 1.0], most).collect()} for most in (10, 100_000)]
    assert got[0] == got[1] and {n for n, _ in got[0].values()} == {sum(k == c for k, _ in rows) for c in "ab"}
    assert ranks.percentiles(df.where("false"), ["k"], [0.5], 10).count() == 0 and ranks.percentiles(df.where("false"), [], [0.5], 10).first()["value"] is None


def test_a_skewed_group_takes_many_tasks(spark):
    """One group of two million cells; no task sorts more than the option allows."""
    n = 2_000_000
    cells = spark.range(0, n, 1, 8).select(F.when(F.col("id") % 1000 == 0, "b").otherwise("a").alias("k"), ((F.col("id") * 7919) % n).cast("double").alias("value"))
    got = {r.k: r.value[0] for r in ranks.percentiles(cells, ["k"], [0.5], 5000).collect()}
    a = sorted((i * 7919) % n for i in range(n) if i % 1000)
    assert got["a"] == statistics.median(a) and got["b"] == statistics.median((i * 7919) % n for i in range(0, n, 1000))


def test_whole_products(spark, small):
    r = np.random.default_rng(1)
    w = r.integers(-2, 3, size=(3, 60))
    w[1][w[1] == 0] = 1
    w[0][w[0] == 0] = -1
    w[0, 30] = 0
    a = LabelArray.from_values(spark, w, [("g", [0, 1, 2]), ("t", range(60))])
    np.testing.assert_array_equal(a.cumprod("t").values, np.cumprod(w, axis=1))
    np.testing.assert_array_equal(a.cumprod("g").values, np.cumprod(w, axis=0))
    tail = LabelArray.from_values(spark, np.array([2] * 62 + [0] + [2] * 70), [("t", range(133))])
    assert tail.cumprod("t").values[61:64].tolist() == [2**62, 0, 0]
    with pytest.raises(Exception, match="exceeds 64 bits"):
        LabelArray.from_values(spark, np.full(70, 2), [("t", range(70))]).cumprod("t").values  # noqa: B018
    assert LabelArray.from_values(spark, np.array([[-2, 2**62, 1]]), [("g", [0]), ("t", range(3))]).cumprod("t").values.tolist() == [[-2, -(2**63), -(2**63)]]


def test_any_associative_function(spark, small):
    v = np.random.default_rng(2).normal(size=(2, 40))
    v[0, 11] = np.nan
    a = LabelArray.from_values(spark, v, [("g", [0, 1]), ("t", range(40))])
    want = np.maximum.accumulate(v, axis=1)
    np.testing.assert_array_equal(a.accumulate(max, "t").values, want)
    np.testing.assert_array_equal(a.accumulate(max, "t", skipna=True).values, np.fmax.accumulate(v, axis=1))
    mean = a.accumulate(lambda x, y: (x[0] + y[0], x[1] + y[1]), "t", skipna=True, of=lambda x: (x, 1), back=lambda s: s[0] / s[1]).values
    np.testing.assert_allclose(mean, np.nancumsum(v, axis=1) / np.cumsum(~np.isnan(v), axis=1))
    text = LabelArray.from_values(spark, np.array(list("abcdefghijklmnopqrst"), dtype=object), [("t", range(20))])
    assert text.accumulate(lambda x, y: x + y, "t").values[-1] == "abcdefghijklmnopqrst"  # not commutative
    lead = LabelArray.from_values(spark, np.array([np.nan, 2.0]), [("t", [0, 1])])
    assert lead.accumulate(min, "t", skipna=True, start=-1.0).values.tolist() == [-1.0, 2.0]


def test_a_line_of_a_million_whole_numbers(spark):
    n = 1_000_000
    df = spark.range(0, n, 1, 8).select(F.col("id").alias("t"), F.when(F.col("id") % 100_000 == 7, 2).when(F.col("id") % 2 == 0, -1).otherwise(1).cast("bigint").alias("value"))
    out = LabelArray.from_dataframe(df, ["t"], listed="ordered").cumprod("t")
    assert out.isel(t=-1) == 2**10 * (-1) ** (n // 2) and out.cells.rdd.getNumPartitions() > 1


@pytest.mark.parametrize("block", [7, 10_000])
@pytest.mark.parametrize("skipna", [False, True])
def test_moving_order_statistics(spark, block, skipna):
    rng = np.random.default_rng(3)
    v = rng.integers(0, 6, size=(2, 50)).astype(float)
    v[0, [4, 5, 20]] = np.nan
    a = LabelArray.from_values(spark, v, [("g", ["x", "y"]), ("t", range(50))])
    gl.set_option("scan.block", block)
    try:
        got = {op: a.moving(op, 5, "t", skipna).values for op in ("median", "rank", "argmin", "argmax")}
    finally:
        gl.reset_options()
    for op, found in got.items():
        for g in range(2):
            for t in range(50):
                w = v[g, max(0, t - 4) : t + 1]
                good = w[~np.isnan(w)]
                if t < 4 or len(good) < (1 if skipna else 5) or op == "rank" and np.isnan(w[-1]):
                    want = np.nan
                elif op == "median":
                    want = np.median(good)
                elif op == "rank":
                    want = 2 * ((good < w[-1]).sum() + ((good == w[-1]).sum() - 1) / 2) / (len(good) - 1) - 1 if len(good) > 1 else 0.0
                else:
                    best = good.min() if op == "argmin" else good.max()
                    want = min(k for k in range(5) if w[4 - k] == best)
                assert found[g, t] == want or np.isnan(found[g, t]) and np.isnan(want), (op, g, t)


def test_weights_are_made_once_for_all_variables(spark, monkeypatch):
    made = []
    plain = interp.weigh
    for place in (interp, gl.dataset):
        monkeypatch.setattr(place, "weigh", lambda spark, a, *k, **kw: made.append(a.name) or plain(spark, a, *k, **kw))
    x, y = [0, 1, 2, 4], [10.0, 20.0]
    v = np.arange(8.0).reshape(4, 2) ** 2
    v[3, 1] = np.nan
    ds = Dataset({"u": LabelArray.from_values(spark, v, [("x", x), ("y", y)]), "v": LabelArray.from_values(spark, v * 3, [("x", x), ("y", y)]), "w": LabelArray.from_values(spark, np.arange(4.0), [("x", x)])})
    other = LabelArray.from_values(spark, np.zeros((3, 2)), [("x", [0.5, 3.0, 9.0]), ("y", [12.5, 20.0])])
    got = ds.interp_like(other)
    assert made == ["x", "y"]
    one = ds["u"].interp_axis([0.5, 3.0, 9.0], "x").interp_axis([12.5, 20.0], "y")
    np.testing.assert_allclose(got["u"].values, one.values)
    np.testing.assert_allclose(got["v"].values, 3 * one.values)
    assert got["w"].values[:2].tolist() == [0.5, 2.5] and np.isnan(got["w"].values[2])
    made.clear()
    filled = ds.interp_axis([0.5, 9.0], "x", right=-1.0)
    assert made == ["x"] and filled["u"].values[1].tolist() == [-1.0, -1.0] and filled["w"].values.tolist() == [0.5, -1.0]
    assert got["u"].cells._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 1  # both dimensions by one aggregation
