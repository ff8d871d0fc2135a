"""Stores, netCDF classic files, JSON, CF times, datasets and options."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

import gridloom as gl
from gridloom import Dataset, LabelArray
from gridloom.sources import cf, netcdf, store


def same(a, b):
    np.testing.assert_allclose(np.asarray(a, dtype=float), np.asarray(b, dtype=float), equal_nan=True)


@pytest.fixture(scope="module")
def a(spark):
    v = np.arange(6.0).reshape(2, 3)
    v[1, 1] = np.nan
    return LabelArray.from_values(spark, v, [("k", ["a", "b"]), ("t", [10, 20, 30])], attrs={"units": "m"})


def test_store(spark, a, tmp_path):
    path = f"file://{tmp_path}/s"
    a.write(path, "w-", "x")
    with pytest.raises(FileExistsError):
        a.write(path, "w-", "x")
    s = gl.open_store(spark, path)
    s.write("y", a.sum("k", skipna=True), fill_value=-99.0)
    assert s.keys() == ["x", "y"] and s["x"].attrs == {"units": "m"} and s["x"].equals(a)
    same(gl.read(spark, path, "y").values, [3, 1, 7])
    cut = gl.read(spark, path, "x", {"t": slice(15, 30)})
    assert cut.labels[1] == (20, 30) and "PushedFilters: [IsNotNull(t)" in cut.cells._jdf.queryExecution().toString()
    s.put("x", {"k": "a"}, 7.0)
    same(gl.read(spark, path, "x").values, [[7, 7, 7], [3, np.nan, 5]])
    store.append(LabelArray.from_values(spark, np.ones((2, 1)), [("k", ["a", "b"]), ("t", [40])]), path, "x", "t")
    same(gl.read(spark, path, "x").values[:, 3], [1, 1])
    b = f"file://{tmp_path}/r"
    a.write(b, "w", "x")
    a.write(f"file://{tmp_path}/q", "w", "x")
    both = gl.read(spark, f"file://{tmp_path}/[qr]", "x", axis="run")
    assert both.dims == ("run", "k", "t") and both.labels[0] == ("q", "r")
    assert gl.read(spark, [b, b], "x", axis="t").shape == (2, 6)


def test_netcdf_round_trip(spark, a, tmp_path):
    day = LabelArray.from_values(spark, np.array([1, 2, 3]), [("day", [dt.datetime(2024, 1, i) for i in (1, 2, 4)])])
    path = f"file://{tmp_path}/f.nc"
    netcdf.write_file(Dataset({"x": a, "d": day}, attrs={"title": "é", "n": 3}), path)
    ds = netcdf.open_file(spark, path)
    assert ds.attrs == {"title": "é", "n": 3} and ds["x"].attrs == {"units": "m"}
    same(ds["x"].values, a.values)
    assert ds["x"].labels == a.labels and ds["d"].labels == day.labels
    same(ds["d"].values, [1, 2, 3])
    netcdf.write_file(a, f"file://{tmp_path}/g.nc", "x")
    same(netcdf.read_files(spark, f"file://{tmp_path}/f.nc", "x", {"k": "b"}).values, a.values[1])
    same(netcdf.read_files(spark, f"file://{tmp_path}/g.*", "x", axis="t").values, a.values)
    assert netcdf.read_files(spark, f"file://{tmp_path}/*.nc", ["x"], axis="file")["x"].labels[0] == ("f", "g")
    with pytest.raises(ValueError):
        netcdf.Classic(b"\x89HDF\r\n\x1a\n")


def test_record_variables():
    import struct

    name = netcdf._name
    head = b"CDF\x01" + struct.pack(">i", 2) + struct.pack(">ii", 10, 2) + name("t") + struct.pack(">i", 0) + name("x") + struct.pack(">i", 3) + struct.pack(">ii", 0, 0)
    parts = [name("a") + struct.pack(">iii", 2, 0, 1) + struct.pack(">ii", 0, 0) + struct.pack(">ii", 3, 8), name("t") + struct.pack(">ii", 1, 0) + struct.pack(">ii", 0, 0) + struct.pack(">ii", 6, 8)]
    begin = len(head) + 8 + sum(len(p) + 4 for p in parts)
    head += struct.pack(">ii", 11, 2) + parts[0] + struct.pack(">i", begin) + parts[1] + struct.pack(">i", begin + 8)
    body = b"".join(np.array([r, r + 1, r + 2], ">i2").tobytes() + b"\0\0" + np.array([r * 10.0], ">f8").tobytes() for r in (1, 5))
    c = netcdf.Classic(head + body)
    assert c.values("a").tolist() == [[1, 2, 3], [5, 6, 7]] and c.labels("t") == [10.0, 50.0] and c.labels("x") == [0, 1, 2]


def test_cf_times(spark):
    df = spark.createDataFrame([(0.0,), (1.5,), (-366.0,)], "n double").select(cf.decode_datetime(F.col("n"), "days since 2000-01-01 06:00").alias("t"))
    assert [r.t for r in df.collect()] == [dt.datetime(2000, 1, 1, 6), dt.datetime(2000, 1, 2, 18), dt.datetime(1998, 12, 31, 6)]
    assert [r[0] for r in df.select(cf.encode_datetime(F.col("t"), "hours since 2000-01-01")).collect()] == [6.0, 42.0, -8778.0]
    assert cf.infer_unit([dt.datetime(2000, 1, 1), dt.datetime(2000, 1, 1, 6)]) == "hours"
    assert spark.sql("select interval '36' hour as i").select(cf.encode_timedelta(F.col("i"), "days")).first()[0] == 1.5


def test_dataset(spark, a):
    ds = Dataset({"x": a, "y": a.sum("t", skipna=True)})
    assert ds.dims == ("k", "t") and len(ds) == 2 and "x" in ds
    same(ds.mean("t", skipna=True)["y"].values, ds["y"].values)
    same(ds.sel(k="b")["y"].item(), 8)
    with pytest.raises(ValueError):
        ds["z"] = a.isel(t=[0])
    ds["z"] = a.isel(t=[0]).squeeze("t")
    del ds["z"]
    assert ds.rename_axes({"k": "key"}).dims == ("key", "t") and list(ds.rename_keys({"x": "w"})) == ["w", "y"]
    same((ds * 2)["x"].values, a.values * 2)
    same((1 - ds)["y"].values, 1 - ds["y"].values)
    assert ds == ds.copy() and not ds == -ds
    s = gl.stack_ds({"p": ds, "q": ds}, axis="run")
    assert s["y"].dims == ("run", "k")
    assert gl.concatenate_ds([ds, ds], "k")["x"].shape == (4, 3)
    same(ds.reindex_axis([20, 99], "t")["x"].values, [[1, np.nan], [np.nan, np.nan]])
    same(ds.interp_axis([15.0], "t")["x"].values, [[0.5], [np.nan]])
    same(ds.reduce_axis(np.nanmax, "t")["x"].values, [2, 5])
    assert ds["t"].values.tolist() == [10, 20, 30] and "dataset of 2 arrays" in repr(ds)
    assert gl.array({"u": a, "v": a.sum("t", skipna=True)}, axis="n").shape == (2, 2, 3)


def test_options_and_constants(spark):
    assert gl.get_option("align.join") == "outer"
    with pytest.raises(KeyError):
        gl.set_option("no.such", 1)
    z = gl.zeros(spark, shape=(2, 3))
    assert z.dims == ("x0", "x1") and z.sum() == 0 and gl.ones_like(z).sum() == 6 and np.isnan(gl.nans(spark, shape=(2,)).values).all()


def test_open_axis(spark):
    df = spark.createDataFrame([(1, "u1", 2.0), (1, "u2", 3.0), (2, "u1", 5.0)], "day long, user string, v double")
    a = LabelArray.from_dataframe(df, ["day", "user"], "v", axes={"day": [1, 2]}, listed=False)
    same(a.sum("user", skipna=True).values, [5, 5])
    same(a.take({"user": "u1"}).values, [2, 5])
    with pytest.raises(ValueError):
        a.sum("user")


def test_streaming(spark, tmp_path):
    from gridloom.streaming import running_reduction

    spark.createDataFrame([("a", 1.0), ("b", 2.0), ("a", 3.0)], "k string, v double").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("k string, v double").parquet(f"{tmp_path}/in")
    q = running_reduction(stream, ["k"], "v", "sum").writeStream.outputMode("complete").format("memory").queryName("run_sum").start()
    q.processAllAvailable()
    q.stop()
    assert {r.k: r.value for r in spark.table("run_sum").collect()} == {"a": 4.0, "b": 2.0}


def test_json_columns(spark):
    rows = [("p", '{"a": {"1": 1.5, "2": 2}, "b": {"1": "x", "z": 4}}'), ("q", '{"b": {"2": 7}, "c": 5}'), ("r", None), ("s", "no json"), ("t", "[[1, 2], {\"0\": 3}]")]
    df = spark.createDataFrame(rows, "k string, text string")
    a = LabelArray.from_json_column(df, "text", ["x", "y"], keep=["k"], kinds={"y": "bigint"})
    got = {(r.k, r.x, r.y): r.value for r in a.to_dataframe().collect() if r.value is not None}
    assert got == {("p", "a", 1): 1.5, ("p", "a", 2): 2.0, ("q", "b", 2): 7.0, ("t", "0", 0): 1.0, ("t", "0", 1): 2.0, ("t", "1", 0): 3.0}
    assert a.dims == ("k", "x", "y") and a.labels[2] == (0, 1, 2)
    assert LabelArray.from_json_column(df.where("false"), "text", ["x"]).shape == (0,)
