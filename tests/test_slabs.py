"""netCDF classic files by byte ranges, slabs written by tasks, and CF calendars."""

import datetime as dt
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom import LabelArray
from gridloom.sources import cf, netcdf, slabs
from gridloom.sources.classic import Header


def big_file(path, rows=4000, columns=50):
    """The array it holds: v (t, s) of doubles with a fill value."""
    values = np.arange(rows * columns, dtype=float).reshape(rows, columns)
    raw = values.copy()
    raw[7, 3] = -999.0
    raw[8, 4] = np.nan
    values[7, 3] = values[8, 4] = np.nan
    t, s = np.arange(rows) * 2.0, np.array([f"c{i:02d}" for i in range(columns)], dtype=object)
    body = netcdf.encode({"t": rows, "s": columns}, [("t", ["t"], {"units": "m"}, t), ("s", ["s"], {}, s), ("v", ["t", "s"], {"_FillValue": -999.0, "long": "x"}, raw)], {"title": "big"})
    path.write_bytes(body)
    return values


@pytest.fixture(scope="module")
def big(tmp_path_factory):
    path = tmp_path_factory.mktemp("nc") / "big.nc"
    return str(path), big_file(path)


def test_a_file_is_read_by_several_tasks(spark, big):
    path, values = big
    a = netcdf.open_file(spark, path, slab_bytes=100_000)["v"]
    assert a.cells.rdd.getNumPartitions() == 16 and a.attrs["long"] == "x" and a.axes[0].attrs["units"] == "m"
    got = a.cells.agg(F.count("value"), F.sum("value")).first()
    assert got[0] == values.size - 2 and got[1] == np.nansum(values)
    np.testing.assert_array_equal(a.isel(t=slice(5, 10)).values, values[5:10])


def test_a_slab_costs_its_own_bytes(spark, big):
    path, values = big
    a = netcdf.open_file(spark, path, slab_bytes=100_000)["v"]
    part = a.sel(t=slice(100.0, 299.0), s=["c10", "c12"])
    np.testing.assert_array_equal(part.values, values[50:150][:, [10, 12]])
    assert part.cells.rdd.getNumPartitions() == 1  # the filters reach the plan
    read = slabs.ranges_of(path)
    header = Header.of(read)
    rows = np.arange(50, 150)
    whole = slabs.plan(header, "v", [rows, np.arange(50)], 8 * 50 * 30)
    assert [len(p.rows) for p in whole] == [30, 30, 30, 10] and sum(n for p in whole for _, n, _, _ in slabs.reads(header, "v", p)) == 100 * 50 * 8
    assert [len(slabs.reads(header, "v", p)) for p in whole] == [1, 1, 1, 1]
    narrow = slabs.plan(header, "v", [rows, np.array([10, 12])], 1 << 20)
    assert sum(n for p in narrow for _, n, _, _ in slabs.reads(header, "v", p)) == 100 * 3 * 8
    assert slabs.plan(header, "v", [rows[:0], np.arange(50)], 1 << 20) == []
    assert a.sel(t=slice(1e6, None)).count() == 0


def test_names_of_the_package(spark, big, tmp_path):
    import gridloom as gl

    text = gl.summary_nc(spark, big[0])
    assert "title: 'big'" in text and "0 / t (4000): 0.0 to 7998.0" in text and "v: double ('t', 's')" in text
    a = gl.read_nc(spark, big[0], "v").isel(t=slice(0, 6))
    gl.write_nc(a, str(tmp_path / "w.nc"), "v")
    gl.write_slabs(a, str(tmp_path / "w"), "t", 4, "v")
    np.testing.assert_array_equal(gl.open_nc(spark, str(tmp_path / "w.nc"))["v"].values, big[1][:6])
    np.testing.assert_array_equal(gl.read_nc(spark, f"{tmp_path}/w/*.nc", "v", axis="t").values, big[1][:6])


def test_header_longer_than_the_first_piece(big):
    read = slabs.ranges_of(big[0])
    assert Header.of(read, first=16).variables == Header.of(read).variables
    with pytest.raises(ValueError, match="damaged"):
        Header.of(lambda at, n: b"CDF\x01\0\0")


def test_records_of_several_variables(spark, tmp_path):
    """Records lie one after the other: x (t, s) of doubles beside y (t) of shorts, and times."""
    name = netcdf._name
    n, m = 5, 3
    head = b"CDF\x01" + struct.pack(">i", n) + struct.pack(">ii", 10, 2) + name("t") + struct.pack(">i", 0) + name("s") + struct.pack(">i", m) + struct.pack(">ii", 0, 0)
    units = netcdf._attributes({"units": "days since 2000-02-28", "calendar": "noleap"})
    none = struct.pack(">ii", 0, 0)
    parts = [("t", [0], units, 6, 8), ("x", [0, 1], none, 6, 8 * m), ("y", [0], none, 3, 4)]
    size = len(head) + 8 + sum(len(name(k)) + 4 + 4 * len(d) + len(a) + 12 for k, d, a, _, _ in parts)
    head += struct.pack(">ii", 11, 3)
    at = size
    for k, d, a, kind, length in parts:
        head += name(k) + struct.pack(f">i{len(d)}i", len(d), *d) + a + struct.pack(">iii", kind, length, at)
        at += length
    x = np.arange(n * m, dtype=">f8").reshape(n, m)
    body = b"".join(struct.pack(">d", i) + x[i].tobytes() + struct.pack(">hh", i * 7, 0) for i in range(n))
    (tmp_path / "r.nc").write_bytes(head + body)
    ds = netcdf.open_file(spark, str(tmp_path / "r.nc"), slab_bytes=50)
    assert ds["x"].cells.rdd.getNumPartitions() == 3 and ds["x"].labels[0][:3] == (dt.datetime(2000, 2, 28), dt.datetime(2000, 3, 1), dt.datetime(2000, 3, 2))
    np.testing.assert_array_equal(ds["x"].values, x)
    assert ds["y"].values.tolist() == [0, 7, 14, 21, 28] and ds["x"].sel(t=dt.datetime(2000, 3, 1), s=2) == 5.0


def test_paths_that_only_spark_reaches(spark, big, monkeypatch):
    monkeypatch.setattr(netcdf, "opened", lambda path: None)
    a = netcdf.open_file(spark, big[0])["v"]
    np.testing.assert_array_equal(a.isel(t=slice(5, 10)).values, big[1][5:10])


def test_slabs_are_written_by_tasks(spark, tmp_path):
    values = np.arange(70.0).reshape(7, 5, 2)
    values[2, 1, 0] = np.nan
    a = LabelArray.from_values(spark, values, [("x", list("gfedcba")), ("y", [5, 4, 3, 2, 1]), ("z", [0.5, 1.5])], attrs={"units": "K"})
    netcdf.write_slabs(a, str(tmp_path / "out"), "y", 2, "v")
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["part-000000.nc", "part-000001.nc", "part-000002.nc"]
    back = netcdf.read_files(spark, f"{tmp_path}/out/*.nc", "v", axis="y").transpose("x", "y", "z")
    np.testing.assert_array_equal(back.values, values)
    assert back.labels == a.labels
    netcdf.write_slabs((a > 3).cells and a.fillna(0.0).apply(lambda c: c.cast("bigint")), str(tmp_path / "whole"), "x", 10)
    assert netcdf.read_files(spark, f"{tmp_path}/whole/part-000000.nc", "value").dtype == "bigint"


# -- calendars ------------------------------------------------------------------------------------


def test_known_dates():
    add = lambda n, ref, c: cf.date_of(cf.day_number(*ref, c) + n, c)
    assert add(59, (2000, 1, 1), "noleap") == (2000, 3, 1) and add(59, (2001, 1, 1), "all_leap") == (2001, 2, 29)
    assert add(59, (2001, 1, 1), "360_day") == (2001, 2, 30) and add(360, (2001, 1, 1), "360_day") == (2002, 1, 1)
    assert add(1, (1900, 2, 28), "julian") == (1900, 2, 29) and add(1, (1900, 2, 28), "proleptic_gregorian") == (1900, 3, 1)
    assert add(1, (1582, 10, 4), "standard") == (1582, 10, 15) and add(-1, (1582, 10, 15), "gregorian") == (1582, 10, 4)
    assert cf.day_number(2000, 1, 1, "standard") - cf.day_number(1500, 1, 1, "standard") == 182_621 - 9  # Gregorian days, less the 9 by which Julian dates are behind then
    with pytest.raises(ValueError):
        cf.day_number(2000, 1, 1, "lunar")


@pytest.mark.parametrize("calendar", sorted(set(cf.CALENDARS)))
def test_days_follow_each_other(calendar):
    """Over 900 years each day number is the date after the last one, and gives itself back."""
    last = None
    for n in range(cf.day_number(1400, 1, 1, calendar), cf.day_number(2300, 1, 1, calendar)):
        date = cf.date_of(n, calendar)
        assert last is None or date > last
        assert cf.day_number(*date, calendar) == n
        last = date
    if calendar == "proleptic_gregorian":
        assert all((dt.date(1, 1, 1) + dt.timedelta(days=k)).timetuple()[:3] == cf.date_of(cf.day_number(1, 1, 1, calendar) + k, calendar) for k in range(0, 900_000, 97))


def test_columns_equal_numbers(spark):
    days = [-800_000, -1, 0, 58, 59, 60, 365, 366, 146_097, 730_000]
    df = spark.createDataFrame([(float(n),) for n in days], "n double")
    for c in cf.CALENDARS:
        units = "days since 1999-12-30 06:00"
        got = df.select("n", cf.decode_calendar(F.col("n") + 0.5, units, c).alias("d")).select("n", "d", cf.encode_calendar(F.col("d.year"), F.col("d.month"), F.col("d.day"), F.col("d.micros"), units, c).alias("back")).collect()
        for r in got:
            assert (r.d.year, r.d.month, r.d.day) == cf.date_of(cf.day_number(1999, 12, 30, c) + int(r.n), c) and r.d.micros == 18 * 3_600_000_000 and r.back == r.n + 0.5
    none = spark.range(1).select(cf.encode_calendar(F.lit(2001), F.lit(2), F.lit(29), F.lit(0), "days since 2000-01-01", "noleap").alias("n")).first()
    assert none.n is None


def test_labels_in_calendars_of_their_own():
    assert cf.decoded_times([0, 1], "days since 2001-02-29", "360_day") == ["2001-02-29 00:00:00", "2001-02-30 00:00:00"]
    assert cf.decoded_times([0.5], "days since 2000-02-28", "noleap") == [dt.datetime(2000, 2, 28, 12)] and cf.decoded_times([1], "days since 2000-01-01", "none") is None


