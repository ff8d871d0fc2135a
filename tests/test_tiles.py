"""Stores in versions, and variables cut into tiles."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

import gridloom as gl
from gridloom import LabelArray
from gridloom.sources import store


@pytest.fixture
def made(spark, tmp_path):
    v = np.arange(60.0).reshape(10, 6)
    v[4, 4] = np.nan
    a = LabelArray.from_values(spark, v, [("x", list(range(100, 110))), ("y", list("abcdef"))], attrs={"units": "m"})
    path = str(tmp_path / "s")
    a.write(path, "w", "v", tiles={"x": 4, "y": 3})
    return path, v, a


def tiles(path):
    """The tile folders of each table of v."""
    root = f"{path}/v"
    return {t: sorted(x for x in os.listdir(f"{root}/{t}") if x.startswith("__tile")) for t in sorted(os.listdir(root), key=lambda t: os.stat(f"{root}/{t}").st_mtime_ns)}


def test_one_cell_is_one_tile(spark, made):
    path, v, a = made
    assert [len(x) for x in tiles(path).values()] == [6]
    s = gl.open_store(spark, path)
    s.put("v", {"x": 105, "y": "b"}, -1.0)
    v[5, 1] = -1
    np.testing.assert_array_equal(gl.read(spark, path, "v").values, v)
    assert list(tiles(path).values())[-1] == ["__tile=t1_0"]
    s.put("v", {"x": slice(103, 104), "y": "f"}, LabelArray.from_values(spark, np.array([7.0, 8.0]), [("x", [103, 104])]))
    v[3:5, 5] = [7, 8]
    np.testing.assert_array_equal(gl.read(spark, path, "v").values, v)
    assert list(tiles(path).values())[-1] == ["__tile=t0_1", "__tile=t1_1"]
    assert s["v"].attrs == {"units": "m"} and np.isnan(gl.read(spark, path, "v", {"x": 104, "y": "e"}).values)
    mask = gl.open_store(spark, path)["v"] > 50
    s.put("v", mask, 0.0)  # any tile may be touched: all are made anew
    np.testing.assert_array_equal(gl.read(spark, path, "v").values, np.where(v > 50, 0, v))


def test_older_versions(spark, made):
    path, v, _ = made
    s = gl.open_store(spark, path)
    s.put("v", {"x": 100}, 5.0)
    assert store.versions(spark, path) == [1, 2]
    np.testing.assert_array_equal(gl.open_store(spark, path, 1)["v"].values, v)
    gone = s.vacuum()
    assert "_meta-00000001" in gone and store.versions(spark, path) == [2]
    v[0] = 5
    # tiles that were not touched are still in the first table, which stays
    np.testing.assert_array_equal(gl.read(spark, path, "v").values, v)
    with pytest.raises(FileNotFoundError):
        gl.open_store(spark, path, 1)


@pytest.mark.parametrize("cut", [{"x": 4, "y": 3}, {}])
def test_a_failed_write_changes_nothing(spark, tmp_path, cut):
    v = np.arange(12.0).reshape(4, 3)
    a = LabelArray.from_values(spark, v, [("x", [1, 2, 3, 4]), ("y", [1, 2, 3])])
    path = str(tmp_path / "s")
    a.write(path, "w", "v", tiles=cut)
    bad = a.make(a.cells.withColumn("value", F.when(F.col("x") == 3, F.raise_error(F.lit("stop")).cast("double")).otherwise(F.col("value"))), a.axes)
    with pytest.raises(Exception, match="stop"):
        gl.open_store(spark, path).put("v", {"x": slice(2, 4)}, bad)
    with pytest.raises(Exception, match="stop"):
        bad.write(path, "a", "v")
    os.mkdir(f"{path}/_meta-00000002")  # a descriptor that was not finished
    assert store.versions(spark, path) == [1]
    np.testing.assert_array_equal(gl.read(spark, path, "v").values, v)


def test_growing_along_tiles(spark, made):
    path, v, a = made
    more = np.arange(18.0).reshape(3, 6) + 1000
    store.append(LabelArray.from_values(spark, more, [("x", [200, 201, 202]), ("y", list("abcdef"))]), path, "v", "x")
    np.testing.assert_array_equal(gl.read(spark, path, "v").values, np.concatenate([v, more]))
    assert list(tiles(path).values())[-1] == ["__tile=t2_0", "__tile=t2_1", "__tile=t3_0", "__tile=t3_1"]
    gl.open_store(spark, path).put("v", {"x": 109}, 1.0)
    assert gl.read(spark, path, "v", {"x": 109}).values.tolist() == [1.0] * 6 and gl.read(spark, path, "v", {"x": 200}).values.tolist() == more[0].tolist()


def test_an_uncut_variable_is_written_once(spark, tmp_path):
    a = LabelArray.from_values(spark, np.arange(6.0).reshape(2, 3), [("k", ["a", "b"]), ("t", [10, 20, 30])])
    path = str(tmp_path / "s")
    a.write(path, "w", "v", fill_value=-9.0)
    gl.open_store(spark, path).put("v", {"k": "a", "t": 20}, 5.0)
    assert len(os.listdir(f"{path}/v")) == 2 and gl.read(spark, path, "v").values.tolist() == [[0, 5, 2], [3, 4, 5]]
    gl.open_store(spark, path).vacuum()
    assert len(os.listdir(f"{path}/v")) == 1 and gl.read(spark, path, "v").sum() == 19
