"""Intermediate tables in a folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Names the tables of this process, so that they can be cleared together.
RUN = f"gridloom-arrays-{uuid.uuid4().hex}"


def shared_folder(spark: SparkSession) -> str:
    """Where all executors can write: spark.checkpoint.dir; where it is unset, a folder of this machine, on a local master only."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return root.rstrip("/") if root else f"file://{tempfile.gettempdir()}"


def keep(df: DataFrame, tag: str = "table") -> DataFrame:
    """Cut the lineage: written once and read back, so no lost executor loses it and no row is computed twice."""
    path = f"{shared_folder(df.sparkSession)}/{RUN}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> bool:
    """Delete the tables that this process has kept; arrays made from them can't be read any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/{RUN}")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
