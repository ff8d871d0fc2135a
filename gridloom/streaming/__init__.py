"""Arrays from streams: an extension, with the reductions that can be kept up to date."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPS = {"sum": F.sum, "mean": F.avg, "min": F.min, "max": F.max, "count": F.count}


def running_reduction(stream: DataFrame, dims: Sequence[str], value: str, op: str, time: str | None = None, late: str = "1 hour") -> DataFrame:
    """A streaming frame of dims and value, reduced over everything else; write it in update or complete mode.

    With time, the watermark bounds the state: dims should then hold a window of time.
    """
    src = stream.withWatermark(time, late) if time else stream
    return src.groupBy(*dims).agg(OPS[op](value).alias("value"))
