"""Connected components by repeated contraction."""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ._common import BROADCAST_ROWS, few_rows, materialize

#: Up to so many edges are joined in one task; more are contracted by rounds until they are as few.
FEW_EDGES = BROADCAST_ROWS


def _smallest(edges: DataFrame) -> DataFrame:
    """node, component of FEW_EDGES edges at most, each with u < v, by one task."""
    kind = edges.schema["u"].dataType

    def run(batches: Iterable[pa.RecordBatch]):
        up: dict = {}

        def top(x):
            while (above := up.setdefault(x, x)) != x:
                up[x] = x = up[above]
            return x

        for b in few_rows(batches):
            for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                low, high = sorted((top(u), top(v)))
                up[high] = low
        nodes = list(up)
        arrow = to_arrow_type(kind)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, arrow), pa.array([top(x) for x in nodes], arrow)], names=["node", "component"])

    return edges.select("u", "v").coalesce(1).mapInArrow(run, f"node {kind.simpleString()}, component {kind.simpleString()}")


def components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) of all nodes of the edges (u, v), materialized.

    Each round maps every node to the smallest node among itself and its neighbours and contracts
    the edges by that map, which at least halves the nodes of each component; the rounds are as
    many as the logarithm of the largest component. A node with very many edges is an aggregate
    with map-side sums and one side of a join, never a collected list. What is left goes to one task
    as soon as it is FEW_EDGES edges at most: rounds over so few are all jobs and tasks, which the driver
    has to keep account of.
    """
    now = materialize(edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "edges")
    maps: list[DataFrame] = []
    while now.count() > FEW_EDGES:
        both = now.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e"))
        low = both.groupBy(F.col("e.u").alias("node")).agg(F.least(F.min("e.v"), F.first("e.u")).alias("to"))
        low = materialize(low, "map")
        maps.append(low)
        ends = now.join(low.withColumnRenamed("node", "u").withColumnRenamed("to", "pu"), "u").join(low.withColumnRenamed("node", "v").withColumnRenamed("to", "pv"), "v")
        now = materialize(ends.where("pu <> pv").select(F.least("pu", "pv").alias("u"), F.greatest("pu", "pv").alias("v")).distinct(), "edges")
    out = materialize(_smallest(now), "components")
    for m in reversed(maps):
        later = out.select(F.col("node").alias("to"), F.col("component").alias("last"))
        out = m.join(later, "to", "left").select("node", F.coalesce("last", "to").alias("component"))
    return materialize(out, "components") if maps else out
