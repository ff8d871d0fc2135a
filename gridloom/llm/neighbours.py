"""Approximate nearest neighbours by inner product over several Hilbert orders.

Each curve projects the vectors onto a few of the axes of a random rotation, puts the projections
on a grid and orders the cells along a Hilbert curve. The order of each curve is cut by key quantiles
into blocks, and blocks into runs; Spark deals the runs by range and sorts them, each with copies of
the blocks next to it. In a run, a query meets the rows of the blocks around its own; what all
curves find is merged and reranked on the original vectors. How far the windows reach is fitted to
the data: for a bounded sample of queries the true neighbours are found by a scan, and the windows
are made wide enough to hold the wanted share of them.

Along the curves travel 8-bit codes of the rows. Their error is bounded, and a pair is dropped only
if even so it can't be among the best.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import lookup, materialize, table


@dataclass(frozen=True)
class Curves:
    """curves: number of orders; axes: projections of each; bits: of the grid for each axis;
    fit_rows: most vectors to which grid and block bounds are fitted; fit_queries: most queries whose
    true neighbours fit the windows; recall: share of them that the windows must hold; bar_rows: most
    vectors (but a sixteenth of all at most), with which each query is compared first to know what score it needs;
    block_rows: most rows of a block; run: blocks of a run, whose rows a task holds at a time."""

    curves: int = 64
    axes: int = 8
    bits: int = 3
    fit_rows: int = 20_000
    fit_queries: int = 128
    recall: float = 0.9
    bar_rows: int = 2048
    block_rows: int = 4_000
    run: int = 32
    seed: int = 7


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of the rows of cells (n, axes), by Skilling's transform."""
    x = [cells[:, i].astype(np.int64) for i in range(cells.shape[1])]
    d, q = len(x), 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(d):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ swap)
            x[i] = x[i] ^ swap
        q >>= 1
    for i in range(1, d):
        x[i] = x[i] ^ x[i - 1]
    t, q = np.zeros_like(x[0]), 1 << (bits - 1)
    while q > 1:
        t = np.where((x[d - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    key = np.zeros_like(t)
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            key = key << 1 | ((x[i] ^ t) >> b & 1)
    return key


class Grid:
    """Rotations and grid bounds, fitted to sample rows; keys() gives a row's place on each curve."""

    def __init__(self, sample: np.ndarray, how: Curves):
        dim, rng = sample.shape[1], np.random.default_rng(how.seed)
        axes = min(how.axes, dim)
        per = dim // axes
        turns = [np.linalg.qr(rng.normal(size=(dim, dim)))[0] for _ in range(ceil(how.curves / per))]
        self.how, self.axes = how, [turns[c // per][:, c % per * axes : c % per * axes + axes] for c in range(how.curves)]
        at = np.linspace(0, 1, 257)[1:-1]
        self.bounds = [np.quantile(sample @ a, at, axis=0) for a in self.axes]

    def keys(self, rows: np.ndarray) -> np.ndarray:
        out = np.empty((len(rows), len(self.axes)), np.int64)
        span = (1 << self.how.bits) - 1
        for c, (a, bounds) in enumerate(zip(self.axes, self.bounds, strict=True)):
            y = rows @ a
            steps = np.linspace(0, span, len(bounds))
            cells = np.stack([np.interp(y[:, i], bounds[:, i], steps) for i in range(y.shape[1])], 1).astype(np.int64) if len(rows) else np.zeros((0, y.shape[1]), np.int64)
            out[:, c] = hilbert_keys(cells, self.how.bits)
        return out


def _matrix(column: pd.Series, dim: int) -> np.ndarray:
    return np.array(column.tolist(), dtype=np.float64).reshape(-1, dim)


def _best(scores: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k best scores, in no order."""
    return np.argpartition(-scores, k - 1)[:k] if len(scores) > k else np.arange(len(scores))


def _valid(rows: DataFrame, id_col: str, vector: str) -> DataFrame:
    kind = "array<float>" if rows.schema[vector].dataType.simpleString() == "array<float>" else "array<double>"
    v = rows.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vector}`").cast(kind).alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull())
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.where(F.coalesce(fine, F.lit(False)) & F.exists("v", lambda x: x != 0)).select("id", "v", F.xxhash64("v").alias("a"), F.xxhash64(F.lit(1), "v").alias("b"))


def inner_product(x: str, y: str) -> Column:
    """In double precision, whatever the type of the components."""
    return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, p: s + p)


def nearest(rows: DataFrame, is_query: Callable[[Column], Column], id_col: str = "vec_id", vector: str = "embedding", k: int = 20, how: Curves = Curves()) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of up to k nearest rows of each query row.

    is_query: a function from the id column, of any type with an order, to a boolean column. Rows with a null id, and vectors
    that are null, zero, or hold null or non-finite components, take no part. Vectors of each length
    are searched among themselves, one length after the other. Equal vectors are handled once, with
    their k + 1 smallest ids, so a vector that a third of the rows share costs no more than another.
    Repeated rows count once; where an id stands on several vectors, each of them is a query and a
    candidate of that id, a query's list holds all of them by rank, and no row of its own id. Ties go to
    the smaller id. An empty table gives no rows; other columns are not used.
    """
    valid = materialize(_valid(rows, id_col, vector), "vectors")
    kind = rows.schema[id_col].dataType.simpleString()
    out = rows.sparkSession.createDataFrame([], f"query_id {kind}, rank int, vec_id {kind}, score double")
    for r in valid.select(F.size("v").alias("n")).distinct().orderBy("n").collect():
        out = out.unionByName(_nearest(valid.where(F.size("v") == r.n), is_query, r.n, k, how))
    return out


def _nearest(valid: DataFrame, is_query: Callable[[Column], Column], dim: int, k: int, how: Curves) -> DataFrame:
    """nearest for vectors of one length: id, v, and the hash a, b of v."""
    spark = valid.sparkSession
    ranked = valid.withColumn("r", F.dense_rank().over(Window.partitionBy("a", "b").orderBy("id"))).where(F.col("r") <= k + 1)
    points = materialize(ranked.groupBy("a", "b").agg(F.first("v").alias("v"), F.array_sort(F.collect_set("id")).alias("ids")), "points")
    queries = materialize(valid.where(is_query(F.col("id"))).select("id", "a", "b").distinct(), "queries")
    asked = materialize(points.join(queries.select("a", "b").distinct(), ["a", "b"], "left_semi").select("a", "b", "v"), "asked")
    n = points.count()
    some = points.orderBy(F.xxhash64("a", "b")).limit(how.fit_rows).select("a", "b", "v").toPandas()
    sample = _matrix(some["v"], dim)
    grid = Grid(sample, how)
    sample_keys = np.sort(grid.keys(sample), axis=0)
    width = max(1, ceil(_window(points, asked, grid, sample_keys, dim, k, how) * n))
    size = min(how.block_rows, max(4, ceil(width / 2)))
    blocks, reach, run = max(1, n // size), ceil(width / size), how.run
    at = np.clip((np.arange(1, blocks) / blocks * len(sample_keys)).astype(int), 0, len(sample_keys) - 1)
    bounds = [sample_keys[at, c] for c in range(how.curves)]
    first = min(how.bar_rows, max(2 * (k + 1), n // 16))
    shared = spark.sparkContext.broadcast((grid, bounds, sample[:first], some["a"].to_numpy()[:first], some["b"].to_numpy()[:first]))

    def begin(batches: Iterable[pd.DataFrame]):
        """The pairs of each query with the best of the sample, which make its list full."""
        y, a, b = shared.value[2:]
        for pdf in batches:
            for s, qa, qb in zip(_matrix(pdf["v"], dim) @ y.T, pdf["a"], pdf["b"], strict=True):
                i = _best(s, k + 1)
                yield pd.DataFrame({"qa": qa, "qb": qb, "a": a[i], "b": b[i], "lo": s[i], "hi": s[i]})

    def placed(batches: Iterable[pd.DataFrame], side: int):
        """Rows (side 0) as codes in their run and in the runs within reach; queries (side 1) in their run alone."""
        grid, bounds, some = shared.value[:3]
        for pdf in batches:
            if not len(pdf):
                continue
            x = _matrix(pdf["v"], dim)
            keys = grid.keys(x)
            if side:
                top = x @ some.T
                bar = np.partition(top, len(some) - k - 1, axis=1)[:, len(some) - k - 1] if len(some) > k else np.full(len(x), -np.inf)
                code, scale = [v.tobytes() for v in x], bar
            else:
                scale = np.abs(x).max(axis=1) / 127
                code = [v.tobytes() for v in np.round(x / scale[:, None]).astype(np.int8)]
            base = pdf[["a", "b"]].assign(code=code, scale=scale, side=side)
            for c, edge in enumerate(bounds):
                low, high = np.searchsorted(edge, keys[:, c], "left"), np.searchsorted(edge, keys[:, c], "right")
                block = low + pdf["a"].to_numpy() % (high - low + 1)  # a key over several blocks is dealt among them
                out = base.assign(curve=c, run=block // run, block=block)
                yield out
                if not side:  # copies for the windows that begin or end in the next runs
                    for k_ in range(1, ceil(reach / run) + 1):
                        for there, near in ((block // run - k_, block - reach <= (block // run - k_) * run + run - 1), (block // run + k_, block + reach >= (block // run + k_) * run)):
                            near &= (there >= 0) & (there <= (blocks - 1) // run)
                            if near.any():
                                yield out[near].assign(run=there[near])

    schema = "a long, b long, code binary, scale double, side int, curve int, run long, block long"
    both = points.select("a", "b", "v").mapInPandas(lambda it: placed(it, 0), schema).union(asked.mapInPandas(lambda it: placed(it, 1), schema))
    dealt = both.repartitionByRange("curve", "run").sortWithinPartitions("curve", "run", "side", "block")

    def meet(batches: Iterable[pa.RecordBatch]):
        """Pairs of a query and a row of its window that may be among the best: lowest and highest score that they can have."""
        now, rows_, y, edge = None, [], None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            group = np.stack([batch.column(i).to_numpy() for i in (5, 6)], 1)
            side, block = batch.column(4).to_numpy(), batch.column(7).to_numpy()
            cuts = np.flatnonzero(np.any(group[1:] != group[:-1], axis=1) | (side[1:] != side[:-1]) | ((block[1:] != block[:-1]) & (side[1:] == 1))) + 1
            out = []
            for lo, hi in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
                if now != (key := tuple(group[lo])):
                    now, rows_, y = key, [], None
                part = batch.slice(lo, hi - lo)
                if not side[lo]:
                    rows_.append(part)
                    continue
                if y is None and rows_:
                    held = pa.Table.from_batches(rows_)
                    ya, yb, scale, at = (held.column(i).to_numpy() for i in (0, 1, 3, 7))
                    y, edge = np.frombuffer(b"".join(held.column(2).to_pylist()), np.int8).reshape(-1, dim) * scale[:, None], at
                if y is None:
                    continue
                s, e = np.searchsorted(edge, block[lo] - reach, "left"), np.searchsorted(edge, block[lo] + reach, "right")
                x = np.frombuffer(b"".join(part.column(2).to_pylist()), np.float64).reshape(-1, dim)
                about, error = x @ y[s:e].T, np.outer(np.abs(x).sum(axis=1), scale[s:e]) * 0.500001
                least, most = about - error, about + error
                bar = part.column(3).to_numpy()
                if e - s > 8 * k:
                    bar = np.maximum(bar, np.partition(least, e - s - k - 1, axis=1)[:, e - s - k - 1])
                q, r = np.nonzero(most >= bar[:, None])
                out.append((part.column(0).to_numpy()[q], part.column(1).to_numpy()[q], ya[s:e][r], yb[s:e][r], least[q, r], most[q, r]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["qa", "qb", "a", "b", "lo", "hi"])

    pair = "qa long, qb long, a long, b long, lo double, hi double"
    found = dealt.mapInArrow(meet, pair).union(asked.mapInPandas(begin, pair)).groupBy("qa", "qb", "a", "b").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    need = F.nth_value("lo", k + 1).over(Window.partitionBy("qa", "qb").orderBy(F.desc("lo")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    found = found.withColumn("need", need).where(F.col("hi") >= F.coalesce("need", F.lit(float("-inf")))).select("qa", "qb", "a", "b")
    there = found.join(points, ["a", "b"]).select("qa", "qb", "v", "ids").join(asked.select(F.col("a").alias("qa"), F.col("b").alias("qb"), F.col("v").alias("q")), ["qa", "qb"])
    named = there.select("qa", "qb", inner_product("q", "v").alias("score"), F.explode("ids").alias("vec_id"))
    top = named.withColumn("r", F.row_number().over(Window.partitionBy("qa", "qb").orderBy(F.desc("score"), "vec_id"))).where(F.col("r") <= k + 1)
    lists = materialize(top.groupBy(F.col("qa").alias("a"), F.col("qb").alias("b")).agg(F.array_sort(F.collect_list(F.struct("r", "vec_id", "score"))).alias("near")), "near")
    own = lookup(queries, lists, ["a", "b"], "inner", spread=F.xxhash64("id"))
    others = own.select(F.col("id").alias("query_id"), F.explode(F.filter("near", lambda x: x.vec_id != F.col("id"))).alias("x")).select("query_id", "x.vec_id", "x.score").distinct()
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return others.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _window(points: DataFrame, asked: DataFrame, grid: Grid, sample_keys: np.ndarray, dim: int, k: int, how: Curves) -> float:
    """Half the width of the windows, as a share of all rows."""
    few = asked.orderBy(F.xxhash64(F.lit(2), "a", "b")).limit(how.fit_queries).select("v").toPandas()
    if few.empty:
        return 0.0
    q = _matrix(few["v"], dim)

    def scan(batches: Iterable[pd.DataFrame]):
        for pdf in batches:
            if len(pdf):
                y = _matrix(pdf["v"], dim)
                for i, s in enumerate(q @ y.T):
                    b = _best(s, k + 1)
                    yield pd.DataFrame({"q": i, "score": s[b], "v": [pdf["v"].iloc[x] for x in b]})

    best = Window.partitionBy("q").orderBy(F.desc("score"))
    true = points.select("v").mapInPandas(scan, f"q int, score double, v {points.schema['v'].dataType.simpleString()}").withColumn("r", F.row_number().over(best)).where(F.col("r").between(2, k + 1)).toPandas()
    if true.empty:
        return 0.0
    mine, theirs = grid.keys(q)[true["q"].to_numpy()], grid.keys(_matrix(true["v"], dim))
    gaps = [np.abs(np.searchsorted(s, theirs[:, c]) - np.searchsorted(s, mine[:, c])) for c, s in enumerate(sample_keys.T)]
    return float(np.quantile(np.min(gaps, axis=0), how.recall)) / len(sample_keys)


def op8_hilbert_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), lambda i: i % 20 == 0)
