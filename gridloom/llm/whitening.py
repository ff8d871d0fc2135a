"""Whitening of embeddings by a tall-skinny QR.

Vectors become whole numbers x = floor(256 c). The distinct ones are the fit list; their sums per
dimension are exact, rows are centred with them, each partition is reduced to a triangular factor
batch by batch, the factors are merged in a tree, and the singular values and right vectors of
the last factor whiten. No covariance is formed on the way, so no digits are lost by squaring.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import fresh, materialize, table

#: Factors that one task of the tree merges.
FAN_IN = 16

#: Numbers up to this size are subtracted as 64-bit integers, larger ones as Python's.
SAFE = 1 << 62


def usable(vec: Column) -> Column:
    """True for vectors without null or non-finite entries."""
    v = vec.cast("array<double>")
    return F.coalesce(~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(False))


def scaled(vec: Column) -> Column:
    """floor(256 c) of each entry as long; beyond a long, its bound."""
    return F.transform(vec.cast("array<double>"), lambda x: F.when(F.abs(x) < 2.0**54, F.floor(x * 256.0)).when(x > 0, F.lit((1 << 63) - 1)).otherwise(F.lit(-(1 << 63))).cast("long"))


@dataclass(frozen=True)
class Fit:
    """What whitens vectors of one length: at most d x d numbers, whatever the rows."""

    n: int
    sums: list[int]
    values: np.ndarray  # eigenvalues, falling, the positive ones
    vectors: np.ndarray  # d x components, unit columns
    explained: np.ndarray

    def shifted(self, x: np.ndarray) -> np.ndarray:
        """n x - S, exact."""
        reach = max(int(x.max(initial=0)), -int(x.min(initial=0))) * self.n + max(map(abs, self.sums), default=0)
        if reach < SAFE:
            return x * self.n - np.array(self.sums, dtype=np.int64)
        return x.astype(object) * self.n - np.array(self.sums, dtype=object)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (self.shifted(x) / self.n).astype(np.float64)

    def whiten(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.vectors / np.sqrt(self.values)

    def deviation(self, x: np.ndarray) -> list[Decimal | None]:
        """Sums of squares of n x - S, exact; null beyond 38 digits."""
        s = self.shifted(x)
        if s.dtype != object and (not s.size or float(np.abs(s).max()) ** 2 * s.shape[1] < SAFE):
            return [Decimal(v) for v in np.einsum("ij,ij->i", s, s).tolist()]
        sums = [sum(int(v) ** 2 for v in row) for row in s]
        return [Decimal(v) if v < 10**38 else None for v in sums]


def matrices(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix) of each length of list among a batch of lists without nulls."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    starts = np.cumsum(sizes) - sizes
    for d in np.unique(sizes):
        rows = np.flatnonzero(sizes == d)
        yield rows, flat[(starts[rows][:, None] + np.arange(d)[None, :]).ravel()].reshape(len(rows), d)


def triangle(*blocks: np.ndarray) -> np.ndarray:
    """The R factor of blocks stacked; of d columns at most d rows."""
    return np.linalg.qr(np.vstack(blocks), mode="r")


PART = T.StructType([T.StructField("d", T.IntegerType()), T.StructField("node", T.LongType()), T.StructField("state", T.ArrayType(T.DoubleType()))])


def reduced(vectors: DataFrame, start: Callable[[int], np.ndarray], step: Callable[[int, np.ndarray, np.ndarray], np.ndarray], merge: Callable[[int, list[np.ndarray]], np.ndarray]) -> dict[int, np.ndarray]:
    """One small array for each length of vector: partitions are folded batch by batch, then merged in a tree.

    vectors has one column x, arrays of long. What is folded does not grow with the rows, and at
    most FAN_IN of them meet in a task; the driver gets the last one of each length.
    """

    def fold(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states: dict[int, np.ndarray] = {}
        for b in batches:
            for _, m in matrices(b.column(0)):
                d = m.shape[1]
                states[d] = step(d, states[d] if d in states else start(d), m)
        node = TaskContext.get().partitionId()
        rows = [{"d": d, "node": node, "state": s.ravel().tolist()} for d, s in states.items()]
        yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("d", pa.int32()), ("node", pa.int64()), ("state", pa.list_(pa.float64()))]))

    def join(part):
        d = int(part["d"].iloc[0])
        ordered = part.sort_values("node")
        got = merge(d, [np.asarray(s) for s in ordered["state"]])
        return ordered.head(1)[["d", "node"]].assign(node=lambda p: p["node"] // FAN_IN, state=[got.ravel().tolist()])

    parts = materialize(vectors.mapInArrow(fold, PART), "factors")
    last = parts.agg(F.max("node")).first()[0]
    while last:
        parts = parts.groupBy("d", F.floor(F.col("node") / FAN_IN).alias("up")).applyInPandas(join, PART)
        last //= FAN_IN
    return {r.d: np.asarray(r.state) for r in parts.collect()}


def fit_whitening(x: DataFrame, components: int) -> tuple[dict[int, Fit], dict[int, float]]:
    """The fits of each length among distinct vectors x, materialized, and the identity errors of whitened."""
    size = F.size("x")
    sums = x.select(size.alias("d"), F.posexplode("x")).groupBy("d", "pos").agg(F.sum(F.col("col").cast("decimal(38,0)")).alias("s"), F.count(F.lit(1)).alias("n"))
    exact: dict[int, list[int]] = {}
    counts: dict[int, int] = {}
    for r in sums.orderBy("d", "pos").collect():
        exact.setdefault(r.d, []).append(int(r.s))
        counts[r.d] = r.n
    bare = {d: Fit(counts[d], s, np.zeros(0), np.zeros((d, 0)), np.zeros(0)) for d, s in exact.items()}
    nonempty = x.where(size > 0)
    factors = reduced(nonempty, lambda d: np.zeros((0, d)), lambda d, r, m: triangle(r, bare[d].centred(m)), lambda d, rs: triangle(*[r.reshape(-1, d) for r in rs]))
    fits = {}
    for d, r in factors.items():
        _, s, vt = np.linalg.svd(r.reshape(-1, d), full_matrices=False)
        values = s**2 / counts[d]
        rank = int((s > s[0] * max(counts[d], d) ** 0.5 * d * np.finfo(float).eps).sum()) if s.size and s[0] > 0 else 0
        k = min(components, rank)
        signs = np.sign(vt[np.arange(k), np.abs(vt[:k]).argmax(axis=1)]) if k else np.zeros(0)
        fits[d] = Fit(counts[d], exact[d], values[:k], (vt[:k] * signs[:, None]).T, values[:k] / values.sum() if k else np.zeros(0))

    def moments(z: np.ndarray) -> np.ndarray:
        mean = z.mean(axis=0)
        return np.concatenate([[len(z)], mean, ((z - mean).T @ (z - mean)).ravel()])

    def together(d: int, states: list[np.ndarray]) -> np.ndarray:
        """Counts, means and centred products of several parts: means first, then each part's products about the common mean."""
        k = fits[d].vectors.shape[1]
        states = [s for s in states if s[0] > 0]
        n = sum(s[0] for s in states)
        mean = sum(s[0] * s[1 : k + 1] for s in states) / n
        products = sum(s[k + 1 :].reshape(k, k) + s[0] * np.outer(s[1 : k + 1] - mean, s[1 : k + 1] - mean) for s in states)
        return np.concatenate([[n], mean, products.ravel()])

    done = reduced(nonempty, lambda d: np.zeros(1), lambda d, s, m: together(d, [s, moments(fits[d].whiten(m))]), together)
    errors = {}
    for d, s in done.items():
        k = fits[d].vectors.shape[1]
        errors[d] = float(np.abs(s[k + 1 :].reshape(k, k) / s[0] - np.eye(k)).max(initial=0.0))
    return fits, errors


def whiten(vectors: DataFrame, vec: str = "embedding", components: int = 4) -> DataFrame:
    """Add n, deviation (decimal), whitened, explained (arrays) and identity_error to the rows with a usable vector.

    Rows whose vector is null or holds null or non-finite entries go; repeated rows each come
    back, but count once in the fit. Vectors of each length are a fit of their own, empty ones have
    no component. Components without variance (a fit of one vector, or dimensions that depend on
    others) have no whitened value: the arrays end before them. Entries beyond a long count as its
    bound; a deviation of more than 38 digits is null. Columns of vectors with the names of new
    ones are replaced, others pass through. An empty table stays empty.
    """
    new = [("n", T.LongType()), ("deviation", T.DecimalType(38, 0)), ("whitened", T.ArrayType(T.DoubleType())), ("explained", T.ArrayType(T.DoubleType())), ("identity_error", T.DoubleType())]
    names = {n for n, _ in new}
    kept = [c for c in vectors.columns if c.lower() not in names]
    hidden = fresh(vectors, "x")
    good = vectors.where(usable(F.col(f"`{vec}`"))).select(*[F.col(f"`{c}`") for c in kept], scaled(F.col(f"`{vec}`")).alias(hidden))
    fits, errors = fit_whitening(materialize(good.select(F.col(hidden).alias("x")).distinct(), "distinct"), components)
    schema = T.StructType([good.schema[c] for c in kept] + [T.StructField(n, t) for n, t in new])
    kinds = [pa.int64(), pa.decimal128(38, 0), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.float64()]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got: list[list] = [[None] * b.num_rows for _ in new]
            for rows, m in matrices(b.column(len(kept))):
                fit = fits.get(m.shape[1])
                z = fit.whiten(m).tolist() if fit else [[]] * len(rows)
                deviation = fit.deviation(m) if fit else [Decimal(0)] * len(rows)
                for i, row in enumerate(rows.tolist()):
                    values = (fit.n if fit else 1, deviation[i], z[i], fit.explained.tolist() if fit else [], errors.get(m.shape[1], 0.0))
                    for column, v in zip(got, values, strict=True):
                        column[row] = v
            yield pa.RecordBatch.from_arrays([*b.columns[: len(kept)], *[pa.array(v, type=t) for v, t in zip(got, kinds, strict=True)]], names=schema.names)

    return good.mapInArrow(run, schema)


def op13_tsqr_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each usable vector and component; a deviation beyond a long is null."""
    got = whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    each = got.select("vec_id", "n", F.col("deviation").try_cast("long").alias("deviation"), "explained", "identity_error", F.posexplode("whitened").alias("at", "whitened"))
    return each.select("vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", "whitened", F.get("explained", F.col("at")).alias("explained"), "identity_error")
