"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: Small sides are broadcast only up to this many rows; larger ones are joined by shuffling.
BROADCAST_ROWS = 100_000

#: The pattern of a word: what lies between the six ASCII white space characters.
WORD = r"[^\x20\x09-\x0D]+"


def words(text: str | None) -> list[bytes]:
    """The words of a text as UTF-8. ``bytes.split`` cuts at exactly the six characters of WORD."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def word_count(text: Column) -> Column:
    """Number of words, as a native expression; 0 for null."""
    spaced = F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x09-\x0D ]+", " ")
    inner = F.trim(spaced)
    return F.when(inner == "", F.lit(0)).otherwise(F.length(inner) - F.length(F.replace(inner, F.lit(" "), F.lit(""))) + 1).cast("long")


_own_dir: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from ``spark.checkpoint.dir``; where it is unset, as in tests, one of this process.

    Unset on anything but a local master is an error: executors would write to folders of their own.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        if not _own_dir:
            _own_dir.append(f"file://{tempfile.mkdtemp(prefix='gridloom-')}")
        found = _own_dir[0]
    return found.rstrip("/")


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Cut the lineage: write to the shared folder and read back, so that no lost executor can lose it."""
    path = f"{shared_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    tidy(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Share of the driver's largest heap from which materialize has garbage collected.
HEAP_SHARE = 0.5


def tidy(spark: SparkSession) -> None:
    """The driver's JVM collects its garbage if its heap has grown beyond HEAP_SHARE of what it may take.

    Left alone, the heap of a long run grows by steps to its limit, though little of it is in use, while busy
    cores make collections slow; a full collection gives the rest back, and shuffle files that nobody needs go.
    """
    jvm = spark.sparkContext._jvm
    heap = jvm.java.lang.Runtime.getRuntime()
    if heap.totalMemory() > HEAP_SHARE * heap.maxMemory():
        jvm.java.lang.System.gc()


#: Cached functions whose values a worker keeps for the next task of one operator.
held: list = []


def few_rows(batches: Iterable[pa.RecordBatch], most: int = 500, keep: Callable | None = None) -> Iterable[pa.RecordBatch]:
    """The batches in slices, so that few texts are Python objects at a time; in the end freed memory goes back to the system.

    What the worker holds for other operators goes first; keep: the cached function of this one.
    """
    for cached in held:
        if cached is not keep:
            cached.cache_clear()
    for b in batches:
        for i in range(0, b.num_rows, most):
            yield b.slice(i, most)
    give_back()


def give_back() -> None:
    """Memory that this process has freed goes back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Python workers get at most so many rows at a time; a smaller setting of the session stays.

    By default they get 10,000, and executor and worker each hold the texts of a batch in and one out. Plans
    read the setting when they run, so it holds for the rest of the session.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value computed once: a plain column in a lambda would be computed for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def sums_before(numbers: Column, step: int = 512) -> Column:
    """For each of an array of numbers the sum of those before it; sums go by blocks of step. numbers: a column or lambda variable."""
    total = lambda a: F.aggregate(a, F.lit(0), lambda x, y: x + y)
    block = lambda i: F.floor(i / step).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), block(F.size(numbers))), lambda b: total(F.slice(numbers, b * step + 1, F.lit(step))))
    before = let(blocks, lambda sums: F.transform(sums, lambda _, i: total(F.slice(sums, F.lit(1), i))))
    return let(before, lambda t: F.transform(numbers, lambda _, i: F.get(t, block(i)) + total(F.slice(numbers, block(i) * step + 1, i % step))))


def spread(df: DataFrame) -> DataFrame:
    """The rows of a scan, dealt anew if they come in fewer partitions than there are cores, as from one small file."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that df does not have."""
    taken = {c.lower() for c in df.columns}
    name = f"__{stem}"
    while name in taken:
        name = f"_{name}"
    return name


def add_from_column(df: DataFrame, source: str, fields: Sequence[T.StructField], make: Callable[[], Callable[[list], dict[str, list]]], drop: Sequence[str] = ()) -> DataFrame:
    """Append columns computed from one column, batch by batch, in Arrow.

    ``make()`` runs once a task and returns a function from a list of values to a dict of
    lists. Other columns but those in drop pass through untouched. A column of df with the name of a
    new one is replaced. Rows are never regrouped, so there is no shuffle.
    """
    new = [f.name for f in fields]
    gone = {n.lower() for n in (*new, *drop)}
    kept = [c for c in df.columns if c.lower() not in gone]
    hidden = fresh(df, "input")
    own = next((i for i, c in enumerate(kept) if c.lower() == source.lower()), len(kept))
    frame = df.select(*[F.col(f"`{c}`") for c in kept], *[F.col(f"`{source}`").alias(hidden)] * (own == len(kept)))
    schema = T.StructType([frame.schema[c] for c in kept] + list(fields))
    kinds = {f.name: to_arrow_type(f.dataType) for f in fields}

    def run(batches: Iterable[pa.RecordBatch]):
        fn = make()
        for b in few_rows(batches):
            got = fn(b.column(own).to_pylist())
            arrays = [b.column(i) for i in range(len(kept))] + [pa.array(got[n], type=kinds[n]) for n in new]
            yield pa.RecordBatch.from_arrays(arrays, names=[*kept, *new])

    return frame.mapInArrow(run, schema)


def lookup(big: DataFrame, small: DataFrame, on: Sequence[str], how: str = "left", salts: int = 64, spread: Column | None = None) -> DataFrame:
    """Join a frame whose keys may be very uneven with one that has each key once.

    small must be materialized: it is counted, and broadcast up to BROADCAST_ROWS rows. Beyond
    that, its rows are repeated for each salt and the rows of big take a salt each, so that a key
    with a third of all rows meets its partner in ``salts`` tasks.
    """
    if small.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return big.join(F.broadcast(small), list(on), how)
    salt = fresh(big, "salt")
    spread = spread if spread is not None else F.xxhash64(*[F.col(f"`{c}`") for c in big.columns if c not in on])
    left = big.withColumn(salt, F.pmod(spread, F.lit(salts)).cast("int"))
    right = small.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*on, salt], how).drop(salt)


def rank_within(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str, plan: DataFrame | None = None, per_task: int = 20_000) -> DataFrame:
    """Add the rank from 0 of each row within its group, in an order fixed by a hash of ``order``.

    plan: rows with each key once, whose other columns are added too. A group may hold a third of
    all rows, so groups are cut by that hash into sub-groups of about ``per_task`` rows; ranks are
    counted inside the sub-groups and shifted by the sizes of the sub-groups before. The keys must
    not be null. df and plan must be materialized, since they are read again.
    """
    keys = list(keys)
    h, sub, n, parts, base = (fresh(df, x) for x in ("hash", "sub", "n", "parts", "base"))
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias(n)).where(F.col(n) > per_task)
    hot = materialize(sizes.select(*keys, F.ceil(F.col(n) / per_task).cast("int").alias(parts)), "hot")
    hashed = df.withColumn(h, F.xxhash64(*order))
    few = hot.limit(BROADCAST_ROWS + 1).count()
    side = F.broadcast(hot) if few <= BROADCAST_ROWS else hot
    if few:
        cut = hashed.join(side, keys, "left").withColumn(sub, F.when(F.col(parts).isNull(), 0).otherwise(F.pmod(F.col(h), F.col(parts))).cast("int")).drop(parts)
    else:
        cut = hashed.withColumn(sub, F.lit(0))
    before = Window.partitionBy(*keys).orderBy(sub).rowsBetween(Window.unboundedPreceding, -1)
    counted = cut.join(F.broadcast(hot) if few <= BROADCAST_ROWS else hot, keys, "left_semi").groupBy(*keys, sub).agg(F.count(F.lit(1)).alias(n))
    bases = counted.select(*keys, sub, F.coalesce(F.sum(n).over(before), F.lit(0)).alias(base))
    if plan is None:
        plan = hot.select(*keys)
    info = plan.join(side, keys, "left").withColumn(sub, F.explode(F.sequence(F.lit(0), F.coalesce(F.col(parts), F.lit(1)) - 1))).drop(parts)
    info = materialize(info.join(bases, [*keys, sub], "left"), "ranks")
    inner = Window.partitionBy(*keys, sub).orderBy(h, *order)
    ranked = cut.withColumn(name, F.row_number().over(inner).cast("long") - 1)
    out = ranked.join(info, [*keys, sub], "left")
    return out.withColumn(name, F.col(name) + F.coalesce(F.col(base), F.lit(0))).drop(h, sub, base)
