"""The labels of an open axis as a table in order.

An axis with very many labels can't list them on the driver. Its labels are a table of label and
position instead: distinct labels are dealt by range and sorted, and positions follow from the
counts of the ranges before, so no task sees more than a range and the driver sees a count for each.
Positions, slices, unions, intersections and neighbouring labels come from that table by
filters, joins and merges of ranges.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import options
from .scratch import keep

_KINDS = {"boolean": "bool", "bigint": "int", "int": "int", "smallint": "int", "double": "float", "float": "float", "string": "str", "timestamp": "time", "timestamp_ntz": "time", "date": "date"}


def number(rows: DataFrame, order: Sequence[Column | str], pos: str = "pos") -> tuple[DataFrame, int]:
    """Rows with their position in an order, and their number.

    Ranges of the order are numbered on their own and shifted by the rows of the ranges before.
    The order should tell all rows apart.
    """
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt = keep(dealt.withColumn("__at", F.monotonically_increasing_id()), "numbered").withColumn("__part", F.shiftright("__at", 33))
    held = dealt.groupBy("__part").agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__n"))
    sizes = held.orderBy("__part").collect()  # a row for each range
    shifts, total = [], 0
    for r in sizes:
        shifts.append((r["__part"], total - r["__first"]))
        total += r["__n"]
    if not shifts:
        return dealt.withColumn(pos, F.col("__at")).drop("__at", "__part"), 0
    shift = rows.sparkSession.createDataFrame(shifts, "__part bigint, __shift bigint")
    return dealt.join(F.broadcast(shift), "__part").withColumn(pos, F.col("__at") + F.col("__shift")).drop("__at", "__part", "__shift"), total


@dataclass(frozen=True, eq=False)
class Labels:
    """table: pos and label, each label once. way: 1 where labels ascend with pos, -1 where they descend, else 0."""

    table: DataFrame
    size: int
    way: int = 1

    @staticmethod
    def found(cells: DataFrame, name: str) -> Labels:
        """The distinct labels of a column, ascending."""
        rows = cells.select(F.col(f"`{name}`").alias("label")).where("label is not null").distinct()
        table, n = number(rows, ["label"])
        return Labels(table, n)

    @staticmethod
    def listed(spark: SparkSession, labels: Sequence, kind: str, way: int) -> Labels:
        """The labels of an axis that lists them."""
        rows = spark.createDataFrame([(i, x) for i, x in enumerate(labels)], f"pos bigint, label {kind}")
        return Labels(rows, len(labels), way)

    @property
    def sql_type(self) -> str:
        return dict(self.table.dtypes)["label"]

    @property
    def kind(self) -> str:
        return _KINDS.get(self.sql_type, "tuple")

    @cached_property
    def small(self) -> bool:
        return self.size <= options.get_option("axis.broadcast_labels")

    def joined(self, rows: DataFrame, on: str, how: str = "inner") -> DataFrame:
        """rows joined with the table by a column that holds labels; label is called like that column."""
        t = self.table.withColumnRenamed("label", on)
        return rows.join(F.broadcast(t) if self.small else t, on, how)

    # -- lookup -------------------------------------------------------------------------------

    def at(self, positions: Sequence[int]) -> list:
        """Labels of positions, a few."""
        found = dict(self.table.where(F.col("pos").isin(*positions)).select("pos", "label").collect()) if positions else {}
        return [found[p] for p in positions]

    def places(self, labels: Sequence) -> dict:
        """Positions of those of a few labels that are there."""
        return {r.label: r.pos for r in self.table.where(F.col("label").isin(*labels)).collect()} if len(labels) else {}

    def nearest(self, labels: Sequence) -> list[tuple | None]:
        """(position, label) nearest to each of a few labels; of two as near the first by position."""
        if not self.size or not labels:
            return [None] * len(labels)
        gap = lambda x: F.struct(F.abs(F.col("label") - F.lit(x)), "pos")
        got = self.table.agg(*[F.min_by(F.struct("pos", "label"), gap(x)).alias(f"n{i}") for i, x in enumerate(labels)]).first()
        return [tuple(x) for x in got]

    def span(self, low, high) -> tuple[int, int] | None:
        """First and last position of the labels from low to high, both inclusive; None is no bound."""
        cond = F.lit(True)
        for bound, keep_ in ((low, lambda b: F.col("label") >= F.lit(b)), (high, lambda b: F.col("label") <= F.lit(b))):
            cond = cond & keep_(bound) if bound is not None else cond
        first, last = self.table.where(cond).agg(F.min("pos"), F.max("pos")).first()
        return None if first is None else (first, last)

    # -- new tables -----------------------------------------------------------------------------

    def stepped(self, steps: range) -> Labels:
        """The labels at evenly spaced positions, in that order."""
        n = len(steps)
        if not n:
            return Labels(self.table.limit(0), 0, self.way)
        low, high = min(steps[0], steps[-1]), max(steps[0], steps[-1])
        pos = F.expr(f"(pos - {steps.start}) div {steps.step}")
        rows = self.table.where(F.col("pos").between(low, high) & ((F.col("pos") - steps.start) % steps.step == 0))
        return Labels(rows.withColumn("pos", pos), n, self.way if steps.step > 0 else -self.way)

    def kept(self, labels: DataFrame) -> Labels:
        """Those of a table of labels (column label), renumbered in the same order."""
        rows = self.table.join(labels.select("label").distinct(), "label", "left_semi")
        table, n = number(rows.select(F.col("pos").alias("__old"), "label"), ["__old"])
        return Labels(table.drop("__old"), n, self.way)

    def ascending(self) -> Labels:
        if self.way == 1:
            return self
        table, n = number(self.table.select("label"), ["label"])
        return Labels(table, n)

    def union(self, other: Labels) -> Labels:
        """In order if both run the same way; otherwise these labels and then the other's unseen ones."""
        if self is other or not other.size:
            return self
        if not self.size:
            return other
        kind = "double" if {self.kind, other.kind} == {"int", "float"} else "string" if self.kind != other.kind else self.sql_type
        mine, theirs = (x.table.withColumn("label", F.col("label").cast(kind)) for x in (self, other))
        way = self.way or (other.way if self.size == 1 else 0)
        if way and way == (other.way or (way if other.size == 1 else 0)) and (self.kind == other.kind or kind == "double"):
            both = mine.select("label").union(theirs.select("label")).distinct()
            table, n = number(both, ["label" if way > 0 else F.desc("label")])
            return Labels(table, n, way)
        new = theirs.join(mine.select("label"), "label", "left_anti")
        table, n = number(mine.select("label", F.lit(0).alias("__side"), F.col("pos").alias("__old")).unionByName(new.select("label", F.lit(1).alias("__side"), F.col("pos").alias("__old"))), ["__side", "__old"])
        return Labels(table.drop("__side", "__old"), n, 0)

    def intersection(self, other: Labels) -> Labels:
        """These labels that the other has too, in this order."""
        return self if self is other else self.kept(other.table)

    def midpoints(self) -> Labels:
        """The means of each label and the next."""
        after = self.table.select((F.col("pos") - 1).alias("pos"), F.col("label").alias("__next"))
        rows = self.table.join(after, "pos").select("pos", ((F.col("label") + F.col("__next")) / 2).alias("label"))
        return Labels(rows, max(self.size - 1, 0), self.way)

    def same(self, other: Labels) -> bool:
        """Equal labels at equal positions; a job where they are not the same table."""
        if self is other:
            return True
        if self.size != other.size or self.sql_type != other.sql_type:
            return False
        return self.table.select("pos", "label").join(other.table.select("pos", "label"), ["pos", "label"]).count() == self.size

    def neighbours(self, asked: DataFrame) -> DataFrame:
        """asked (pos, label) with before (pos, label of the last label at or before it) and after (the first one after it).

        An as-of join by merging: both tables are dealt by range of label together; each range
        looks back and ahead inside itself, and across its ends at what the ranges beside it begin
        or end with, a row for each range.
        """
        kind = "double" if {self.kind, _KINDS.get(dict(asked.dtypes)["label"], "")} <= {"int", "float"} else self.sql_type
        have = self.table.select(F.col("label").cast(kind).alias("__x"), F.lit(0).alias("__side"), F.struct("pos", "label").alias("own"), F.lit(None).cast("bigint").alias("pos"), F.lit(None).cast(dict(asked.dtypes)["label"]).alias("label"))
        want = asked.select(F.col("label").cast(kind).alias("__x"), F.lit(1).alias("__side"), F.lit(None).cast(have.schema["own"].dataType).alias("own"), "pos", "label")
        dealt = have.unionByName(want).repartitionByRange("__x").sortWithinPartitions("__x", "__side", "pos")
        dealt = keep(dealt.withColumn("__at", F.monotonically_increasing_id()), "merged").withColumn("__part", F.shiftright("__at", 33))
        ends = dealt.groupBy("__part").agg(F.max_by("own", F.when(F.col("own").isNotNull(), F.col("__at"))).alias("__last"), F.min_by("own", F.when(F.col("own").isNotNull(), F.col("__at"))).alias("__first"))
        up, down = Window.orderBy("__part"), Window.orderBy(F.desc("__part"))  # over a row for each range
        earlier = F.last("__last", True).over(up.rowsBetween(Window.unboundedPreceding, -1))
        later = F.last("__first", True).over(down.rowsBetween(Window.unboundedPreceding, -1))
        ends = ends.select("__part", earlier.alias("__earlier"), later.alias("__later"))
        within = Window.partitionBy("__part")
        seen = F.last("own", True).over(within.orderBy("__at").rowsBetween(Window.unboundedPreceding, 0))
        ahead = F.last("own", True).over(within.orderBy(F.desc("__at")).rowsBetween(Window.unboundedPreceding, 0))
        met = dealt.withColumns({"__seen": seen, "__ahead": ahead}).where("__side = 1").join(F.broadcast(ends), "__part")
        return met.select("pos", "label", F.coalesce("__seen", "__earlier").alias("before"), F.coalesce("__ahead", "__later").alias("after"))
