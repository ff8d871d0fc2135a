"""Mixing sources to target weights by entropy balancing.

Each document gets a rate, the mean number of its copies. Of all rates that give each source its
target number of words, the ones nearest to 1 in relative entropy are exponential tilts,
rate = exp(lambda of the source * size / mean size), cut at the most copies allowed. The lambdas
are the solution of the convex dual, found for all sources together by safeguarded Newton steps;
each step is one distributed aggregation. As a rate depends on source and size alone, the sums
run over a table of (source, size, count).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import add_from_column, fresh, materialize, rank_within, spread, table, word_count, words


@dataclass(frozen=True)
class Mix:
    """weights: of the sources by code point, repeating; share: of all words that the mix takes;
    most: a document's most copies; tolerance: relative error of a source's rates; steps: most Newton steps."""

    weights: tuple[float, ...] = (5.0, 2.0, 1.0)
    share: float = 1.5
    most: int = 2
    tolerance: float = 1e-9
    steps: int = 60


def targets(totals: dict[str, int], mix: Mix = Mix()) -> dict[str, float]:
    """The words each source should give; totals: its words, in order of the sources.

    What exceeds the most that a source can give is shared among the others by weight, again and
    again until none exceeds.
    """
    weight = {s: mix.weights[i % len(mix.weights)] for i, s in enumerate(totals)}
    out: dict[str, float] = {}
    open_, left = dict(weight), mix.share * sum(totals.values())
    while open_:
        unit = left / sum(open_.values())
        full = [s for s in open_ if open_[s] * unit > mix.most * totals[s]]
        if not full:
            return out | {s: w * unit for s, w in open_.items()}
        for s in full:
            out[s] = float(mix.most * totals[s])
            left -= out[s]
            del open_[s]
    return out


def solve_rates(cells: DataFrame, goal: dict[str, float], totals: dict[str, int], mix: Mix = Mix()) -> dict[str, float]:
    """The lambda of each source, per word. cells: key, size, n with size above 0, materialized.

    A target of 0 gives -inf and one at the most that the source can give inf. Newton's step is
    taken inside a bracket of the root and halved into it otherwise.
    """
    spark = cells.sparkSession
    lam: dict[str, float] = {}
    low: dict[str, float] = {}
    high: dict[str, float] = {}
    for s, t in goal.items():
        if t <= 0 or totals[s] == 0:
            lam[s] = -math.inf
        elif t >= mix.most * totals[s] * (1 - mix.tolerance):
            lam[s] = math.inf
        else:
            low[s], high[s] = -math.inf, math.log(mix.most)  # at size 1 or more all rates are at most by then
    at = dict.fromkeys(low, 0.0)
    for _ in range(mix.steps):
        if not at:
            break
        now = spark.createDataFrame([(k, v) for k, v in at.items()], "key string, lam double")
        rate = F.least(F.exp(F.col("lam") * F.col("size")), F.lit(float(mix.most)))
        got = cells.join(F.broadcast(now), "key").select("key", (F.col("n") * F.col("size")).cast("double").alias("w"), rate.alias("r"), "size").groupBy("key").agg(
            F.sum(F.col("w") * F.col("r")).alias("have"), F.sum(F.when(F.col("r") < mix.most, F.col("w") * F.col("size") * F.col("r")).otherwise(0.0)).alias("slope"))
        for s, have, slope in got.collect():
            gap = have - goal[s]
            if abs(gap) <= mix.tolerance * goal[s]:
                lam[s] = at.pop(s)
                continue
            low[s], high[s] = (at[s], high[s]) if gap < 0 else (low[s], at[s])
            step = at[s] - gap / slope if slope > 0 else math.inf
            if low[s] == -math.inf:  # no bracket below yet: at most a long way down
                at[s] = max(step, 4 * at[s] - 1e-3) if at[s] <= 0 else (step if step > -math.inf else 0.0)
            else:
                at[s] = step if low[s] < step < high[s] else (low[s] + high[s]) / 2
    return lam | at


def whole_copies(cells: pd.DataFrame, most: int) -> pd.Series:
    """Copies of each cell (size, n, rate) so that their words follow the sum of the rates.

    From the largest size down, each cell also makes up for the words its predecessors gave too
    many or too few, as far as its copies allow; what remains in the end is at most about the
    smallest documents.
    """
    owed, out = 0.0, []
    for size, n, rate in zip(cells["size"], cells["n"], cells["rate"], strict=True):
        owed += float(size) * n * rate
        c = min(max(round(owed / size), 0), most * n)
        owed -= float(size) * c
        out.append(c)
    return pd.Series(out, dtype="int64")


def with_sizes(docs: DataFrame, text: str, drop: tuple[str, ...] = ()) -> DataFrame:
    """Add size, the number of words; 0 for null. Columns in drop are left out."""
    return add_from_column(docs, text, [T.StructField("size", T.LongType())], lambda: lambda texts: {"size": [len(words(t)) for t in texts]}, drop)


def mix_sources(docs: DataFrame, source: str = "source", text: str = "text", by: str = "doc_id", mix: Mix = Mix()) -> DataFrame:
    """mix_sized over the documents' numbers of words, counted natively: the texts stay in the rows, and would go to Python and back."""
    return mix_sized(docs.withColumn("size", word_count(F.col(f"`{text}`"))), source, by, mix)


def mix_sized(docs: DataFrame, source: str = "source", by: str = "doc_id", mix: Mix = Mix()) -> DataFrame:
    """Add source_size, target, copies and taken to each row of docs, which have their size.

    by: the column whose hash decides which documents of one source and size get the extra copies,
    so reruns agree. A null source is a source, the last by order; null and empty texts have size 0
    and no copies. Repeated rows are documents each; an empty table comes back empty. Columns of
    docs named like the new ones are replaced. One row a source is on the driver, and one source's
    distinct sizes meet in a task, never its documents.
    """
    key, row, cell, given = (fresh(docs, x) for x in ("key", "row", "n", "copies"))
    sized = docs.drop("source_size", "target", "copies", "taken").withColumn(key, F.coalesce(F.concat(F.lit("s"), F.col(f"`{source}`").cast("string")), F.lit("")))
    sized = materialize(sized, "sized")
    cells = materialize(sized.groupBy(F.col(key).alias("key"), "size").agg(F.count(F.lit(1)).alias("n")), "cells")
    found = {r.key: int(r.total) for r in cells.groupBy("key").agg(F.sum(F.col("size") * F.col("n")).alias("total")).collect()}
    totals = {s: found[s] for s in sorted(found, key=lambda s: (s == "", s))}
    goal = targets(totals, mix)
    lam = solve_rates(cells.where("size > 0"), goal, totals, mix)
    spark = docs.sparkSession
    of = spark.createDataFrame([(s, totals[s], goal[s], lam[s]) for s in totals] or [], "key string, source_size long, target double, lam double")
    rated = cells.join(F.broadcast(of), "key")
    rate = F.when(F.col("size") == 0, 0.0).when(F.col("lam") == math.inf, float(mix.most)).when(F.col("lam") == -math.inf, 0.0).otherwise(F.least(F.exp(F.col("lam") * F.col("size")), F.lit(float(mix.most))))
    rated = rated.withColumn("rate", rate)
    most = mix.most

    def round_source(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("size", ascending=False).reset_index(drop=True)
        full = pdf["size"] > 0
        pdf["copies"] = 0
        pdf.loc[full, "copies"] = whole_copies(pdf[full].reset_index(drop=True), most).to_numpy()
        return pdf[["key", "size", "n", "source_size", "target", "copies"]]

    plan = rated.select("key", "size", "n", "source_size", "target", "rate").groupBy("key").applyInPandas(round_source, "key string, size long, n long, source_size long, target double, copies long")
    plan = materialize(plan.select(F.col("key").alias(key), "size", F.col("n").alias(cell), "source_size", "target", F.col("copies").alias(given)), "plan")
    ranked = rank_within(sized, [key, "size"], [by], row, plan=plan)
    copies = F.floor(F.col(given) / F.col(cell)) + F.when(F.col(row) < F.col(given) % F.col(cell), 1).otherwise(0)
    out = ranked.withColumn("copies", copies.cast("long"))
    return out.withColumn("taken", F.col("copies") * F.col("size")).drop(key, row, cell, given)


def repeat_copies(mixed: DataFrame) -> DataFrame:
    """As many rows as copies."""
    at = fresh(mixed, "copy")
    return mixed.where(F.col("copies") > 0).withColumn(at, F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).drop(at)


def op3_entropy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = with_sizes(spread(table(spark, sf_dir, "documents").select("doc_id", "source", "text")), "text", ("text",))
    return mix_sized(sized).select("doc_id", "size", "source_size", "target", "taken")
