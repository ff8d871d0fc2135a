"""Exact order statistics of groups that no task could hold, and of windows that slide.

For large groups ranks are narrowed for all of them at once: in each round one aggregation
sketches, for every rank asked of every group, the values that bound it, and one more counts what lies
below, between and on the bounds. A round leaves a few hundredths of a group, so two or three do;
what is left is sorted. Nothing but counts and bounds is shuffled, and every answer is a value of the
group, so the result does not depend on the sketch.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import keep

#: Points of a sketch; a rank is bounded by the points around it.
GRID = 200


def _by(frame: DataFrame, others: DataFrame, keys: list[str], small: bool = True) -> DataFrame:
    others = F.broadcast(others) if small else others
    return frame.join(others, keys) if keys else frame.crossJoin(others)  # without keys: the few ranks of the one group


def ranked(values: DataFrame, keys: list[str], asked: DataFrame, most: int) -> DataFrame:
    """keys, rank and the value of each asked rank (keys, rank, n; ranks from 0 of n values).

    values: keys and value, materialized, without nulls. asked holds some ranks a group, and no more than
    a broadcast for groups of more than ``most`` values each.
    """
    none = F.lit(None).cast("double")
    state = keep(asked.select(*keys, "rank", "n", F.lit(0).cast("bigint").alias("base"), none.alias("low"), none.alias("high"), none.alias("answer")), "ranks")
    grid = [i / GRID for i in range(GRID + 1)]
    while True:
        open_ = state.where((F.col("n") > most) & F.col("answer").isNull())
        if open_.isEmpty():
            break
        bounds = open_.select(*keys, "rank", "n", "base", "low", "high")
        inside = _by(values, bounds, keys).where((F.col("low").isNull() | (F.col("value") > F.col("low"))) & (F.col("high").isNull() | (F.col("value") < F.col("high"))))
        sketch = inside.groupBy(*keys, "rank").agg(F.percentile_approx("value", grid, 10_000).alias("points"))
        at = F.floor((F.col("rank") - F.col("base")) / F.greatest(F.col("n") - 1, F.lit(1)) * GRID).cast("int")
        ends = sketch.join(F.broadcast(bounds), [*keys, "rank"]).select(*keys, "rank", "n", "base", "low", "high", F.get("points", F.greatest(at - 1, F.lit(0))).alias("from"), F.get("points", F.least(at + 2, F.lit(GRID))).alias("to"))
        ends = keep(ends, "bounds")
        v = F.col("value")
        seen = _by(values, ends, keys).where((F.col("low").isNull() | (v > F.col("low"))) & (F.col("high").isNull() | (v < F.col("high"))))
        c = seen.groupBy(*keys, "rank").agg(
            F.count_if(v < F.col("from")).alias("below"), F.count_if(v == F.col("from")).alias("on_from"), F.count_if((v > F.col("from")) & (v < F.col("to"))).alias("between"),
            F.count_if((v == F.col("to")) & (F.col("to") > F.col("from"))).alias("on_to"))
        c = c.join(F.broadcast(ends), [*keys, "rank"])
        where = F.col("rank") - F.col("base")
        first = F.col("below") + F.col("on_from")
        second = first + F.col("between")
        third = second + F.col("on_to")
        step = c.select(
            *keys, "rank",
            F.when(where < F.col("below"), F.col("below")).when(where < first, F.lit(1)).when(where < second, F.col("between")).when(where < third, F.lit(1)).otherwise(F.col("n") - third).alias("n"),
            (F.col("base") + F.when(where < first, F.lit(0)).when(where < third, first).otherwise(third)).alias("base"),
            F.when(where < F.col("below"), F.col("low")).when(where < second, F.col("from")).otherwise(F.col("to")).alias("low"),
            F.when(where < F.col("below"), F.col("from")).when(where < second, F.col("to")).otherwise(F.col("high")).alias("high"),
            F.when((where >= F.col("below")) & (where < first), F.col("from")).when((where >= second) & (where < third), F.col("to")).alias("answer"),
        )
        done = state.where((F.col("n") <= most) | F.col("answer").isNotNull())
        state = keep(done.unionByName(step), "ranks")
    rest = state.where("answer is null").select(*keys, "rank", "base", "low", "high")
    left = _by(values, rest, keys).where((F.col("low").isNull() | (F.col("value") > F.col("low"))) & (F.col("high").isNull() | (F.col("value") < F.col("high"))))
    sorted_ = left.groupBy(*keys, "rank").agg(F.array_sort(F.collect_list("value")).alias("v"), F.first("base").alias("base"))
    last = sorted_.select(*keys, "rank", F.get("v", (F.col("rank") - F.col("base")).cast("int")).alias("value"))
    return state.where("answer is not null").select(*keys, "rank", F.col("answer").alias("value")).unionByName(last)


def percentiles(cells: DataFrame, keys: list[str], shares: Sequence[float], most: int) -> DataFrame:
    """keys, count, and value: an array of percentiles with linear interpolation, of the values that are not missing.

    Groups of up to ``most`` values are aggregated as usual; larger ones, of which there are few, by narrowing.
    """
    if any(not k.startswith("__key") for k in keys):  # dimensions may be called like the columns used here
        own = [f"__key{i}" for i in range(len(keys))]
        got = percentiles(cells.select(*[F.col(f"`{k}`").alias(o) for k, o in zip(keys, own, strict=True)], "value"), own, shares, most)
        return got.withColumnsRenamed(dict(zip(own, keys, strict=True)))
    values = keep(cells.where("value is not null").select(*keys, F.col("value").cast("double").alias("value")), "values")
    sizes = keep(values.groupBy(*keys).agg(F.count(F.lit(1)).alias("count")), "sizes")
    large = sizes.where(F.col("count") > most)
    spread = F.array(*[F.lit(float(s)) for s in shares])
    if not keys:
        small = values.groupBy().agg(F.count(F.lit(1)).alias("count"), F.percentile("value", spread).alias("value")) if large.isEmpty() else None
    else:
        small = values.join(F.broadcast(large.select(*keys)), keys, "left_anti").groupBy(*keys).agg(F.count(F.lit(1)).alias("count"), F.percentile("value", spread).alias("value"))
    if small is not None and large.isEmpty():
        return small
    places = F.transform(spread, lambda s: s * (F.col("count") - 1))
    ranks = F.array_distinct(F.flatten(F.transform(places, lambda p: F.array(F.floor(p), F.ceil(p)))))
    asked = large.select(*keys, F.col("count").alias("n"), F.explode(ranks.cast("array<bigint>")).alias("rank"))
    found = ranked(values, keys, asked, most).groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("rank", "value"))).alias("of"))
    found = large.join(found, keys) if keys else large.crossJoin(found)

    def between(p: Column) -> Column:
        low, high = F.floor(p).cast("bigint"), F.ceil(p).cast("bigint")
        a, b = F.element_at("of", low), F.element_at("of", high)
        return F.when(low == high, a).otherwise((high - p) * a + (p - low) * b)

    big = found.select(*keys, "count", F.transform(places, between).alias("value"))
    return big if small is None else small.unionByName(big)


# -- sliding windows ------------------------------------------------------------------------------


def sliding(op: str, values: np.ndarray, width: int, skipna: bool) -> np.ndarray:
    """median, rank, argmin or argmax of the last ``width`` values, NaN for missing; NaN before the first full window.

    rank: the place of the last value among its window, from -1 (least) to 1, ties in the middle. argmin
    and argmax: how many cells back, 0 for the last; of equals the nearest. Windows are kept in order
    (median, rank) or as a queue of candidates (argmin, argmax), so a step costs the logarithm of the width, or less.
    """
    s = pd.Series(values)
    need = 1 if skipna else width
    if op == "median":
        out = s.rolling(width, min_periods=need).median().to_numpy()
    elif op == "rank":
        place, n = s.rolling(width, min_periods=need).rank(method="average").to_numpy(), s.rolling(width, min_periods=need).count().to_numpy()
        out = np.where(n > 1, 2 * (place - 1) / np.maximum(n - 1, 1) - 1, 0.0)
        out = np.where(np.isnan(place), np.nan, out)
    else:
        from collections import deque

        sign = 1.0 if op == "argmin" else -1.0
        queue: deque[int] = deque()
        out, missing = np.full(len(values), np.nan), 0
        for i, x in enumerate((sign * values).tolist()):
            if x != x:
                missing += 1
            else:
                while queue and sign * values[queue[-1]] >= x:
                    queue.pop()
                queue.append(i)
            if i >= width and values[i - width] != values[i - width]:
                missing -= 1
            while queue and queue[0] <= i - width:
                queue.popleft()
            if queue and (skipna or not missing):
                out[i] = i - queue[0]
    out[: width - 1] = np.nan
    return out
