"""Percentiles and quantiles along an axis."""

from __future__ import annotations


def percentile(a, pct, axis=0, newaxis: str | None = None, skipna: bool = False):
    return a.percentile(pct, axis, newaxis, skipna=skipna)


def quantile(a, q, axis=0, newaxis: str | None = None, skipna: bool = False):
    return a.quantile(q, axis, newaxis, skipna)
