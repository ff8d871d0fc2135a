"""Labelled N-dimensional arrays on Spark DataFrames."""

from .array import LabelArray
from .axis import Axis
from .dataset import Dataset, concatenate_ds, stack_ds
from .functions import percentile, quantile
from .operators.align import align, align_dims, array, broadcast_arrays, concatenate, stack
from .options import get_option, print_options, reset_options, set_option
from .sources.netcdf import open_file as open_nc
from .sources.netcdf import read_files as read_nc
from .sources.netcdf import summary as summary_nc
from .sources.netcdf import write_file as write_nc
from .sources.netcdf import write_slabs
from .sources.store import open_store, read


def full(spark, value, axes=None, dims=None, shape=None, dtype: str | None = None, **attrs) -> LabelArray:
    """dtype: a Spark type, such as bigint, double or boolean."""
    out = LabelArray.constant(spark, value, axes, dims, shape, attrs)
    return out if dtype is None else out.make(out.cells.withColumn("value", out.cells["value"].cast(dtype)), out.axes)


def zeros(spark, axes=None, dims=None, shape=None, dtype: str = "double", **attrs) -> LabelArray:
    return full(spark, 0, axes, dims, shape, dtype, **attrs)


def ones(spark, axes=None, dims=None, shape=None, dtype: str = "double", **attrs) -> LabelArray:
    return full(spark, 1, axes, dims, shape, dtype, **attrs)


def nans(spark, axes=None, dims=None, shape=None, dtype: str = "double", **attrs) -> LabelArray:
    return full(spark, None, axes, dims, shape, dtype, **attrs)


empty = nans


def zeros_like(a: LabelArray, dtype: str | None = None) -> LabelArray:
    """With the axes and, if no other is given, the type of a; so the others."""
    return zeros(a.spark, list(a.axes), dtype=dtype or a.dtype)


def ones_like(a: LabelArray, dtype: str | None = None) -> LabelArray:
    return ones(a.spark, list(a.axes), dtype=dtype or a.dtype)


def nans_like(a: LabelArray, dtype: str | None = None) -> LabelArray:
    return nans(a.spark, list(a.axes), dtype=dtype or a.dtype)


empty_like = nans_like


def interp1d(a: LabelArray, values, axis=0, **how) -> LabelArray:
    return a.interp_axis(values, axis, **how)


def interp2d(a: LabelArray, newaxes, dims=(-2, -1), **how) -> LabelArray:
    return a.interp2d(newaxes, dims, **how)


__all__ = [
    "Axis", "Dataset", "LabelArray", "align", "align_dims", "array", "broadcast_arrays", "concatenate", "concatenate_ds", "empty", "empty_like", "full", "get_option", "interp1d", "interp2d", "nans", "nans_like",
    "ones", "ones_like", "open_nc", "open_store", "percentile", "print_options", "quantile", "read", "read_nc", "reset_options", "set_option", "stack", "stack_ds", "summary_nc", "write_nc", "write_slabs", "zeros", "zeros_like",
]
