"""Functions on arrays, beside their methods."""

from .stats import percentile, quantile

__all__ = ["percentile", "quantile"]
