"""Aggregates with the corner cases that the features need."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(a, b) -> Column:
    """a / b, and 0 where b is 0 or either is null."""
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def edge_names(label: str, edges: list[float]) -> list[str]:
    """Names such as v(0,5); whole edges are written without a fraction."""
    said = [f"{e:g}" for e in edges]
    return [f"{label}({a},{b})" for a, b in zip(said, said[1:], strict=False)]


def density_histogram(value: Column, edges: list[float], label: str, where: Column | None = None) -> list[Column]:
    """Aggregates: one density per bin; the last bin is closed, values outside are ignored, none gives 0."""
    if where is not None:
        value = F.when(where, value)
    inside = F.sum(F.when((value >= edges[0]) & (value <= edges[-1]), 1).otherwise(0))
    out = []
    for k, name in enumerate(edge_names(label, edges)):
        lo, hi = edges[k], edges[k + 1]
        top = value <= hi if k == len(edges) - 2 else value < hi
        n = F.sum(F.when((value >= lo) & top, 1).otherwise(0))
        out.append(ratio(n, inside * F.lit(float(hi - lo))).alias(name))
    return out


def skewness(value: Column) -> Column:
    """Biased skewness; 0 for constant values, null for none."""
    return F.when(F.count(value) > 0, F.coalesce(F.skewness(value), F.lit(0.0)))


def kurtosis(value: Column) -> Column:
    """Biased excess kurtosis; -3 for constant values, null for none."""
    return F.when(F.count(value) > 0, F.coalesce(F.kurtosis(value), F.lit(-3.0)))


def seconds(later: Column, earlier: Column) -> Column:
    """Seconds between two zone-less timestamps, with their fraction."""
    return F.timestamp_diff("MICROSECOND", earlier, later) / F.lit(1e6)
