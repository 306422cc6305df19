"""Proper scoring rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def interval_score(lower: Column, upper: Column, actual: Column, alpha: float) -> Column:
    """Width of the interval plus 2/alpha times the distance by which it misses."""
    miss = F.greatest(lower - actual, F.lit(0.0)) + F.greatest(actual - upper, F.lit(0.0))
    return (upper - lower) + F.lit(2.0 / alpha) * miss


def level_position(levels: list[float], level: float) -> int:
    """0-based position of a quantile level in the fixed level list."""
    return [round(x, 3) for x in levels].index(round(level, 3))


def at_level(q: Column, levels: list[float], level: float) -> Column:
    return F.element_at(q, level_position(levels, level) + 1)


def weighted_interval_score(
    actual: Column, q: Column, levels: list[float], intervals: list[tuple[float, float, float]]
) -> Column:
    """WIS: half the median error plus alpha/2-weighted interval scores over K + 1/2."""
    total = F.lit(0.5) * F.abs(actual - at_level(q, levels, 0.5))
    for low, high, alpha in intervals:
        total = total + F.lit(alpha / 2.0) * interval_score(
            at_level(q, levels, low), at_level(q, levels, high), actual, alpha
        )
    return total / F.lit(len(intervals) + 0.5)


def covered(actual: Column, q: Column, levels: list[float], low: float, high: float) -> Column:
    return actual.between(at_level(q, levels, low), at_level(q, levels, high))
