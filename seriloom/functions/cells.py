"""Cell-level helpers: lenient parsing, missing-value rules and rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_number(col: Column | str) -> Column:
    """Text to double; junk and NaN become NULL (NaN would poison Spark's avg)."""
    c = F.col(col) if isinstance(col, str) else col
    number = c.try_cast("double")
    return F.when(~F.isnan(number), number)


def to_day(col: Column | str) -> Column:
    """Text to date; junk becomes NULL."""
    c = F.col(col) if isinstance(col, str) else col
    return c.try_cast("date")


def ratio(num: Column, den: Column) -> Column:
    """num / den, NULL when the denominator is zero or missing."""
    return F.when(den != 0, num / den)


def rounded(value: Column | str, places: int) -> Column:
    """The binary value rounded to decimal places, exact halves to even: what Python's ``round`` gives.

    2.675 is stored slightly below and becomes 2.67. Scaling alone would round the product to a half
    first, so the product's own error (by splitting both factors into halves of their bits) decides ties.
    """
    c = (F.col(value) if isinstance(value, str) else value).cast("double")
    scale = float(10**places)
    split = 134217729.0  # 2 ** 27 + 1
    scale_high = split * scale - (split * scale - scale)
    scale_low = scale - scale_high
    high = c * split - (c * split - c)
    low = c - high
    product = c * scale
    error = ((high * scale_high - product) + high * scale_low + low * scale_high) + low * scale_low
    whole = F.floor(product).cast("double")
    over = (product - whole - 0.5) + error
    up = (over > 0) | ((over == 0) & (whole % 2 != 0))
    return F.when(F.abs(product) < 2.0**52, (whole + up.cast("double")) / scale).otherwise(c)


def share(cond: Column) -> Column:
    """Aggregate: share of rows where ``cond`` holds."""
    return F.avg(cond.cast("double"))


def count_where(cond: Column) -> Column:
    """Aggregate: number of rows where ``cond`` holds."""
    return F.count(F.when(cond, F.lit(1)))


def median(value: Column) -> Column:
    """Aggregate: exact median (linear interpolation), NULL rows skipped."""
    return F.percentile(value, F.lit(0.5))


def sorted_quantile(ordered: Column, level: Column | float) -> Column:
    """Linear-interpolation quantile of an ascending array without NULLs."""
    p = level if isinstance(level, Column) else F.lit(float(level))
    pos = p * (F.size(ordered) - 1)
    low = F.floor(pos)
    a = F.element_at(ordered, (low + 1).cast("int"))
    b = F.element_at(ordered, (F.ceil(pos) + 1).cast("int"))
    return F.when(F.size(ordered) > 0, a + (b - a) * (pos - low))


def levels_of(levels: list[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in levels])


def pool_quantiles(pool: Column, levels: list[float]) -> Column:
    """Quantiles at fixed levels of an unordered array; sorts once."""
    ordered = F.sort_array(pool)
    # the sorted pool is bound to a lambda variable so it is sorted a single time
    return F.element_at(
        F.transform(
            F.array(ordered),
            lambda s: F.transform(levels_of(levels), lambda p: sorted_quantile(s, p)),
        ),
        1,
    )
