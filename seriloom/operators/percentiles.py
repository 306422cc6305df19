"""Exact percentiles for groups of any size.

``percentile`` keeps every distinct value of a group in one aggregation buffer. That is fine for
weekly series (a calendar bounds their length) but not for raw rows, where one series may hold a
third of the table. Here values are counted first, the wanted ranks are located in coarse value
buckets, and only the few buckets that hold a wanted rank are looked at value by value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS_PER_OCTAVE = 1024
LOWEST_OCTAVE = 1100  # below the smallest positive double


def _bucket(value: Column) -> Column:
    # order-preserving: larger values never get a smaller bucket; small values are told apart like large ones
    size = F.floor((F.log2(F.abs(value)) + LOWEST_OCTAVE) * BUCKETS_PER_OCTAVE)
    return F.when(value == 0, F.lit(0.0)).otherwise(F.signum(value) * size).cast("long")


def grouped_percentiles(
    df: DataFrame, keys: list[str], value: str, probs: dict[str, float]
) -> DataFrame:
    """One row per (non-null) key with exact linear-interpolation percentiles named by ``probs``.

    The NULL filters are spelled out so that both uses of the counts have the same plan and share
    one exchange.
    """
    present = F.col(value).isNotNull() & _bucket(F.col(value)).isNotNull()
    for k in keys:
        present = present & F.col(k).isNotNull()
    counts = (
        df.filter(present)
        .groupBy(*keys, F.col(value).alias("_v"))
        .agg(F.count("*").alias("_n"))
        .withColumn("_b", _bucket(F.col("_v")))
        .filter("_b IS NOT NULL")
    )
    by_group = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    sizes = (
        counts.groupBy(*keys, "_b")
        .agg(F.sum("_n").alias("_bn"))
        .withColumn("_before", F.sum("_bn").over(by_group.orderBy("_b")) - F.col("_bn"))
        .withColumn("_total", F.sum("_bn").over(by_group))
    )
    ranks = []
    for p in probs.values():
        pos = F.lit(float(p)) * (F.col("_total") - 1)
        ranks += [F.floor(pos), F.ceil(pos)]
    wanted = F.exists(
        F.array(*ranks),
        lambda r: (r >= F.col("_before")) & (r < F.col("_before") + F.col("_bn")),
    )
    hit = sizes.filter(wanted).select(*keys, "_b", "_before", "_total")
    inside = counts.join(hit, [*keys, "_b"])
    by_bucket = Window.partitionBy(*keys, "_b").orderBy("_v")
    placed = inside.withColumn("_end", F.col("_before") + F.sum("_n").over(by_bucket))
    start = F.col("_end") - F.col("_n")

    def value_at(rank: Column) -> Column:
        return F.max(F.when((rank >= start) & (rank < F.col("_end")), F.col("_v")))

    out = []
    for name, p in probs.items():
        pos = F.lit(float(p)) * (F.col("_total") - 1)
        low, high = value_at(F.floor(pos)), value_at(F.ceil(pos))
        weight = F.max(pos - F.floor(pos))
        out.append((low + (high - low) * weight).alias(name))
    return placed.groupBy(*keys).agg(*out)
