"""Canonical tables of the test data that many queries start from."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriloom.operators import series as se
from seriloom.sources import testbed as tb

AS_OF = "2001-08-15"


def as_of():
    return F.lit(AS_OF).cast("date")


def combined(spark, d, key: str = "nation") -> DataFrame:
    return se.combine_indicators(tb.observations(spark, d, key))


def weekly(spark, d, key: str = "nation") -> DataFrame:
    return se.weekly_resample(combined(spark, d, key))


def weekly_ili(spark, d) -> DataFrame:
    """First indicator only, zeros kept."""
    return se.weekly_resample(se.single_indicator(tb.observations(spark, d), "ili", need_positive=False))


def clean(spark, d) -> DataFrame:
    """Training series with the zeros kept as observations."""
    return se.clean_for_training(weekly_ili(spark, d), zeros="keep")


def sites(spark, d) -> DataFrame:
    """(series_id, location): the weather location of each series."""
    r = F.col("n_regionkey")
    loc = F.when(r.isin(0, 3), "A").when(r.isin(1, 4), "N").otherwise("R")
    return tb.table(spark, d, "nation").select(F.col("n_name").alias("series_id"), loc.alias("location"))


def regions(spark, d) -> DataFrame:
    """(parent, series_id): nations as parts of regions."""
    nation, region = tb.table(spark, d, "nation"), tb.table(spark, d, "region")
    return nation.join(region, nation.n_regionkey == region.r_regionkey).select(
        F.col("r_name").alias("parent"), F.col("n_name").alias("series_id")
    )
