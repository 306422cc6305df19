"""Adapters from the star-schema test tables to the canonical tables.

Orders play the surveillance reports: status F counts as the first indicator, O as the
second, and the customer's nation (or segment, or the customer) is the series.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _orders_by(spark: SparkSession, sf_dir: str, key: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    if key == "customer":
        return orders.withColumn("series_id", F.concat(F.lit("C"), F.col("o_custkey").cast("string")))
    customer = table(spark, sf_dir, "customer")
    joined = orders.join(customer, orders.o_custkey == customer.c_custkey)
    if key == "segment":
        return joined.withColumn("series_id", F.col("c_mktsegment"))
    nation = table(spark, sf_dir, "nation")
    name = F.concat_ws("/", "n_name", "c_mktsegment") if key == "nation_segment" else F.col("n_name")
    return joined.join(nation, joined.c_nationkey == nation.n_nationkey).withColumn("series_id", name)


def observations(spark: SparkSession, sf_dir: str, key: str = "nation") -> DataFrame:
    """obs(series_id, obs_date, ili, ari): weekly Monday counts of F and O orders."""
    return (
        _orders_by(spark, sf_dir, key)
        .groupBy("series_id", F.date_trunc("week", "o_orderdate").cast("date").alias("obs_date"))
        .agg(
            F.count_if(F.col("o_orderstatus") == "F").cast("double").alias("ili"),
            F.count_if(F.col("o_orderstatus") == "O").cast("double").alias("ari"),
        )
    )


def daily_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """obs with several reports per day and per-order amounts (row-level, not aggregated)."""
    amount = F.round(F.col("o_totalprice") / 1000.0)
    return _orders_by(spark, sf_dir, "nation").select(
        "series_id",
        F.col("o_orderdate").cast("date").alias("obs_date"),
        F.when(F.col("o_orderstatus") == "F", amount)
        .when(F.col("o_orderstatus") == "P", F.lit(0.0))
        .alias("ili"),
        F.when(F.col("o_orderstatus") != "F", F.round(amount / 16.0)).alias("ari"),
        F.col("o_orderkey").alias("row_key"),
    )


def feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw-looking text feed, one row per order, with junk by a rule on the order key."""
    k = F.col("o_orderkey")
    day = F.date_format(F.date_trunc("week", "o_orderdate"), "yyyy-MM-dd")
    cases = F.floor(F.col("o_totalprice") / 1000.0).cast("string")
    return _orders_by(spark, sf_dir, "nation").select(
        F.concat(F.lit("N"), F.lpad(F.col("n_nationkey").cast("string"), 2, "0")).alias("COUNTRY_CODE"),
        F.col("n_name").alias("COUNTRY_AREA_TERRITORY"),
        F.when(k % 97 == 0, F.lit("7")).otherwise(day).alias("ISO_WEEKSTARTDATE"),
        F.when(F.col("o_orderpriority") == "1-URGENT", F.lit("0-4"))
        .when(F.col("o_orderpriority") == "2-HIGH", F.lit("all"))
        .otherwise(F.lit("ALL"))
        .alias("AGEGROUP_CODE"),
        F.when(k % 89 == 0, F.lit("n/a"))
        .when(F.col("o_orderstatus") == "F", cases)
        .when(F.col("o_orderstatus") == "P", F.lit("0"))
        .alias("ILI_CASE"),
        F.when(k % 83 == 0, F.lit("-"))
        .when(F.col("o_orderstatus") == "O", cases)
        .when(F.col("o_orderstatus") == "P", F.lit("0"))
        .alias("ARI_CASE"),
        k.alias("row_key"),
    )


def weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    """weather(location, date, five daily features) from line items by ship date."""
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy(
        F.col("l_returnflag").alias("location"), F.col("l_shipdate").cast("date").alias("date")
    ).agg(
        F.avg("l_discount").alias("temp_mean"),
        F.max("l_discount").alias("temp_max"),
        F.min("l_discount").alias("temp_min"),
        F.avg("l_tax").alias("humidity_mean"),
        F.min("l_tax").alias("humidity_min"),
    )


def nation_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """edges(src, dst, rank): up to four nations whose key follows in steps of five."""
    nation = table(spark, sf_dir, "nation")
    src = nation.select(
        F.col("n_name").alias("src"),
        F.explode(F.sequence(F.lit(1), F.lit(4))).alias("rank"),
        F.col("n_nationkey").alias("k"),
    ).withColumn("dst_key", (F.col("k") + 5 * F.col("rank")) % 25)
    dst = nation.select(F.col("n_name").alias("dst"), F.col("n_nationkey").alias("dst_key"))
    return src.join(dst, "dst_key").select("src", "dst", "rank")


def latitudes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """bbox(code, name, min_lon, min_lat, max_lon, max_lat) derived from nation keys."""
    k = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select(
        F.concat(F.lit("N"), F.lpad(k.cast("string"), 2, "0")).alias("code"),
        F.lower("n_name").alias("name"),
        (k * 7.0 - 90.0).alias("min_lon"),
        (k * 5.0 - 65.0).alias("min_lat"),
        (k * 7.0 - 80.0).alias("max_lon"),
        (k * 5.0 - 58.5).alias("max_lat"),
    )
