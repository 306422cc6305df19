"""Calendar, weather and neighbour covariates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriloom.functions import fixed_values as fv
from seriloom.functions.calendar import season_angle, week_end, wrap_week
from seriloom.functions.cells import share
from seriloom.operators.series import by_week, whole_series

AGGREGATES = {
    "temp_mean": F.avg,
    "temp_max": F.max,
    "temp_min": F.min,
    "humidity_mean": F.avg,
    "humidity_min": F.min,
}


def week_sincos(weekly: DataFrame, week: str = "week") -> DataFrame:
    """Adds the ISO week's place on the yearly circle."""
    angle = season_angle(F.weekofyear(week))
    return weekly.withColumns({"week_sin": F.sin(angle), "week_cos": F.cos(angle)})


def last_points(weekly: DataFrame, *columns: str) -> DataFrame:
    """One row per series with the last point's index and the named columns."""
    return weekly.groupBy("series_id").agg(
        F.max(F.struct("idx", *columns)).alias("m")
    ).select("series_id", "m.*")


def future_week_sincos(weekly: DataFrame, horizon: int = fv.HORIZON) -> DataFrame:
    """The same circle for the next ``horizon`` weeks in a 52-week calendar."""
    ahead = last_points(weekly, "week").select(
        "series_id",
        F.weekofyear("week").alias("last_week"),
        F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("step"),
    )
    angle = season_angle(F.col("iso_week"))
    return ahead.withColumn("iso_week", wrap_week(F.col("last_week") + F.col("step"))).select(
        "series_id", "step", "iso_week", F.sin(angle).alias("week_sin"), F.cos(angle).alias("week_cos")
    )


def future_flags(weekly: DataFrame, flags: list[str], horizon: int = fv.HORIZON) -> DataFrame:
    """Last value of each flag repeated over the next ``horizon`` steps."""
    return last_points(weekly, *flags).select(
        "series_id", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("step"), *flags
    )


# --- weather ------------------------------------------------------------------------------


def weather_weekly(weekly: DataFrame, daily: DataFrame, anchor: str = "forward") -> DataFrame:
    """weekly(series_id, location, week) plus five weather features.

    ``forward`` takes the days from a label up to the next label, ``week`` the days of the
    labelled week itself. On the regular Sunday grid both are an equi-join on the week the day
    falls in, so no range join is needed. With a forward anchor the last label of a series ends
    seven days later, which the regular grid gives by itself.
    """
    if anchor == "forward":
        bucket = F.date_sub(week_end(F.date_add("date", 1)), 7)
    elif anchor == "week":
        bucket = week_end(F.col("date"))
    else:
        raise ValueError(f"unknown anchor {anchor!r}")
    per_week = daily.groupBy("location", bucket.alias("week")).agg(
        *[agg(c).alias(c) for c, agg in AGGREGATES.items()]
    )
    return weekly.join(per_week, ["location", "week"], "left")


def weather_irregular(labels: DataFrame, daily: DataFrame) -> DataFrame:
    """Weather per label for labels at any distance: [label, next label), the last one 7 days.

    Labels are expanded to the days they own (each day belongs to one label of a series), which
    turns the range join into an equi-join on (location, date).
    """
    nxt = F.coalesce(F.lead("week").over(by_week("week")), F.date_add("week", 7))
    owned = labels.withColumn("_end", F.date_sub(nxt, 1)).filter(F.col("_end") >= F.col("week")).withColumn(
        "date", F.explode(F.sequence("week", "_end", F.expr("interval 1 day")))
    )
    return (
        owned.join(daily, ["location", "date"], "left")
        .groupBy("series_id", "location", "week")
        .agg(*[agg(c).alias(c) for c, agg in AGGREGATES.items()])
    )


def fit_scaler(df: DataFrame, features: list[str], keys: list[str]) -> DataFrame:
    """Mean and population deviation per feature; a deviation of 0 becomes 1."""
    parts = []
    for f in features:
        sd = F.stddev_pop(f)
        parts += [F.avg(f).alias(f"{f}_mean"), F.when(sd == 0, 1.0).otherwise(sd).alias(f"{f}_scale")]
    return df.groupBy(*keys).agg(*parts)


def apply_scaler(df: DataFrame, scaler: DataFrame, features: list[str], keys: list[str]) -> DataFrame:
    """Standardise with fitted statistics, possibly from other data; NULLs stay NULL."""
    joined = df.join(scaler, keys, "left")
    return joined.select(
        *[c for c in df.columns if c not in features],
        *[((F.col(f) - F.col(f"{f}_mean")) / F.col(f"{f}_scale")).alias(f) for f in features],
    )


def zscore_features(df: DataFrame, features: list[str], keys: list[str]) -> DataFrame:
    return apply_scaler(df, fit_scaler(df, features, keys), features, keys)


def align_check(weekly: DataFrame, covariates: DataFrame, features: list[str]) -> DataFrame:
    """Per series: both lengths, whether they agree, and the missing share of every feature."""
    target = weekly.groupBy("series_id").agg(F.count("*").alias("n_target"))
    cov = covariates.groupBy("series_id").agg(
        F.count("*").alias("n_covariate"),
        *[(100 * share(F.col(f).isNull())).alias(f"{f}_missing_pct") for f in features],
    )
    return target.join(cov, "series_id", "left").withColumn(
        "aligned", F.coalesce(F.col("n_target") == F.col("n_covariate"), F.lit(False))
    )


def weather_coverage(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """Best cached range per request: the exact range, else the first range that contains it.

    Both sides of the equi-join on location are distinct ranges, whatever the number of series that ask
    for one, and the choice is a two-phase minimum over a struct.
    """
    r = requests.select("series_id", "location", "start", "end")
    asked = r.select("location", "start", "end").distinct()
    c = cache.select("location", F.col("start").alias("c_start"), F.col("end").alias("c_end")).distinct()
    inside = (F.col("c_start") <= F.col("start")) & (F.col("c_end") >= F.col("end"))
    exact = (F.col("c_start") == F.col("start")) & (F.col("c_end") == F.col("end"))
    best = (
        asked.join(c, "location")
        .filter(inside)
        .groupBy("location", "start", "end")
        .agg(F.min(F.struct((~exact).alias("not_exact"), "c_start", "c_end")).alias("m"))
    )
    return r.join(best, ["location", "start", "end"], "left").select(
        "series_id",
        "location",
        "start",
        "end",
        F.col("m.c_start").alias("cache_start"),
        F.col("m.c_end").alias("cache_end"),
        (~F.col("m.not_exact")).alias("exact"),
    )


def weather_trim(daily: DataFrame, requests: DataFrame) -> DataFrame:
    """Daily rows inside the requested range of each series."""
    return daily.join(requests.select("series_id", "location", "start", "end"), "location").filter(
        F.col("date").between(F.col("start"), F.col("end"))
    ).drop("start", "end")


def cache_freshness(
    needs: DataFrame, cache: DataFrame, target: Column, fresh_days: int = fv.FRESH_GAP_DAYS
) -> DataFrame:
    """fresh / stale / missing / no_data per series.

    ``needs`` holds (series_id, location, start, end) with NULL dates where a series has no data;
    the required end is the later of the series end and ``target``.
    """
    cached = cache.groupBy("location").agg(F.max("end").alias("cached_end"))
    required = F.when(F.col("end").isNotNull(), F.greatest(F.col("end"), target))
    out = (
        needs.withColumn("required_end", required)
        .join(cached, "location", "left")
        .withColumn("gap_days", F.datediff("required_end", "cached_end").cast("bigint"))
    )
    status = (
        F.when(F.col("end").isNull(), "no_data")
        .when(F.col("cached_end").isNull(), "missing")
        .when(F.col("gap_days") <= fresh_days, "fresh")
        .otherwise("stale")
    )
    return out.select("series_id", "location", "start", "required_end", "cached_end", "gap_days", status.alias("status"))


def cache_extend(old: DataFrame, tail: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Cached rows plus a fetched tail; on overlapping days the cached row wins.

    A struct minimum instead of dropDuplicates, whose survivor is arbitrary.
    """
    k = keys or ["location", "date"]
    rest = [c for c in old.columns if c not in k]
    both = old.withColumn("_src", F.lit(0)).unionByName(tail.withColumn("_src", F.lit(1)))
    kept = both.groupBy(*k).agg(F.min_by(F.struct(*rest), "_src").alias("m"))
    return kept.select(*k, "m.*")


def refresh_plan(
    freshness: DataFrame, refresh_stale: bool = True, overlap: int = fv.EXTEND_OVERLAP_DAYS
) -> DataFrame:
    """Work list: the full range for missing caches, the tail for stale ones."""
    wanted = ["missing", "stale"] if refresh_stale else ["missing"]
    tail_from = F.date_sub("cached_end", overlap)
    return freshness.filter(F.col("status").isin(wanted)).select(
        "series_id",
        "location",
        F.when(F.col("status") == "missing", "full").otherwise("tail").alias("action"),
        F.when(F.col("status") == "missing", F.col("start")).otherwise(tail_from).alias("fetch_from"),
        F.col("required_end").alias("fetch_to"),
    )


# --- neighbours ---------------------------------------------------------------------------


def neighbour_features(
    weekly: DataFrame,
    edges: DataFrame,
    max_neighbours: int | None = fv.MAX_NEIGHBOURS,
    min_share: float = fv.MIN_NEIGHBOUR_SHARE,
) -> DataFrame:
    """(series_id, neighbour, rank, week, value) for neighbours observed often enough.

    Only the first ``max_neighbours`` by rank are considered (None for all); a neighbour is kept
    where at least ``min_share`` of the target's weeks have a value.
    """
    first = edges if max_neighbours is None else edges.filter(F.col("rank") <= max_neighbours)
    target = weekly.select(F.col("series_id").alias("src"), "week")
    other = weekly.select(F.col("series_id").alias("dst"), "week", "value")
    present = other.select("dst").distinct()
    wide = (
        target.join(first.join(present, "dst", "left_semi"), "src")
        .join(other, ["dst", "week"], "left")
    )
    coverage = F.avg(F.col("value").isNotNull().cast("double")).over(Window.partitionBy("src", "dst"))
    return wide.withColumn("_share", coverage).filter(F.col("_share") >= min_share).select(
        F.col("src").alias("series_id"), F.col("dst").alias("neighbour"), "rank", "week", "value"
    )


def covariate_gate(context: DataFrame, future: DataFrame, horizon: int = fv.HORIZON) -> DataFrame:
    """Which covariates a rolling forecast may use.

    ``context`` and ``future`` are (series_id, cutoff, name, idx, value). A past covariate counts
    if its last context value is there; the future block of a (series, cutoff) counts if every
    covariate in it has ``horizon`` non-null steps.
    """
    past = context.groupBy("series_id", "cutoff", "name").agg(
        F.max(F.struct("idx", "value"))["value"].isNotNull().alias("use_past")
    )
    per_name = future.groupBy("series_id", "cutoff", "name").agg(
        ((F.count("value") == F.count("*")) & (F.count("*") >= horizon)).alias("full")
    )
    block = per_name.groupBy("series_id", "cutoff").agg(F.bool_and("full").alias("use_future"))
    return past.join(block, ["series_id", "cutoff"], "left").select(
        "series_id", "cutoff", "name", "use_past", F.coalesce("use_future", F.lit(False)).alias("use_future")
    )


def feature_usage(entities: DataFrame, group: str, used: str) -> DataFrame:
    """Users of a feature per group with a TOTAL line (rollup)."""
    return (
        entities.rollup(group)
        .agg(
            F.count_if(F.col(used)).alias("n_used"),
            F.count("*").alias("n_total"),
            (100 * share(F.col(used))).alias("used_pct"),
            F.grouping(group).alias("_total"),
        )
        .select(
            F.when(F.col("_total") == 1, "TOTAL").otherwise(F.col(group)).alias(group),
            "n_used",
            "n_total",
            "used_pct",
        )
    )
