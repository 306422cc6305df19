"""Published views: detail points, activity status, lists and chart ranges.

``as_of`` is always an argument, never the clock.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriloom.functions import fixed_values as fv
from seriloom.functions.calendar import week_start
from seriloom.functions.cells import rounded
from seriloom.functions.scores import level_position

BAND = ["forecast", "lower", "upper", "lower_50", "upper_50"]
FIELDS = ["historical", *BAND]


def type_name(flag: Column) -> Column:
    return F.when(flag == 1, "ARI").otherwise("ILI")


def staleness(series: DataFrame, as_of: Column, days: int = fv.STALE_DAYS) -> DataFrame:
    """(series_id, last_update, age_days, stale); a series without a date is stale."""
    last = series.groupBy("series_id").agg(F.max("obs_date").alias("last_update"))
    age = F.datediff(as_of, "last_update")
    return last.select(
        "series_id",
        "last_update",
        age.cast("bigint").alias("age_days"),
        F.coalesce(age >= days, F.lit(True)).alias("stale"),
    )


def series_points(layout: DataFrame, starts: DataFrame, levels: list[float] | None = None) -> DataFrame:
    """(series_id, date, historical, forecast, lower, upper, lower_50, upper_50).

    Dates count weeks from the first observation; the outer band is the 10%..90% range and the
    inner one lies midway between the neighbouring deciles.
    """
    lv = levels or fv.LEVELS_9

    def at(level: float) -> Column:
        return F.element_at("q", level_position(lv, level) + 1)

    shown = F.col("mean_forecast").isNotNull()
    return layout.join(starts.select("series_id", "start"), "series_id").select(
        "series_id",
        F.date_add("start", (F.col("time") * 7).cast("int")).alias("date"),
        F.col("context").alias("historical"),
        F.col("mean_forecast").alias("forecast"),
        F.when(shown, at(0.1)).alias("lower"),
        F.when(shown, at(0.9)).alias("upper"),
        F.when(shown, (at(0.2) + at(0.3)) / 2).alias("lower_50"),
        F.when(shown, (at(0.7) + at(0.8)) / 2).alias("upper_50"),
    )


def suppress_stale(points: DataFrame, stale: DataFrame) -> DataFrame:
    """Forecast fields of stale series become NULL; their history stays."""
    marked = points.join(stale.select("series_id", "stale"), "series_id")
    return marked.withColumns({f: F.when(~F.col("stale"), F.col(f)) for f in BAND})


def nowcast_value(points: DataFrame, week: Column) -> DataFrame:
    """(series_id, value, source) for one week: the report, else the forecast floored at zero."""
    value = F.coalesce("historical", F.greatest(F.col("forecast"), F.lit(0.0)))
    source = F.when(F.col("historical").isNotNull(), "actual").when(F.col("forecast").isNotNull(), "forecast")
    # greatest() skips NULLs, so a missing forecast must not become 0
    return points.filter(F.col("date") == week).select(
        "series_id", F.when(source.isNotNull(), value).alias("value"), source.alias("source")
    )


def type_info(series: DataFrame) -> DataFrame:
    """(series_id, current_type, start): type of the last reported week and the first date."""
    typed = F.col("data_type").isNotNull()
    by_day = F.struct("obs_date", "data_type")
    reported = F.max(F.when(typed & F.col("cases").isNotNull(), by_day))["data_type"]
    any_row = F.max(F.when(typed, by_day))["data_type"]
    return series.groupBy("series_id").agg(
        F.coalesce(reported, any_row).alias("current_type"), F.min("obs_date").alias("start")
    )


def type_map(series: DataFrame) -> DataFrame:
    """(series_id, date, data_type): one type per reported day."""
    return series.filter("data_type IS NOT NULL").groupBy("series_id", F.col("obs_date").alias("date")).agg(
        F.max("data_type").alias("data_type")
    )


def merged_type_map(types: DataFrame, info: DataFrame, parts: DataFrame) -> DataFrame:
    """(parent, date, data_type) over the parts of a parent.

    A week whose parts disagree has a NULL type. A parent whose parts do not share their current
    type has no map at all. ``parts`` is (parent, series_id).
    """
    agreed = (
        parts.join(info, "series_id")
        .groupBy("parent")
        .agg(
            F.min("current_type").alias("lo"),
            F.max("current_type").alias("hi"),
            F.count("current_type").alias("k"),
            F.count("*").alias("n"),
        )
        .filter((F.col("lo") == F.col("hi")) & (F.col("k") == F.col("n")))
        .select("parent")
    )
    weeks = (
        types.join(parts, "series_id")
        .groupBy("parent", "date")
        .agg(F.min("data_type").alias("lo"), F.max("data_type").alias("hi"))
        .select("parent", "date", F.when(F.col("lo") == F.col("hi"), F.col("lo")).alias("data_type"))
    )
    return weeks.join(agreed, "parent", "left_semi")


def type_aware_baseline(
    points: DataFrame, types: DataFrame, info: DataFrame, min_same: int = fv.MIN_SAME_TYPE
) -> DataFrame:
    """(series_id, mean, std, n_same): z-score baseline over weeks of the current indicator.

    Falls back to all weeks where fewer than ``min_same`` carry the current type. Sample
    standard deviation; one conditional aggregate gives both versions.
    """
    hist = points.filter("historical IS NOT NULL").select("series_id", "date", "historical")
    typed = hist.join(types, ["series_id", "date"], "left").join(
        info.select("series_id", "current_type"), "series_id", "left"
    )
    same = F.when(F.col("data_type") == F.col("current_type"), F.col("historical"))
    return (
        typed.withColumn("same", same)
        .groupBy("series_id")
        .agg(
            F.avg("historical").alias("mean_all"),
            F.stddev_samp("historical").alias("std_all"),
            F.avg("same").alias("mean_same"),
            F.stddev_samp("same").alias("std_same"),
            F.count("same").alias("n_same"),
        )
        .select(
            "series_id",
            F.when(F.col("n_same") >= min_same, F.col("mean_same")).otherwise(F.col("mean_all")).alias("mean"),
            F.when(F.col("n_same") >= min_same, F.col("std_same")).otherwise(F.col("std_all")).alias("std"),
            "n_same",
        )
    )


def zscore(value: Column, mean: Column, std: Column) -> Column:
    """Standard score, 0 where the deviation is not positive or unknown."""
    return F.when(std > 0, (value - mean) / std).otherwise(F.when(value.isNotNull(), 0.0))


def activity_score(values: DataFrame, baseline: DataFrame) -> DataFrame:
    """Adds zscore, score = clip(z/2, 0, 1) and status (high from one deviation up)."""
    z = zscore(F.col("value"), F.col("mean"), F.col("std"))
    return (
        values.join(baseline.select("series_id", "mean", "std"), "series_id")
        .withColumn("zscore", z)
        .withColumn("score", F.least(F.greatest(F.col("zscore") / 2, F.lit(0.0)), F.lit(1.0)))
        .withColumn("status", F.when(F.col("zscore") >= 1.0, "high").otherwise("low"))
        .drop("mean", "std")
    )


def week_calendar(as_of: Column, ahead: int = 4) -> Column:
    """Current Monday and the following ones as an array of dates."""
    monday = week_start(as_of)
    return F.transform(F.sequence(F.lit(0), F.lit(ahead)), lambda i: F.date_add(monday, (i * 7).cast("int")))


def future_weeks_view(
    points: DataFrame,
    baseline: DataFrame,
    stale: DataFrame,
    as_of: Column,
    ahead: int = 4,
    reach: int = fv.FORECAST_REACH_DAYS,
) -> DataFrame:
    """Forecasts of the next Mondays on the z scale, only within ``reach`` days of the last report."""
    monday = week_start(as_of)
    last = stale.select("series_id", "last_update")
    rows = (
        points.filter(
            F.col("forecast").isNotNull()
            & (F.col("date") > monday)
            & (F.col("date") <= F.date_add(monday, 7 * ahead))
            & (F.datediff("date", monday) % 7 == 0)
        )
        .join(last, "series_id")
        .filter(F.datediff("date", "last_update") <= reach)
        .select("series_id", "date", F.greatest(F.col("forecast"), F.lit(0.0)).alias("value"))
    )
    return activity_score(rows, baseline)


def status_map(
    points: DataFrame,
    series: DataFrame,
    stale: DataFrame,
    as_of: Column,
    info: DataFrame | None = None,
    types: DataFrame | None = None,
) -> DataFrame:
    """One row per series for the map, flat; see ``status_documents`` for the nested form.

    Stale series appear without figures; other series without any value for the week are left out.
    """
    info = info if info is not None else type_info(series)
    types = types if types is not None else type_map(series)
    base = type_aware_baseline(points, types, info)
    now = nowcast_value(points, week_start(as_of)).filter("value IS NOT NULL")
    scored = activity_score(now, base)
    out = stale.join(info.select("series_id", "current_type"), "series_id", "left").join(scored, "series_id", "left")
    figures = {
        "value": rounded("value", 1),
        "zscore": rounded("zscore", 2),
        "score": F.col("score"),
        "source": F.col("source"),
    }
    return out.filter(F.col("stale") | F.col("value").isNotNull()).select(
        "series_id",
        type_name(F.col("current_type")).alias("data_type"),
        *[F.when(~F.col("stale"), c).alias(n) for n, c in figures.items()],
        F.when(F.col("stale"), "stale").otherwise(F.col("status")).alias("status"),
        "stale",
        "last_update",
    )


def status_documents(status: DataFrame, future: DataFrame) -> DataFrame:
    """status rows with their forecast weeks nested and sorted (at most four per series)."""
    weeks = future.groupBy("series_id").agg(
        F.sort_array(
            F.collect_list(
                F.struct(
                    "date",
                    rounded("value", 1).alias("value"),
                    rounded("zscore", 2).alias("zscore"),
                    "score",
                    "status",
                )
            )
        ).alias("forecast_weeks")
    )
    shown = F.when(~F.col("stale"), F.col("forecast_weeks"))
    empty = F.filter("forecast_weeks", lambda _: F.lit(False))
    return (
        status.join(weeks, "series_id", "left")
        .withColumn("forecast_weeks", F.coalesce(shown, empty))
    )


def detail_documents(points: DataFrame, status: DataFrame, changes: DataFrame) -> DataFrame:
    """One nested detail document per series; its points are bounded by the calendar."""
    body = points.groupBy("series_id").agg(
        F.sort_array(F.collect_list(F.struct("date", *FIELDS))).alias("points")
    )
    switch = changes.groupBy("series_id").agg(
        F.sort_array(
            F.collect_list(F.struct("date", F.col("from_type").alias("from"), F.col("to_type").alias("to")))
        ).alias("data_type_changes")
    )
    return (
        body.join(status.select("series_id", "data_type", "stale", "last_update"), "series_id")
        .join(switch, "series_id", "left")
    )


def combine_parts(points: DataFrame, parts: DataFrame) -> DataFrame:
    """Sum the points of sub-regions per date; a field is NULL only where all parts lack it."""
    return (
        points.join(parts, "series_id")
        .groupBy("parent", "date")
        .agg(*[F.sum(f).alias(f) for f in FIELDS])
    )


def combine_facts(info: DataFrame, parts: DataFrame, changes: DataFrame, as_of: Column, days: int = fv.STALE_DAYS) -> DataFrame:
    """Per parent: last update (freshest part), stale, the parts' most frequent type, and whether
    all parts switched indicator identically. ``info`` is (series_id, last_update, data_type)."""
    lists = changes.groupBy("series_id").agg(
        F.concat_ws(
            ";",
            F.sort_array(F.collect_list(F.concat_ws(">", F.col("date").cast("string"), "from_type", "to_type"))),
        ).alias("changes")
    )
    rows = parts.join(info, "series_id").join(lists, "series_id", "left").fillna("", ["changes"])
    per_type = rows.groupBy("parent", "data_type").agg(F.count("*").alias("k"))
    top = per_type.groupBy("parent").agg(F.min(F.struct(-F.col("k"), F.col("data_type")))["data_type"].alias("data_type"))
    facts = rows.groupBy("parent").agg(
        F.max("last_update").alias("last_update"),
        F.min("changes").alias("lo"),
        F.max("changes").alias("hi"),
        F.count("*").alias("n_parts"),
    )
    age = F.datediff(as_of, "last_update")
    return facts.join(top, "parent").select(
        "parent",
        "data_type",
        "last_update",
        F.coalesce(age >= days, F.lit(True)).alias("stale"),
        F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise("").alias("changes"),
        "n_parts",
    )


def latest_data_week(status: DataFrame) -> DataFrame:
    return status.agg(F.max("last_update").alias("latest_data_week"))


def country_list(points: DataFrame, details: DataFrame, on_map: DataFrame) -> DataFrame:
    """Sorted list of all series with detail pages: type, first report, last update, on_map flag.

    ``details`` is (series_id, name, data_type, last_update, stale).
    """
    since = points.groupBy("series_id").agg(
        F.min(F.when(F.col("historical").isNotNull(), F.col("date"))).alias("since")
    )
    shown = on_map.select("series_id").distinct().withColumn("on_map", F.lit(True))
    return (
        details.join(since, "series_id", "left")
        .join(shown, "series_id", "left")
        .fillna(False, ["on_map"])
        .orderBy(F.lower("name"), "series_id")
    )


def list_totals(listing: DataFrame) -> DataFrame:
    return listing.agg(F.count("*").alias("total"), F.count_if("on_map").alias("on_map"))


def range_view(points: DataFrame, last_history: int | None = 52, first_forecast: int | None = 8) -> DataFrame:
    """Last N history points and first M forecast points, the forecast line bridged to history."""
    newest = Window.partitionBy("series_id").orderBy(F.col("date").desc())
    oldest = Window.partitionBy("series_id").orderBy("date")
    is_hist, is_fc = F.col("historical").isNotNull(), F.col("forecast").isNotNull()
    ranked = points.withColumn("_from_end", F.sum(is_hist.cast("int")).over(newest)).withColumn(
        "_from_start", F.sum(is_fc.cast("int")).over(oldest)
    )
    keep_hist = is_hist if last_history is None else is_hist & (F.col("_from_end") <= last_history)
    keep_fc = is_fc if first_forecast is None else is_fc & (F.col("_from_start") <= first_forecast)
    last_fc = F.max(F.when(is_fc, F.col("date"))).over(Window.partitionBy("series_id"))
    shown = ranked.filter(keep_hist | keep_fc).withColumn("_last_fc", last_fc)
    bridge = is_hist & (F.col("_from_end") == 1) & F.col("forecast").isNull() & (F.col("_last_fc") > F.col("date"))
    return (
        shown.withColumn("forecast", F.when(bridge, F.col("historical")).otherwise(F.col("forecast")))
        .drop("_from_end", "_from_start", "_last_fc")
    )
