"""Building one clean weekly series per entity.

Two sizes of data meet here. Raw observations can be arbitrarily many per series, so per-series
facts are computed with two-phase aggregates and joined back (a small table, which Spark
broadcasts by size or whose skewed join AQE splits). After ``weekly_resample`` a series has at
most one row per calendar week, so windows partitioned by series are bounded by the calendar.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriloom.functions import fixed_values as fv
from seriloom.functions.calendar import week_end
from seriloom.functions.cells import count_where
from seriloom.operators.percentiles import grouped_percentiles


def by_week(order: str = "idx") -> Window:
    return Window.partitionBy("series_id").orderBy(order)


def whole_series() -> Window:
    return Window.partitionBy("series_id")


# --- indicators ---------------------------------------------------------------------------


def single_indicator(obs: DataFrame, indicator: str, need_positive: bool = True) -> DataFrame:
    """(series_id, obs_date, cases) of one indicator; series without a value > 0 are left out."""
    rows = obs.select("series_id", "obs_date", F.col(indicator).alias("cases"))
    if not need_positive:
        return rows
    reporting = rows.filter("cases > 0").select("series_id").distinct()
    return rows.join(reporting, "series_id", "left_semi")


def adaptive_indicator(obs: DataFrame) -> DataFrame:
    """First indicator if it is ever positive, else the second; neither drops the series."""
    facts = obs.groupBy("series_id").agg(
        F.bool_or(F.coalesce(F.col("ili") > 0, F.lit(False))).alias("has_ili"),
        F.bool_or(F.coalesce(F.col("ari") > 0, F.lit(False))).alias("has_ari"),
    )
    return (
        obs.join(facts.filter("has_ili OR has_ari"), "series_id")
        .select(
            "series_id",
            "obs_date",
            F.when(F.col("has_ili"), F.col("ili")).otherwise(F.col("ari")).alias("cases"),
            F.when(F.col("has_ili"), 0).otherwise(1).alias("data_type"),
        )
    )


def indicator_profile(
    obs: DataFrame,
    min_both: int = fv.MIN_BOTH_WEEKS,
    scale_ratio: float = fv.SCALE_RATIO,
    min_weeks: int = fv.MIN_WINNER_WEEKS,
    min_years: float = fv.MIN_WINNER_YEARS,
) -> DataFrame:
    """Per series: which indicators exist and whether the parallel-reporting guard fires.

    ``keep_only`` is 'ili' or 'ari' where two indicators of very different scale must not be
    mixed, else NULL.
    """
    # the same NULL filter in front of every use lets Spark share the exchange below ``obs``
    obs = obs.filter("series_id IS NOT NULL")
    ili_pos, ari_pos = F.col("ili") > 0, F.col("ari") > 0

    def span(cond: Column) -> Column:
        day = F.when(cond, F.col("obs_date"))
        return F.datediff(F.max(day), F.min(day)) / F.lit(365.25)

    facts = obs.groupBy("series_id").agg(
        count_where(F.col("ili").isNotNull() & F.col("ari").isNotNull()).alias("n_both"),
        count_where(ili_pos).alias("n_ili"),
        count_where(ari_pos).alias("n_ari"),
        span(ili_pos).alias("years_ili"),
        span(ari_pos).alias("years_ari"),
    )
    values = obs.select(
        "series_id",
        F.explode(
            F.array(
                F.struct(F.lit("ili").alias("kind"), F.col("ili").alias("v")),
                F.struct(F.lit("ari").alias("kind"), F.col("ari").alias("v")),
            )
        ).alias("e"),
    ).select("series_id", "e.kind", "e.v").filter("v > 0")
    medians = (
        grouped_percentiles(values, ["series_id", "kind"], "v", {"med": 0.5})
        .groupBy("series_id")
        .agg(
            F.max(F.when(F.col("kind") == "ili", F.col("med"))).alias("med_ili"),
            F.max(F.when(F.col("kind") == "ari", F.col("med"))).alias("med_ari"),
        )
    )
    winner = F.when(F.col("med_ari") > F.col("med_ili"), "ari").otherwise("ili")
    ratio = F.greatest("med_ili", "med_ari") / F.least("med_ili", "med_ari")
    return (
        facts.join(medians, "series_id", "left")
        .withColumn("winner", F.when(F.col("med_ili").isNotNull() & F.col("med_ari").isNotNull(), winner))
        .withColumn(
            "winner_weeks", F.when(F.col("winner") == "ari", F.col("n_ari")).when(F.col("winner") == "ili", F.col("n_ili"))
        )
        .withColumn(
            "winner_years",
            F.when(F.col("winner") == "ari", F.col("years_ari")).when(F.col("winner") == "ili", F.col("years_ili")),
        )
        .withColumn(
            "keep_only",
            F.when(
                (F.col("n_both") >= min_both)
                & (ratio > scale_ratio)
                & (F.col("winner_weeks") >= min_weeks)
                & (F.col("winner_years") >= min_years),
                F.col("winner"),
            ),
        )
    )


def combine_indicators(obs: DataFrame, profile: DataFrame | None = None, **guard) -> DataFrame:
    """(series_id, obs_date, cases, data_type): first indicator, second where the first is 0 or missing.

    A series with a single live indicator keeps all its rows. Where both are live, rows without
    a positive value go, and the guard may keep the larger-scale indicator only.
    """
    obs = obs.filter("series_id IS NOT NULL")
    facts = (profile if profile is not None else indicator_profile(obs, **guard)).select(
        "series_id", "n_ili", "n_ari", "keep_only"
    )
    fallback = (F.coalesce(F.col("ili"), F.lit(0.0)) == 0) & (F.col("ari") > 0)
    mode = (
        F.when((F.col("n_ili") > 0) & (F.col("n_ari") == 0), "only_ili")
        .when((F.col("n_ili") == 0) & (F.col("n_ari") > 0), "only_ari")
        .when(F.col("keep_only") == "ili", "guard_ili")
        .when(F.col("keep_only") == "ari", "guard_ari")
        .when(F.col("n_ili") > 0, "mixed")
    )
    use_ari = F.col("mode").isin("only_ari", "guard_ari") | ((F.col("mode") == "mixed") & F.coalesce(fallback, F.lit(False)))
    return (
        obs.join(facts, "series_id")
        .withColumn("mode", mode)
        .filter(F.col("mode").isNotNull())
        .withColumn("data_type", F.when(use_ari, 1).otherwise(0))
        .withColumn("cases", F.when(use_ari, F.col("ari")).otherwise(F.col("ili")))
        .filter(F.col("mode").isin("only_ili", "only_ari") | (F.col("cases") > 0))
        .select("series_id", "obs_date", "cases", "data_type")
    )


def has_data(summary: DataFrame, allowed: DataFrame | None = None) -> DataFrame:
    """Entities with any reported case, optionally restricted to an allow-list of names."""
    live = summary.filter((F.col("total_ili_cases") > 0) | (F.col("total_ari_cases") > 0))
    return live if allowed is None else live.join(allowed, "country", "left_semi")


def source_priority(sources: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Best source per series: combined, then ili, then ari; ties by path.

    A two-phase min over a struct, so no window has to hold a whole series.
    """
    ranks = F.create_map(
        *[F.lit(x) for i, k in enumerate(order or ["combined", "ili", "ari"]) for x in (k, i)]
    )
    ranked = sources.withColumn("rank", ranks[F.col("kind")])
    return (
        ranked.filter(F.col("rank").isNotNull())
        .groupBy("series_id")
        .agg(F.min(F.struct("rank", "path", "kind")).alias("best"))
        .select("series_id", "best.kind", "best.path")
    )


# --- grids --------------------------------------------------------------------------------


def daily_grid(series: DataFrame) -> DataFrame:
    """Every calendar day between the first and last observation; gaps are NULL."""
    span = series.groupBy("series_id").agg(
        F.min("obs_date").alias("d0"), F.max("obs_date").alias("d1")
    )
    grid = span.select(
        "series_id", F.explode(F.sequence("d0", "d1", F.expr("interval 1 day"))).alias("obs_date")
    )
    return grid.join(series, ["series_id", "obs_date"], "left")


def weekly_resample(series: DataFrame) -> DataFrame:
    """weekly(series_id, week, idx, value): mean per week, empty weeks as NULL rows.

    Rows are averaged per (series, week) before any window; gaps are then opened between
    neighbouring weeks, so neither a daily grid nor a separate calendar join is needed.
    """
    means = series.groupBy("series_id", week_end(F.col("obs_date")).alias("week")).agg(
        F.avg("cases").alias("value")
    )
    w = by_week("week")
    opened = means.select(
        "series_id",
        "value",
        F.col("week").alias("own_week"),
        F.first("week").over(w).alias("week0"),
        F.coalesce(F.date_sub(F.lead("week").over(w), 7), F.col("week")).alias("until"),
    )
    return opened.select(
        "series_id",
        "week0",
        "own_week",
        "value",
        F.explode(F.sequence("own_week", "until", F.expr("interval 7 day"))).alias("week"),
    ).select(
        "series_id",
        "week",
        (F.datediff("week", "week0") / 7).cast("int").alias("idx"),
        F.when(F.col("week") == F.col("own_week"), F.col("value")).alias("value"),
    )


def gap_profile(series: DataFrame, weekly: DataFrame) -> DataFrame:
    """Counts and percentages of missing cells on the daily and the weekly grid.

    The daily counts come from dates and non-null rows alone; the grid is not built. As on the
    joined grid, a day reported twice counts twice.
    """
    per_day = series.groupBy("series_id", "obs_date").agg(
        F.count("*").alias("n"), F.count("cases").alias("k")
    )
    days = per_day.groupBy("series_id").agg(
        (F.datediff(F.max("obs_date"), F.min("obs_date")) + 1 + F.sum(F.col("n") - 1)).alias("daily_total"),
        F.sum("k").alias("daily_present"),
    )
    weeks = weekly.groupBy("series_id").agg(
        F.count("*").alias("weekly_total"), F.count("value").alias("weekly_present")
    )
    def pct(kind: str) -> Column:
        return 100 * (F.col(f"{kind}_total") - F.col(f"{kind}_present")) / F.col(f"{kind}_total")

    return days.join(weeks, "series_id").select(
        "series_id",
        "daily_total",
        (F.col("daily_total") - F.col("daily_present")).alias("daily_missing"),
        pct("daily").alias("daily_missing_pct"),
        "weekly_total",
        (F.col("weekly_total") - F.col("weekly_present")).alias("weekly_missing"),
        pct("weekly").alias("weekly_missing_pct"),
    )


# --- cleaning -----------------------------------------------------------------------------


def zero_policy(weekly: DataFrame, mode: str = "floor", floor: float = fv.ZERO_FLOOR) -> DataFrame:
    """Zeros become a small floor value, stay, or become NULL (the training default)."""
    if mode == "keep":
        return weekly
    if mode not in ("floor", "null"):
        raise ValueError(f"unknown zero policy {mode!r}")
    other = F.lit(floor) if mode == "floor" else F.lit(None).cast("double")
    return weekly.withColumn("value", F.when(F.col("value") == 0, other).otherwise(F.col("value")))


def clip_outliers(weekly: DataFrame, iqr: bool = True, max_value: float | None = None) -> DataFrame:
    """Clip to q1 - 1.5 IQR .. q3 + 1.5 IQR of the non-null values, then to ``max_value``."""
    out = weekly
    value = F.col("value")
    if iqr:
        q = F.percentile("value", F.array(F.lit(0.25), F.lit(0.75))).over(whole_series())
        out = out.withColumn("_q", q)
        reach = 1.5 * (F.col("_q")[1] - F.col("_q")[0])
        value = F.greatest(F.least(value, F.col("_q")[1] + reach), F.col("_q")[0] - reach)
    if max_value is not None:
        value = F.least(value, F.lit(float(max_value)))
    # greatest/least skip NULLs, so missing cells are put back
    return out.withColumn("value", F.when(F.col("value").isNotNull(), value)).drop("_q")


def context_tail(weekly: DataFrame, length: int) -> DataFrame:
    """Last ``length`` points of every series."""
    last = F.max("idx").over(whole_series())
    return weekly.withColumn("_last", last).filter(F.col("idx") > F.col("_last") - length).drop("_last")


def undated_series(
    rows: DataFrame, value: str, order: str, chunk: int = 100_000, series: str = "series_id"
) -> DataFrame:
    """Positional series without dates; numeric ``order`` gives the position files have implicitly.

    Raw rows of one series can be any number, so positions are not taken from a window over the
    whole series: rows are counted per stretch of ``chunk`` order values, the (few) stretches are
    accumulated, and rows are numbered inside their stretch only.
    """
    cut = rows.select(
        F.col(series).alias("series_id"),
        F.col(order).alias("_o"),
        F.floor(F.col(order) / chunk).alias("_chunk"),
        F.col(value).cast("double").alias("value"),
    )
    sizes = cut.groupBy("series_id", "_chunk").agg(F.count("*").alias("_k"))
    before = sizes.withColumn(
        "_before",
        F.sum("_k").over(Window.partitionBy("series_id").orderBy("_chunk")) - F.col("_k"),
    ).drop("_k")
    inside = F.row_number().over(Window.partitionBy("series_id", "_chunk").orderBy("_o")) - 1
    return cut.withColumn("_pos", inside).join(before, ["series_id", "_chunk"]).select(
        "series_id",
        F.lit(None).cast("date").alias("week"),
        (F.col("_before") + F.col("_pos")).alias("idx"),
        "value",
    )


def train_test_split(weekly: DataFrame, test_share: float = 0.2) -> DataFrame:
    """Adds ``part``: the first int(n * (1 - share)) points train, the rest test."""
    first = F.min("idx").over(whole_series())
    n = F.count("*").over(whole_series())
    cut = F.floor(n * F.lit(1.0 - test_share))
    return weekly.withColumn("part", F.when(F.col("idx") - first < cut, "train").otherwise("test"))


def zero_runs_to_null(weekly: DataFrame, longest: int = fv.MAX_ZERO_RUN) -> DataFrame:
    """Zero runs longer than ``longest`` become NULL; a missing week ends a run."""
    zero = F.coalesce(F.col("value") == 0, F.lit(False))
    islands = weekly.withColumn("_zero", zero).withColumn(
        "_breaks", F.sum(F.when(F.col("_zero"), 0).otherwise(1)).over(by_week())
    )
    run = F.sum(F.col("_zero").cast("int")).over(Window.partitionBy("series_id", "_breaks"))
    return islands.withColumn(
        "value", F.when(~(F.col("_zero") & (run > longest)), F.col("value"))
    ).drop("_zero", "_breaks")


def trim_leading(
    weekly: DataFrame, share: float = fv.LEAD_SHARE, width: int = fv.LEAD_WINDOW
) -> DataFrame:
    """Drop the lead-in before the first forward window whose mean exceeds a share of the median.

    A series without such a window, or shorter than ``width`` + 1, is returned as it is.
    """
    level = F.percentile(F.when(F.col("value") > 0, F.col("value")), F.lit(0.5)).over(whole_series())
    ahead = F.avg("value").over(by_week().rowsBetween(0, width - 1))
    n = F.count("*").over(whole_series())
    first = F.min("idx").over(whole_series())
    scanned = weekly.select("*", level.alias("_level"), ahead.alias("_ahead"), n.alias("_n"), first.alias("_first"))
    hit = (F.col("_ahead") > F.col("_level") * share) & (F.col("idx") - F.col("_first") < F.col("_n") - width)
    start = F.coalesce(F.min(F.when(hit, F.col("idx"))).over(whole_series()), F.col("_first"))
    return (
        scanned.withColumn("_start", start)
        .filter(F.col("idx") >= F.col("_start"))
        .withColumn("idx", (F.col("idx") - F.col("_start")).cast("int"))
        .drop("_level", "_ahead", "_n", "_first", "_start")
    )


def clean_for_training(weekly: DataFrame, zeros: str = "null") -> DataFrame:
    """Zero policy, zero-run cleaning and lead-in trimming in the order training uses."""
    return trim_leading(zero_runs_to_null(zero_policy(weekly, zeros)))


# --- indicator flag -----------------------------------------------------------------------


def data_type_weekly(series: DataFrame, weekly: DataFrame) -> DataFrame:
    """weekly plus ``data_type_indicator``: daily fill forward then backward, weekly maximum.

    Within a week the filled daily flag takes the values reported that week and, for the days
    before the first report, the flag carried over from the last earlier report. So one row per
    reporting week is enough; the daily grid is never built.
    """
    monday = F.date_sub("week", 6)
    flags = (
        series.filter(F.col("data_type").isNotNull())
        .groupBy("series_id", week_end(F.col("obs_date")).alias("week"))
        .agg(
            F.min("obs_date").alias("first_day"),
            F.max("data_type").alias("top"),
            F.max(F.struct("obs_date", "data_type"))["data_type"].alias("closing"),
            F.min(F.struct("obs_date", "data_type"))["data_type"].alias("opening"),
        )
    )
    w = by_week("week")
    joined = weekly.join(flags, ["series_id", "week"], "left")
    carried = F.last("closing", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    very_first = F.min(
        F.when(F.col("opening").isNotNull(), F.struct("week", "opening"))
    ).over(whole_series())["opening"]
    full = joined.withColumns({"_carried": carried, "_opening": very_first})
    in_week = F.greatest(
        F.col("top"), F.when(F.col("first_day").isNull() | (F.col("first_day") > monday), F.col("_carried"))
    )
    return full.select(
        *weekly.columns,
        F.coalesce(in_week, F.col("_opening"), F.lit(0)).cast("double").alias("data_type_indicator"),
    )


def type_changes(series: DataFrame) -> DataFrame:
    """First day of every indicator switch with the names before and after.

    Distinct (series, day, type) first: the window then sees at most two rows per calendar day.
    """
    days = series.filter(F.col("data_type").isNotNull() & F.col("obs_date").isNotNull()).select(
        "series_id", "obs_date", "data_type"
    ).distinct()
    w = Window.partitionBy("series_id").orderBy("obs_date", "data_type")
    def name(c: Column) -> Column:
        return F.when(c == 1, "ARI").otherwise("ILI")

    return (
        days.withColumn("_prev", F.lag("data_type").over(w))
        .filter(F.col("_prev") != F.col("data_type"))
        .select(
            "series_id",
            F.col("obs_date").alias("date"),
            name(F.col("_prev")).alias("from_type"),
            name(F.col("data_type")).alias("to_type"),
        )
    )
