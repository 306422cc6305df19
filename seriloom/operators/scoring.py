"""Scoring of rolling forecasts: WIS, coverage, errors, phases and peak timing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriloom.functions import fixed_values as fv
from seriloom.functions.cells import count_where, median, ratio, rounded, share
from seriloom.functions.scores import at_level, covered, weighted_interval_score
from seriloom.operators.percentiles import grouped_percentiles
from seriloom.operators.series import by_week

PHASES = ["growth", "peak_window", "decay"]


# --- peaks and phases ---------------------------------------------------------------------


def find_peaks(
    weekly: DataFrame,
    distance: int = fv.PEAK_DISTANCE,
    prominence: float = fv.PEAK_PROMINENCE,
) -> DataFrame:
    """(series_id, idx, height, prominence) of seasonal peaks.

    ``weekly`` must carry ``threshold``. Missing values count as zero. Height is checked first,
    then distance (higher peaks win, later ones among equals), then prominence relative to the
    threshold. Plateaus are islands of equal values; they peak in the middle.
    """
    w = by_week()
    v = weekly.select("series_id", "idx", "threshold", F.coalesce("value", F.lit(0.0)).alias("v"))
    runs = (
        v.withColumn("_new", F.coalesce(F.col("v") != F.lag("v").over(w), F.lit(True)).cast("int"))
        .withColumn("run", F.sum("_new").over(w))
        .groupBy("series_id", "run")
        .agg(
            F.min("idx").alias("first"),
            F.max("idx").alias("last"),
            F.max("v").alias("v"),
            F.max("threshold").alias("threshold"),
        )
    )
    # one array of runs per series (bounded by the calendar) carries all later steps
    series = runs.groupBy("series_id").agg(
        F.sort_array(F.collect_list(F.struct("first", "last", "v"))).alias("runs"),
        F.max("threshold").alias("threshold"),
    )
    # kept whole: a summit is a run strictly above both neighbours; the ends never qualify
    summits = F.filter(
        F.transform(
            "runs",
            lambda r, i: F.struct(
                r["v"].alias("v"),
                F.floor((r["first"] + r["last"]) / 2).cast("int").alias("idx"),
                i.alias("at"),
                (
                    (i > 0)
                    & (i < F.size("runs") - 1)
                    & (F.get("runs", i - 1)["v"] < r["v"])
                    & (F.get("runs", i + 1)["v"] < r["v"])
                    & (r["v"] >= F.col("threshold"))
                ).alias("ok"),
            ),
        ),
        lambda s: F.coalesce(s["ok"], F.lit(False)),
    )
    ranked = F.sort_array("summits", asc=False)  # by height, then position, both descending
    none = F.filter("ranked", lambda s: F.lit(False))
    spaced = F.aggregate(
        "ranked",
        F.col("none"),
        lambda kept, s: F.when(
            F.forall(kept, lambda k: F.abs(k["idx"] - s["idx"]) >= distance),
            F.array_append(kept, s),
        ).otherwise(kept),
    )
    peaks = (
        series.withColumn("summits", summits)
        .withColumn("ranked", ranked)
        .withColumn("none", none)
        .select("series_id", "runs", "threshold", F.explode(spaced).alias("p"))
        .select("series_id", "runs", "threshold", "p.idx", "p.at", F.col("p.v").alias("height"))
    )
    heights = F.col("runs.v")

    def base(part: Column) -> Column:
        # lowest value on the way to the first strictly higher run (part starts at the peak)
        stop = F.array_position(F.transform(part, lambda x: x > F.col("height")), True)
        return F.array_min(F.when(stop > 0, F.slice(part, F.lit(1), stop.cast("int") - 1)).otherwise(part))

    left = F.reverse(F.slice(heights, F.lit(1), F.col("at") + 1))
    right = F.slice(heights, F.col("at") + 1, F.size("runs") - F.col("at"))
    return (
        peaks.withColumn("prominence", F.col("height") - F.greatest(base(left), base(right)))
        .filter(F.col("prominence") >= F.col("threshold") * prominence)
        .select("series_id", "idx", "height", "prominence")
    )


def phase_labels(weekly: DataFrame, peaks: DataFrame, reach: int = fv.PEAK_WINDOW) -> DataFrame:
    """weekly plus ``phase``: off_season, growth, peak_window or decay.

    The few peaks of a series travel as one array, joined on the series alone: both sides are
    already partitioned by series, and the nearest peak before and after a row is row-local.
    """
    lists = peaks.groupBy("series_id").agg(F.collect_list("idx").alias("_peaks"))
    marked = weekly.join(lists, "series_id", "left")
    since = F.col("idx") - F.array_max(F.filter("_peaks", lambda p: p <= F.col("idx")))
    until = F.array_min(F.filter("_peaks", lambda p: p >= F.col("idx"))) - F.col("idx")
    marked = marked.withColumns({"_since": since, "_until": until})
    since, until = F.col("_since"), F.col("_until")
    phase = (
        F.when(F.col("value").isNull() | (F.col("value") < F.col("threshold")), "off_season")
        .when((since <= reach) | (until <= reach), "peak_window")
        .when(until.isNotNull() & (since.isNull() | (until <= since)), "growth")
        .when(since.isNotNull(), "decay")
        .otherwise("growth")
    )
    return marked.withColumn("phase", phase).drop("_peaks", "_since", "_until")


# --- scores -------------------------------------------------------------------------------


def score_horizons(
    points: DataFrame,
    model: str,
    baseline: str | None = None,
    levels: list[float] | None = None,
    intervals: list[tuple[float, float, float]] | None = None,
    outer: tuple[float, float] = (0.025, 0.975),
) -> DataFrame:
    """One row per (series, cutoff, h) with all scores; row-local, no shuffle.

    Steps whose actual is missing or off-season are skipped, as are steps without a forecast.
    """
    lv = levels or fv.LEVELS_7
    iv = intervals or fv.INTERVALS_7
    fields = ["actuals", "actual_weeks", model]
    if baseline:
        fields.append(baseline)
    if "phases" in points.columns:
        fields.append("phases")
    # a NULL array would make the whole zip NULL; an empty one is padded with NULLs
    whole = [F.coalesce(F.col(f), F.array()).alias(f) for f in fields]
    padded = points.select("series_id", "cutoff", "threshold", *whole)
    rows = padded.select(
        "series_id", "cutoff", "threshold", F.posexplode(F.arrays_zip(*fields)).alias("p", "e")
    )
    actual, q = F.col("e.actuals"), F.col(f"e.{model}")
    mid = at_level(q, lv, 0.5)
    ae = F.abs(mid - actual)
    out = [
        "series_id",
        "cutoff",
        (F.col("p") + 1).alias("h"),
        F.col("e.actual_weeks").alias("week"),
        actual.alias("actual"),
        mid.alias("median"),
        weighted_interval_score(actual, q, lv, iv).alias("wis"),
        ae.alias("ae"),
        F.when(actual > 0, ae / actual).alias("ape"),
        covered(actual, q, lv, 0.25, 0.75).cast("int").alias("cov50"),
        covered(actual, q, lv, *outer).cast("int").alias("cov_outer"),
    ]
    if baseline:
        out.append(weighted_interval_score(actual, F.col(f"e.{baseline}"), lv, iv).alias("baseline_wis"))
    if "phases" in points.columns:
        out.append(F.col("e.phases").alias("phase"))
    return rows.filter(actual.isNotNull() & (actual >= F.col("threshold")) & q.isNotNull()).select(*out)


def relative_wis(scores: DataFrame, keys: list[str]) -> DataFrame:
    """Mean WIS over mean baseline WIS per key; NULL where either mean is zero or missing."""
    m = scores.groupBy(*keys).agg(F.avg("wis").alias("mean_wis"), F.avg("baseline_wis").alias("mean_baseline_wis"))
    return m.withColumn(
        "relative_wis", F.when(F.col("mean_wis") != 0, ratio(F.col("mean_wis"), F.col("mean_baseline_wis")))
    )


def horizon_rwis(scores: DataFrame) -> DataFrame:
    """Ratio per (series, h), only where every scored step also has a baseline score."""
    g = scores.groupBy("series_id", "h").agg(
        F.count("wis").alias("n"),
        F.count("baseline_wis").alias("n_baseline"),
        F.avg("wis").alias("mean_wis"),
        F.avg("baseline_wis").alias("mean_baseline_wis"),
    )
    ok = (F.col("n") == F.col("n_baseline")) & (F.col("mean_baseline_wis") > 0)
    return g.withColumn("rwis", F.when(ok, F.col("mean_wis") / F.col("mean_baseline_wis")))


def phase_mape(scores: DataFrame) -> DataFrame:
    """Mean absolute percentage error and count per (series, phase), the phase of the scored row."""
    return (
        scores.filter(F.col("phase").isin(PHASES))
        .groupBy("series_id", "phase")
        .agg((100 * F.avg("ape")).alias("mape_pct"), F.count("*").alias("n_points"))
    )


def first_maximum(values: Column) -> Column:
    return F.array_position(values, F.array_max(values))


def peak_timing(
    points: DataFrame, model: str, levels: list[float] | None = None, significance: float = fv.PEAK_SIGNIFICANCE
) -> DataFrame:
    """(series_id, cutoff, error): forecast peak position minus actual one inside the window.

    Positive means too late. Windows with a missing value or without a significant maximum
    do not count.
    """
    lv = levels or fv.LEVELS_7
    path = F.transform(model, lambda q: at_level(q, lv, 0.5))
    actual = F.col("window_actuals")
    ok = (
        F.forall(actual, lambda v: v.isNotNull())
        & F.forall(path, lambda v: v.isNotNull())
        & (F.array_max(actual) >= F.col("threshold") * significance)
    )
    return points.filter(F.col(model).isNotNull() & ok).select(
        "series_id", "cutoff", (first_maximum(path) - first_maximum(actual)).cast("int").alias("error")
    )


def metrics_per_series(series: DataFrame, scores: DataFrame, timing: DataFrame | None = None) -> DataFrame:
    """One row per series with the rounded figures of the evaluation document.

    Series without a scored step keep their row: counts are 0 and figures NULL.
    """
    m = scores.groupBy("series_id").agg(
        rounded(100 * F.avg("ape"), 2).alias("mape_pct"),
        rounded(100 * median(F.col("ape")), 2).alias("median_error_pct"),
        rounded(F.avg("ae"), 4).alias("mae"),
        rounded(F.avg("wis"), 4).alias("wis"),
        rounded(
            F.when(F.avg("wis") != 0, F.avg("wis") / F.nullif(F.avg("baseline_wis"), F.lit(0.0))), 3
        ).alias("relative_wis"),
        rounded(100 * F.avg("cov50"), 1).alias("coverage_50"),
        rounded(100 * F.avg("cov_outer"), 1).alias("coverage_95"),
        F.count("*").alias("n_eval_points"),
    )
    out = series.join(m, "series_id", "left")
    if timing is not None:
        p = timing.groupBy("series_id").agg(
            rounded(F.avg(F.abs("error")), 2).alias("peak_timing_mae_weeks"),
            rounded(F.avg("error"), 2).alias("peak_timing_bias_weeks"),
            F.count("*").alias("n_peak_timing_points"),
        )
        out = out.join(p, "series_id", "left").fillna(0, ["n_peak_timing_points"])
    return out.fillna(0, ["n_eval_points"])


def metrics_document(metrics: DataFrame, scores: DataFrame) -> DataFrame:
    """metrics plus the nested maps: per-horizon ratios and per-phase errors."""
    h = horizon_rwis(scores).groupBy("series_id").agg(
        F.map_from_entries(
            F.sort_array(F.collect_list(F.struct(F.col("h").cast("string"), rounded("rwis", 4))))
        ).alias("per_horizon_rwis")
    )
    p = phase_mape(scores).groupBy("series_id").agg(
        F.map_from_entries(
            F.sort_array(
                F.collect_list(
                    F.struct("phase", F.struct(rounded("mape_pct", 2).alias("mape_pct"), "n_points").alias("v"))
                )
            )
        ).alias("phase_mape")
    )
    return metrics.join(h, "series_id", "left").join(p, "series_id", "left")


def horizon_table(scores: DataFrame) -> DataFrame:
    """Per horizon and in total: counts, mean scores, ratio, error and coverage (rollup)."""
    g = scores.rollup("h").agg(
        F.count("*").alias("n"),
        F.avg("wis").alias("mean_wis"),
        F.avg("baseline_wis").alias("mean_baseline_wis"),
        F.avg("ae").alias("mae"),
        (100 * F.avg("cov50")).alias("cov50_pct"),
        (100 * F.avg("cov_outer")).alias("cov_outer_pct"),
        F.grouping("h").alias("_all"),
    )
    return g.select(
        F.when(F.col("_all") == 1, "ALL").otherwise(F.col("h").cast("string")).alias("horizon"),
        "n",
        "mean_wis",
        "mean_baseline_wis",
        F.when(F.col("mean_baseline_wis") > 0, F.col("mean_wis") / F.col("mean_baseline_wis")).alias("rwis"),
        "mae",
        "cov50_pct",
        "cov_outer_pct",
    )


def overall_summary(metrics: DataFrame) -> DataFrame:
    """(metric, mean, median, n, n_below_1) over all series.

    Medians run over every series at once, so they use the bucketed exact percentile.
    """
    names = ["mape_pct", "wis", "relative_wis", "coverage_50", "coverage_95"]
    if "peak_timing_mae_weeks" in metrics.columns:
        names.append("peak_timing_mae_weeks")
    long = metrics.select(
        F.explode(
            F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("v")) for n in names])
        ).alias("e")
    ).select("e.metric", "e.v").filter("v IS NOT NULL")
    flat = long.groupBy("metric").agg(
        F.avg("v").alias("mean"), F.count("*").alias("n"), count_where(F.col("v") < 1.0).alias("n_below_1")
    )
    mid = grouped_percentiles(long, ["metric"], "v", {"median": 0.5})
    return flat.join(mid, "metric").select(
        "metric",
        "mean",
        "median",
        "n",
        F.when(F.col("metric") == "relative_wis", F.col("n_below_1")).alias("n_below_1"),
    )


def mean_over_series(per_key: DataFrame, key: str, value: str) -> DataFrame:
    """Second-level mean of a per-series figure by horizon or phase."""
    return per_key.filter(F.col(value).isNotNull()).groupBy(key).agg(
        F.avg(value).alias(f"mean_{value}"), F.count("*").alias("n_series")
    )


def leaderboard(metrics: DataFrame) -> DataFrame:
    """Series by relative WIS, those without one (or with 0) last; ties by name."""
    return metrics.withColumn(
        "sort_key", F.coalesce(F.nullif(F.col("relative_wis"), F.lit(0.0)), F.lit(999.0))
    ).orderBy("sort_key", "series_id")


def coverage_table(scores: DataFrame, keys: list[str]) -> DataFrame:
    return scores.groupBy(*keys).agg(
        share(F.col("cov50") == 1).alias("coverage_50"),
        share(F.col("cov_outer") == 1).alias("coverage_outer"),
        F.count("*").alias("n"),
    )


def point_errors(scores: DataFrame, keys: list[str]) -> DataFrame:
    """Mean absolute error, mean and median absolute percentage error per key."""
    flat = scores.groupBy(*keys).agg(
        F.avg("ae").alias("mae"), (100 * F.avg("ape")).alias("mape_pct"), F.count("ape").alias("n")
    )
    mid = grouped_percentiles(scores, keys, "ape", {"median_ape": 0.5})
    return flat.join(mid, keys, "left").withColumn("median_error_pct", 100 * F.col("median_ape")).drop("median_ape")
