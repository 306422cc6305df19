"""Quality screening and training windows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriloom.functions import fixed_values as fv
from seriloom.functions.cells import count_where, median, rounded, share, sorted_quantile
from seriloom.operators.series import whole_series


def nan_pattern(weekly: DataFrame) -> DataFrame:
    """seasonal where gaps sit in the same calendar months every year, else sporadic."""
    months = weekly.groupBy("series_id", F.month("week").alias("month")).agg(
        share(F.col("value").isNull()).alias("missing")
    )
    return months.groupBy("series_id").agg(
        count_where(F.col("missing") < 0.2).alias("full_months"),
        count_where(F.col("missing") > 0.8).alias("empty_months"),
    ).withColumn(
        "pattern",
        F.when((F.col("full_months") >= 8) & (F.col("empty_months") >= 2), "seasonal").otherwise("sporadic"),
    )


def quality_screen(
    weekly: DataFrame,
    min_weeks: int = fv.MIN_WEEKS,
    min_years: float = fv.MIN_YEARS,
    max_missing: float = fv.MAX_MISSING_PCT,
    min_scale: float = fv.MIN_SCALE,
) -> DataFrame:
    """One row per cleaned series with its statistics, reasons for exclusion and the decision.

    Years and missing share are rounded to one place and the scale to two before they are
    compared, as the thresholds are stated on rounded figures.
    """
    value = F.col("value")
    stats = weekly.groupBy("series_id").agg(
        F.count("value").alias("n_weeks_nonnan"),
        rounded(100 * (1 - F.count("value") / F.count("*")), 1).alias("nan_pct"),
        rounded(F.datediff(F.max("week"), F.min("week")) / F.lit(365.25), 1).alias("years_coverage"),
        F.coalesce(rounded(median(F.when(value > 0, value)), 2), F.lit(0.0)).alias("scale"),
    )
    out = stats.join(nan_pattern(weekly).select("series_id", F.col("pattern").alias("nan_pattern")), "series_id")

    reasons = F.concat_ws(
        "; ",
        F.when(
            F.col("n_weeks_nonnan") < min_weeks,
            F.concat(F.lit("too_few_nonnan("), F.col("n_weeks_nonnan").cast("string"), F.lit(f"<{min_weeks})")),
        ),
        F.when(
            F.col("years_coverage") < min_years,
            F.concat(F.lit("too_short("), F.col("years_coverage").cast("string"), F.lit(f"yr<{min_years})")),
        ),
        F.when(
            (F.col("nan_pattern") == "sporadic") & (F.col("nan_pct") > max_missing),
            F.concat(F.lit("high_nan_sporadic("), F.col("nan_pct").cast("string"), F.lit(f"%>{max_missing:g}%)")),
        ),
        F.when(
            F.col("scale") < min_scale,
            F.concat(F.lit("too_small_scale("), F.col("scale").cast("string"), F.lit(f"<{min_scale})")),
        ),
    )
    return out.withColumn("exclude_reason", reasons).withColumn("include", F.col("exclude_reason") == "")


def screen_override(screen: DataFrame, excluded: DataFrame) -> DataFrame:
    """Manual exclusions win over the screen; ``excluded`` is a one-column table of series."""
    marks = excluded.select("series_id").distinct().withColumn("_out", F.lit(True))
    out = F.coalesce("_out", F.lit(False))
    return screen.join(marks, "series_id", "left").withColumns(
        {
            "include": F.col("include") & ~out,
            "exclude_reason": F.when(out, "manually excluded").otherwise(F.col("exclude_reason")),
        }
    ).drop("_out")


def training_list(screen: DataFrame) -> DataFrame:
    """Included series, sorted, with their kind: the rows of the training list.

    A sorted table instead of one collected array, so the list may be of any length.
    """
    return screen.filter("include").select("series_id", "data_type").orderBy("series_id")


def holdout_split(
    weekly: DataFrame,
    context: int = fv.CONTEXT_WEEKS,
    target: int = fv.TARGET_WEEKS,
    held_out: int = fv.HELD_OUT_WEEKS,
) -> DataFrame:
    """Per series: length, end of the training part, and whether the series is long enough."""
    return weekly.groupBy("series_id").agg(F.count("*").alias("n")).select(
        "series_id",
        "n",
        (F.col("n") - held_out).alias("train_end"),
        (F.col("n") >= context + target + held_out).alias("usable"),
    )


def peak_threshold(weekly: DataFrame, held_out: int = fv.HELD_OUT_WEEKS, level: float = fv.PEAK_LEVEL) -> DataFrame:
    """Quantile of the positive training values; infinite where there are none."""
    train = weekly.withColumn("_n", F.count("*").over(whole_series())).filter(
        F.col("idx") < F.col("_n") - held_out
    )
    q = F.percentile(F.when(F.col("value") > 0, F.col("value")), F.lit(level))
    return train.groupBy("series_id").agg(
        F.coalesce(q, F.lit(float("inf"))).alias("peak_threshold")
    )


def recency_repeats(window_end: Column, newest: Column, decay: float = fv.RECENCY_DECAY) -> Column:
    """1 to 3 copies by an exponential weight of the window's age in years."""
    weight = F.exp(-decay * F.datediff(newest, window_end) / F.lit(365.25))
    return F.when(weight >= 0.70, 3).when(weight >= 0.30, 2).otherwise(1)


def _series_arrays(weekly: DataFrame, covariates: list[str]) -> DataFrame:
    """One row per series with index-ordered arrays; a series is bounded by the calendar."""
    fields = ["idx", "week", "value", *covariates]
    return weekly.groupBy("series_id").agg(
        F.sort_array(F.collect_list(F.struct(*fields))).alias("rows")
    ).select("series_id", *[F.col(f"rows.{f}").alias(f"a_{f}") for f in fields[1:]], F.size("rows").alias("n"))


def build_windows(
    weekly: DataFrame,
    covariates: list[str] | None = None,
    context: int = fv.CONTEXT_WEEKS,
    target: int = fv.TARGET_WEEKS,
    stride: int = fv.STRIDE_WEEKS,
    held_out: int = fv.HELD_OUT_WEEKS,
    future_known: list[str] | None = None,
    part: str | None = None,
) -> DataFrame:
    """Training and validation windows of every usable series, or those of one ``part`` ("train", "val").

    (series_id, part, end_ctx, target, future, past_covariates, future_covariates, repeats):
    ``target`` holds the context, as training expects, and ``future`` the values to predict.
    Windows whose future is entirely missing are skipped. ``repeats`` carries the recency and
    peak weights; ``oversample`` turns it into copies.
    """
    if part not in (None, "train", "val"):
        raise ValueError("part must be 'train', 'val' or None")
    covs = covariates or []
    known = fv.FUTURE_KNOWN if future_known is None else future_known
    arrays = _series_arrays(weekly, covs).filter(F.col("n") >= context + target + held_out)
    positive_train = F.sort_array(
        F.filter(F.slice("a_value", F.lit(1), F.col("n") - held_out), lambda v: v > 0)
    )
    facts = arrays.withColumns(
        {
            "train_end": F.col("n") - held_out,
            "peak": F.coalesce(sorted_quantile(positive_train, fv.PEAK_LEVEL), F.lit(float("inf"))),
        }
    )

    def ends(first: Column, last: Column) -> Column:
        # an empty range must give no window, and sequence() would count backwards
        return F.when(last >= first, F.sequence(first, last, F.lit(stride))).otherwise(
            F.array().cast("array<int>")
        )

    train = F.transform(
        ends(F.lit(context), F.col("train_end") - target),
        lambda e: F.struct(F.lit("train").alias("part"), e.alias("end_ctx")),
    )
    valid = F.transform(
        ends(F.col("train_end"), F.col("n") - target),
        lambda e: F.struct(F.lit("val").alias("part"), e.alias("end_ctx")),
    )
    wanted = {"train": train, "val": valid}.get(part, F.concat(train, valid))

    def as_map(names: list[str], cut) -> Column:
        if not names:
            return F.create_map().cast("map<string, array<double>>")
        return F.map_from_arrays(
            F.array(*[F.lit(c) for c in names]),
            F.array(*[cut(f"a_{c}").cast("array<double>") for c in names]),
        )

    def window(w: Column) -> Column:
        end = w["end_ctx"]
        start = F.greatest(F.lit(0), end - context)

        def past(name: str) -> Column:
            return F.slice(name, start + 1, end - start)

        def ahead(name: str) -> Column:
            return F.slice(name, end + 1, F.lit(target))

        age = recency_repeats(F.element_at("a_week", end), F.element_at("a_week", F.col("train_end")))
        # array_max skips NULLs, so a half-missing future is judged on what it has
        is_peak = F.array_max(ahead("a_value")) > F.col("peak")
        repeats = F.when(w["part"] == "val", 1).otherwise(age * F.when(is_peak, fv.PEAK_REPEAT).otherwise(1))
        return F.struct(
            w["part"].alias("part"),
            end.alias("end_ctx"),
            past("a_value").alias("target"),
            ahead("a_value").alias("future"),
            as_map(covs, past).alias("past_covariates"),
            as_map([c for c in covs if c in known], ahead).alias("future_covariates"),
            repeats.alias("repeats"),
        )

    # windows are cut before they are exploded, so no window row carries a whole series
    cut = facts.select("series_id", "peak", F.explode(F.transform(wanted, window)).alias("w"))
    return cut.filter(F.exists("w.future", lambda v: v.isNotNull())).select("series_id", "w.*", "peak")


def oversample(windows: DataFrame) -> DataFrame:
    """Emit the copies that ``repeats`` stands for, numbered by ``copy``."""
    return windows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("repeats"))))


def detect_features(samples: DataFrame) -> DataFrame:
    """Covariate names present in any sample (distinct rows, not the first sample only)."""
    return samples.select(F.explode(F.map_keys("past_covariates")).alias("feature")).distinct()


def sample_counts(windows: DataFrame) -> DataFrame:
    """Per series: windows and emitted samples of both parts."""
    def total(part: str, c: Column) -> Column:
        return F.coalesce(F.sum(F.when(F.col("part") == part, c)), F.lit(0)).cast("bigint")

    one = F.lit(1)
    return windows.groupBy("series_id").agg(
        total("train", one).alias("train_windows"),
        total("train", F.col("repeats")).alias("train_samples"),
        total("val", one).alias("val_windows"),
    )
