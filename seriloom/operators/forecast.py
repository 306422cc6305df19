"""Probabilistic forecasts for every series and every rolling cutoff at once.

``rolling_points`` makes one pass over the weekly table (one exchange, one sort), holds each series as
one array in time order, and puts everything an evaluated cutoff needs on a row of its own: last value, pools
of past differences, values a season ago, and the actuals to be scored. Forecasting and scoring are then row-local.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriloom.functions import fixed_values as fv
from seriloom.functions.cells import levels_of, pool_quantiles
from seriloom.operators.series import by_week, whole_series


def season_threshold(weekly: DataFrame, percentile: float = fv.SEASON_PERCENTILE) -> DataFrame:
    """Off-season level per series: a percentile of the positive values, 1.0 if there are none."""
    q = F.percentile(F.when(F.col("value") > 0, F.col("value")), F.lit(percentile / 100.0))
    return weekly.groupBy("series_id").agg(F.coalesce(q, F.lit(1.0)).alias("threshold"))


def with_threshold(weekly: DataFrame, percentile: float = fv.SEASON_PERCENTILE) -> DataFrame:
    q = F.percentile(F.when(F.col("value") > 0, F.col("value")), F.lit(percentile / 100.0))
    return weekly.withColumn("threshold", F.coalesce(q.over(whole_series()), F.lit(1.0)))


def symmetric(pool: Column) -> Column:
    """Differences followed by their negatives."""
    return F.concat(pool, F.transform(pool, lambda d: -d))


def in_order(rows: DataFrame) -> DataFrame:
    """One row per series with each column as an array in time order: at most one element a week."""
    names = [c for c in rows.columns if c not in ("series_id", "idx")]
    packed = rows.groupBy("series_id").agg(
        F.sort_array(F.collect_list(F.struct("idx", *[F.col(f"`{c}`") for c in names]))).alias("_rows")
    )
    return packed.select("series_id", *[F.col("_rows")[c].alias(c) for c in ["idx", *names]])


def stretch(column: str, end: Column, length: int | None) -> Column:
    """Known values among the ``length`` elements of an array before position ``end`` (None: all of them)."""
    first = F.lit(0) if length is None else F.greatest(end - length, F.lit(0))
    return F.array_compact(F.slice(column, first + 1, end - first))


def diff_pool(weekly: DataFrame, history: int | None = fv.HISTORY_WEEKS) -> DataFrame:
    """(series_id, cutoff, last_value, pool): symmetric one-step differences before each cutoff.

    Cutoff c uses the rows before c; pools with fewer than four differences are left out. Every pool is a
    stretch of the series' one array, so no frame slides over the rows.
    """
    steps = weekly.select("series_id", "idx", "value", (F.col("value") - F.lag("value").over(by_week())).alias("d"))
    series = in_order(steps)
    at = F.col("at")
    cuts = series.select("*", F.posexplode("value").alias("at", "last_value")).filter("last_value IS NOT NULL")
    pooled = cuts.select("series_id", (F.get("idx", at) + 1).alias("cutoff"), "last_value", stretch("d", at + 1, history).alias("pool"))
    return pooled.filter(F.size("pool") >= fv.MIN_POOL).withColumn("pool", symmetric(F.col("pool")))


def rolling_points(
    weekly: DataFrame,
    horizon: int = fv.HORIZON,
    window: int = fv.SEASON_WEEKS,
    min_context: int = fv.MIN_CONTEXT,
    history: int | None = fv.HISTORY_WEEKS,
    start: Column | None = None,
    end: Column | None = None,
    target_offset: int = 1,
    threshold: bool = True,
) -> DataFrame:
    """One row per evaluated target row t with cutoff c = t - horizon.

    ``target_offset`` 1 scores step h against row c + h, 0 against row c + h - 1 (the row the
    step actually predicts). Rows whose target is missing or off-season, or whose last context
    value is missing, are not evaluated. Extra columns of ``weekly`` (such as ``phase``) are
    carried as arrays next to the actuals.

    The columns of a series become arrays in time order; the evaluated rows are picked first, and only
    for them are pools cut out of the arrays, as stretches of any length. ``start`` and ``end`` are literals.
    """
    w = by_week()
    H = horizon
    base = weekly if "threshold" in weekly.columns else with_threshold(weekly)
    lags = {"_ds": fv.SEASON_WEEKS, **{f"_d{h}": h for h in range(1, H + 1)}}
    steps = base.withColumns({name: F.col("value") - F.lag("value", k).over(w) for name, k in lags.items()})
    series = in_order(steps)
    at = F.col("_at")
    n = F.size("value")
    hs = range(1, H + 1)
    scored_at = [H - h + (1 - target_offset) for h in hs]

    def back(column: str, steps: int, here: Column = at) -> Column:
        return F.get(f"`{column}`", here - steps)

    def evaluated(here: Column) -> Column:
        keep = back("value", 0, here).isNotNull() & back("value", H + 1, here).isNotNull()
        if threshold:
            keep = keep & (back("value", 0, here) >= back("threshold", 0, here))
        if start is not None:
            keep = keep & (back("week", 0, here) >= start)
        if end is not None:
            keep = keep & (back("week", 0, here) <= end)
        return keep

    first = F.greatest(F.lit(min_context + H), n - window)
    picked = F.when(first < n, F.filter(F.sequence(first, F.greatest(n - 1, first)), evaluated))
    points = series.select("*", F.explode(picked).alias("_at"))
    names = {"idx": "t", "value": "target_value"}
    columns = {names.get(c, c): back(c, 0) for c in base.columns if c != "series_id"}
    columns |= {
        "last_value": back("value", H + 1),
        "pool": stretch("_d1", at - H, history),
        "season_pool": stretch("_ds", at - H, history),
        "step_pools": F.array(*[stretch(f"_d{h}", at - H, history) for h in hs]),
        "season_base": F.array(*[back("value", H - h + 1 + fv.SEASON_WEEKS) for h in hs]),
        "actuals": F.array(*[back("value", s) for s in scored_at]),
        "actual_weeks": F.array(*[back("week", s) for s in scored_at]),
        "window_actuals": F.array(*[back("value", H - h + 1) for h in hs]),
        "cutoff": back("idx", 0) - H,
    }
    if "phase" in base.columns:
        columns["phases"] = F.array(*[back("phase", s) for s in scored_at])
    return points.select("series_id", *[c.alias(name) for name, c in columns.items()])


# --- forecasters --------------------------------------------------------------------------


def draw_seed(*keys: Column) -> Column:
    """32-bit seed from a row's keys; the same under any partitioning."""
    text = F.concat_ws("|", *[k.cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def _walk_udf(levels: list[float], horizon: int, n_paths: int):
    path_part = np.arange(1, n_paths + 1, dtype=np.uint64) * np.uint64(0x9E3779B1)
    step_part = np.arange(1, horizon + 1, dtype=np.uint64) * np.uint64(0x85EBCA77)
    grid = path_part[:, None] + step_part[None, :]

    def mixed(x):
        # integer finaliser on 32 bits: two rounds of shift-xor-multiply and a last shift-xor
        mask = np.uint64(0xFFFFFFFF)
        for _ in range(2):
            x = ((x >> np.uint64(16)) ^ x) * np.uint64(0x45D9F3B) & mask
        return (x >> np.uint64(16)) ^ x

    @F.pandas_udf("array<array<double>>")
    def walk(last: pd.Series, pool: pd.Series, seed: pd.Series) -> pd.Series:
        out = []
        for v, d, s in zip(last, pool, seed):
            if d is None or len(d) == 0 or v is None or np.isnan(v):
                out.append(None)
                continue
            d = np.asarray(d, dtype=float)
            pick = mixed((grid + np.uint64(s)) & np.uint64(0xFFFFFFFF)) % np.uint64(len(d))
            ends = np.maximum(v + np.cumsum(d[pick.astype(np.int64)], axis=1), 0.0)
            q = np.quantile(ends, levels, axis=0).T
            q[0] = np.quantile(np.maximum(v + d, 0.0), levels)  # one step is exact
            out.append(q.tolist())
        return pd.Series(out, dtype=object)

    # the optimizer must neither copy the simulation nor move it below the repartition
    return walk.asNondeterministic()


def random_walk_quantiles(
    points: DataFrame,
    levels: list[float] | None = None,
    horizon: int = fv.HORIZON,
    n_paths: int = fv.N_PATHS,
    name: str = "random_walk",
) -> DataFrame:
    """Adds ``name``: per horizon, quantiles of last value plus sampled symmetric increments.

    Draws are hashes of (series, cutoff, path, step), so results do not depend on partitioning,
    retries or row order. Step 1 is the exact quantile of the pool. The simulation is the one
    place where a row needs thousands of numbers: it runs vectorised on Arrow batches, row by
    row, with memory bounded by n_paths x horizon.
    """
    lv = levels or fv.LEVELS_7
    pool = F.when(F.size("pool") >= fv.MIN_POOL, symmetric(F.col("pool")))
    udf = _walk_udf(lv, horizon, n_paths)
    # a row is small but costs n_paths x horizon draws: spread rows by count, not by bytes
    tasks = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return points.repartition(tasks, "series_id", "cutoff").withColumn(
        name, udf(F.col("last_value"), pool, draw_seed(F.col("series_id"), F.col("cutoff")))
    )


def seasonal_naive_quantiles(
    points: DataFrame, levels: list[float] | None = None, name: str = "seasonal_naive"
) -> DataFrame:
    """Value of the same week a season ago plus quantiles of past season-on-season changes."""
    lv = levels or fv.LEVELS_7
    enough = F.size("season_pool") >= fv.MIN_POOL
    spread = F.when(enough, pool_quantiles(F.col("season_pool"), lv))
    return points.withColumn("_spread", spread).withColumn(
        name,
        F.transform(
            "season_base",
            lambda b: F.when(
                b.isNotNull() & F.col("_spread").isNotNull(),
                F.transform("_spread", lambda r: F.greatest(F.lit(0.0), b + r)),
            ),
        ),
    ).drop("_spread")


def direct_step_quantiles(
    points: DataFrame, levels: list[float] | None = None, name: str = "direct_step"
) -> DataFrame:
    """Last value plus quantiles of symmetric h-step differences: the pool of each step itself."""
    lv = levels or fv.LEVELS_7
    last = F.col("last_value")
    return points.withColumn(
        name,
        F.transform(
            "step_pools",
            lambda p: F.when(
                F.size(p) >= fv.MIN_POOL,
                F.transform(pool_quantiles(symmetric(p), lv), lambda r: F.greatest(F.lit(0.0), last + r)),
            ),
        ),
    )


def long_quantiles(points: DataFrame, model: str, levels: list[float] | None = None) -> DataFrame:
    """(series_id, cutoff, h, level, value) of one model column."""
    lv = levels or fv.LEVELS_7
    per_h = points.select("series_id", "cutoff", F.posexplode(model).alias("p", "q")).filter("q IS NOT NULL")
    pairs = per_h.select(
        "series_id",
        "cutoff",
        (F.col("p") + 1).alias("h"),
        F.explode(F.arrays_zip(levels_of(lv).alias("level"), F.col("q").alias("value"))).alias("e"),
    )
    return pairs.select("series_id", "cutoff", "h", "e.level", "e.value")


def level_positions(long: DataFrame) -> DataFrame:
    """Long quantiles to one row per (series, cutoff, h) with arrays sorted by level."""
    return (
        long.groupBy("series_id", "cutoff", "h")
        .agg(F.sort_array(F.collect_list(F.struct("level", "value"))).alias("e"))
        .select("series_id", "cutoff", "h", F.col("e.level").alias("levels"), F.col("e.value").alias("q"))
    )


def forecast_origin(weekly: DataFrame, horizon: int = fv.HORIZON, history: int | None = fv.HISTORY_WEEKS) -> DataFrame:
    """One row per series at its end, with the inputs of the forecasters (cutoff = length)."""
    w = by_week()
    lags = {"_d1": 1, "_ds": fv.SEASON_WEEKS, **{f"_d{h}": h for h in range(2, horizon + 1)}}
    steps = weekly.select(
        "series_id",
        "week",
        "idx",
        "value",
        F.max("idx").over(whole_series()).alias("_last"),
        *[(F.col("value") - F.lag("value", k).over(w)).alias(n) for n, k in lags.items()],
    )
    # only the end of the series is wanted, so the pools are plain aggregates, not sliding frames
    recent = F.lit(True) if history is None else F.col("idx") > F.col("_last") - history

    def pool(name: str) -> Column:
        kept = F.when(recent & F.col(name).isNotNull(), F.struct("idx", F.col(name).alias("d")))
        return F.sort_array(F.collect_list(kept))["d"]

    def at(offset: int) -> Column:
        return F.max(F.when(F.col("idx") == F.col("_last") - offset, F.col("value")))

    hs = range(1, horizon + 1)
    return steps.groupBy("series_id").agg(
        F.max("week").alias("week"),
        (F.max("idx") + 1).alias("cutoff"),
        at(0).alias("last_value"),
        pool("_d1").alias("pool"),
        pool("_ds").alias("season_pool"),
        F.array(*[pool(f"_d{h}") for h in hs]).alias("step_pools"),
        F.array(*[at(fv.SEASON_WEEKS - h) for h in hs]).alias("season_base"),
    )


def forecast_layout(
    weekly: DataFrame, origin: DataFrame, model: str, levels: list[float] | None = None
) -> DataFrame:
    """Context rows, then forecast rows: (series_id, time, context, mean_forecast, q array).

    ``mean_forecast`` is the median of the quantile forecast; a series without a forecast has its rows with NULL.
    """
    lv = levels or fv.LEVELS_9
    blank = F.lit(None).cast("array<double>")
    history = weekly.select(
        "series_id",
        F.col("idx").alias("time"),
        F.col("value").alias("context"),
        F.lit(None).cast("double").alias("mean_forecast"),
        blank.alias("q"),
    )
    mid = [round(x, 3) for x in lv].index(0.5) + 1
    unknown = F.array_repeat(blank, F.size("step_pools"))
    ahead = origin.select("series_id", "cutoff", F.posexplode(F.coalesce(model, unknown)).alias("p", "q")).select(
        "series_id",
        (F.col("cutoff") + F.col("p")).alias("time"),
        F.lit(None).cast("double").alias("context"),
        F.element_at("q", mid).alias("mean_forecast"),
        "q",
    )
    return history.unionByName(ahead)
