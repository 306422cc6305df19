"""Rolling evaluation of a forecaster against the random-walk baseline."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame

from seriloom.functions import fixed_values as fv
from seriloom.functions.storage import cut_lineage
from seriloom.operators import forecast as fc
from seriloom.operators import scoring as so
from seriloom.operators import series as se

Forecaster = Callable[[DataFrame], DataFrame]


@dataclass
class Evaluation:
    scores: DataFrame
    metrics: DataFrame
    summary: DataFrame
    by_horizon: DataFrame
    by_phase: DataFrame
    leaderboard: DataFrame


def rolling_evaluation(
    weekly: DataFrame,
    model: str = "seasonal_naive",
    forecaster: Forecaster = fc.seasonal_naive_quantiles,
    horizon: int = fv.HORIZON,
    window: int = fv.SEASON_WEEKS,
    n_paths: int = fv.N_PATHS,
    start: Column | None = None,
    end: Column | None = None,
    target_offset: int = 1,
    season_percentile: float = fv.SEASON_PERCENTILE,
) -> Evaluation:
    """Score ``forecaster`` at every rolling cutoff of every series.

    ``forecaster`` adds a column named ``model`` with one quantile array (levels of ``LEVELS_7``)
    per horizon. Scores are written once and read by all summaries.
    """
    base = fc.with_threshold(se.zero_policy(weekly, "floor"), season_percentile)
    phased = so.phase_labels(base, so.find_peaks(base))
    points = fc.rolling_points(
        phased, horizon=horizon, window=window, start=start, end=end, target_offset=target_offset
    )
    points = cut_lineage(forecaster(fc.random_walk_quantiles(points, horizon=horizon, n_paths=n_paths)))
    scores = cut_lineage(so.score_horizons(points, model, "random_walk"))
    names = weekly.select("series_id").distinct()
    metrics = so.metrics_per_series(names, scores, so.peak_timing(points, model))
    return Evaluation(
        scores=scores,
        metrics=so.metrics_document(metrics, scores),
        summary=so.overall_summary(metrics),
        by_horizon=so.horizon_table(scores),
        by_phase=so.mean_over_series(so.phase_mape(scores), "phase", "mape_pct"),
        leaderboard=so.leaderboard(metrics),
    )
