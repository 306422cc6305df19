"""Training data: screen the series, cut windows, write samples."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriloom.functions import fixed_values as fv
from seriloom.functions.storage import cut_lineage
from seriloom.operators import covariates as cv
from seriloom.operators import screening as sc
from seriloom.operators import series as se


@dataclass
class TrainingSet:
    screen: DataFrame
    windows: DataFrame
    counts: DataFrame


def prepare_training(
    series: DataFrame,
    excluded: DataFrame | None = None,
    covariates: list[str] | None = None,
    latitudes: DataFrame | None = None,
    weather: DataFrame | None = None,
    neighbors: DataFrame | None = None,
    **sizes,
) -> TrainingSet:
    """``series`` is (series_id, obs_date, cases, data_type); ``covariates`` any of data_type,
    hemisphere, week_of_year, weather and neighbors, each with its table: ``latitudes``
    (series_id, hemisphere), ``weather`` (series_id, week, features as made by ``weather_weekly``) and
    ``neighbors`` (src, dst, rank) with resolved names.
    """
    wanted = covariates or []
    unknown = set(wanted) - set(fv.COVARIATES)
    if unknown:
        raise ValueError(f"unknown covariates: {sorted(unknown)}")
    weekly = se.weekly_resample(series)
    if "data_type" in wanted:
        weekly = se.data_type_weekly(series, weekly)
    clean = se.clean_for_training(weekly)
    names = ["data_type_indicator"] if "data_type" in wanted else []
    if "week_of_year" in wanted:
        clean = cv.week_sincos(clean)
        names += ["week_sin", "week_cos"]
    if "hemisphere" in wanted:
        if latitudes is None:
            raise ValueError("hemisphere needs the latitudes table")
        clean = clean.join(latitudes.select("series_id", "hemisphere"), "series_id", "left").fillna(
            0.0, ["hemisphere"]
        )
        names.append("hemisphere")
    if "weather" in wanted:
        if weather is None:
            raise ValueError("weather needs the weekly weather table")
        features = [c for c in weather.columns if c not in ("series_id", "location", "week")]
        clean = clean.join(weather.select("series_id", "week", *features), ["series_id", "week"], "left")
        names += features
    if "neighbors" in wanted:
        if neighbors is None:
            raise ValueError("neighbors needs the table of edges")
        ranks = list(range(1, fv.MAX_NEIGHBOURS + 1))
        seen = cv.neighbour_features(clean.select("series_id", "week", "value"), neighbors)
        wide = seen.groupBy("series_id", "week").agg(
            *[F.max(F.when(F.col("rank") == r, F.col("value"))).alias(f"neighbor_{r}") for r in ranks]
        )
        clean = clean.join(wide, ["series_id", "week"], "left")
        names += [f"neighbor_{r}" for r in ranks]
    clean = cut_lineage(clean)
    screen = sc.quality_screen(clean)
    if excluded is not None:
        screen = sc.screen_override(screen, excluded)
    usable = clean.join(screen.filter("include").select("series_id"), "series_id", "left_semi")
    windows = sc.build_windows(usable, names, **sizes)
    return TrainingSet(screen=screen, windows=windows, counts=sc.sample_counts(windows))
