"""Daily refresh: guard, series, forecasts and published tables in one Spark job.

The tables that several later steps read (series, weeks, points and scores of the published places) are written once on the way.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame

from pyspark.sql import functions as F

from seriloom.functions import fixed_values as fv
from seriloom.functions.storage import cut_lineage
from seriloom.operators import forecast as fc
from seriloom.operators import hierarchy as hy
from seriloom.operators import series as se
from seriloom.operators import views as vw
from seriloom.sources import feed as fd

SKIP = {"unchanged"}
REFUSE = {"no_dates", "older", "shrunk"}


@dataclass
class Published:
    """The tables of one refresh."""

    series: DataFrame
    weekly: DataFrame
    points: DataFrame
    status: DataFrame
    future: DataFrame
    details: DataFrame
    listing: DataFrame


def verdict(new: DataFrame, previous: DataFrame | None) -> str:
    """The guard's one-word decision (a single row comes to the driver)."""
    return fd.refresh_guard(new, previous).first()["verdict"]


def publish(obs: DataFrame, as_of: Column, horizon: int = 8, nodes: DataFrame | None = None, excluded: DataFrame | None = None) -> Published:
    """From observations to every published table.

    ``nodes`` says which series stand for which place on the map (``hierarchy.members``); without it every series is a place of
    its own. Published rows carry their node's code, and the same as ``series_id``. ``excluded`` (series_id) is marked in the listing.
    """
    series = cut_lineage(se.combine_indicators(obs))
    weekly = cut_lineage(se.zero_policy(se.weekly_resample(series), "floor"))
    origin = fc.random_walk_quantiles(
        fc.forecast_origin(weekly, horizon), fv.LEVELS_9, horizon=horizon
    )
    layout = fc.forecast_layout(weekly, origin, "random_walk")
    starts = series.groupBy("series_id").agg(F.min("obs_date").alias("start"))
    raw_points = vw.series_points(layout, starts)

    known = cut_lineage(hy.series_facts(series))
    nodes = hy.own_nodes(known) if nodes is None else nodes
    facts = cut_lineage(hy.node_facts(known, nodes, as_of))
    points = cut_lineage(hy.node_points(raw_points, known, nodes, as_of))
    fresh = facts.select("code", "stale")
    points = points.join(fresh, "code").withColumns({f: F.when(~F.col("stale"), F.col(f)) for f in vw.BAND}).drop("stale")
    scores = cut_lineage(hy.node_scores(points, facts, as_of))
    place = F.col("code").alias("series_id")
    return Published(
        series=series,
        weekly=weekly,
        points=points.select(place, "*"),
        status=hy.status_map(scores).select(place, "*"),
        future=hy.future_weeks(scores).select(place, "*"),
        details=hy.detail_documents(points, facts).select(place, "*"),
        listing=hy.country_list(scores, nodes, excluded).select(place, "*"),
    )


def refresh(
    feed: DataFrame,
    previous: DataFrame | None,
    as_of: Column,
    horizon: int = 8,
    nodes: DataFrame | None = None,
    excluded: DataFrame | None = None,
) -> tuple[str, Published | None]:
    """Guarded refresh: nothing is computed for an unchanged pull, a suspicious pull is an error."""
    decision = verdict(feed, previous)
    if decision in SKIP:
        return decision, None
    if decision in REFUSE:
        raise ValueError(f"feed refused by the guard: {decision}")
    obs = fd.to_observations(feed).select("series_id", "obs_date", "ili", "ari")
    return decision, publish(obs, as_of, horizon, nodes, excluded)
