"""Publishing a hierarchy of series: parts and parents scored in one plan.

A *node* is what gets a row on the map: a series of its own, or a parent that stands for several series (its parts). Every
series is expanded to the nodes it belongs to, so a parent and a series of its own go through the same aggregates: one over
(node, date) that sums points and compares indicators, and one over nodes that takes the baseline, this week's figure, the
next weeks' forecasts and the first report at once. The points are read once, and nothing is written on the way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriloom.functions import fixed_values as fv
from seriloom.functions.calendar import week_start
from seriloom.functions.cells import rounded
from seriloom.operators import entities as en
from seriloom.operators import views as vw

WEEKS_AHEAD = 4


def members(
    names: DataFrame,
    mapping: DataFrame,
    parents: DataFrame,
    overrides: dict[str, str] | None = None,
    show_parts: bool = False,
) -> DataFrame:
    """(series_id, code, name, parent): the nodes of each series.

    ``names`` is (series_id, name), ``mapping`` (name, code) and ``parents`` (part_code, parent_code, parent_name). A series whose
    name has no code belongs to no node. A part belongs to its parent, and with ``show_parts`` also to a node of its own.
    """
    shown = names.select("series_id", "name")
    codes = en.code_lookup(shown.select("name").distinct(), mapping, overrides)
    coded = shown.join(codes, "name").filter("code IS NOT NULL")
    above = coded.join(parents.withColumnRenamed("part_code", "code"), "code", "left")
    display = F.replace("name", F.lit("_"), F.lit(" "))
    kind = "struct<code:string,name:string,parent:string>"
    own = F.struct(F.col("code"), display.alias("name"), F.col("parent_code").alias("parent")).cast(kind)
    upper = F.struct(F.col("parent_code").alias("code"), F.col("parent_name").alias("name"), F.lit(None).alias("parent")).cast(kind)
    part = F.array(own, upper) if show_parts else F.array(upper)
    each = F.explode(F.when(F.col("parent_code").isNull(), F.array(own)).otherwise(part))
    return above.select("series_id", each.alias("node")).select("series_id", "node.*")


def own_nodes(series: DataFrame) -> DataFrame:
    """Members where every series is a node under its own name."""
    own = series.select("series_id").distinct()
    return own.select("series_id", F.col("series_id").alias("code"), F.col("series_id").alias("name"), F.lit(None).cast("string").alias("parent"))


def series_facts(series: DataFrame) -> DataFrame:
    """(series_id, last_update, current_type, days, changes): all that publishing needs to know of a series, from one pass.

    ``days`` has the distinct (obs_date, data_type) in order, so it is bounded by the calendar; ``changes`` spells the switches of
    indicator in it. Rows are reduced to days before a series is gathered.
    """
    days = series.groupBy("series_id", "obs_date", "data_type").agg(F.max(F.col("cases").isNotNull()).alias("reported"))
    typed = F.col("data_type").isNotNull() & F.col("obs_date").isNotNull()
    day = F.struct("obs_date", "data_type")
    facts = days.groupBy("series_id").agg(
        F.max("obs_date").alias("last_update"),
        F.coalesce(F.max(F.when(typed & F.col("reported"), day)), F.max(F.when(typed, day)))["data_type"].alias("current_type"),
        F.sort_array(F.collect_list(F.when(typed, day))).alias("days"),
    )
    at = F.filter(
        F.sequence(F.lit(1), F.greatest(F.size("days") - 1, F.lit(1))),
        lambda i: F.get("days", i)["data_type"] != F.get("days", i - 1)["data_type"],
    )

    def spelt(i: Column) -> Column:
        new, old = F.get("days", i), F.get("days", i - 1)
        return F.concat_ws(">", new["obs_date"].cast("string"), vw.type_name(old["data_type"]), vw.type_name(new["data_type"]))

    return facts.withColumn("changes", F.array_join(F.transform(at, spelt), ";"))


def node_facts(facts: DataFrame, nodes: DataFrame, as_of: Column, days: int = fv.STALE_DAYS) -> DataFrame:
    """(code, name, parent, data_type, last_update, stale, changes, n_parts, current_type) of every node from ``series_facts``.

    The newest part dates a node, most parts give its type (the first by name in a tie), switches count where all parts agree
    on them, and the current indicator is unknown where they do not agree on it.
    """
    rows = nodes.join(facts.drop("days"), "series_id").withColumn("ari", F.col("current_type") == 1)
    lo, hi, known = F.min("current_type"), F.max("current_type"), F.count("current_type") == F.count("*")
    one = F.min("changes") == F.max("changes")
    age = F.datediff(as_of, "last_update")
    merged = rows.groupBy("code").agg(
        F.min("name").alias("name"),
        F.min("parent").alias("parent"),
        F.when(2 * F.count_if("ari") >= F.count("*"), "ARI").otherwise("ILI").alias("data_type"),
        F.max("last_update").alias("last_update"),
        F.when(one, F.min("changes")).otherwise("").alias("changes"),
        F.count("*").alias("n_parts"),
        F.when((lo == hi) & known, lo).alias("current_type"),
    )
    return merged.withColumn("stale", F.coalesce(age >= days, F.lit(True)))


def node_points(points: DataFrame, facts: DataFrame, nodes: DataFrame, as_of: Column, days: int = fv.STALE_DAYS) -> DataFrame:
    """(code, date, fields, week_type): sums over a node's parts and the indicator of the week, NULL where parts differ.

    Forecasts of a stale part do not count. The parts' facts are joined once for each series; a week's indicator is
    looked up in the series' own days.
    """
    old = F.coalesce(F.datediff(as_of, "last_update") >= days, F.lit(True))
    by_day = F.map_from_entries("latest")
    latest = F.filter("days", lambda x, i: F.coalesce(F.get("days", i + 1)["obs_date"] != x["obs_date"], F.lit(True)))
    about = facts.select("series_id", old.alias("old"), latest.alias("latest")).select("series_id", "old", by_day.alias("types"))
    known = points.join(nodes.select("series_id", "code").join(about, "series_id"), "series_id")
    known = known.withColumn("week_type", F.try_element_at("types", F.col("date")))
    lo, hi = F.min("week_type"), F.max("week_type")
    sums = [F.sum("historical").alias("historical"), *[F.sum(F.when(~F.col("old"), F.col(f))).alias(f) for f in vw.BAND]]
    return known.groupBy("code", "date").agg(*sums, F.when(lo == hi, lo).alias("week_type"))


def node_scores(
    points: DataFrame, facts: DataFrame, as_of: Column, min_same: int = fv.MIN_SAME_TYPE, reach: int = fv.FORECAST_REACH_DAYS
) -> DataFrame:
    """``facts`` with since, value, source, zscore, score, status and weeks (the next Mondays' forecasts on the same scale)."""
    monday = week_start(as_of)
    shown = facts.join(points, "code", "left")  # a node without points stays
    shown = shown.withColumn("same", F.when(F.col("week_type") == F.col("current_type"), F.col("historical")))
    this_week = F.col("date") == monday
    forecast = F.when(~F.col("stale"), F.col("forecast"))

    def ahead(i: int) -> Column:
        return F.max(F.when(F.col("date") == F.date_add(monday, 7 * i), forecast)).alias(f"f{i}")

    figures = shown.groupBy(*facts.columns).agg(
        F.avg("historical").alias("mean_all"),
        F.stddev_samp("historical").alias("std_all"),
        F.avg("same").alias("mean_same"),
        F.stddev_samp("same").alias("std_same"),
        F.count("same").alias("n_same"),
        F.min(F.when(F.col("historical").isNotNull(), F.col("date"))).alias("since"),
        F.max(F.when(this_week, F.col("historical"))).alias("now"),
        *[ahead(i) for i in range(WEEKS_AHEAD + 1)],
    )
    enough = F.col("n_same") >= min_same
    figures = figures.withColumns(
        {
            "mean": F.when(enough, F.col("mean_same")).otherwise(F.col("mean_all")),
            "std": F.when(enough, F.col("std_same")).otherwise(F.col("std_all")),
            "source": F.when(F.col("now").isNotNull(), "actual").when(F.col("f0").isNotNull(), "forecast"),
        }
    )
    # greatest() skips NULLs, so a missing forecast must not become 0
    value = F.when(F.col("source") == "forecast", F.greatest("f0", F.lit(0.0))).otherwise(F.col("now"))

    def scaled(value: Column, date: Column) -> Column:
        z = vw.zscore(value, F.col("mean"), F.col("std"))
        score = F.least(F.greatest(z / 2, F.lit(0.0)), F.lit(1.0))
        return F.struct(
            date.alias("date"), value.alias("value"), z.alias("zscore"), score.alias("score"), F.when(z >= 1.0, "high").otherwise("low").alias("status")
        )

    mondays = [F.date_add(monday, 7 * i) for i in range(1, WEEKS_AHEAD + 1)]
    near = [F.datediff(d, "last_update") <= reach for d in mondays]
    known = [F.col(f"f{i}").isNotNull() & n for i, n in enumerate(near, 1)]
    weeks = [F.when(k, scaled(F.greatest(f"f{i}", F.lit(0.0)), d)) for i, (k, d) in enumerate(zip(known, mondays), 1)]
    joined = figures.withColumn("value", value)
    joined = joined.withColumn("now_scaled", F.when(F.col("value").isNotNull(), scaled(F.col("value"), monday)))
    return joined.select(
        *facts.columns,
        "since",
        "value",
        "source",
        F.col("now_scaled.zscore").alias("zscore"),
        F.col("now_scaled.score").alias("score"),
        F.col("now_scaled.status").alias("status"),
        F.filter(F.array(*weeks), lambda w: w.isNotNull()).alias("weeks"),
    )


def status_map(scores: DataFrame) -> DataFrame:
    """One row for each node of the map, its forecast weeks nested. Stale nodes appear without figures; other nodes without
    any value for the week are left out."""
    fresh = ~F.col("stale")
    figures = {"value": rounded("value", 1), "zscore": rounded("zscore", 2), "score": F.col("score"), "source": F.col("source")}
    week = F.transform(
        "weeks",
        lambda w: F.struct(w["date"].alias("date"), rounded(w["value"], 1).alias("value"), rounded(w["zscore"], 2).alias("zscore"), w["score"].alias("score"), w["status"].alias("status")),
    )
    nothing = F.filter(week, lambda _: F.lit(False))
    return scores.filter(F.col("stale") | F.col("value").isNotNull()).select(
        "code",
        "name",
        "parent",
        "data_type",
        *[F.when(fresh, c).alias(n) for n, c in figures.items()],
        F.when(F.col("stale"), "stale").otherwise(F.col("status")).alias("status"),
        "stale",
        "last_update",
        F.when(fresh, week).otherwise(nothing).alias("forecast_weeks"),
    )


def future_weeks(scores: DataFrame) -> DataFrame:
    """(code, date, value, zscore, score, status): one row for each forecast week of each node."""
    return scores.select("code", F.explode("weeks").alias("w")).select("code", "w.*")


def country_list(scores: DataFrame, nodes: DataFrame, excluded: DataFrame | None = None, short: dict[str, str] | None = None) -> DataFrame:
    """Every node by lower name: type, first report, last update, stale, on_map, and whether a part of it is excluded from training.

    ``excluded`` is (series_id).
    """
    on_map = F.col("stale") | F.col("value").isNotNull()
    listed = scores.select("code", "name", "parent", "data_type", "since", "last_update", "stale", on_map.alias("on_map"))
    if excluded is None:
        out = listed.withColumn("excluded", F.lit(False))
    else:
        left_out = nodes.join(excluded.select("series_id").distinct(), "series_id", "left_semi").select("code").distinct()
        out = listed.join(left_out.withColumn("excluded", F.lit(True)), "code", "left").fillna(False, ["excluded"])
    out = en.alias_map(out, short).withColumn("name", F.col("short_name")).drop("short_name")
    return out.orderBy(F.lower("name"), "code")


def list_totals(listing: DataFrame) -> DataFrame:
    """(total, on_map, excluded): how many nodes there are."""
    return listing.agg(F.count("*").alias("total"), F.count_if("on_map").alias("on_map"), F.count_if("excluded").alias("excluded"))


def published(points: DataFrame, facts: DataFrame, nodes: DataFrame, as_of: Column) -> DataFrame:
    """``node_scores`` from the points of the series and their ``series_facts``."""
    merged = node_facts(facts, nodes, as_of)
    return node_scores(node_points(points, facts, nodes, as_of), merged, as_of)


def detail_documents(points: DataFrame, facts: DataFrame) -> DataFrame:
    """One nested detail document for each node: sorted points, and the switches of indicator that all its parts share."""
    body = points.groupBy("code").agg(F.sort_array(F.collect_list(F.struct("date", *vw.FIELDS))).alias("points"))
    listed = F.filter(F.split("changes", ";"), lambda x: x != "")
    switch = F.transform(
        listed,
        lambda x: F.struct(
            F.split_part(x, F.lit(">"), F.lit(1)).cast("date").alias("date"),
            F.split_part(x, F.lit(">"), F.lit(2)).alias("from"),
            F.split_part(x, F.lit(">"), F.lit(3)).alias("to"),
        ),
    )
    about = facts.select("code", "name", "data_type", "stale", "last_update", switch.alias("data_type_changes"))
    return body.join(about, "code")
