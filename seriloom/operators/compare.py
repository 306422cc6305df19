"""Comparing many models on a forecast hub, and covariate experiments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seriloom.functions import fixed_values as fv
from seriloom.functions.calendar import add_weeks_52, add_weeks_iso, iso_monday
from seriloom.functions.cells import levels_of
from seriloom.functions.scores import at_level, covered, weighted_interval_score


# --- rounds and truth ---------------------------------------------------------------------


def season_rounds(seasons: DataFrame, extra_weeks: int = 0) -> DataFrame:
    """(season, year, week, round) from the first week to 52 and from 1 to the last week.

    ``seasons`` is (season, start_year, start_week, end_year, end_week); ``extra_weeks`` extends
    the end, as truth must reach beyond the last round.
    """
    first = F.transform(
        F.sequence(F.col("start_week"), F.lit(52)),
        lambda w: F.struct(F.col("start_year").alias("year"), w.alias("week")),
    )
    second = F.transform(
        F.sequence(F.lit(1), F.col("end_week") + extra_weeks),
        lambda w: F.struct(F.col("end_year").alias("year"), w.alias("week")),
    )
    return seasons.select("season", F.explode(F.concat(first, second)).alias("r")).select(
        "season",
        "r.year",
        "r.week",
        F.concat_ws("_", F.col("r.year").cast("string"), F.lpad(F.col("r.week").cast("string"), 2, "0")).alias("round"),
    )


def known_seasons(spark: SparkSession) -> DataFrame:
    """The fixed seasons as a table."""
    rows = [(k, *v) for k, v in fv.SEASONS.items()]
    return spark.createDataFrame(
        rows, "season string, start_year int, start_week int, end_year int, end_week int, indicator string"
    )


def truth_latest_vintage(vintages: DataFrame, second: DataFrame | None = None, keys: list[str] | None = None) -> DataFrame:
    """Latest restatement per (year, week); a second source fills only what is missing."""
    k = keys or ["year", "week"]
    latest = vintages.groupBy(*k).agg(F.max_by("value", "vintage").alias("value"))
    if second is None:
        return latest
    other = second.select(*k, F.col("value").alias("_other"))
    return latest.join(other, k, "full").select(*k, F.coalesce("value", "_other").alias("value"))


def extend_series(base: DataFrame, truth: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Base series plus the truth weeks it lacks (left anti join), with a running position."""
    k = keys or ["year", "week"]
    groups = [c for c in k if c not in ("year", "week")]
    new = truth.join(base, k, "left_anti").select(*k, "value")
    both = base.select(*k, "value").unionByName(new)
    w = Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(0))
    return both.withColumn("idx", F.row_number().over(w.orderBy("year", "week")) - 1)


def split_year_week(df: DataFrame, column: str = "year_week") -> DataFrame:
    """``YYYY-WW`` text to integer year and week, so that sorting is numeric."""
    parts = F.split(column, "[-_]")
    return df.withColumns({"year": parts[0].cast("int"), "week": parts[1].cast("int")})


def with_monday(df: DataFrame) -> DataFrame:
    return df.withColumn("monday", iso_monday(F.col("year"), F.col("week")))


def regime_flag(year: Column, week: Column, start_year: int, start_week: int, indicator: str) -> Column:
    """1 from the season start on when the season is scored on the second indicator."""
    if indicator != "ARI":
        return F.lit(0)
    after = (year > start_year) | ((year == start_year) & (week >= start_week))
    return F.when(after, 1).otherwise(0)


# --- hub forecasts ------------------------------------------------------------------------


def hub_quantiles(
    forecasts: DataFrame,
    levels: list[float] | None = None,
    place: str = "IT",
    horizons: list[int] | None = None,
    tolerance: float = fv.LEVEL_TOLERANCE,
) -> DataFrame:
    """(model, round, h, q) with one array aligned to ``levels``.

    Each level takes the value given exactly at it, else the nearest level closer than the
    tolerance; a (model, round, h) with a level missing is dropped. The nearest match is an
    equi-join on tolerance-wide buckets against the fixed level list (three rows per level).
    """
    lv = [round(x, 3) for x in (levels or fv.LEVELS_23)]
    # buckets are counted in units of the tolerance; a level reaches into the two next to its own
    width = float(tolerance)
    near = F.array(
        *[
            F.struct(F.lit(int(p / width + 1e-9) + step).cast("bigint").alias("bucket"), F.lit(p).alias("level"))
            for p in lv
            for step in (-1, 0, 1)
        ]
    )
    buckets = forecasts.sparkSession.range(1).select(F.explode(near).alias("e")).select("e.*")
    rows = forecasts.filter(
        (F.col("luogo") == place)
        & (F.col("tipo_valore") == "quantile")
        & F.col("orizzonte").isin(horizons or [1, 2, 3, 4])
        & (F.col("target").isNull() | F.col("target").isin("ILI", "ARI"))
        & F.col("valore").isNotNull()
    ).select(
        "model",
        "round",
        F.col("orizzonte").alias("h"),
        "id_valore",
        "valore",
        F.floor(F.col("id_valore") / width + 1e-9).alias("bucket"),
    )
    gap = F.abs(F.col("id_valore") - F.col("level"))
    best = F.min(F.struct(gap.alias("gap"), F.col("id_valore"), (-F.col("valore")).alias("neg")))
    per_level = (
        rows.join(buckets, "bucket")
        .filter(gap < width)
        .groupBy("model", "round", "h", "level")
        .agg((-best["neg"]).alias("v"))
    )
    return (
        per_level.groupBy("model", "round", "h")
        .agg(F.sort_array(F.collect_list(F.struct("level", "v"))).alias("e"))
        .filter(F.size("e") == len(lv))
        .select("model", "round", "h", F.col("e.v").alias("q"))
    )


def target_week_shift(rounds: DataFrame, truth: DataFrame, iso: bool = False) -> DataFrame:
    """Adds target_year, target_week and the actual; rows without one go. Weeks are those of a 52-week calendar, or with
    ``iso`` exact ISO weeks, where week 53 of a long year is a target and is followed by week 1."""
    year, week = (add_weeks_iso if iso else add_weeks_52)(F.col("year"), F.col("week"), F.col("h"))
    t = truth.select(F.col("year").alias("target_year"), F.col("week").alias("target_week"), F.col("value").alias("actual"))
    return (
        rounds.withColumns({"target_year": year, "target_week": week})
        .join(t, ["target_year", "target_week"])
        .filter(F.col("actual").isNotNull())
    )


def score_all_models(
    forecasts: DataFrame,
    levels: list[float] | None = None,
    intervals: list[tuple[float, float, float]] | None = None,
) -> DataFrame:
    """(model, round, h) rows with ``q`` and ``actual`` to WIS, APE and coverage."""
    lv, iv = levels or fv.LEVELS_23, intervals or fv.INTERVALS_23
    q, y = F.col("q"), F.col("actual")
    mid = at_level(q, lv, 0.5)
    return forecasts.select(
        "model",
        "round",
        "h",
        weighted_interval_score(y, q, lv, iv).alias("wis"),
        F.when(y > 0, F.abs(mid - y) / y).alias("ape"),
        covered(y, q, lv, 0.25, 0.75).cast("int").alias("cov50"),
        covered(y, q, lv, 0.05, 0.95).cast("int").alias("cov90"),
    )


# --- ratios -------------------------------------------------------------------------------


def against_baseline(scores: DataFrame, baseline: str) -> DataFrame:
    """Scores with the baseline's WIS of the same (round, h) next to them."""
    base = scores.filter(F.col("model") == baseline).select("round", "h", F.col("wis").alias("baseline_wis"))
    return scores.join(base, ["round", "h"])


COVERAGE = {"cov50": "coverage_50", "cov90": "coverage_90"}


def coverage_of(scores: DataFrame) -> list[Column]:
    """Shares of scores inside each interval, for the flags that ``scores`` has."""
    return [F.avg(flag).alias(name) for flag, name in COVERAGE.items() if flag in scores.columns]


def simple_rwis(scores: DataFrame, baseline: str) -> DataFrame:
    """Per model: mean WIS over the baseline's mean WIS on common keys, with the coverage of both intervals there."""
    return (
        against_baseline(scores, baseline)
        .groupBy("model")
        .agg(
            F.avg("wis").alias("mean_wis"),
            F.avg("baseline_wis").alias("mean_baseline_wis"),
            F.count("*").alias("n"),
            *coverage_of(scores),
        )
        .select(
            "model",
            (F.col("mean_wis") / F.nullif("mean_baseline_wis", F.lit(0.0))).alias("rwis"),
            "n",
            *[name for flag, name in COVERAGE.items() if flag in scores.columns],
        )
    )


def horizon_rwis_models(scores: DataFrame, baseline: str, models: list[str] | None = None) -> DataFrame:
    """The same ratio per horizon, for chosen models."""
    joined = against_baseline(scores, baseline)
    if models is not None:
        joined = joined.filter(F.col("model").isin(models))
    g = joined.groupBy("model", "h").agg(
        F.avg("wis").alias("mean_wis"), F.avg("baseline_wis").alias("mean_baseline_wis"), F.count("*").alias("n")
    )
    return g.select(
        "model",
        "h",
        F.when(F.col("mean_baseline_wis") > 0, F.col("mean_wis") / F.col("mean_baseline_wis")).alias("rwis"),
        "n",
    )


def key_sets(scores: DataFrame, by: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(models, sets): the key set of each model as a bitmap, and the distinct bitmaps with their keys.

    Keys (round, h) are numbered within their group, and a model's keys become bits. Models that submitted on the same occasions share a
    bitmap, so there are far fewer bitmaps than models. ``models`` is (by..., model, keys), ``sets`` (by..., keys, round, h).
    """
    group = by or []
    occasions = scores.select(*group, "round", "h").distinct()
    numbered = occasions.withColumn("bit", F.row_number().over(Window.partitionBy(*(group or [F.lit(0)])).orderBy("round", "h")) - 1)
    bits = scores.select(*group, "model", "round", "h").join(numbered, [*group, "round", "h"])
    part, place = F.bitmap_bucket_number("bit"), F.bitmap_bit_position("bit")
    maps = bits.groupBy(*group, "model", part.alias("part")).agg(F.bitmap_construct_agg(place).alias("map"))
    spelt = F.sha2(F.to_json(F.sort_array(F.collect_list(F.struct("part", F.hex("map").alias("map"))))), 256)
    models = maps.groupBy(*group, "model").agg(spelt.alias("keys"))
    holder = models.groupBy(*group, "keys").agg(F.min("model").alias("model"))
    sets = bits.join(holder, [*group, "model"]).select(*group, "keys", "round", "h")
    return models, sets


def pairwise_rwis(
    scores: DataFrame,
    baseline: str,
    min_common: int = fv.MIN_COMMON_KEYS,
    by: list[str] | None = None,
) -> DataFrame:
    """Geometric mean of the ratios of a model's mean WIS to every other model's on their common keys, divided by the baseline's
    own (1 if it has none), with the model's coverage. ``by`` repeats the comparison within groups such as seasons.

    No pair of models is opened. The common keys of two models are those of one within the key set of the other, so means are
    taken for each model and distinct key set; and the sum of ln(ratio) over all models of a set S is their number
    times ln(mean on S) less a sum that belongs to S and the model's own set alone.
    """
    group = by or []
    models, sets = key_sets(scores, group)
    on = scores.select(*group, "model", "round", "h", "wis").join(sets.withColumnRenamed("keys", "other"), [*group, "round", "h"])
    means = on.groupBy(*group, "model", "other").agg(F.avg("wis").alias("mean"), F.count("*").alias("n"))
    means = means.filter(F.col("n") >= min_common).join(models, [*group, "model"])
    # the other side of the ratio: models of a set, by their means on mine
    theirs = means.filter(F.col("mean") > 0).groupBy(*group, F.col("keys").alias("set_"), F.col("other").alias("mine"))
    theirs = theirs.agg(F.count("*").alias("k"), F.sum(F.ln("mean")).alias("ln_theirs"))
    own = F.col("keys") == F.col("other")
    met = means.withColumns({"set_": F.col("other"), "mine": F.col("keys")}).join(theirs, [*group, "set_", "mine"])
    # a model is no rival of its own; its ratio of 1 adds nothing to the sum
    rivals = F.col("k") - F.when(own & (F.col("mean") > 0), 1).otherwise(0)
    known = F.col("mean") > 0
    gain = F.when(known, F.col("k") * F.ln("mean") - F.col("ln_theirs"))
    theta = (
        met.groupBy(*group, "model")
        .agg(F.sum(gain).alias("gain"), F.sum(F.when(known, rivals)).alias("k"), F.sum(rivals).alias("n_models"))
        .filter("n_models > 0")
        .select(*group, "model", F.exp(F.col("gain") / F.nullif("k", F.lit(0))).alias("theta"), "n_models")
    )
    hits = scores.groupBy(*group, "model").agg(F.count("*").alias("n_scores"), *coverage_of(scores))
    # one row per model: the baseline's value is spread by a window over this small table
    window = Window.partitionBy(*(group or [F.lit(0)]))
    base = F.max(F.when(F.col("model") == baseline, F.col("theta"))).over(window)
    return theta.join(hits, [*group, "model"]).withColumn("_b", F.coalesce(base, F.lit(1.0))).select(
        *group, "model", "theta", (F.col("theta") / F.col("_b")).alias("pairwise_rwis"), "n_models", *hits.columns[len(group) + 2 :]
    )


def model_mape(scores: DataFrame, horizons: list[int] | None = None) -> DataFrame:
    """Overall and per-horizon MAPE in percent, one row per model."""
    hs = horizons or [1, 2, 3, 4]
    return scores.filter("ape IS NOT NULL").groupBy("model").agg(
        (100 * F.avg("ape")).alias("mape_pct"),
        *[(100 * F.avg(F.when(F.col("h") == h, F.col("ape")))).alias(f"mape_h{h}") for h in hs],
    )


def best_other_model(ratios: DataFrame, excluded: list[str]) -> DataFrame:
    """Lowest ratio outside the excluded names."""
    return ratios.filter(~F.col("model").isin(excluded) & F.col("rwis").isNotNull()).agg(
        F.min(F.struct("rwis", "model")).alias("m")
    ).select("m.model", "m.rwis")


def season_ranking(ratios: DataFrame) -> DataFrame:
    """Rank by pairwise ratio within the season; a season has one row per model."""
    w = Window.partitionBy("season").orderBy("pairwise_rwis")
    return ratios.withColumn("rank", F.rank().over(w))


# --- experiments --------------------------------------------------------------------------


def experiment_grid(spark: SparkSession, covariates: list[str] | None = None) -> DataFrame:
    """All covariate subsets by size, then by position, with ids from 1; id 0 is zero-shot."""
    covs = covariates or fv.COVARIATES
    k = len(covs)
    names = F.array(*[F.lit(c) for c in covs])
    short = F.array(*[F.lit(fv.COVARIATE_SHORT.get(c, c)) for c in covs])
    picked = F.filter(
        F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.lit(1) == F.getbit(F.col("mask"), i)
    )
    subsets = spark.range(2**k).withColumnRenamed("id", "mask").withColumn("at", picked)
    subsets = subsets.select(
        F.transform("at", lambda i: F.get(names, i)).alias("covariates"),
        F.transform("at", lambda i: F.get(short, i)).alias("short"),
        F.size("at").alias("size"),
        "at",
    )
    # 2^k rows by construction, so one ordered window is enough
    order = Window.partitionBy(F.lit(0)).orderBy("size", "at")
    grid = subsets.select(
        F.row_number().over(order).alias("exp_id"),
        "covariates",
        F.when(F.col("size") == 0, "nocov").otherwise(F.array_join("short", "-")).alias("suffix"),
        F.lit(True).alias("tuned"),
    )
    zero = spark.range(1).select(
        F.lit(0).alias("exp_id"),
        F.array().cast("array<string>").alias("covariates"),
        F.lit("base-zeroshot").alias("suffix"),
        F.lit(False).alias("tuned"),
    )
    return zero.unionByName(grid)


METRICS = ["relative_wis", "wis", "coverage_50", "coverage_95", "mae", "mape_pct"]


def hub_figures(scores: DataFrame, baseline: str, runs: DataFrame) -> DataFrame:
    """(exp_id, hub_rwis, hub_coverage_50, hub_coverage_90, hub_mape_pct, hub_rwis_by_h, hub_mape_by_h) of the hub models that
    are experiments, by ``runs(model, exp_id)``.

    Ratio and coverage are those on the baseline's keys, errors those of all keys. Sums by horizon are the entries of the maps, and
    their totals the overall figures, so scores are grouped once.
    """
    base = scores.filter(F.col("model") == baseline).select("round", "h", F.col("wis").alias("base"))
    mine = scores.join(runs, "model").join(base, ["round", "h"], "left")
    common = F.col("base").isNotNull()
    sums = {
        "wis": F.sum(F.when(common, F.col("wis"))),
        "base": F.sum("base"),
        "n": F.sum(common.cast("bigint")),
        "cov50": F.sum(F.when(common, F.col("cov50"))),
        "cov90": F.sum(F.when(common, F.col("cov90"))),
        "ape": F.sum("ape"),
        "n_ape": F.count("ape"),
    }
    by_h = mine.groupBy("exp_id", "h").agg(*[c.alias(name) for name, c in sums.items()])

    def over(a: str, b: str, total: bool = False, scale: int = 1) -> Column:
        x, y = (F.sum(a), F.sum(b)) if total else (F.col(a), F.col(b))
        return scale * x / F.nullif(y, F.lit(0))

    def by_horizon(value: Column) -> Column:
        entries = F.collect_list(F.when(value.isNotNull(), F.struct("h", value.alias("v"))))
        return F.map_from_entries(F.sort_array(entries))

    return by_h.groupBy("exp_id").agg(
        over("wis", "base", True).alias("hub_rwis"),
        over("cov50", "n", True).alias("hub_coverage_50"),
        over("cov90", "n", True).alias("hub_coverage_90"),
        over("ape", "n_ape", True, 100).alias("hub_mape_pct"),
        by_horizon(over("wis", "base")).alias("hub_rwis_by_h"),
        by_horizon(over("ape", "n_ape", scale=100)).alias("hub_mape_by_h"),
    )


def experiment_rollup(
    grid: DataFrame,
    results: DataFrame,
    horizon_results: DataFrame | None = None,
    horizons: int = fv.HORIZON,
    hub: DataFrame | None = None,
) -> DataFrame:
    """Mean of each metric over series per experiment; experiments without results keep a row.

    ``results`` is (exp_id, series_id, metrics...), ``horizon_results`` (exp_id, series_id, h, rwis), ``hub`` the figures of ``hub_figures``.
    """
    g = results.groupBy("exp_id").agg(
        *[F.avg(m).alias(f"mean_{m}") for m in METRICS if m in results.columns], F.count("*").alias("n_series")
    )
    out = grid.join(g, "exp_id", "left")
    if horizon_results is not None:
        h = horizon_results.groupBy("exp_id").agg(
            *[F.avg(F.when(F.col("h") == i, F.col("rwis"))).alias(f"mean_rwis_h{i}") for i in range(1, horizons + 1)]
        )
        out = out.join(h, "exp_id", "left")
    return out if hub is None else out.join(hub, "exp_id", "left")


def experiment_matrix(results: DataFrame, exp_ids: list[int], metric: str = "relative_wis") -> DataFrame:
    """Series by experiments; the ids are given, so the pivot needs no extra pass."""
    return results.groupBy("series_id").pivot("exp_id", exp_ids).agg(F.max(metric))


def top_bottom_k(results: DataFrame, k: int = 5, metric: str = "relative_wis") -> DataFrame:
    """Best and worst ``k`` series per experiment, the worst only where there are more than 2k.

    Both ends are ``row_number() <= k`` filters, which Spark turns into a per-task top-k before
    the shuffle, so an experiment with very many series is never gathered in one task.
    """
    rows = results.filter(F.col(metric).isNotNull()).select("exp_id", "series_id", metric)
    size = rows.groupBy("exp_id").agg(F.count("*").alias("n"))
    up = Window.partitionBy("exp_id").orderBy(F.col(metric), F.col("series_id"))
    down = Window.partitionBy("exp_id").orderBy(F.col(metric).desc(), F.col("series_id").desc())
    best = rows.withColumn("pos", F.row_number().over(up)).filter(F.col("pos") <= k)
    worst = rows.withColumn("pos", F.row_number().over(down)).filter(F.col("pos") <= k)
    best = best.withColumn("side", F.lit("top")).join(size, "exp_id").withColumn("place", F.col("pos").cast("bigint"))
    worst = (
        worst.withColumn("side", F.lit("bottom"))
        .join(size, "exp_id")
        .filter(F.col("n") > 2 * k)
        .withColumn("place", F.col("n") - F.col("pos") + 1)
    )
    return best.unionByName(worst).select("exp_id", "side", "place", "series_id", metric)


def best_config(rollup: DataFrame) -> DataFrame:
    """Best experiment per metric: lowest, except the highest for coverage. Hub metrics need a rollup with hub figures."""
    wanted = [("relative_wis", False), ("mape_pct", False), ("hub_rwis", False), ("hub_mape_pct", False), ("coverage_95", True)]
    wanted = [(m, m if m.startswith("hub_") else f"mean_{m}", top) for m, top in wanted]
    wanted = [w for w in wanted if w[1] in rollup.columns]
    rows = rollup.select(
        "exp_id",
        "suffix",
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(m).alias("metric"),
                        F.col(c).alias("value"),
                        (-F.col(c) if top else F.col(c)).alias("cost"),
                    )
                    for m, c, top in wanted
                ]
            )
        ).alias("e"),
    ).filter("e.value IS NOT NULL")
    return rows.groupBy(F.col("e.metric").alias("metric")).agg(
        F.min(F.struct(F.col("e.cost"), F.col("exp_id"), F.col("suffix"), F.col("e.value").alias("value"))).alias("m")
    ).select("metric", "m.exp_id", "m.suffix", "m.value")


def marginal_impact(rollup: DataFrame, metric: str = "mean_relative_wis") -> DataFrame:
    """Mean gain of adding a covariate over all pairs of tuned experiments that differ in it only."""
    runs = rollup.filter("tuned").select("exp_id", "covariates", F.col(metric).alias("v"))
    with_it = runs.select("covariates", "v", F.explode("covariates").alias("covariate")).withColumn(
        "rest", F.array_join(F.array_remove("covariates", F.col("covariate")), ",")
    )
    without = runs.select(F.array_join("covariates", ",").alias("rest"), F.col("v").alias("v0"))
    return (
        with_it.join(without, "rest")
        .filter(F.col("v").isNotNull() & F.col("v0").isNotNull())
        .groupBy("covariate")
        .agg(F.avg(F.col("v0") - F.col("v")).alias("impact"), F.count("*").alias("n_pairs"))
    )
