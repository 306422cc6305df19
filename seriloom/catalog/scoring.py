"""Scoring."""

from pyspark.sql import functions as F

from seriloom.catalog import forecast as cf
from seriloom.catalog import tables as tt
from seriloom.catalog.registry import query
from seriloom.catalog.sqlparts import B, R, part, sql, wis_sql
from seriloom.functions import fixed_values as fv
from seriloom.functions.scores import interval_score
from seriloom.operators import forecast as fc
from seriloom.operators import scoring as so
from seriloom.operators import series as se
from seriloom.sources import testbed as tb

H = fv.HORIZON

# --- peaks and phases ---------------------------------------------------------------------

part(
    "runs",
    """SELECT series_id, run, min(idx) AS first, max(idx) AS last, max(v) AS v, max(threshold) AS threshold FROM (
        SELECT *, sum(fresh) OVER (PARTITION BY series_id ORDER BY idx) AS run FROM (
            SELECT series_id, idx, threshold, coalesce(value, 0) AS v,
                CASE WHEN coalesce(value, 0) = lag(coalesce(value, 0)) OVER (PARTITION BY series_id ORDER BY idx) THEN 0 ELSE 1 END AS fresh FROM ev)) GROUP BY 1, 2""",
    "ev",
)
part(
    "summits",
    """SELECT series_id, (first + last) // 2 AS idx, v, threshold FROM (
        SELECT *, lag(v) OVER w AS before, lead(v) OVER w AS after FROM runs WINDOW w AS (PARTITION BY series_id ORDER BY run))
    WHERE v > before AND v > after AND v >= threshold""",
    "runs",
)
part(
    "spaced",
    f"""SELECT series_id, unnest(list_reduce(list_transform(list(idx ORDER BY v DESC, idx DESC), lambda x: [x]),
        lambda kept, x: CASE WHEN len(list_filter(kept, lambda k: abs(k - x[1]) < {fv.PEAK_DISTANCE})) = 0 THEN list_concat(kept, x) ELSE kept END)) AS idx
    FROM summits GROUP BY 1""",
    "summits",
)
part(
    "peaks",
    f"""SELECT * FROM (SELECT s.series_id, s.idx, u.v AS height, u.threshold, u.v - greatest(
            (SELECT min(v) FROM runs r WHERE r.series_id = s.series_id AND r.first <= s.idx AND r.first > coalesce(
                (SELECT max(first) FROM runs b WHERE b.series_id = s.series_id AND b.first <= s.idx AND b.v > u.v), -1)),
            (SELECT min(v) FROM runs r WHERE r.series_id = s.series_id AND r.last >= s.idx AND r.last < coalesce(
                (SELECT min(last) FROM runs b WHERE b.series_id = s.series_id AND b.last >= s.idx AND b.v > u.v), 1000000))) AS prominence
        FROM spaced s JOIN summits u USING (series_id, idx)) WHERE prominence >= threshold * {fv.PEAK_PROMINENCE}::DOUBLE""",
    "runs",
    "spaced",
    "summits",
)
part(
    "phases",
    f"""SELECT e.*, CASE WHEN value IS NULL OR value < threshold THEN 'off_season'
            WHEN idx - before <= {fv.PEAK_WINDOW} OR after - idx <= {fv.PEAK_WINDOW} THEN 'peak_window'
            WHEN after IS NOT NULL AND (before IS NULL OR after - idx <= idx - before) THEN 'growth'
            WHEN before IS NOT NULL THEN 'decay' ELSE 'growth' END AS phase
    FROM (SELECT e.*, (SELECT max(idx) FROM peaks p WHERE p.series_id = e.series_id AND p.idx <= e.idx) AS before,
            (SELECT min(idx) FROM peaks p WHERE p.series_id = e.series_id AND p.idx >= e.idx) AS after FROM ev e) e""",
    "ev",
    "peaks",
)


def phased(spark, d):
    weekly = cf.evaluation_weekly(spark, d)
    return so.phase_labels(weekly, so.find_peaks(weekly))


@query(
    "season_threshold",
    sql(f"SELECT series_id, {R('max(threshold)', 'threshold')} FROM ev GROUP BY 1", "ev"),
)
def season_threshold(spark, d):
    return fc.season_threshold(se.zero_policy(tt.weekly(spark, d), "floor"))


@query("find_peaks", sql(f"SELECT series_id, {B('idx', 'idx')}, {R('height', 'height')}, {R('prominence', 'prominence')} FROM peaks", "peaks"))
def find_peaks(spark, d):
    return so.find_peaks(cf.evaluation_weekly(spark, d))


@query("phase_labels", sql(f"SELECT series_id, week, {B('idx', 'idx')}, {R('value', 'value')}, phase FROM phases", "phases"))
def phase_labels(spark, d):
    return phased(spark, d).select("series_id", "week", "idx", "value", "phase")


# --- scores -------------------------------------------------------------------------------

_CORE = f"""SELECT p.series_id, p.cutoff, q.h, a.week, a.phase, a.value AS actual, q.q AS q, q.q[4] AS median,
        {wis_sql("a.value", "q.q", fv.LEVELS_7, fv.INTERVALS_7)} AS wis, abs(q.q[4] - a.value) AS ae,
        abs(q.q[4] - a.value) / a.value AS ape,
        (a.value BETWEEN q.q[3] AND q.q[5])::INT AS cov50, (a.value BETWEEN q.q[1] AND q.q[7])::INT AS cov_outer,
        CASE WHEN b.q IS NOT NULL THEN {wis_sql("a.value", "b.q", fv.LEVELS_7, fv.INTERVALS_7)} END AS baseline_wis
    FROM pts p JOIN {{model}} q USING (series_id, cutoff)
    JOIN phases a ON a.series_id = p.series_id AND a.idx = p.cutoff + q.h
    LEFT JOIN rw b ON b.series_id = p.series_id AND b.cutoff = p.cutoff AND b.h = q.h
    WHERE a.value >= p.threshold"""
part("scores", _CORE.format(model="sn"), "pts", "sn", "rw", "phases")


def points_with_models(spark, d, phases: bool = True):
    weekly = phased(spark, d) if phases else cf.evaluation_weekly(spark, d)
    pts = fc.rolling_points(weekly)
    return fc.seasonal_naive_quantiles(fc.random_walk_quantiles(pts, n_paths=cf.N_PATHS))


def scores(spark, d, phases: bool = True):
    return so.score_horizons(points_with_models(spark, d, phases), "seasonal_naive", "random_walk")


def own_scores(spark, d, phases: bool = True):
    """Scores without a baseline, so nothing is simulated for them."""
    weekly = phased(spark, d) if phases else cf.evaluation_weekly(spark, d)
    return so.score_horizons(fc.seasonal_naive_quantiles(fc.rolling_points(weekly)), "seasonal_naive")


KEY = f"series_id, {B('cutoff', 'cutoff')}, {B('h', 'h')}"


@query(
    "score_horizons",
    sql(
        f"SELECT {KEY}, week, phase, "
        + ", ".join(R(c, c) for c in ["actual", "median", "wis", "ae", "ape", "baseline_wis"])
        + f", {B('cov50', 'cov50')}, {B('cov_outer', 'cov_outer')} FROM scores",
        "scores",
    ),
)
def score_horizons(spark, d):
    return scores(spark, d)


# order prices play observations, a customer's mean and deviation give intervals
part(
    "bands",
    """SELECT c_mktsegment AS model, o_orderkey, o_totalprice / 1000.0 AS y, m - s AS lower, m + s AS upper
    FROM orders JOIN customer ON o_custkey = c_custkey
    JOIN (SELECT o_custkey AS k, avg(o_totalprice / 1000.0) AS m, stddev_pop(o_totalprice / 1000.0) AS s FROM orders GROUP BY 1) ON k = o_custkey""",
)


@query(
    "interval_score",
    sql(
        f"SELECT model, o_orderkey, {R('(upper - lower) + 4.0::DOUBLE * (greatest(lower - y, 0) + greatest(y - upper, 0))', 'score')} FROM bands",
        "bands",
    ),
)
def interval_scores(spark, d):
    orders, customer = tb.table(spark, d, "orders"), tb.table(spark, d, "customer")
    y = F.col("o_totalprice") / 1000.0
    band = orders.groupBy(F.col("o_custkey").alias("k")).agg(F.avg(y).alias("m"), F.stddev_pop(y).alias("s"))
    rows = orders.join(customer, orders.o_custkey == customer.c_custkey).join(band, orders.o_custkey == band.k)
    low, high = F.col("m") - F.col("s"), F.col("m") + F.col("s")
    return rows.select(
        F.col("c_mktsegment").alias("model"), "o_orderkey", interval_score(low, high, y, 0.5).alias("score")
    )


part("scores_ds", _CORE.format(model="ds"), "pts", "ds", "rw", "phases")


@query("wis_7", sql(f"SELECT {KEY}, {R('actual', 'actual')}, {R('wis', 'wis')} FROM scores_ds", "scores_ds"))
def wis_7(spark, d):
    pts = fc.direct_step_quantiles(cf.points(spark, d))
    return so.score_horizons(pts, "direct_step").select("series_id", "cutoff", "h", "actual", "wis")


L23 = "[" + ", ".join(f"{x}::DOUBLE" for x in fv.LEVELS_23) + "]"
cf.direct_part("ds23", "pts", "diffs", L23, H, history=None)


@query(
    "wis_23",
    sql(
        f"""SELECT p.series_id, {B("p.cutoff", "cutoff")}, {B("q.h", "h")}, {R(wis_sql("a.value", "q.q", fv.LEVELS_23, fv.INTERVALS_23), "wis")},
            {B("(a.value BETWEEN q.q[7] AND q.q[17])::INT", "cov50")}, {B("(a.value BETWEEN q.q[3] AND q.q[21])::INT", "cov90")}
        FROM pts p JOIN ds23 q USING (series_id, cutoff) JOIN ev a ON a.series_id = p.series_id AND a.idx = p.cutoff + q.h WHERE a.value >= p.threshold""",
        "pts",
        "ds23",
        "ev",
    ),
)
def wis_23(spark, d):
    pts = fc.direct_step_quantiles(cf.points(spark, d, history=None), fv.LEVELS_23)
    s = so.score_horizons(pts, "direct_step", levels=fv.LEVELS_23, intervals=fv.INTERVALS_23, outer=(0.05, 0.95))
    return s.select("series_id", "cutoff", "h", "wis", "cov50", F.col("cov_outer").alias("cov90"))


@query(
    "coverage",
    sql(f"SELECT {B('h', 'h')}, {R('avg(cov50)', 'coverage_50')}, {R('avg(cov_outer)', 'coverage_outer')}, count(*) AS n FROM scores GROUP BY h", "scores"),
)
def coverage(spark, d):
    return so.coverage_table(own_scores(spark, d, False), ["h"])


@query(
    "point_errors",
    sql(
        f"""SELECT series_id, {R("avg(ae)", "mae")}, {R("100 * avg(ape)", "mape_pct")}, count(ape) AS n, {R("100 * quantile_cont(ape, 0.5)", "median_error_pct")}
        FROM scores GROUP BY 1""",
        "scores",
    ),
)
def point_errors(spark, d):
    return so.point_errors(own_scores(spark, d, False), ["series_id"])


@query(
    "relative_wis",
    sql(
        f"""SELECT series_id, {R("avg(wis)", "mean_wis")}, {R("avg(baseline_wis)", "mean_baseline_wis")},
            {R("CASE WHEN avg(wis) <> 0 THEN avg(wis) / nullif(avg(baseline_wis), 0) END", "relative_wis")} FROM scores GROUP BY 1""",
        "scores",
    ),
)
def relative_wis(spark, d):
    return so.relative_wis(scores(spark, d, False), ["series_id"])


part(
    "h_rwis",
    """SELECT series_id, h, count(wis) AS n, count(baseline_wis) AS n_baseline, avg(wis) AS mean_wis, avg(baseline_wis) AS mean_baseline_wis,
        CASE WHEN count(wis) = count(baseline_wis) AND avg(baseline_wis) > 0 THEN avg(wis) / avg(baseline_wis) END AS rwis FROM scores GROUP BY 1, 2""",
    "scores",
)


@query(
    "horizon_rwis",
    sql(
        f"SELECT series_id, {B('h', 'h')}, n, n_baseline, {R('mean_wis', 'mean_wis')}, {R('mean_baseline_wis', 'mean_baseline_wis')}, {R('rwis', 'rwis')} FROM h_rwis",
        "h_rwis",
    ),
)
def horizon_rwis(spark, d):
    return so.horizon_rwis(scores(spark, d, False))


@query(
    "horizon_table",
    sql(
        f"""SELECT coalesce(h::VARCHAR, 'ALL') AS horizon, count(*) AS n, {R("avg(wis)", "mean_wis")}, {R("avg(baseline_wis)", "mean_baseline_wis")},
            {R("avg(wis) / nullif(avg(baseline_wis), 0)", "rwis")}, {R("avg(ae)", "mae")}, {R("100 * avg(cov50)", "cov50_pct")}, {R("100 * avg(cov_outer)", "cov_outer_pct")}
        FROM scores GROUP BY ROLLUP (h)""",
        "scores",
    ),
)
def horizon_table(spark, d):
    return so.horizon_table(scores(spark, d, False))


part(
    "ph_mape",
    "SELECT series_id, phase, 100 * avg(ape) AS mape_pct, count(*) AS n_points FROM scores WHERE phase <> 'off_season' GROUP BY 1, 2",
    "scores",
)


@query("phase_mape", sql(f"SELECT series_id, phase, {R('mape_pct', 'mape_pct')}, n_points FROM ph_mape", "ph_mape"))
def phase_mape(spark, d):
    return so.phase_mape(own_scores(spark, d))


part(
    "timing",
    f"""SELECT series_id, cutoff, list_position(f, list_max(f)) - list_position(a, list_max(a)) AS error FROM (
        SELECT p.series_id, p.cutoff, any_value(p.threshold) AS thr, list(a.value ORDER BY h) AS a, list(q.q[4] ORDER BY h) AS f, count(a.value) AS k, count(*) AS n
        FROM pts p JOIN sn q USING (series_id, cutoff) JOIN ev a ON a.series_id = p.series_id AND a.idx = p.cutoff + q.h - 1 GROUP BY 1, 2)
    WHERE k = {H} AND n = {H} AND list_max(a) >= thr * {fv.PEAK_SIGNIFICANCE}""",
    "pts",
    "sn",
    "ev",
)


@query("peak_timing", sql(f"SELECT series_id, {B('cutoff', 'cutoff')}, {B('error', 'error')} FROM timing", "timing"))
def peak_timing(spark, d):
    return so.peak_timing(fc.seasonal_naive_quantiles(cf.points(spark, d)), "seasonal_naive")


part(
    "metrics",
    f"""SELECT s.series_id, m.* EXCLUDE (series_id, n_eval_points), coalesce(n_eval_points, 0) AS n_eval_points,
        t.* EXCLUDE (series_id, n_peak_timing_points), coalesce(n_peak_timing_points, 0) AS n_peak_timing_points
    FROM (SELECT n_name AS series_id FROM nation) s
    LEFT JOIN (SELECT series_id, {R("100 * avg(ape)", "mape_pct", 2)}, {R("100 * quantile_cont(ape, 0.5)", "median_error_pct", 2)}, {R("avg(ae)", "mae", 4)},
            {R("avg(wis)", "wis", 4)}, {R("CASE WHEN avg(wis) <> 0 THEN avg(wis) / nullif(avg(baseline_wis), 0) END", "relative_wis", 3)},
            {R("100 * avg(cov50)", "coverage_50", 1)}, {R("100 * avg(cov_outer)", "coverage_95", 1)}, count(*) AS n_eval_points FROM scores GROUP BY 1) m USING (series_id)
    LEFT JOIN (SELECT series_id, {R("avg(abs(error))", "peak_timing_mae_weeks", 2)}, {R("avg(error)", "peak_timing_bias_weeks", 2)}, count(*) AS n_peak_timing_points
        FROM timing GROUP BY 1) t USING (series_id)""",
    "scores",
    "timing",
)


def metrics(spark, d):
    pts = points_with_models(spark, d, phases=False)
    names = tb.table(spark, d, "nation").select(F.col("n_name").alias("series_id"))
    return so.metrics_per_series(
        names,
        so.score_horizons(pts, "seasonal_naive", "random_walk"),
        so.peak_timing(pts, "seasonal_naive"),
    )


@query("metrics_per_series", sql("SELECT * FROM metrics", "metrics"))
def metrics_per_series(spark, d):
    return metrics(spark, d)


_NAMES = ["mape_pct", "wis", "relative_wis", "coverage_50", "coverage_95", "peak_timing_mae_weeks"]


@query(
    "overall_summary",
    sql(
        " UNION ALL ".join(
            f"SELECT '{n}' AS metric, {R(f'avg({n})', 'mean')}, {R(f'quantile_cont({n}, 0.5)', 'median')}, count({n}) AS n, "
            + (f"count(*) FILTER (WHERE {n} < 1)" if n == "relative_wis" else "NULL::BIGINT")
            + f" AS n_below_1 FROM metrics HAVING count({n}) > 0"  # a metric nobody has gets no line
            for n in _NAMES
        ),
        "metrics",
    ),
)
def overall_summary(spark, d):
    return so.overall_summary(metrics(spark, d))


@query(
    "leaderboard",
    sql(
        """SELECT series_id, relative_wis, mape_pct, coverage_50, coverage_95, n_eval_points, coalesce(nullif(relative_wis, 0), 999) AS sort_key FROM metrics""",
        "metrics",
    ),
)
def leaderboard(spark, d):
    return so.leaderboard(metrics(spark, d)).select(
        "series_id", "relative_wis", "mape_pct", "coverage_50", "coverage_95", "n_eval_points", "sort_key"
    )
