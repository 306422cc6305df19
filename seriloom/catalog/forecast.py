"""Forecast generation."""

from pyspark.sql import functions as F

from seriloom.catalog import tables as tt
from seriloom.catalog.registry import query
from seriloom.catalog.sqlparts import B, R, level_list, part, sql
from seriloom.functions import fixed_values as fv
from seriloom.operators import forecast as fc
from seriloom.operators import series as se

N_PATHS = fv.N_PATHS
H = fv.HORIZON
L7, L9 = level_list(fv.LEVELS_7), level_list(fv.LEVELS_9)


def evaluation_weekly(spark, d):
    """Weekly series as scored: zeros at the floor value, off-season level attached."""
    return fc.with_threshold(se.zero_policy(tt.weekly(spark, d), "floor"))


def points(spark, d, **kw):
    return fc.rolling_points(evaluation_weekly(spark, d), **kw)


part(
    "ev",
    """SELECT w.series_id, week, idx, CASE WHEN value = 0 THEN 1e-6::DOUBLE ELSE value END AS value, n, threshold
    FROM weekly w JOIN (SELECT series_id, count(*) AS n,
        coalesce(quantile_cont(CASE WHEN value = 0 THEN 1e-6::DOUBLE ELSE value END, 0.2) FILTER (WHERE value >= 0), 1.0) AS threshold
        FROM weekly GROUP BY 1) USING (series_id)""",
    "weekly",
)
part(
    "diffs",
    """SELECT a.series_id, a.idx, k, a.value - b.value AS d FROM ev a, (SELECT unnest([1, 2, 3, 4, 52]) AS k)
    JOIN ev b ON b.series_id = a.series_id AND b.idx = a.idx - k WHERE a.value IS NOT NULL AND b.value IS NOT NULL""",
    "ev",
)
part(
    "pts",
    f"""SELECT e.series_id, e.idx AS t, e.idx - {H} AS cutoff, e.week, e.value AS target_value, e.threshold, l.value AS last_value
    FROM ev e JOIN ev l ON l.series_id = e.series_id AND l.idx = e.idx - {H + 1}
    WHERE e.idx >= greatest({fv.MIN_CONTEXT + H}, e.n - {fv.SEASON_WEEKS}) AND e.value >= e.threshold AND l.value IS NOT NULL""",
    "ev",
)


@query(
    "diff_pool",
    sql(
        f"""SELECT e.series_id, {B("e.idx + 1", "cutoff")}, {R("any_value(e.value)", "last_value")}, 2 * count(*) AS pool_size,
            {R("2 * sum(abs(d))", "pool_abs")}, {R("max(abs(d))", "pool_max")}
        FROM ev e JOIN diffs f ON f.series_id = e.series_id AND k = 1 AND f.idx > e.idx - {fv.HISTORY_WEEKS} AND f.idx <= e.idx
        WHERE e.value IS NOT NULL GROUP BY e.series_id, e.idx HAVING count(*) >= {fv.MIN_POOL}""",
        "ev",
        "diffs",
    ),
)
def diff_pool(spark, d):
    return fc.diff_pool(evaluation_weekly(spark, d)).select(
        "series_id",
        "cutoff",
        "last_value",
        F.size("pool").alias("pool_size"),
        F.aggregate("pool", F.lit(0.0), lambda a, x: a + F.abs(x)).alias("pool_abs"),
        F.array_max("pool").alias("pool_max"),
    )


@query(
    "rolling_cutoffs",
    sql(
        f"SELECT series_id, {B('t', 't')}, {B('cutoff', 'cutoff')}, week, {R('target_value', 'target_value')}, {R('threshold', 'threshold')}, {R('last_value', 'last_value')} FROM pts",
        "pts",
    ),
)
def rolling_cutoffs(spark, d):
    return points(spark, d).select("series_id", "t", "cutoff", "week", "target_value", "threshold", "last_value")


def walk_parts(prefix: str, pts: str, levels: str, n_paths: int) -> None:
    """Hash-driven random walks, drawn path by path in SQL."""
    part(
        f"{prefix}_el",
        f"""SELECT series_id, cutoff, last_value, threshold, pos, CASE WHEN pos < k THEN d ELSE -d END AS d, 2 * k AS size FROM (
            SELECT p.series_id, p.cutoff, p.last_value, p.threshold, f.d, count(*) OVER (PARTITION BY p.series_id, p.cutoff) AS k,
                row_number() OVER (PARTITION BY p.series_id, p.cutoff ORDER BY f.idx) - 1 AS p0
            FROM {pts} p JOIN diffs f ON f.series_id = p.series_id AND f.k = 1 AND f.idx >= p.cutoff - {fv.HISTORY_WEEKS} AND f.idx < p.cutoff) z,
            LATERAL (SELECT unnest([p0, p0 + k]) AS pos) WHERE k >= {fv.MIN_POOL}""",
        pts,
        "diffs",
    )
    part(
        f"{prefix}_x0",
        f"""SELECT series_id, cutoff, last_value, size, path, step,
            (CAST('0x' || substr(md5(series_id || '|' || cutoff), 1, 8) AS BIGINT) + path * 2654435761 + step * 2246822519) & 4294967295 AS x
        FROM (SELECT DISTINCT series_id, cutoff, last_value, size FROM {prefix}_el),
            (SELECT unnest(range(1, {n_paths} + 1)) AS path), (SELECT unnest(range(1, {H} + 1)) AS step)""",
        f"{prefix}_el",
    )
    part(f"{prefix}_x1", f"SELECT * REPLACE ((xor(x >> 16, x) * 73244475) & 4294967295 AS x) FROM {prefix}_x0", f"{prefix}_x0")
    part(f"{prefix}_x2", f"SELECT * REPLACE ((xor(x >> 16, x) * 73244475) & 4294967295 AS x) FROM {prefix}_x1", f"{prefix}_x1")
    part(
        prefix,
        f"""SELECT series_id, cutoff, step AS h, quantile_cont(v, {levels}) AS q FROM (
            SELECT x.series_id, x.cutoff, x.step, greatest(0.0, x.last_value + sum(e.d) OVER (PARTITION BY x.series_id, x.cutoff, x.path ORDER BY x.step)) AS v
            FROM {prefix}_x2 x JOIN {prefix}_el e ON e.series_id = x.series_id AND e.cutoff = x.cutoff AND e.pos = xor(x.x >> 16, x.x) % x.size)
        WHERE step > 1 GROUP BY 1, 2, 3
        UNION ALL SELECT series_id, cutoff, 1, quantile_cont(greatest(0.0, last_value + d), {levels}) FROM {prefix}_el GROUP BY 1, 2""",
        f"{prefix}_x2",
        f"{prefix}_el",
    )


walk_parts("rw", "pts", L7, N_PATHS)

part(
    "sn",
    f"""SELECT p.series_id, p.cutoff, h, [greatest(0.0, b.value + r) FOR r IN q] AS q FROM (
        SELECT p.series_id, p.cutoff, quantile_cont(d, {L7}) AS q FROM pts p JOIN diffs f ON f.series_id = p.series_id AND f.k = 52
            AND f.idx >= p.cutoff - {fv.HISTORY_WEEKS} AND f.idx < p.cutoff GROUP BY 1, 2 HAVING count(*) >= {fv.MIN_POOL}) p,
        (SELECT unnest(range(1, {H} + 1)) AS h) JOIN ev b ON b.series_id = p.series_id AND b.idx = p.cutoff + h - 53 WHERE b.value IS NOT NULL""",
    "pts",
    "diffs",
    "ev",
)


def direct_part(name: str, pts: str, diffs: str, levels: str, steps: int, history: int | None = fv.HISTORY_WEEKS) -> None:
    window = f"AND f.idx >= p.cutoff - {history}" if history is not None else ""
    part(
        name,
        f"""SELECT series_id, cutoff, h, [greatest(0.0, last_value + r) FOR r IN q] AS q FROM (
            SELECT series_id, cutoff, last_value, k AS h, quantile_cont(d, {levels}) AS q FROM (
                SELECT p.series_id, p.cutoff, p.last_value, f.k, unnest([f.d, -f.d]) AS d FROM {pts} p JOIN {diffs} f
                ON f.series_id = p.series_id AND f.k <= {steps} {window} AND f.idx < p.cutoff)
            GROUP BY 1, 2, 3, 4 HAVING count(*) >= {2 * fv.MIN_POOL})""",
        pts,
        diffs,
    )


direct_part("ds", "pts", "diffs", L7, H)


def _long(name: str) -> str:
    return (
        f"SELECT series_id, {B('cutoff', 'cutoff')}, {B('h', 'h')}, {R('level', 'level')}, {R('value', 'value')} FROM ("
        f"SELECT series_id, cutoff, h, unnest({L7}) AS level, unnest(q) AS value FROM {name})"
    )


@query("random_walk_quantiles", sql(_long("rw"), "rw"))
def random_walk_quantiles(spark, d):
    walked = fc.random_walk_quantiles(points(spark, d), n_paths=N_PATHS)
    return fc.long_quantiles(walked, "random_walk")


@query("seasonal_naive_quantiles", sql(_long("sn"), "sn"))
def seasonal_naive_quantiles(spark, d):
    return fc.long_quantiles(fc.seasonal_naive_quantiles(points(spark, d)), "seasonal_naive")


@query(
    "quantile_sort_levels",
    sql(
        f"""SELECT series_id, {B("cutoff", "cutoff")}, {B("h", "h")}, CAST(7 AS BIGINT) AS n_levels, {R("q[1]", "lowest")}, {R("q[4]", "median")}, {R("q[7]", "highest")} FROM ds""",
        "ds",
    ),
)
def quantile_sort_levels(spark, d):
    arrays = fc.level_positions(fc.long_quantiles(fc.direct_step_quantiles(points(spark, d)), "direct_step"))
    mid = F.element_at("q", F.array_position("levels", F.lit(0.5)).cast("int"))
    return arrays.select(
        "series_id",
        "cutoff",
        "h",
        F.size("levels").alias("n_levels"),
        F.element_at("q", 1).alias("lowest"),
        mid.alias("median"),
        F.element_at("q", -1).alias("highest"),
    )


part("origin", "SELECT series_id, n AS cutoff, value AS last_value, threshold FROM ev WHERE idx = n - 1", "ev")
direct_part("ahead", "origin", "diffs", L9, H)


@query(
    "forecast_layout",
    sql(
        f"""SELECT series_id, {B("idx", "time")}, {R("value", "context")}, NULL::DOUBLE AS mean_forecast, NULL::DOUBLE AS q_low, NULL::DOUBLE AS q_high FROM ev
        UNION ALL SELECT o.series_id, {B("o.cutoff + s.h - 1", "time")}, NULL, {R("q[5]")}, {R("q[1]")}, {R("q[9]")}
        FROM origin o CROSS JOIN (SELECT unnest(range(1, {H} + 1)) AS h) s LEFT JOIN ahead a ON a.series_id = o.series_id AND a.h = s.h""",
        "ev",
        "origin",
        "ahead",
    ),
)
def forecast_layout(spark, d):
    weekly = evaluation_weekly(spark, d)
    origin = fc.direct_step_quantiles(fc.forecast_origin(weekly), fv.LEVELS_9)
    return fc.forecast_layout(weekly, origin, "direct_step").select(
        "series_id",
        "time",
        "context",
        "mean_forecast",
        F.element_at("q", 1).alias("q_low"),
        F.element_at("q", 9).alias("q_high"),
    )
