"""Quality screening and training windows."""

from pyspark.sql import functions as F

from seriloom.catalog import series as _series  # noqa: F401  (flag_weeks part)
from seriloom.catalog import tables as tt
from seriloom.catalog.registry import query
from seriloom.catalog.sqlparts import B, R, part, sql
from seriloom.operators import covariates as cv
from seriloom.operators import entities as en
from seriloom.operators import screening as sc
from seriloom.operators import series as se
from seriloom.sources import testbed as tb

CONTEXT, TARGET, STRIDE, HELD = 104, 4, 4, 52
SIZES = {"context": CONTEXT, "target": TARGET, "stride": STRIDE, "held_out": HELD}


@query(
    "nan_pattern",
    sql(
        """SELECT series_id, count(*) FILTER (WHERE m < 0.2) AS full_months, count(*) FILTER (WHERE m > 0.8) AS empty_months,
            CASE WHEN count(*) FILTER (WHERE m < 0.2) >= 8 AND count(*) FILTER (WHERE m > 0.8) >= 2 THEN 'seasonal' ELSE 'sporadic' END AS pattern
        FROM (SELECT series_id, month(week) AS mm, avg((value IS NULL)::INT) AS m FROM weekly_ns GROUP BY 1, 2) GROUP BY 1""",
        "weekly_ns",
    ),
)
def nan_pattern(spark, d):
    return sc.nan_pattern(tt.weekly(spark, d, "nation_segment"))


part(
    "screen",
    f"""SELECT *, exclude_reason = '' AS include FROM (SELECT *, concat_ws('; ',
            CASE WHEN n_weeks_nonnan < 156 THEN 'too_few_nonnan(' || n_weeks_nonnan || '<156)' END,
            CASE WHEN years_coverage < 4 THEN 'too_short(' || years_coverage || 'yr<4)' END,
            CASE WHEN nan_pattern = 'sporadic' AND nan_pct > 20 THEN 'high_nan_sporadic(' || nan_pct || '%>20%)' END,
            CASE WHEN scale < 2.0 THEN 'too_small_scale(' || scale || '<2.0)' END) AS exclude_reason
        FROM (SELECT series_id, count(value) AS n_weeks_nonnan, {R("100.0 * (1 - count(value) / CAST(count(*) AS DOUBLE))", "nan_pct", 1)},
                {R("date_diff('day', min(week), max(week)) / 365.25", "years_coverage", 1)},
                {R("coalesce(quantile_cont(value, 0.5) FILTER (WHERE value > 0), 0)", "scale", 2)} FROM clean GROUP BY 1)
        JOIN (SELECT series_id, CASE WHEN count(*) FILTER (WHERE m < 0.2) >= 8 AND count(*) FILTER (WHERE m > 0.8) >= 2 THEN 'seasonal' ELSE 'sporadic' END AS nan_pattern
              FROM (SELECT series_id, month(week) AS mm, avg((value IS NULL)::INT) AS m FROM clean GROUP BY 1, 2) GROUP BY 1) USING (series_id))""",
    "clean",
)


def screen(spark, d):
    return sc.quality_screen(tt.clean(spark, d), max_missing=20.0, min_scale=2.0)


@query("quality_screen", sql("SELECT * FROM screen", "screen"))
def quality_screen(spark, d):
    return screen(spark, d)


@query(
    "screen_override",
    sql(
        """SELECT series_id, include AND n_regionkey <> 0 AS include,
            CASE WHEN n_regionkey = 0 THEN 'manually excluded' ELSE exclude_reason END AS exclude_reason
        FROM screen JOIN nation ON n_name = series_id""",
        "screen",
    ),
)
def screen_override(spark, d):
    excluded = tb.table(spark, d, "nation").filter("n_regionkey = 0").select(F.col("n_name").alias("series_id"))
    return sc.screen_override(screen(spark, d), excluded).select("series_id", "include", "exclude_reason")


part("lengths", "SELECT series_id, count(*) AS n, max(week) AS last_week FROM weekly GROUP BY 1", "weekly")
part(
    "windows",
    f"""SELECT w.*, a.context_sum, a.n_context, a.n_missing, f1, f2, f3, f4, p.peak_threshold,
        CASE WHEN part = 'val' THEN 1 ELSE (CASE WHEN weight >= 0.70 THEN 3 WHEN weight >= 0.30 THEN 2 ELSE 1 END)
            * (CASE WHEN greatest(f1, f2, f3, f4) > p.peak_threshold THEN 3 ELSE 1 END) END AS repeats
    FROM (SELECT series_id, n, 'train' AS part, unnest(range({CONTEXT}, n - {HELD} - {TARGET} + 1, {STRIDE})) AS end_ctx FROM lengths WHERE n >= {CONTEXT + TARGET + HELD}
          UNION ALL SELECT series_id, n, 'val', unnest(range(n - {HELD}, n - {TARGET} + 1, {STRIDE})) FROM lengths WHERE n >= {CONTEXT + TARGET + HELD}) w
    JOIN (SELECT l.series_id, coalesce(quantile_cont(value, 0.7) FILTER (WHERE value > 0 AND idx < n - {HELD}), 'inf'::DOUBLE) AS peak_threshold,
              max(week) FILTER (WHERE idx = n - {HELD} - 1) AS newest FROM weekly JOIN lengths l USING (series_id) GROUP BY 1) p ON p.series_id = w.series_id,
    LATERAL (SELECT sum(value) AS context_sum, count(*) AS n_context, count(*) - count(value) AS n_missing,
            exp(-0.3::DOUBLE * date_diff('day', max(week), p.newest) / 365.25::DOUBLE) AS weight
        FROM weekly x WHERE x.series_id = w.series_id AND x.idx >= greatest(0, w.end_ctx - {CONTEXT}) AND x.idx < w.end_ctx) a,
    LATERAL (SELECT max(value) FILTER (WHERE idx = w.end_ctx) AS f1, max(value) FILTER (WHERE idx = w.end_ctx + 1) AS f2,
            max(value) FILTER (WHERE idx = w.end_ctx + 2) AS f3, max(value) FILTER (WHERE idx = w.end_ctx + 3) AS f4
        FROM weekly x WHERE x.series_id = w.series_id AND x.idx >= w.end_ctx AND x.idx < w.end_ctx + {TARGET}) f
    WHERE f1 IS NOT NULL OR f2 IS NOT NULL OR f3 IS NOT NULL OR f4 IS NOT NULL""",
    "weekly",
    "lengths",
)


def _flat(windows):
    total = F.aggregate("target", F.lit(0.0), lambda a, v: a + F.coalesce(v, F.lit(0.0)))
    return windows.select(
        "series_id",
        "end_ctx",
        F.size("target").alias("n_context"),
        F.size(F.filter("target", lambda v: v.isNull())).alias("n_missing"),
        total.alias("context_sum"),
        *[F.get("future", F.lit(i)).alias(f"f{i + 1}") for i in range(TARGET)],
    )


FLAT = (
    f"series_id, {B('end_ctx', 'end_ctx')}, n_context, n_missing, {R('coalesce(context_sum, 0)', 'context_sum')}, "
    + ", ".join(R(f"f{i}", f"f{i}") for i in range(1, 5))
)


@query("train_windows", sql(f"SELECT {FLAT} FROM windows WHERE part = 'train'", "windows"))
def train_windows(spark, d):
    return _flat(sc.build_windows(tt.weekly(spark, d), part="train", **SIZES))


@query("val_windows", sql(f"SELECT {FLAT} FROM windows WHERE part = 'val'", "windows"))
def val_windows(spark, d):
    return _flat(sc.build_windows(tt.weekly(spark, d), part="val", **SIZES))


@query(
    "holdout_split",
    sql(f"SELECT series_id, n, n - {HELD} AS train_end, n >= {CONTEXT + TARGET + HELD} AS usable FROM lengths", "lengths"),
)
def holdout_split(spark, d):
    return sc.holdout_split(tt.weekly(spark, d), CONTEXT, TARGET, HELD)


@query(
    "peak_threshold",
    sql(
        f"""SELECT series_id, {R("coalesce(quantile_cont(value, 0.7) FILTER (WHERE value > 0), 'inf'::DOUBLE)", "peak_threshold")}
        FROM weekly JOIN lengths USING (series_id) WHERE idx < n - {HELD} GROUP BY 1""",
        "weekly",
        "lengths",
    ),
)
def peak_threshold(spark, d):
    return sc.peak_threshold(tt.weekly(spark, d), HELD)


@query(
    "recency_repeat",
    sql(
        f"""SELECT series_id, week, {B("CASE WHEN weight >= 0.70 THEN 3 WHEN weight >= 0.30 THEN 2 ELSE 1 END", "repeats")}
        FROM (SELECT series_id, week, exp(-0.3::DOUBLE * date_diff('day', week, last_week) / 365.25::DOUBLE) AS weight FROM weekly JOIN lengths USING (series_id))""",
        "weekly",
        "lengths",
    ),
)
def recency_repeat(spark, d):
    newest = F.max("week").over(se.whole_series())
    return tt.weekly(spark, d).select("series_id", "week", newest.alias("newest")).select(
        "series_id", "week", sc.recency_repeats(F.col("week"), F.col("newest")).alias("repeats")
    )


@query(
    "oversample",
    sql(
        f"SELECT series_id, part, {B('end_ctx', 'end_ctx')}, {B('unnest(range(1, repeats + 1))', 'copy')}, {B('repeats', 'repeats')} FROM windows",
        "windows",
    ),
)
def oversample(spark, d):
    windows = sc.build_windows(tt.weekly(spark, d), **SIZES)
    return sc.oversample(windows).select("series_id", "part", "end_ctx", "copy", "repeats")


COVS = ["hemisphere", "week_sin", "week_cos", "data_type_indicator", "trend"]


def samples(spark, d):
    series = tt.combined(spark, d)
    flagged = cv.week_sincos(se.data_type_weekly(series, se.weekly_resample(series)))
    names = tb.table(spark, d, "nation").select(F.col("n_name").alias("name"))
    hemi = en.coordinates(names, tb.latitudes(spark, d)).select(
        F.col("name").alias("series_id"), en.hemisphere(F.col("lat")).alias("hemisphere")
    )
    full = flagged.join(hemi, "series_id").withColumn("trend", F.col("idx").cast("double"))
    return sc.build_windows(full, covariates=COVS, **SIZES)


@query(
    "sample_covariates",
    sql(
        f"""SELECT w.series_id, w.part, {B("w.end_ctx", "end_ctx")}, 'data_type_indicator,hemisphere,trend,week_cos,week_sin' AS past_names,
            'data_type_indicator,hemisphere,week_cos,week_sin' AS future_names,
            (SELECT {R("sum(flag)")} FROM flag_weeks x WHERE x.series_id = w.series_id AND x.idx >= w.end_ctx - {CONTEXT} AND x.idx < w.end_ctx) AS past_flags,
            (SELECT {R("sum(sin(2 * pi() * weekofyear(week) / 52.0::DOUBLE))")} FROM weekly x WHERE x.series_id = w.series_id AND x.idx >= w.end_ctx AND x.idx < w.end_ctx + 4) AS future_sin
        FROM windows w""",
        "windows",
        "flag_weeks",
    ),
)
def sample_covariates(spark, d):
    def names(c):
        return F.array_join(F.array_sort(F.map_keys(c)), ",")

    def total(c, name):
        return F.aggregate(F.element_at(c, F.lit(name)), F.lit(0.0), lambda a, v: a + v)

    return samples(spark, d).select(
        "series_id",
        "part",
        "end_ctx",
        names("past_covariates").alias("past_names"),
        names("future_covariates").alias("future_names"),
        total("past_covariates", "data_type_indicator").alias("past_flags"),
        total("future_covariates", "week_sin").alias("future_sin"),
    )


@query(
    "detect_features",
    sql("SELECT unnest(['hemisphere', 'week_sin', 'week_cos', 'data_type_indicator', 'trend']) AS feature WHERE EXISTS (SELECT 1 FROM windows)", "windows"),
)
def detect_features(spark, d):
    return sc.detect_features(samples(spark, d))


@query(
    "sample_counts",
    sql(
        f"""SELECT series_id, count(*) FILTER (WHERE part = 'train') AS train_windows,
            {B("coalesce(sum(repeats) FILTER (WHERE part = 'train'), 0)", "train_samples")}, count(*) FILTER (WHERE part = 'val') AS val_windows
        FROM windows GROUP BY 1""",
        "windows",
    ),
)
def sample_counts(spark, d):
    return sc.sample_counts(sc.build_windows(tt.weekly(spark, d), **SIZES))
