"""Series construction and cleaning."""

from pyspark.sql import functions as F

from seriloom.catalog import tables as tt
from seriloom.catalog.registry import query
from seriloom.catalog.sqlparts import B, R, part, sql
from seriloom.operators import series as se
from seriloom.operators import views as vw
from seriloom.sources import testbed as tb

W = f"series_id, week, {B('idx', 'idx')}, {R('value', 'value')}"


@query(
    "single_indicator",
    sql(
        f"""SELECT series_id, obs_date, {R("ili", "cases")} FROM obs_cust
        WHERE series_id IN (SELECT series_id FROM obs_cust WHERE ili > 0)""",
        "obs_cust",
    ),
)
def single_indicator(spark, d):
    return se.single_indicator(tb.observations(spark, d, "customer"), "ili")


@query(
    "adaptive_indicator",
    sql(
        f"""SELECT series_id, obs_date, {R("CASE WHEN i THEN ili ELSE ari END", "cases")}, {B("CASE WHEN i THEN 0 ELSE 1 END", "data_type")}
        FROM obs_cust JOIN (SELECT series_id, max(ili) > 0 AS i, max(ari) > 0 AS a FROM obs_cust GROUP BY 1) USING (series_id) WHERE i OR a""",
        "obs_cust",
    ),
)
def adaptive_indicator(spark, d):
    return se.adaptive_indicator(tb.observations(spark, d, "customer"))


@query(
    "combine_indicators",
    sql(f"SELECT series_id, obs_date, {R('cases', 'cases')}, {B('data_type', 'data_type')} FROM combined_cust", "combined_cust"),
)
def combine_indicators(spark, d):
    return tt.combined(spark, d, "customer")


@query(
    "parallel_guard",
    sql(
        f"""SELECT series_id, n_both, n_ili, n_ari, {R("years_ili", "years_ili")}, {R("years_ari", "years_ari")},
            {R("med_ili", "med_ili")}, {R("med_ari", "med_ari")}, winner, winner_weeks, {R("winner_years", "winner_years")}, keep_only
        FROM profile_amounts""",
        "profile_amounts",
    ),
)
def parallel_guard(spark, d):
    return se.indicator_profile(tb.daily_amounts(spark, d))


part(
    "days",
    """SELECT series_id, CAST(unnest(generate_series(CAST(lo AS TIMESTAMP), CAST(hi AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS obs_date
    FROM (SELECT series_id, min(obs_date) AS lo, max(obs_date) AS hi FROM combined GROUP BY 1)""",
    "combined",
)


@query(
    "daily_grid",
    sql(
        f"""SELECT series_id, obs_date, {R("cases", "cases")}, {B("data_type", "data_type")}
        FROM days LEFT JOIN combined USING (series_id, obs_date)""",
        "days",
    ),
)
def daily_grid(spark, d):
    return se.daily_grid(tt.combined(spark, d))


@query("weekly_resample", sql(f"SELECT {W} FROM weekly", "weekly"))
def weekly_resample(spark, d):
    return tt.weekly(spark, d)


@query(
    "gap_profile",
    sql(
        f"""SELECT a.*, b.* EXCLUDE (series_id) FROM
        (SELECT series_id, count(*) AS daily_total, count(*) - count(cases) AS daily_missing,
            {R("100.0 * (count(*) - count(cases)) / count(*)", "daily_missing_pct")}
         FROM days LEFT JOIN combined USING (series_id, obs_date) GROUP BY 1) a
        JOIN (SELECT series_id, count(*) AS weekly_total, count(*) - count(value) AS weekly_missing,
            {R("100.0 * (count(*) - count(value)) / count(*)", "weekly_missing_pct")} FROM weekly GROUP BY 1) b USING (series_id)""",
        "days",
        "weekly",
    ),
)
def gap_profile(spark, d):
    series = tt.combined(spark, d)
    return se.gap_profile(series, se.weekly_resample(series))


@query(
    "zero_policy",
    sql(
        f"""SELECT mode, {W.replace("value", "CASE WHEN value = 0 THEN CASE mode WHEN 'floor' THEN 1e-6 WHEN 'keep' THEN 0.0 END ELSE value END", 1)}
        FROM weekly_ili, (SELECT unnest(['floor', 'keep', 'null']) AS mode)""",
        "weekly_ili",
    ),
)
def zero_policy(spark, d):
    weekly = tt.weekly_ili(spark, d)
    out = None
    for mode in ("floor", "keep", "null"):
        one = se.zero_policy(weekly, mode).withColumn("mode", F.lit(mode))
        out = one if out is None else out.unionByName(one)
    return out


@query(
    "clip_outliers",
    sql(
        f"""SELECT series_id, week, {B("idx", "idx")}, {R("CASE WHEN value IS NOT NULL THEN least(greatest(least(value, q3 + 1.5 * (q3 - q1)), q1 - 1.5 * (q3 - q1)), 3.0) END", "value")}
        FROM weekly JOIN (SELECT series_id, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM weekly GROUP BY 1) USING (series_id)""",
        "weekly",
    ),
)
def clip_outliers(spark, d):
    return se.clip_outliers(tt.weekly(spark, d), iqr=True, max_value=3.0)


@query(
    "context_tail",
    sql(
        f"SELECT {W} FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY idx DESC) AS r FROM weekly) WHERE r <= 128",
        "weekly",
    ),
)
def context_tail(spark, d):
    return se.context_tail(tt.weekly(spark, d), 128)


@query(
    "undated_series",
    f"""SELECT event_type AS series_id, CAST(NULL AS DATE) AS week,
        row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS idx, {R("value", "value")} FROM events""",
)
def undated_series(spark, d):
    return se.undated_series(tb.table(spark, d, "events"), "value", "event_id", chunk=1000, series="event_type")


@query(
    "train_test_split",
    sql(
        f"""SELECT {W}, CASE WHEN idx < CAST(floor(n * (1.0::DOUBLE - 0.2::DOUBLE)) AS BIGINT) THEN 'train' ELSE 'test' END AS part
        FROM (SELECT *, count(*) OVER (PARTITION BY series_id) AS n FROM weekly)""",
        "weekly",
    ),
)
def train_test_split(spark, d):
    return se.train_test_split(tt.weekly(spark, d), 0.2)


@query("zero_runs_to_null", sql(f"SELECT {W} FROM no_runs", "no_runs"))
def zero_runs_to_null(spark, d):
    return se.zero_runs_to_null(tt.weekly_ili(spark, d))


@query("trim_leading", sql(f"SELECT {W} FROM clean", "clean"))
def trim_leading(spark, d):
    return tt.clean(spark, d)


part(
    "flag_days",
    """SELECT series_id, obs_date, coalesce(last_value(data_type IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY obs_date),
        first_value(data_type IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY obs_date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS flag
    FROM days LEFT JOIN combined USING (series_id, obs_date)""",
    "days",
)
part(
    "flag_weeks",
    """SELECT w.series_id, w.week, w.idx, w.value, coalesce(f.flag, 0) AS flag FROM weekly w LEFT JOIN (
        SELECT series_id, CAST(date_trunc('week', obs_date) + INTERVAL 6 DAY AS DATE) AS week, max(flag) AS flag FROM flag_days GROUP BY 1, 2) f
    ON f.series_id = w.series_id AND f.week = w.week""",
    "flag_days",
    "weekly",
)


@query("data_type_weekly", sql(f"SELECT {W}, {R('flag', 'data_type_indicator')} FROM flag_weeks", "flag_weeks"))
def data_type_weekly(spark, d):
    series = tt.combined(spark, d)
    return se.data_type_weekly(series, se.weekly_resample(series))


part(
    "switches",
    """SELECT series_id, obs_date AS date, CASE prev WHEN 1 THEN 'ARI' ELSE 'ILI' END AS from_type, CASE data_type WHEN 1 THEN 'ARI' ELSE 'ILI' END AS to_type
    FROM (SELECT *, lag(data_type) OVER (PARTITION BY series_id ORDER BY obs_date) AS prev FROM combined_cust) WHERE prev <> data_type""",
    "combined_cust",
)


@query("type_changes", sql("SELECT * FROM switches", "switches"))
def type_changes(spark, d):
    return se.type_changes(tt.combined(spark, d, "customer"))


part(
    "nation_facts",
    f"""SELECT s.series_id, r_name AS parent, max(obs_date) AS last_update, CASE arg_max(data_type, obs_date) WHEN 1 THEN 'ARI' ELSE 'ILI' END AS data_type, coalesce(any_value(changes), '') AS changes
    FROM combined s JOIN nation ON n_name = s.series_id JOIN region ON n_regionkey = r_regionkey LEFT JOIN (
        SELECT series_id, string_agg(strftime(obs_date, '%Y-%m-%d') || '>' || CASE prev WHEN 1 THEN 'ARI' ELSE 'ILI' END || '>' || CASE data_type WHEN 1 THEN 'ARI' ELSE 'ILI' END, ';' ORDER BY obs_date) AS changes
        FROM (SELECT *, lag(data_type) OVER (PARTITION BY series_id ORDER BY obs_date) AS prev FROM combined) WHERE prev <> data_type GROUP BY 1) c USING (series_id)
    GROUP BY 1, 2""",
    "combined",
)


@query(
    "combine_parts",
    sql(
        f"""SELECT * FROM (SELECT parent, week AS date, {R("sum(value)", "historical")}, {R("sum(value * 2)", "forecast")}, {R("sum(value - 1)", "lower")},
            {R("sum(value + 1)", "upper")}, {R("sum(NULL::DOUBLE)", "lower_50")}, {R("sum(idx)", "upper_50")}
        FROM weekly JOIN (SELECT n_name AS series_id, r_name AS parent FROM nation JOIN region ON n_regionkey = r_regionkey) USING (series_id)
        GROUP BY 1, 2) JOIN (SELECT parent, max(last_update) AS last_update, max(last_update) <= DATE '{tt.AS_OF}' - 56 AS stale, count(*) AS n_parts,
            CASE WHEN count(*) FILTER (WHERE data_type = 'ILI') > count(*) FILTER (WHERE data_type = 'ARI') THEN 'ILI' ELSE 'ARI' END AS data_type,
            CASE WHEN min(changes) = max(changes) THEN min(changes) ELSE '' END AS changes FROM nation_facts GROUP BY 1) USING (parent)""",
        "weekly",
        "nation_facts",
    ),
)
def combine_parts(spark, d):
    v = F.col("value")
    series = tt.combined(spark, d)
    points = se.weekly_resample(series).select(
        "series_id",
        F.col("week").alias("date"),
        v.alias("historical"),
        (v * 2).alias("forecast"),
        (v - 1).alias("lower"),
        (v + 1).alias("upper"),
        F.lit(None).cast("double").alias("lower_50"),
        F.col("idx").cast("double").alias("upper_50"),
    )
    parts = tt.regions(spark, d)
    info = series.groupBy("series_id").agg(F.max("obs_date").alias("last_update"))
    info = info.join(vw.type_info(series), "series_id").select("series_id", "last_update", vw.type_name(F.col("current_type")).alias("data_type"))
    facts = vw.combine_facts(info, parts, se.type_changes(series), tt.as_of())
    return vw.combine_parts(points, parts).join(facts, "parent")
