"""Published views. Series are (nation, segment) pairs, some of which have gone quiet."""

from pyspark.sql import functions as F

from seriloom.catalog import forecast as cf
from seriloom.catalog import tables as tt
from seriloom.catalog.registry import query
from seriloom.catalog.sqlparts import B, R, level_list, part, sql
from seriloom.functions import fixed_values as fv
from seriloom.operators import forecast as fc
from seriloom.operators import hierarchy as hy
from seriloom.operators import series as se
from seriloom.operators import views as vw
from seriloom.sources import testbed as tb

KEY = "nation_segment"
STEPS = 8
DAY = f"DATE '{tt.AS_OF}'"
MONDAY = f"CAST(date_trunc('week', {DAY}) AS DATE)"

part(
    "stale",
    f"""SELECT series_id, max(obs_date) AS last_update, date_diff('day', max(obs_date), {DAY}) AS age_days,
        date_diff('day', max(obs_date), {DAY}) >= 56 AS stale FROM combined_ns GROUP BY 1""",
    "combined_ns",
)


@query(
    "staleness",
    f"""SELECT 'C' || c_custkey AS series_id, max(CAST(o_orderdate AS DATE)) AS last_update, date_diff('day', max(CAST(o_orderdate AS DATE)), {DAY}) AS age_days,
        coalesce(date_diff('day', max(CAST(o_orderdate AS DATE)), {DAY}) >= 56, true) AS stale
    FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey""",
)
def staleness(spark, d):
    customer, orders = tb.table(spark, d, "customer"), tb.table(spark, d, "orders")
    rows = customer.join(orders, customer.c_custkey == orders.o_custkey, "left").select(
        F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("series_id"),
        F.col("o_orderdate").cast("date").alias("obs_date"),
    )
    return vw.staleness(rows, tt.as_of())


# forecasts at the end of every series
part(
    "ev_ns",
    """SELECT series_id, week, idx, CASE WHEN value = 0 THEN 1e-6::DOUBLE ELSE value END AS value,
        count(*) OVER (PARTITION BY series_id) AS n FROM weekly_ns""",
    "weekly_ns",
)
part(
    "diffs_ns",
    f"""SELECT a.series_id, a.idx, k, a.value - b.value AS d FROM ev_ns a, (SELECT unnest(range(1, {STEPS} + 1)) AS k)
    JOIN ev_ns b ON b.series_id = a.series_id AND b.idx = a.idx - k WHERE a.value IS NOT NULL AND b.value IS NOT NULL""",
    "ev_ns",
)
part("origin_ns", "SELECT series_id, n AS cutoff, value AS last_value FROM ev_ns WHERE idx = n - 1", "ev_ns")
cf.direct_part("ahead_ns", "origin_ns", "diffs_ns", level_list(fv.LEVELS_9), STEPS)
part(
    "points",
    """SELECT series_id, CAST("start" + 7 * idx AS DATE) AS date, historical, forecast, lower, upper, lower_50, upper_50 FROM (
        SELECT series_id, CAST(idx AS INT) AS idx, value AS historical, NULL::DOUBLE AS forecast, NULL::DOUBLE AS lower, NULL::DOUBLE AS upper, NULL::DOUBLE AS lower_50, NULL::DOUBLE AS upper_50 FROM ev_ns
        UNION ALL SELECT o.series_id, CAST(o.cutoff + h - 1 AS INT), NULL, q[5], q[1], q[9], (q[2] + q[3]) / 2, (q[7] + q[8]) / 2
        FROM origin_ns o, (SELECT unnest(range(1, 9)) AS h) LEFT JOIN ahead_ns a ON a.series_id = o.series_id AND a.h = h.h)
    JOIN (SELECT series_id, min(obs_date) AS "start" FROM combined_ns GROUP BY 1) USING (series_id)""".replace(
        "(SELECT unnest(range(1, 9)) AS h) LEFT", "(SELECT unnest(range(1, 9)) AS h) h LEFT"
    ).replace("o.cutoff + h - 1", "o.cutoff + h.h - 1"),
    "ev_ns",
    "origin_ns",
    "ahead_ns",
    "combined_ns",
)
FIELDS = ", ".join(R(f, f) for f in vw.FIELDS)


def base_series(spark, d):
    return tt.combined(spark, d, KEY)


def points(spark, d, series=None):
    series = base_series(spark, d) if series is None else series
    weekly = se.zero_policy(se.weekly_resample(series), "floor")
    origin = fc.direct_step_quantiles(fc.forecast_origin(weekly, STEPS), fv.LEVELS_9)
    layout = fc.forecast_layout(weekly, origin, "direct_step")
    starts = series.groupBy("series_id").agg(F.min("obs_date").alias("start"))
    return vw.series_points(layout, starts)


@query("series_points", sql(f"SELECT series_id, date, {FIELDS} FROM points", "points"))
def series_points(spark, d):
    return points(spark, d)


@query(
    "suppress_stale",
    sql(
        "SELECT series_id, date, stale, "
        + R("historical", "historical")
        + ", "
        + ", ".join(R(f"CASE WHEN NOT stale THEN {f} END", f) for f in vw.BAND)
        + " FROM points JOIN stale USING (series_id)",
        "points",
        "stale",
    ),
)
def suppress_stale(spark, d):
    series = base_series(spark, d)
    return vw.suppress_stale(points(spark, d, series), vw.staleness(series, tt.as_of()))


part(
    "now",
    f"""SELECT series_id, coalesce(historical, greatest(forecast, 0.0)) AS value,
        CASE WHEN historical IS NOT NULL THEN 'actual' WHEN forecast IS NOT NULL THEN 'forecast' END AS source
    FROM points WHERE date = DATE '2001-07-30'""",
    "points",
)


@query("nowcast_value", sql(f"SELECT series_id, {R('CASE WHEN source IS NOT NULL THEN value END', 'value')}, source FROM now", "now"))
def nowcast_value(spark, d):
    return vw.nowcast_value(points(spark, d), F.lit("2001-07-30").cast("date"))


part(
    "info",
    """SELECT series_id, arg_max(data_type, obs_date) AS current_type, min(obs_date) AS "start" FROM combined_ns GROUP BY 1""",
    "combined_ns",
)


@query("type_info", sql(f"SELECT series_id, {B('current_type', 'current_type')}, start FROM info", "info"))
def type_info(spark, d):
    return vw.type_info(base_series(spark, d))


part(
    "z_base",
    """SELECT series_id, CASE WHEN n_same >= 13 THEN m1 ELSE m0 END AS mean, CASE WHEN n_same >= 13 THEN s1 ELSE s0 END AS std, n_same FROM (
        SELECT p.series_id, avg(historical) AS m0, stddev_samp(historical) AS s0, avg(historical) FILTER (WHERE t.data_type = i.current_type) AS m1,
            stddev_samp(historical) FILTER (WHERE t.data_type = i.current_type) AS s1, count(historical) FILTER (WHERE t.data_type = i.current_type) AS n_same
        FROM points p JOIN info i USING (series_id) LEFT JOIN combined_ns t ON t.series_id = p.series_id AND t.obs_date = p.date
        WHERE historical IS NOT NULL GROUP BY 1)""",
    "points",
    "info",
    "combined_ns",
)


@query("type_aware_baseline", sql(f"SELECT series_id, {R('mean', 'mean')}, {R('std', 'std')}, n_same FROM z_base", "z_base"))
def type_aware_baseline(spark, d):
    series = base_series(spark, d)
    return vw.type_aware_baseline(points(spark, d, series), vw.type_map(series), vw.type_info(series))


@query(
    "merged_type_map",
    sql(
        f"""SELECT parent, obs_date AS date, {B("CASE WHEN min(data_type) = max(data_type) THEN min(data_type) END", "data_type")}
        FROM (SELECT split_part(series_id, '/', 1) AS parent, * FROM combined_ns)
        WHERE parent IN (SELECT split_part(series_id, '/', 1) FROM info GROUP BY 1 HAVING min(current_type) = max(current_type)) GROUP BY 1, 2""",
        "combined_ns",
        "info",
    ),
)
def merged_type_map(spark, d):
    series = base_series(spark, d)
    info = vw.type_info(series)
    parts = info.select(F.split_part("series_id", F.lit("/"), F.lit(1)).alias("parent"), "series_id")
    return vw.merged_type_map(vw.type_map(series), info, parts)


_Z = "CASE WHEN std > 0 THEN (value - mean) / std ELSE 0 END"


part(
    "z_hist",
    """SELECT series_id, CASE WHEN n_same >= 13 THEN m1 ELSE m0 END AS mean, CASE WHEN n_same >= 13 THEN s1 ELSE s0 END AS std FROM (
        SELECT p.series_id, avg(value) AS m0, stddev_samp(value) AS s0, avg(value) FILTER (WHERE t.data_type = i.current_type) AS m1,
            stddev_samp(value) FILTER (WHERE t.data_type = i.current_type) AS s1, count(value) FILTER (WHERE t.data_type = i.current_type) AS n_same
        FROM weekly p JOIN (SELECT series_id, arg_max(data_type, obs_date) AS current_type FROM combined GROUP BY 1) i USING (series_id)
        LEFT JOIN combined t ON t.series_id = p.series_id AND t.obs_date + 6 = p.week WHERE value IS NOT NULL GROUP BY 1)""",
    "weekly",
    "combined",
)


@query(
    "activity_score",
    sql(
        f"""SELECT series_id, {R("value", "value")}, 'actual' AS source, {R("z", "zscore")}, {R("least(greatest(z / 2, 0), 1)", "score")},
            CASE WHEN z >= 1 THEN 'high' ELSE 'low' END AS status
        FROM (SELECT w.series_id, value, {_Z} AS z FROM weekly w JOIN z_hist USING (series_id) WHERE week = DATE '2001-07-29' AND value IS NOT NULL)""",
        "weekly",
        "z_hist",
    ),
)
def activity_score(spark, d):
    """Which series are unusually active in one week, from reports alone."""
    series = tt.combined(spark, d)
    weekly = se.weekly_resample(series)
    hist = weekly.select("series_id", F.date_sub("week", 6).alias("date"), F.col("value").alias("historical"))
    base = vw.type_aware_baseline(hist, vw.type_map(series), vw.type_info(series))
    week = hist.withColumn("forecast", F.lit(None).cast("double"))
    now = vw.nowcast_value(week, F.lit("2001-07-23").cast("date")).filter("value IS NOT NULL")
    return vw.activity_score(now, base)


part(
    "future",
    f"""SELECT series_id, date, greatest(forecast, 0.0) AS value, mean, std FROM points JOIN stale USING (series_id) JOIN z_base USING (series_id)
    WHERE forecast IS NOT NULL AND date IN (SELECT CAST({MONDAY} + 7 * k AS DATE) FROM (SELECT unnest([1, 2, 3, 4]) AS k)) AND date_diff('day', last_update, date) <= 56""",
    "points",
    "stale",
    "z_base",
)


@query(
    "future_weeks_view",
    sql(
        f"""SELECT series_id, date, {R("value", "value")}, {R("z", "zscore")}, {R("least(greatest(z / 2, 0), 1)", "score")}, CASE WHEN z >= 1 THEN 'high' ELSE 'low' END AS status
        FROM (SELECT *, {_Z} AS z FROM future)""",
        "future",
    ),
)
def future_weeks_view(spark, d):
    series = base_series(spark, d)
    facts = hy.series_facts(series)
    scores = hy.published(points(spark, d, series), facts, hy.own_nodes(facts), tt.as_of())
    return hy.future_weeks(scores).withColumnRenamed("code", "series_id")


@query(
    "week_calendar",
    """SELECT day, CAST(date_trunc('week', day) + k * INTERVAL 7 DAY AS DATE) AS monday, k AS step FROM (
        SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders), (SELECT unnest(range(0, 5)) AS k)""",
)
def week_calendar(spark, d):
    days = tb.table(spark, d, "orders").select(F.col("o_orderdate").cast("date").alias("day")).distinct()
    return days.select("day", F.posexplode(vw.week_calendar(F.col("day"))).alias("step", "monday"))


# nations of two regions stand for their segments; a series of every eleventh nation has no code
part(
    "nodes",
    """SELECT DISTINCT series_id, code, name, parent FROM (
        SELECT series_id, code || '-' || seg AS code, replace(series_id, '_', ' ') AS name, CASE WHEN up THEN code END AS parent FROM coded_ns
        UNION ALL SELECT series_id, code, replace(nation, '_', ' '), NULL FROM coded_ns WHERE up)""",
    "coded_ns",
)
part(
    "coded_ns",
    """SELECT DISTINCT series_id, n_name AS nation, substr(split_part(series_id, '/', 2), 1, 1) AS seg, 'N' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS code,
        n_regionkey IN (0, 2) AS up FROM combined_ns JOIN nation ON n_name = split_part(series_id, '/', 1) WHERE n_nationkey % 11 <> 10""",
    "combined_ns",
)
part(
    "switches_ns",
    """SELECT series_id, string_agg(strftime(obs_date, '%Y-%m-%d') || '>' || CASE prev WHEN 1 THEN 'ARI' ELSE 'ILI' END || '>' || CASE data_type WHEN 1 THEN 'ARI' ELSE 'ILI' END, ';' ORDER BY obs_date) AS changes
    FROM (SELECT *, lag(data_type) OVER (PARTITION BY series_id ORDER BY obs_date) AS prev FROM combined_ns) WHERE prev <> data_type GROUP BY 1""",
    "combined_ns",
)
part(
    "node_facts",
    f"""SELECT *, coalesce(date_diff('day', last_update, {DAY}) >= 56, true) AS stale FROM (
        SELECT code, min(name) AS name, min(parent) AS parent, max(last_update) AS last_update, count(*) AS n_parts,
            CASE WHEN count(*) FILTER (WHERE current_type = 1) > count(*) FILTER (WHERE current_type = 0) THEN 'ARI'
                WHEN count(*) FILTER (WHERE current_type = 1) < count(*) FILTER (WHERE current_type = 0) THEN 'ILI' ELSE 'ARI' END AS data_type,
            CASE WHEN min(coalesce(changes, '')) = max(coalesce(changes, '')) THEN min(coalesce(changes, '')) ELSE '' END AS changes,
            CASE WHEN min(current_type) = max(current_type) THEN min(current_type) END AS current_type
        FROM nodes JOIN stale USING (series_id) JOIN info USING (series_id) LEFT JOIN switches_ns USING (series_id) GROUP BY code)""",
    "nodes",
    "stale",
    "info",
    "switches_ns",
)
part(
    "node_points",
    "SELECT code, p.date, "
    + "sum(historical) AS historical, "
    + ", ".join(f"sum(CASE WHEN NOT stale THEN {f} END) AS {f}" for f in vw.BAND)
    + """, CASE WHEN min(data_type) = max(data_type) THEN min(data_type) END AS data_type
    FROM points p JOIN stale USING (series_id) JOIN nodes USING (series_id) LEFT JOIN combined_ns c ON c.series_id = p.series_id AND c.obs_date = p.date GROUP BY 1, 2""",
    "points",
    "stale",
    "nodes",
    "combined_ns",
)
part(
    "node_base",
    """SELECT code, CASE WHEN n_same >= 13 THEN m1 ELSE m0 END AS mean, CASE WHEN n_same >= 13 THEN s1 ELSE s0 END AS std, since FROM (
        SELECT code, avg(historical) AS m0, stddev_samp(historical) AS s0, avg(historical) FILTER (WHERE p.data_type = f.current_type) AS m1,
            stddev_samp(historical) FILTER (WHERE p.data_type = f.current_type) AS s1, count(historical) FILTER (WHERE p.data_type = f.current_type) AS n_same,
            min(date) FILTER (WHERE historical IS NOT NULL) AS since
        FROM node_points p JOIN node_facts f USING (code) GROUP BY 1)""",
    "node_points",
    "node_facts",
)
part(
    "node_status",
    f"""SELECT f.*, since, value, source, {_Z} AS z, mean, std FROM node_facts f LEFT JOIN node_base USING (code) LEFT JOIN (
        SELECT code, CASE WHEN historical IS NULL THEN greatest(forecast, 0.0) ELSE historical END AS value,
            CASE WHEN historical IS NOT NULL THEN 'actual' ELSE 'forecast' END AS source
        FROM (SELECT code, date, historical, CASE WHEN NOT stale THEN forecast END AS forecast FROM node_points JOIN node_facts USING (code))
        WHERE date = {MONDAY} AND (historical IS NOT NULL OR forecast IS NOT NULL)) USING (code)""",
    "node_facts",
    "node_base",
    "node_points",
)
part(
    "node_weeks",
    f"""SELECT code, count(*) AS n_weeks, min(date) AS first_week, sum({R("value", None, 1)}) AS total, sum({R(_Z, None, 2)}) AS z_total, count(*) FILTER (WHERE {_Z} >= 1) AS n_high FROM (
        SELECT code, date, greatest(forecast, 0.0) AS value, mean, std FROM node_points JOIN node_facts USING (code) JOIN node_base USING (code)
        WHERE NOT stale AND forecast IS NOT NULL AND date > {MONDAY} AND date <= CAST({MONDAY} + 28 AS DATE) AND date_diff('day', last_update, date) <= 56) GROUP BY 1""",
    "node_points",
    "node_facts",
    "node_base",
)
part("left_out_ns", "SELECT series_id FROM combined_ns GROUP BY 1 HAVING count(*) % 4 = 0", "combined_ns")


def nodes_of(spark, d):
    """Places on the map: the series themselves, and in two regions also their nations."""
    nation = tb.table(spark, d, "nation")
    code = F.concat(F.lit("N"), F.lpad(F.col("n_nationkey").cast("string"), 2, "0"))
    seg = tb.table(spark, d, "customer").select(F.col("c_nationkey").alias("n_nationkey"), F.col("c_mktsegment").alias("seg")).distinct()
    known = nation.filter("n_nationkey % 11 <> 10").join(seg, "n_nationkey").withColumn("code", F.concat_ws("-", code, F.substring("seg", 1, 1)))
    mapping = known.select(F.concat_ws("/", "n_name", "seg").alias("name"), "code")
    upper = known.filter("n_regionkey IN (0, 2)")
    parents = upper.select(F.col("code").alias("part_code"), code.alias("parent_code"), F.replace("n_name", F.lit("_"), F.lit(" ")).alias("parent_name"))
    return hy.members(mapping.select(F.col("name").alias("series_id"), "name"), mapping, parents, show_parts=True)


def scored_nodes(spark, d):
    series = base_series(spark, d)
    facts = hy.series_facts(series)
    nodes = nodes_of(spark, d)
    return hy.published(points(spark, d, series), facts, nodes, tt.as_of()), nodes, series


_FRESH = "CASE WHEN NOT stale THEN {} END"


@query(
    "status_map",
    sql(
        f"""SELECT code, name, parent, data_type, {_FRESH.format(R("value", None, 1))} AS value, {_FRESH.format("CASE WHEN value IS NOT NULL THEN " + R("z", None, 2) + " END")} AS zscore,
            {_FRESH.format("CASE WHEN value IS NOT NULL THEN " + R("least(greatest(z / 2, 0), 1)") + " END")} AS score, {_FRESH.format("source")} AS source,
            CASE WHEN stale THEN 'stale' WHEN z >= 1 THEN 'high' ELSE 'low' END AS status, stale, last_update, coalesce(n_weeks, 0) AS n_weeks, first_week,
            {R("total", "weeks_total")}, {R("z_total", "weeks_zscore")}, coalesce(n_high, 0) AS n_high
        FROM node_status LEFT JOIN node_weeks USING (code) WHERE stale OR value IS NOT NULL""",
        "node_status",
        "node_weeks",
    ),
)
def status_map(spark, d):
    rows = hy.status_map(scored_nodes(spark, d)[0])
    weeks = F.col("forecast_weeks")

    def total(field):
        return F.when(F.size(weeks) > 0, F.aggregate(weeks, F.lit(0.0), lambda a, w: a + w[field]))

    return rows.select(
        *[c for c in rows.columns if c != "forecast_weeks"],
        F.size(weeks).cast("bigint").alias("n_weeks"),
        F.get(weeks, F.lit(0))["date"].alias("first_week"),
        total("value").alias("weeks_total"),
        total("zscore").alias("weeks_zscore"),
        F.size(F.filter(weeks, lambda w: w["status"] == "high")).cast("bigint").alias("n_high"),
    )


@query(
    "latest_data_week",
    sql(
        "SELECT data_type, max(last_update) AS latest_data_week FROM node_status WHERE stale OR value IS NOT NULL GROUP BY ROLLUP (data_type)",
        "node_status",
    ),
)
def latest_data_week(spark, d):
    shown = hy.status_map(scored_nodes(spark, d)[0])
    return shown.rollup("data_type").agg(F.max("last_update").alias("latest_data_week"))


@query(
    "country_list",
    sql(
        """SELECT code, name, parent, data_type, since, last_update, stale, stale OR value IS NOT NULL AS on_map,
            code IN (SELECT code FROM nodes JOIN left_out_ns USING (series_id)) AS excluded FROM node_status""",
        "node_status",
        "nodes",
        "left_out_ns",
    ),
)
def country_list(spark, d):
    scores, nodes, series = scored_nodes(spark, d)
    left_out = series.groupBy("series_id").count().filter("count % 4 = 0")
    return hy.country_list(scores, nodes, left_out)


@query(
    "range_view",
    sql(
        f"""SELECT series_id, date, {R("historical", "historical")}, {R("CASE WHEN rh = 1 AND forecast IS NULL AND last_fc > date THEN historical ELSE forecast END", "forecast")}
        FROM (SELECT *, max(date) FILTER (WHERE forecast IS NOT NULL) OVER (PARTITION BY series_id) AS last_fc FROM (
            SELECT *, CASE WHEN historical IS NOT NULL THEN row_number() OVER (PARTITION BY series_id, historical IS NOT NULL ORDER BY date DESC) END AS rh,
                CASE WHEN forecast IS NOT NULL THEN row_number() OVER (PARTITION BY series_id, forecast IS NOT NULL ORDER BY date) END AS rf FROM points)
            WHERE rh <= 52 OR rf <= 8)""",
        "points",
    ),
)
def range_view(spark, d):
    return vw.range_view(points(spark, d)).select("series_id", "date", "historical", "forecast")
