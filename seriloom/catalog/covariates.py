"""Covariates and enrichment joins."""

from pyspark.sql import functions as F

from seriloom.catalog import tables as tt
from seriloom.catalog.registry import query
from seriloom.catalog.sqlparts import B, R, part, sql
from seriloom.functions.calendar import week_end
from seriloom.functions.fixed_values import WEATHER_FEATURES
from seriloom.operators import covariates as cv
from seriloom.operators import entities as en
from seriloom.operators import series as se
from seriloom.sources import testbed as tb
from seriloom.catalog import series as _series  # noqa: F401  (flag_weeks part)

W = f"series_id, week, {B('idx', 'idx')}, {R('value', 'value')}"
ANGLE = "2 * pi() * {w} / 52.0::DOUBLE"
FEATS = ", ".join(R(f, f) for f in WEATHER_FEATURES)


@query(
    "week_sincos",
    sql(f"SELECT {W}, {R('sin(' + ANGLE.format(w='weekofyear(week)') + ')', 'week_sin')}, {R('cos(' + ANGLE.format(w='weekofyear(week)') + ')', 'week_cos')} FROM weekly", "weekly"),
)
def week_sincos(spark, d):
    return cv.week_sincos(tt.weekly(spark, d))


@query(
    "future_week_sincos",
    sql(
        f"""SELECT series_id, {B("step", "step")}, {B("w", "iso_week")}, {R("sin(" + ANGLE.format(w="w") + ")", "week_sin")}, {R("cos(" + ANGLE.format(w="w") + ")", "week_cos")}
        FROM (SELECT series_id, step, ((weekofyear(last) + step - 1) % 52) + 1 AS w
              FROM (SELECT series_id, max(week) AS last FROM weekly GROUP BY 1), (SELECT unnest([1, 2, 3, 4]) AS step))""",
        "weekly",
    ),
)
def future_week_sincos(spark, d):
    return cv.future_week_sincos(tt.weekly(spark, d))


@query(
    "future_flags",
    sql(
        f"""SELECT series_id, {B("step", "step")}, {R("flag", "data_type_indicator")}, {R("hemi", "hemisphere")}
        FROM (SELECT series_id, arg_max(flag, idx) AS flag FROM flag_weeks GROUP BY 1), (SELECT unnest([1, 2, 3, 4]) AS step)
        JOIN (SELECT n_name, CASE WHEN (min_lat + max_lat) / 2 > 23.5 THEN 1 WHEN (min_lat + max_lat) / 2 < -23.5 THEN -1 ELSE 0 END AS hemi
              FROM nation JOIN boxes ON boxes.name = lower(n_name)) ON n_name = series_id""",
        "flag_weeks",
        "boxes",
    ),
)
def future_flags(spark, d):
    series = tt.combined(spark, d)
    flagged = se.data_type_weekly(series, se.weekly_resample(series))
    names = tb.table(spark, d, "nation").select(F.col("n_name").alias("name"))
    hemi = en.coordinates(names, tb.latitudes(spark, d)).select(
        F.col("name").alias("series_id"), en.hemisphere(F.col("lat")).alias("hemisphere")
    )
    return cv.future_flags(flagged.join(hemi, "series_id"), ["data_type_indicator", "hemisphere"])


AGG = (
    "avg(temp_mean) AS temp_mean, max(temp_max) AS temp_max, min(temp_min) AS temp_min, "
    "avg(humidity_mean) AS humidity_mean, min(humidity_min) AS humidity_min"
)
part(
    "weather_weeks",
    f"""SELECT w.series_id, s.location, w.week, w.idx, w.value, {AGG}
    FROM weekly w JOIN sites s USING (series_id)
    LEFT JOIN weather d ON d.location = s.location AND d.date >= w.week AND d.date < w.week + 7 GROUP BY ALL""",
    "weekly",
    "sites",
    "weather",
)


def weather_weeks(spark, d):
    placed = tt.weekly(spark, d).join(tt.sites(spark, d), "series_id")
    return cv.weather_weekly(placed, tb.weather(spark, d))


@query("weather_weekly", sql(f"SELECT series_id, location, week, {B('idx', 'idx')}, {R('value', 'value')}, {FEATS} FROM weather_weeks", "weather_weeks"))
def weather_weekly(spark, d):
    return weather_weeks(spark, d)


@query(
    "zscore_features",
    sql(
        "SELECT series_id, week, "
        + ", ".join(
            R(
                f"({f} - avg({f}) OVER (PARTITION BY series_id)) / CASE WHEN stddev_pop({f}) OVER (PARTITION BY series_id) = 0 THEN 1 "
                f"ELSE stddev_pop({f}) OVER (PARTITION BY series_id) END",
                f,
            )
            for f in WEATHER_FEATURES[:4]
        )
        + " FROM weather_weeks",
        "weather_weeks",
    ),
)
def zscore_features(spark, d):
    feats = WEATHER_FEATURES[:4]
    return cv.zscore_features(weather_weeks(spark, d).select("series_id", "week", *feats), feats, ["series_id"])


@query(
    "align_check",
    sql(
        f"""SELECT series_id, n_target, n_covariate, temp_mean_missing_pct, humidity_mean_missing_pct, coalesce(n_target = n_covariate, false) AS aligned
        FROM (SELECT series_id, count(*) AS n_target FROM weekly_ili GROUP BY 1) LEFT JOIN
        (SELECT series_id, count(*) AS n_covariate, {R("100.0 * avg((temp_mean IS NULL OR temp_max < 0.05)::INT)", "temp_mean_missing_pct")},
            {R("100.0 * avg((humidity_mean IS NULL)::INT)", "humidity_mean_missing_pct")}
         FROM weather_weeks GROUP BY 1) USING (series_id)""",
        "weekly_ili",
        "weather_weeks",
    ),
)
def align_check(spark, d):
    feats = ["temp_mean", "humidity_mean"]
    warm = F.when(F.coalesce(F.col("temp_max") >= 0.05, F.lit(True)), F.col("temp_mean"))
    return cv.align_check(tt.weekly_ili(spark, d), weather_weeks(spark, d).withColumn("temp_mean", warm), feats)


part(
    "cache_ranges",
    """SELECT l_returnflag AS location, min(CAST(l_shipdate AS DATE)) AS "start", max(CAST(l_shipdate AS DATE)) AS "end"
    FROM lineitem GROUP BY l_returnflag, year(l_shipdate)
    UNION ALL SELECT l_returnflag, min(CAST(l_shipdate AS DATE)), max(CAST(l_shipdate AS DATE)) FROM lineitem
        WHERE l_returnflag <> 'R' AND l_shipdate < '2001-07-01' GROUP BY l_returnflag, l_linestatus""",
)
part(
    "requests",
    """SELECT 'C' || o_custkey AS series_id, CASE o_custkey % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'N' ELSE 'R' END AS location,
        min(CAST(o_orderdate AS DATE)) AS "start", max(CAST(o_orderdate AS DATE)) AS "end" FROM orders GROUP BY o_custkey""",
)


def cache_ranges(spark, d):
    li = tb.table(spark, d, "lineitem").withColumn("date", F.col("l_shipdate").cast("date"))
    bounds = [F.min("date").alias("start"), F.max("date").alias("end")]
    yearly = li.groupBy(F.col("l_returnflag").alias("location"), F.year("date").alias("y")).agg(*bounds).drop("y")
    early = li.filter((F.col("l_returnflag") != "R") & (F.col("l_shipdate") < F.lit("2001-07-01").cast("timestamp_ntz")))
    longer = early.groupBy(F.col("l_returnflag").alias("location"), "l_linestatus").agg(*bounds).drop("l_linestatus")
    return yearly.unionByName(longer)


def requests(spark, d):
    k = F.col("o_custkey")
    loc = F.when(k % 3 == 0, "A").when(k % 3 == 1, "N").otherwise("R")
    return (
        tb.table(spark, d, "orders")
        .groupBy(F.concat(F.lit("C"), k.cast("string")).alias("series_id"), loc.alias("location"))
        .agg(F.min(F.col("o_orderdate").cast("date")).alias("start"), F.max(F.col("o_orderdate").cast("date")).alias("end"))
    )


@query(
    "weather_coverage",
    sql(
        """SELECT r.series_id, r.location, r."start", r."end", c."start" AS cache_start, c."end" AS cache_end,
            CASE WHEN c."start" IS NOT NULL THEN c."start" = r."start" AND c."end" = r."end" END AS exact
        FROM requests r LEFT JOIN cache_ranges c ON c.location = r.location AND c."start" <= r."start" AND c."end" >= r."end"
        QUALIFY row_number() OVER (PARTITION BY r.series_id ORDER BY (c."start" = r."start" AND c."end" = r."end") DESC, c."start", c."end") = 1""",
        "requests",
        "cache_ranges",
    ),
)
def weather_coverage(spark, d):
    return cv.weather_coverage(requests(spark, d), cache_ranges(spark, d))


@query(
    "weather_trim",
    sql(
        f"""SELECT series_id, location, count(*) AS n_days, min(date) AS first_day, max(date) AS last_day, {R("sum(temp_mean)", "temp_total")}
        FROM (SELECT series_id, location, min(obs_date) AS a, max(obs_date) AS b FROM combined JOIN sites USING (series_id) GROUP BY 1, 2)
        JOIN weather USING (location) WHERE date BETWEEN a AND b GROUP BY 1, 2""",
        "combined",
        "sites",
        "weather",
    ),
)
def weather_trim(spark, d):
    need = (
        tt.combined(spark, d)
        .groupBy("series_id")
        .agg(F.min("obs_date").alias("start"), F.max("obs_date").alias("end"))
        .join(tt.sites(spark, d), "series_id")
    )
    return (
        cv.weather_trim(tb.weather(spark, d), need)
        .groupBy("series_id", "location")
        .agg(
            F.count("*").alias("n_days"),
            F.min("date").alias("first_day"),
            F.max("date").alias("last_day"),
            F.sum("temp_mean").alias("temp_total"),
        )
    )


part(
    "freshness",
    """SELECT *, date_diff('day', cached_end, required_end) AS gap_days,
        CASE WHEN required_end IS NULL THEN 'no_data' WHEN cached_end IS NULL THEN 'missing'
             WHEN date_diff('day', cached_end, required_end) <= 14 THEN 'fresh' ELSE 'stale' END AS status
    FROM (SELECT 'C' || c_custkey AS series_id, CASE c_mktsegment WHEN 'BUILDING' THEN 'A' WHEN 'MACHINERY' THEN 'X' WHEN 'FURNITURE' THEN 'N' ELSE 'R' END AS location,
            min(CAST(o_orderdate AS DATE)) AS "start", greatest(max(CAST(o_orderdate AS DATE)), CASE WHEN max(o_orderdate) IS NOT NULL THEN DATE '2001-07-20' END) AS required_end
          FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, c_mktsegment)
    LEFT JOIN (SELECT l_returnflag AS location, CAST(max(CAST(l_shipdate AS DATE)) - CASE l_returnflag WHEN 'N' THEN 200 ELSE 120 END AS DATE) AS cached_end
        FROM lineitem GROUP BY 1) USING (location)""",
)


def freshness(spark, d):
    customer = tb.table(spark, d, "customer")
    orders = tb.table(spark, d, "orders")
    seg = F.col("c_mktsegment")
    loc = F.when(seg == "BUILDING", "A").when(seg == "MACHINERY", "X").when(seg == "FURNITURE", "N").otherwise("R")
    needs = (
        customer.join(orders, customer.c_custkey == orders.o_custkey, "left")
        .groupBy(F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("series_id"), loc.alias("location"))
        .agg(F.min(F.col("o_orderdate").cast("date")).alias("start"), F.max(F.col("o_orderdate").cast("date")).alias("end"))
    )
    # caches end some months before the last row, earlier at one location
    flag, last = F.col("l_returnflag"), F.max(F.col("l_shipdate").cast("date"))
    cache = tb.table(spark, d, "lineitem").groupBy(flag.alias("location")).agg(last.alias("last"))
    cache = cache.select("location", F.date_sub("last", F.when(F.col("location") == "N", 200).otherwise(120)).alias("end"))
    return cv.cache_freshness(needs, cache, F.lit("2001-07-20").cast("date"))


@query("cache_freshness", sql("SELECT * FROM freshness", "freshness"))
def cache_freshness(spark, d):
    return freshness(spark, d)


@query(
    "refresh_plan",
    sql(
        """SELECT series_id, location, CASE status WHEN 'missing' THEN 'full' ELSE 'tail' END AS action,
            CASE status WHEN 'missing' THEN "start" ELSE CAST(cached_end - 7 AS DATE) END AS fetch_from, required_end AS fetch_to
        FROM freshness WHERE status IN ('missing', 'stale')""",
        "freshness",
    ),
)
def refresh_plan(spark, d):
    return cv.refresh_plan(freshness(spark, d))


@query(
    "cache_extend",
    sql(
        f"SELECT location, date, {FEATS} FROM (SELECT * FROM weather WHERE date <= '2000-12-31' UNION ALL "
        "SELECT location, date, temp_mean + 1, temp_max + 1, temp_min + 1, humidity_mean + 1, humidity_min + 1 FROM weather WHERE date > '2000-12-31')",
        "weather",
    ),
)
def cache_extend(spark, d):
    daily = tb.weather(spark, d)
    old = daily.filter(F.col("date") <= "2000-12-31")
    tail = daily.filter(F.col("date") >= "2000-12-24").select(
        "location", "date", *[(F.col(f) + 1).alias(f) for f in WEATHER_FEATURES]
    )
    return cv.cache_extend(old, tail)


part(
    "neighbour_rows",
    """SELECT src AS series_id, dst AS neighbour, rank, week, value FROM (
        SELECT e.src, e.dst, e.rank, t.week, o.value, avg((o.value IS NOT NULL)::INT) OVER (PARTITION BY e.src, e.dst) AS present
        FROM edges e JOIN weekly t ON t.series_id = e.src LEFT JOIN weekly o ON o.series_id = e.dst AND o.week = t.week
        WHERE e.rank <= 6 AND e.dst IN (SELECT series_id FROM weekly)) WHERE present >= 0.5""",
    "edges",
    "weekly",
)


@query("neighbor_features", sql(f"SELECT series_id, neighbour, {B('rank', 'rank')}, week, {R('value', 'value')} FROM neighbour_rows", "neighbour_rows"))
def neighbor_features(spark, d):
    return cv.neighbour_features(tt.weekly(spark, d), tb.nation_neighbours(spark, d))


part(
    "gate_past",
    """SELECT n.series_id, w.idx + k AS cutoff, n.neighbour AS name, w.idx, n.value
    FROM neighbour_rows n JOIN weekly w USING (series_id, week), (SELECT unnest([1, 2, 3, 4]) AS k)""",
    "neighbour_rows",
    "weekly",
)


@query(
    "covariate_gate",
    sql(
        """SELECT p.series_id, CAST(p.cutoff AS BIGINT) AS cutoff, p.name, p.use_past, coalesce(f.ok, false) AS use_future
        FROM (SELECT series_id, cutoff, name, arg_max_null(value, idx) IS NOT NULL AS use_past FROM gate_past GROUP BY ALL) p
        LEFT JOIN (SELECT c.series_id, c.cutoff, count(*) >= 4 AND count(w.value) = count(*) AS ok
            FROM (SELECT DISTINCT series_id, cutoff FROM gate_past) c JOIN weekly w ON w.series_id = c.series_id AND w.idx >= c.cutoff AND w.idx < c.cutoff + 4
            GROUP BY 1, 2) f ON f.series_id = p.series_id AND f.cutoff = p.cutoff""",
        "gate_past",
    ),
)
def covariate_gate(spark, d):
    weekly = tt.weekly(spark, d)
    near = cv.neighbour_features(weekly, tb.nation_neighbours(spark, d))
    steps = F.explode(F.sequence(F.lit(1), F.lit(4))).alias("k")
    context = (
        near.join(weekly.select("series_id", "week", "idx"), ["series_id", "week"])
        .select("*", steps)
        .select("series_id", (F.col("idx") + F.col("k")).alias("cutoff"), F.col("neighbour").alias("name"), "idx", "value")
    )
    # the series itself stands for a covariate known ahead
    future = weekly.select("*", steps).select(
        "series_id", (F.col("idx") - F.col("k") + 1).alias("cutoff"), F.lit("known").alias("name"), "idx", "value"
    )
    return cv.covariate_gate(context, future)


@query(
    "feature_usage",
    f"""SELECT coalesce(event_type, 'TOTAL') AS event_type, count(*) FILTER (WHERE used) AS n_used, count(*) AS n_total, {R("100.0 * avg(used::INT)", "used_pct")}
    FROM (SELECT event_type, user_id, max(value) > 50 AS used FROM events GROUP BY 1, 2) GROUP BY ROLLUP (event_type)""",
)
def feature_usage(spark, d):
    users = tb.table(spark, d, "events").groupBy("event_type", "user_id").agg((F.max("value") > 50).alias("used"))
    return cv.feature_usage(users, "event_type", "used")
