"""Sources, sinks and ingest checks."""

from pyspark.sql import functions as F

from seriloom.catalog.registry import query
from seriloom.catalog.sqlparts import B, R, level_list, part, sql
from seriloom.functions import fixed_values as fv
from seriloom.functions.cells import levels_of
from seriloom.functions.storage import fresh_path
from seriloom.operators import entities as en
from seriloom.operators import screening as sc
from seriloom.operators import series as se
from seriloom.operators import views as vw
from seriloom.sources import feed as fd
from seriloom.sources import series_files as sf
from seriloom.sources import testbed as tb

FEED = "COUNTRY_CODE, COUNTRY_AREA_TERRITORY, ISO_WEEKSTARTDATE, AGEGROUP_CODE, ILI_CASE, ARI_CASE"


@query("read_feed", sql(f"SELECT {FEED}, CAST(row_key AS VARCHAR) AS row_key FROM feed", "feed"))
def read_feed(spark, d):
    path = fresh_path(spark, "feed")
    tb.feed(spark, d).write.option("header", True).csv(path)
    return fd.read_feed(spark, path)


@query(
    "malformed_split",
    sql(
        f"""SELECT count(*) AS n_lines, {B("count(*) FILTER (WHERE row_key % 113 = 0)", "n_bad")},
        {R("count(*) FILTER (WHERE row_key % 113 = 0) / CAST(count(*) AS DOUBLE)", "bad_share")},
        count(*) FILTER (WHERE row_key % 113 = 0) / CAST(count(*) AS DOUBLE) <= 0.01 AS accepted FROM feed""",
        "feed",
    ),
)
def malformed_split(spark, d):
    k = F.col("row_key")
    rows = tb.feed(spark, d)
    cells = [F.coalesce(F.col(c), F.lit("")) for c in fv.FEED_COLUMNS]
    # some names hold a line break between quotes: one record on two lines
    cells[1] = F.when(k % 131 == 0, F.concat(F.lit('"'), cells[1], F.lit('\nand others"'))).otherwise(cells[1])
    full, short = F.concat_ws(",", *cells), F.concat_ws(",", *cells[:4])
    line = F.when(k % 113 == 0, F.concat(full, F.lit(",7,x"))).when(k % 127 == 0, short).otherwise(full)
    path = fresh_path(spark, "lines")
    rows.select(line.alias("value")).write.text(path)
    good, bad = fd.split_malformed(spark, path, columns=fv.FEED_COLUMNS)
    return fd.malformed_report(good, bad)


@query(
    "feed_profile",
    sql(
        """SELECT count(*) AS n_rows, count(DISTINCT COUNTRY_AREA_TERRITORY) AS n_entities,
        max(TRY_CAST(ISO_WEEKSTARTDATE AS DATE)) AS latest_week, CAST(0 AS BIGINT) AS n_missing_columns,
        count(*) >= 10000 AS accepted FROM feed""",
        "feed",
    ),
)
def feed_profile(spark, d):
    return fd.feed_profile(tb.feed(spark, d))


part("pull_new", "SELECT count(*) AS k, max(TRY_CAST(ISO_WEEKSTARTDATE AS DATE)) AS w FROM feed", "feed")
part(
    "pull_old",
    "SELECT count(*) AS k, max(TRY_CAST(ISO_WEEKSTARTDATE AS DATE)) AS w FROM feed WHERE ISO_WEEKSTARTDATE < '2001-01-01'",
    "feed",
)


@query(
    "refresh_guard",
    sql(
        """SELECT *, CASE WHEN scenario = 'same' THEN 'unchanged' WHEN latest_new IS NULL THEN 'no_dates'
            WHEN latest_new < latest_previous THEN 'older' WHEN n_rows_new < 0.5 * n_rows_previous THEN 'shrunk' ELSE 'ok' END AS verdict
        FROM (SELECT 'newer' AS scenario, n.k AS n_rows_new, p.k AS n_rows_previous, n.w AS latest_new, p.w AS latest_previous
              FROM pull_new n, pull_old p
            UNION ALL SELECT 'same', n.k, n.k, n.w, n.w FROM pull_new n
            UNION ALL SELECT 'rolled_back', p.k, n.k, p.w, n.w FROM pull_new n, pull_old p)""",
        "pull_new",
        "pull_old",
    ),
)
def refresh_guard(spark, d):
    new = tb.feed(spark, d)
    earlier = new.filter(F.col("ISO_WEEKSTARTDATE") < "2001-01-01")  # the pull of an earlier day
    cases = {"newer": (new, earlier), "same": (new, new), "rolled_back": (earlier, new)}
    out = None
    for name, (a, b) in cases.items():
        one = fd.refresh_guard(a, b).withColumn("scenario", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


# hub submissions: empirical quantiles of order prices per segment (the model), week and priority
_H = "CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 WHEN '3-MEDIUM' THEN 3 ELSE 4 END"
part(
    "hub",
    f"""SELECT model, round, h AS orizzonte, 'IT' AS luogo, 'quantile' AS tipo_valore, 'ILI' AS target,
        CASE WHEN model = 'MACHINERY' THEN round(lv + 0.004, 3) WHEN model = 'HOUSEHOLD' AND h = 4 AND lv = 0.5 THEN 0.506 ELSE lv END AS id_valore,
        v AS valore
    FROM (SELECT model, round, h, unnest({level_list(fv.LEVELS_23)}) AS lv, unnest(q) AS v
        FROM (SELECT c_mktsegment AS model, isoyear(o_orderdate) || '_' || lpad(CAST(week(o_orderdate) AS VARCHAR), 2, '0') AS round,
                {_H} AS h, quantile_cont(round(o_totalprice / 1000.0), {level_list(fv.LEVELS_23)}) AS q
              FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL))""",
)


def hub_forecasts(spark, d):
    orders, customer = tb.table(spark, d, "orders"), tb.table(spark, d, "customer")
    p = F.col("o_orderpriority")
    h = F.when(p == "1-URGENT", 1).when(p == "2-HIGH", 2).when(p == "3-MEDIUM", 3).otherwise(4)
    year = F.expr("extract(YEAROFWEEK FROM o_orderdate)")
    rnd = F.concat_ws("_", year.cast("string"), F.lpad(F.weekofyear("o_orderdate").cast("string"), 2, "0"))
    q = (
        orders.join(customer, orders.o_custkey == customer.c_custkey)
        .groupBy(F.col("c_mktsegment").alias("model"), rnd.alias("round"), h.alias("h"))
        .agg(F.percentile(F.round(F.col("o_totalprice") / 1000.0), levels_of(fv.LEVELS_23)).alias("q"))
    )
    long = q.select(
        "model",
        "round",
        "h",
        F.explode(F.arrays_zip(levels_of(fv.LEVELS_23).alias("lv"), F.col("q").alias("v"))).alias("e"),
    )
    lv = F.col("e.lv")
    given = (
        F.when(F.col("model") == "MACHINERY", F.round(lv + 0.004, 3))
        .when((F.col("model") == "HOUSEHOLD") & (F.col("h") == 4) & (lv == 0.5), 0.506)
        .otherwise(lv)
    )
    return long.select(
        "model",
        "round",
        F.lit("IT").alias("luogo"),
        F.lit("quantile").alias("tipo_valore"),
        F.col("h").alias("orizzonte"),
        F.lit("ILI").alias("target"),
        given.alias("id_valore"),
        F.col("e.v").alias("valore"),
    )


@query(
    "read_partitioned_rounds",
    sql(
        f"""SELECT model, round, {B("orizzonte", "orizzonte")}, luogo, tipo_valore,
            CASE WHEN model <> 'BUILDING' THEN target END AS target, {R("id_valore", "id_valore")}, {R("valore", "valore")} FROM hub""",
        "hub",
    ),
)
def read_partitioned_rounds(spark, d):
    path = fresh_path(spark, "rounds")
    # one file per (model, round); a fixed task count, as many small files cost more than their rows
    tasks = 4 * spark.sparkContext.defaultParallelism
    rows = hub_forecasts(spark, d).repartition(tasks, "model", "round")
    older = rows.filter("model = 'BUILDING'").drop("target")  # a model whose files lack the column
    rows.filter("model <> 'BUILDING'").write.partitionBy("model", "round").option("header", True).csv(path)
    older.write.mode("append").partitionBy("model", "round").option("header", True).csv(path)
    return sf.read_rounds(spark, path)


@query(
    "write_series",
    sql(f"SELECT series_id, obs_date, {R('cases', 'cases')}, {B('data_type', 'data_type')} FROM combined", "combined"),
)
def write_series(spark, d):
    path = fresh_path(spark, "series")
    sf.write_series(se.combine_indicators(tb.observations(spark, d)), path)
    return sf.read_series(spark, path)


@query(
    "write_nested_json",
    sql(
        f"""SELECT c.series_id, max(obs_date) AS last_update, count(*) AS n_points, {R("sum(cases)", "total")},
            coalesce(any_value(k.n), 0) AS n_changes
        FROM combined c LEFT JOIN (SELECT series_id, count(*) AS n FROM (
            SELECT series_id, data_type, lag(data_type) OVER (PARTITION BY series_id ORDER BY obs_date) AS prev FROM combined)
            WHERE prev <> data_type GROUP BY 1) k USING (series_id) GROUP BY 1""",
        "combined",
    ),
)
def write_nested_json(spark, d):
    series = se.combine_indicators(tb.observations(spark, d))
    blank = F.lit(None).cast("double")
    points = series.select(
        "series_id",
        F.col("obs_date").alias("date"),
        F.col("cases").alias("historical"),
        *[blank.alias(c) for c in vw.BAND],
    )
    facts = vw.staleness(series, F.lit("2001-08-15").cast("date")).join(
        vw.type_info(series).select("series_id", vw.type_name(F.col("current_type")).alias("data_type")), "series_id"
    )
    docs = vw.detail_documents(points, facts, se.type_changes(series))
    path = fresh_path(spark, "details")
    sf.write_documents(docs, path)
    back = spark.read.schema(docs.schema).json(path)
    return back.select(
        "series_id",
        "last_update",
        F.size("points").cast("bigint").alias("n_points"),
        F.aggregate("points", F.lit(0.0), lambda a, p: a + p["historical"]).alias("total"),
        F.coalesce(F.size("data_type_changes"), F.lit(0)).cast("bigint").alias("n_changes"),
    )


@query(
    "write_samples",
    sql(
        f"""SELECT series_id, part, {B("w.at", "end_ctx")}, CAST(104 AS BIGINT) AS n_context,
            (SELECT {R("coalesce(sum(c.value), 0)")} FROM weekly c WHERE c.series_id = w.series_id AND c.idx >= w.at - 104 AND c.idx < w.at) AS context_sum
        FROM (SELECT series_id, 'train' AS part, unnest(range(104, n - 52 - 4 + 1, 4)) AS at FROM (SELECT series_id, count(*) AS n FROM weekly GROUP BY 1) WHERE n >= 160
            UNION ALL SELECT series_id, 'val', unnest(range(n - 52, n - 4 + 1, 4)) FROM (SELECT series_id, count(*) AS n FROM weekly GROUP BY 1) WHERE n >= 160) w
        WHERE EXISTS (SELECT 1 FROM weekly c WHERE c.series_id = w.series_id AND c.idx >= w.at AND c.idx < w.at + 4 AND c.value IS NOT NULL)""",
        "weekly",
    ),
)
def write_samples(spark, d):
    weekly = se.weekly_resample(se.combine_indicators(tb.observations(spark, d)))
    windows = sc.build_windows(weekly, context=104, held_out=52)
    path = fresh_path(spark, "samples")
    sf.write_samples(windows, path)
    back = spark.read.parquet(path)
    total = F.aggregate("target", F.lit(0.0), lambda a, v: a + F.coalesce(v, F.lit(0.0)))
    return back.select("series_id", "part", "end_ctx", F.size("target").alias("n_context"), total.alias("context_sum"))


# --- filters, projections, entity resolution ----------------------------------------------


@query(
    "age_all_filter",
    sql("SELECT row_key, COUNTRY_CODE, AGEGROUP_CODE FROM feed WHERE upper(AGEGROUP_CODE) = 'ALL'", "feed"),
)
def age_all_filter(spark, d):
    return fd.all_ages(tb.feed(spark, d)).select("row_key", "COUNTRY_CODE", "AGEGROUP_CODE")


@query(
    "coerce_numeric",
    sql(
        f"""SELECT COUNTRY_AREA_TERRITORY AS series_id,
            count(*) FILTER (WHERE ISO_WEEKSTARTDATE IS NOT NULL AND TRY_CAST(ISO_WEEKSTARTDATE AS DATE) IS NULL) AS junk_dates,
            count(*) FILTER (WHERE ILI_CASE IS NOT NULL AND TRY_CAST(ILI_CASE AS DOUBLE) IS NULL) AS junk_ili,
            count(*) FILTER (WHERE ARI_CASE IS NOT NULL AND TRY_CAST(ARI_CASE AS DOUBLE) IS NULL) AS junk_ari,
            {R("sum(TRY_CAST(ILI_CASE AS DOUBLE))", "sum_ili")}, {R("sum(TRY_CAST(ARI_CASE AS DOUBLE))", "sum_ari")},
            max(TRY_CAST(ISO_WEEKSTARTDATE AS DATE)) AS latest_week FROM feed GROUP BY 1""",
        "feed",
    ),
)
def coerce_numeric(spark, d):
    return fd.numeric_quality(tb.feed(spark, d))


_ENTITIES = "SELECT p_name AS name, 'P' || min(p_partkey) AS code, min(p_partkey) AS first_seen FROM part GROUP BY 1"
_ASKED = """SELECT DISTINCT query FROM (
    SELECT upper(p_name) AS query FROM part UNION ALL SELECT split_part(p_name, ' ', 2) FROM part
    UNION ALL SELECT substr(p_name, 2, 5) FROM part UNION ALL SELECT p_type FROM part
    UNION ALL SELECT substr(p_name, 1, 2) FROM part
    UNION ALL SELECT lower('P' || min(p_partkey)) FROM part GROUP BY p_name)"""


@query(
    "resolve_entity",
    f"""WITH e AS ({_ENTITIES}), q AS ({_ASKED}),
    hits AS (SELECT query, code, name, first_seen,
        CASE WHEN upper(query) = code THEN 1 WHEN lower(query) = lower(name) THEN 2
             WHEN regexp_matches(name, '(?i)\\b' || query || '\\b') THEN 3
             WHEN length(query) >= 3 AND contains(lower(name), lower(query)) THEN 4 END AS rule FROM q, e),
    best AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY rule, first_seen) AS rn FROM hits WHERE rule IS NOT NULL)
    SELECT q.query, code, name, CAST(rule AS BIGINT) AS rule FROM q LEFT JOIN best ON q.query = best.query AND rn = 1""",
)
def resolve_entity(spark, d):
    part_ = tb.table(spark, d, "part")
    ents = part_.groupBy(F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("first_seen")).withColumn(
        "code", F.concat(F.lit("P"), F.col("first_seen").cast("string"))
    )
    asked = part_.select(
        F.explode(
            F.array(
                F.upper("p_name"),
                F.split_part("p_name", F.lit(" "), F.lit(2)),
                F.substring("p_name", 2, 5),
                F.col("p_type"),
                F.substring("p_name", 1, 2),
            )
        ).alias("query")
    ).unionByName(ents.select(F.lower("code").alias("query")))
    return en.resolve_entity(asked, ents)


@query(
    "code_lookup",
    """WITH m AS (SELECT CASE WHEN n_nationkey % 2 = 0 THEN lower(n_name) ELSE replace(lower(n_name), '_', ' ') END AS k,
            'N' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS code FROM nation),
        names AS (SELECT n_name AS name FROM nation UNION ALL SELECT r_name || '_CONGO' FROM region UNION ALL SELECT 'Democratic_' || r_name || '_Congo' FROM region
            UNION ALL SELECT r_name FROM region)
    SELECT name, coalesce(CASE lower(name) WHEN 'nation_7' THEN 'OV' WHEN 'asia' THEN 'AX' END, a.code, b.code,
        CASE WHEN lower(name) LIKE '%congo%' THEN CASE WHEN lower(name) LIKE '%democratic%' THEN 'CD' ELSE 'CG' END END) AS code
    FROM names LEFT JOIN m a ON a.k = lower(name) LEFT JOIN m b ON b.k = replace(lower(name), '_', ' ')""",
)
def code_lookup(spark, d):
    nation, region = tb.table(spark, d, "nation"), tb.table(spark, d, "region")
    low = F.lower("n_name")
    mapping = nation.select(
        F.when(F.col("n_nationkey") % 2 == 0, low).otherwise(F.replace(low, F.lit("_"), F.lit(" "))).alias("name"),
        F.concat(F.lit("N"), F.lpad(F.col("n_nationkey").cast("string"), 2, "0")).alias("code"),
    )
    r = F.col("r_name")
    names = nation.select(F.col("n_name").alias("name")).unionByName(
        region.select(
            F.explode(
                F.array(F.concat(r, F.lit("_CONGO")), F.concat(F.lit("Democratic_"), r, F.lit("_Congo")), r)
            ).alias("name")
        )
    )
    return en.code_lookup(names, mapping, {"nation_7": "OV", "asia": "AX"})


@query(
    "alias_map",
    """SELECT n_name AS name, CASE n_name WHEN 'NATION_3' THEN 'Third' WHEN 'NATION_9' THEN 'Ninth' ELSE n_name END AS short_name,
        count(*) AS n_customers FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2""",
)
def alias_map(spark, d):
    customer, nation = tb.table(spark, d, "customer"), tb.table(spark, d, "nation")
    names = customer.join(nation, customer.c_nationkey == nation.n_nationkey).select(F.col("n_name").alias("name"))
    short = {"NATION_3": "Third", "NATION_9": "Ninth"}
    return en.alias_map(names, short).groupBy("name", "short_name").agg(F.count("*").alias("n_customers"))


_COORD = """SELECT n_name AS name,
    CASE WHEN n_regionkey = 0 THEN n_nationkey + 0.25::DOUBLE ELSE (min_lat + max_lat) / 2 END AS lat,
    CASE WHEN n_regionkey = 0 THEN n_nationkey - 0.75::DOUBLE ELSE (min_lon + max_lon) / 2 END AS lon
    FROM nation JOIN boxes ON boxes.name = lower(n_name)"""


def coordinates(spark, d):
    nation = tb.table(spark, d, "nation")
    capitals = nation.filter("n_regionkey = 0").select(
        F.col("n_name").alias("name"), (F.col("n_nationkey") + 0.25).alias("lat"), (F.col("n_nationkey") - 0.75).alias("lon")
    )
    return en.coordinates(nation.select(F.col("n_name").alias("name")), tb.latitudes(spark, d), capitals)


@query("bbox_centroid", sql(f"SELECT name, {R('lat', 'lat')}, {R('lon', 'lon')} FROM ({_COORD})", "boxes"))
def bbox_centroid(spark, d):
    return coordinates(spark, d)


@query(
    "hemisphere",
    sql(
        f"""SELECT name, {R("lat", "lat")}, {R("CASE WHEN lat > 23.5 THEN 1 WHEN lat < -23.5 THEN -1 ELSE 0 END", "hemisphere")},
            k AS n_customers FROM (SELECT n_name AS name, (min_lat + max_lat) / 2 AS lat FROM nation JOIN boxes ON boxes.name = lower(n_name))
        JOIN (SELECT n_name AS name, count(*) AS k FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1) USING (name)""",
        "boxes",
    ),
)
def hemisphere(spark, d):
    customer, nation = tb.table(spark, d, "customer"), tb.table(spark, d, "nation")
    per_name = (
        customer.join(nation, customer.c_nationkey == nation.n_nationkey)
        .groupBy(F.col("n_name").alias("name"))
        .agg(F.count("*").alias("n_customers"))
    )
    return en.coordinates(per_name, tb.latitudes(spark, d)).select(
        "name", "lat", en.hemisphere(F.col("lat")).alias("hemisphere"), "n_customers"
    )


_SUMMARY = f"""SELECT *, CASE WHEN total_ili_cases > 0 AND total_ari_cases > 0 THEN 'ILI, ARI' WHEN total_ili_cases > 0 THEN 'ILI'
        WHEN total_ari_cases > 0 THEN 'ARI' ELSE 'None' END AS data_types
    FROM (SELECT COUNTRY_AREA_TERRITORY AS country, {R("coalesce(sum(TRY_CAST(ILI_CASE AS DOUBLE)), 0)", "total_ili_cases")},
        {R("coalesce(sum(TRY_CAST(ARI_CASE AS DOUBLE)), 0)", "total_ari_cases")} FROM feed GROUP BY 1)"""


@query("summary_by_entity", sql(_SUMMARY, "feed"))
def summary_by_entity(spark, d):
    return fd.summary_by_entity(tb.feed(spark, d))


@query(
    "has_data_filter",
    sql(
        f"""SELECT country, total_ili_cases, total_ari_cases, data_types FROM ({_SUMMARY})
        WHERE (total_ili_cases > 0 OR total_ari_cases > 0) AND country IN (SELECT n_name FROM nation WHERE n_regionkey < 3)""",
        "feed",
    ),
)
def has_data_filter(spark, d):
    allowed = tb.table(spark, d, "nation").filter("n_regionkey < 3").select(F.col("n_name").alias("country"))
    return se.has_data(fd.summary_by_entity(tb.feed(spark, d)), allowed)


@query(
    "source_priority",
    """SELECT series_id, kind, kind || '/' || series_id AS path FROM (
        SELECT 'C' || o_custkey AS series_id, CASE min(CASE o_orderstatus WHEN 'P' THEN 0 WHEN 'F' THEN 1 ELSE 2 END)
            WHEN 0 THEN 'combined' WHEN 1 THEN 'ili' ELSE 'ari' END AS kind FROM orders GROUP BY 1)""",
)
def source_priority(spark, d):
    s = F.col("o_orderstatus")
    kind = F.when(s == "P", "combined").when(s == "F", "ili").otherwise("ari")
    sid = F.concat(F.lit("C"), F.col("o_custkey").cast("string"))
    files = tb.table(spark, d, "orders").select(
        sid.alias("series_id"), kind.alias("kind"), F.concat_ws("/", kind, sid).alias("path")
    )
    return se.source_priority(files)
