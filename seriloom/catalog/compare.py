"""Model comparison and experiments."""

from pyspark.sql import functions as F

from seriloom.catalog import ingest as ing
from seriloom.catalog.registry import query
from seriloom.catalog.sqlparts import B, R, part, sql, wis_sql
from seriloom.functions import fixed_values as fv
from seriloom.operators import compare as cm
from seriloom.sources import testbed as tb

BASE = "BUILDING"
_Y, _W = "isoyear(o_orderdate)", "week(o_orderdate)"


def orders_by_week(spark, d):
    return tb.table(spark, d, "orders").select(
        F.expr("extract(YEAROFWEEK FROM o_orderdate)").alias("year"),
        F.weekofyear("o_orderdate").alias("week"),
        F.round(F.col("o_totalprice") / 1000.0).alias("price"),
        "o_orderpriority",
        "o_orderstatus",
        F.col("o_orderdate").cast("date").alias("day"),
    )


part(
    "week_rows",
    f"SELECT {_Y} AS year, {_W} AS week, round(o_totalprice / 1000.0) AS price, o_orderpriority, o_orderstatus, CAST(o_orderdate AS DATE) AS day FROM orders",
)
part("truth", "SELECT year, week, avg(price) AS value FROM week_rows GROUP BY 1, 2", "week_rows")
part(
    "season_years",
    "SELECT DISTINCT year || '-' || (year + 1) AS season, year AS start_year, 46 AS start_week, year + 1 AS end_year, 13 AS end_week FROM week_rows",
    "week_rows",
)


def truth(spark, d):
    return orders_by_week(spark, d).groupBy("year", "week").agg(F.avg("price").alias("value"))


def seasons(spark, d):
    y = F.col("year")
    return (
        orders_by_week(spark, d)
        .select(y.alias("start_year"))
        .distinct()
        .select(
            F.concat_ws("-", F.col("start_year").cast("string"), (F.col("start_year") + 1).cast("string")).alias("season"),
            "start_year",
            F.lit(46).alias("start_week"),
            (F.col("start_year") + 1).alias("end_year"),
            F.lit(13).alias("end_week"),
        )
    )


@query(
    "season_rounds",
    sql(
        f"""SELECT season, {B("y", "year")}, {B("w", "week")}, y || '_' || lpad(w::VARCHAR, 2, '0') AS round FROM (
            SELECT season, start_year AS y, unnest(range(46, 53)) AS w FROM season_years
            UNION ALL SELECT season, end_year, unnest(range(1, 14)) FROM season_years)""",
        "season_years",
    ),
)
def season_rounds(spark, d):
    return cm.season_rounds(seasons(spark, d))


@query(
    "truth_latest_vintage",
    sql(
        f"""SELECT {B("year", "year")}, {B("week", "week")}, {R("coalesce(v.value, s.value)", "value")}
        FROM (SELECT year, week, arg_max(value, vintage) AS value FROM (SELECT o_orderpriority AS vintage, year, week, avg(price) AS value FROM week_rows
              WHERE o_orderstatus = 'F' GROUP BY 1, 2, 3) GROUP BY 1, 2) v
        FULL JOIN (SELECT year, week, max(price) AS value FROM week_rows GROUP BY 1, 2) s USING (year, week)""",
        "week_rows",
    ),
)
def truth_latest_vintage(spark, d):
    rows = orders_by_week(spark, d)
    vintages = (
        rows.filter("o_orderstatus = 'F'")
        .groupBy(F.col("o_orderpriority").alias("vintage"), "year", "week")
        .agg(F.avg("price").alias("value"))
    )
    second = rows.groupBy("year", "week").agg(F.max("price").alias("value"))
    return cm.truth_latest_vintage(vintages, second)


@query(
    "extend_series",
    sql(
        f"""SELECT segment, {B("year", "year")}, {B("week", "week")}, {R("value", "value")}, row_number() OVER (PARTITION BY segment ORDER BY year, week) - 1 AS idx FROM (
            SELECT c_mktsegment AS segment, {_Y} AS year, {_W} AS week, coalesce(max(o_totalprice) FILTER (WHERE o_orderstatus = 'F'), -max(o_totalprice)) AS value
            FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3)""",
    ),
)
def extend_series(spark, d):
    orders, customer = tb.table(spark, d, "orders"), tb.table(spark, d, "customer")
    rows = orders.join(customer, orders.o_custkey == customer.c_custkey)
    keys = [
        F.col("c_mktsegment").alias("segment"),
        F.expr("extract(YEAROFWEEK FROM o_orderdate)").alias("year"),
        F.weekofyear("o_orderdate").alias("week"),
    ]
    base = rows.filter("o_orderstatus = 'F'").groupBy(*keys).agg(F.max("o_totalprice").alias("value"))
    other = rows.groupBy(*keys).agg((-F.max("o_totalprice")).alias("value"))
    return cm.extend_series(base, other, ["segment", "year", "week"])


@query(
    "iso_week_date",
    sql(f"SELECT {B('year', 'year')}, {B('week', 'week')}, min(CAST(date_trunc('week', day) AS DATE)) AS monday, count(*) AS n FROM week_rows GROUP BY 1, 2", "week_rows"),
)
def iso_week_date(spark, d):
    weeks = orders_by_week(spark, d)
    text = F.concat_ws("-", F.col("year").cast("string"), F.lpad(F.col("week").cast("string"), 2, "0"))
    per_week = weeks.groupBy(text.alias("year_week")).agg(F.count("*").alias("n"))
    return cm.with_monday(cm.split_year_week(per_week)).select("year", "week", "monday", "n")


@query(
    "regime_flag",
    sql(
        f"""SELECT {B("year", "year")}, {B("week", "week")}, {R("value", "value")},
            CAST((year * 100 + week >= 200040)::INT AS BIGINT) AS ari_season, CAST(0 AS BIGINT) AS ili_season FROM truth""",
        "truth",
    ),
)
def regime_flag(spark, d):
    y, w = F.col("year"), F.col("week")
    return truth(spark, d).select(
        "year",
        "week",
        "value",
        cm.regime_flag(y, w, 2000, 40, "ARI").alias("ari_season"),
        cm.regime_flag(y, w, 2000, 40, "ILI").alias("ili_season"),
    )


# --- hub ----------------------------------------------------------------------------------

part(
    "hub_q",
    """SELECT model, round, h, list(v ORDER BY lv) AS q FROM (
        SELECT l.model, l.round, l.h, l.lv, arg_min(s.valore, abs(s.id_valore - l.lv) * 1000 + s.id_valore / 1000) AS v
        FROM (SELECT model, round, orizzonte AS h, unnest(LEVELS) AS lv FROM (SELECT DISTINCT model, round, orizzonte FROM hub)) l
        JOIN hub s ON s.model = l.model AND s.round = l.round AND s.orizzonte = l.h AND abs(s.id_valore - l.lv) < 0.005
        GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3 HAVING count(*) = 23""".replace(
        "LEVELS", "[" + ", ".join(f"{x}::DOUBLE" for x in fv.LEVELS_23) + "]"
    ),
    "hub",
)


def hub(spark, d):
    return cm.hub_quantiles(ing.hub_forecasts(spark, d))


@query(
    "hub_quantiles",
    sql(
        f"SELECT model, round, {B('h', 'h')}, {R('q[1]', 'q_low')}, {R('q[12]', 'q_mid')}, {R('q[23]', 'q_high')}, {R('list_sum(q)', 'q_sum')} FROM hub_q",
        "hub_q",
    ),
)
def hub_quantiles(spark, d):
    return hub(spark, d).select(
        "model",
        "round",
        "h",
        F.element_at("q", 1).alias("q_low"),
        F.element_at("q", 12).alias("q_mid"),
        F.element_at("q", 23).alias("q_high"),
        F.aggregate("q", F.lit(0.0), lambda a, v: a + v).alias("q_sum"),
    )


part(
    "shifted",
    """SELECT r.*, t.value AS actual FROM (
        SELECT *, CASE WHEN w + h > 52 THEN y + 1 ELSE y END AS target_year, CASE WHEN w + h > 52 THEN w + h - 52 ELSE w + h END AS target_week
        FROM (SELECT *, CAST(split_part(round, '_', 1) AS INT) AS y, CAST(split_part(round, '_', 2) AS INT) AS w FROM hub_q)) r
    JOIN truth t ON t.year = target_year AND t.week = target_week""",
    "hub_q",
    "truth",
)


def shifted(spark, d):
    return cm.target_week_shift(cm.split_year_week(hub(spark, d), "round"), truth(spark, d))


@query(
    "target_week_shift",
    sql(
        f"SELECT model, round, {B('h', 'h')}, {B('target_year', 'target_year')}, {B('target_week', 'target_week')}, {R('actual', 'actual')} FROM shifted",
        "shifted",
    ),
)
def target_week_shift(spark, d):
    return shifted(spark, d).select("model", "round", "h", "target_year", "target_week", "actual")


@query(
    "target_week_shift_iso",
    sql(
        f"""SELECT model, round, {B('h', 'h')}, {B('target_year', 'target_year')}, {B('target_week', 'target_week')}, {R('t.value', 'actual')} FROM (
            SELECT *, isoyear(day) AS target_year, week(day) AS target_week FROM (
                SELECT *, CAST(date_trunc('week', make_date(CAST(split_part(round, '_', 1) AS INT), 1, 4)) AS DATE)
                    + CAST(7 * (CAST(split_part(round, '_', 2) AS INT) - 1 + h) AS INT) AS day FROM hub_q))
        JOIN truth t ON t.year = target_year AND t.week = target_week""",
        "hub_q",
        "truth",
    ),
)
def target_week_shift_iso(spark, d):
    moved = cm.target_week_shift(cm.split_year_week(hub(spark, d), "round"), truth(spark, d), iso=True)
    return moved.select("model", "round", "h", "target_year", "target_week", "actual")


part(
    "hub_scores",
    f"""SELECT model, round, h, {wis_sql("actual", "q", fv.LEVELS_23, fv.INTERVALS_23)} AS wis,
        CASE WHEN actual > 0 THEN abs(q[12] - actual) / actual END AS ape,
        (actual BETWEEN q[7] AND q[17])::INT AS cov50, (actual BETWEEN q[3] AND q[21])::INT AS cov90 FROM shifted""",
    "shifted",
)


def hub_scores(spark, d):
    return cm.score_all_models(shifted(spark, d))


@query(
    "score_all_models",
    sql(f"SELECT model, round, {B('h', 'h')}, {R('wis', 'wis')}, {R('ape', 'ape')}, {B('cov50', 'cov50')}, {B('cov90', 'cov90')} FROM hub_scores", "hub_scores"),
)
def score_all_models(spark, d):
    return hub_scores(spark, d)


part(
    "vs_base",
    f"SELECT s.*, b.wis AS bw FROM hub_scores s JOIN hub_scores b ON b.round = s.round AND b.h = s.h AND b.model = '{BASE}'",
    "hub_scores",
)


@query("simple_rwis", sql(f"SELECT model, {R('avg(wis) / nullif(avg(bw), 0)', 'rwis')}, count(*) AS n, {R('avg(cov50)', 'coverage_50')}, {R('avg(cov90)', 'coverage_90')} FROM vs_base GROUP BY 1", "vs_base"))
def simple_rwis(spark, d):
    return cm.simple_rwis(hub_scores(spark, d), BASE)


part(
    "theta",
    """SELECT m AS model, exp(avg(ln(ratio))) AS theta, count(*) AS n_models FROM (
        SELECT a.model AS m, b.model AS o, avg(a.wis) / avg(b.wis) AS ratio FROM hub_scores a JOIN hub_scores b ON a.round = b.round AND a.h = b.h AND a.model <> b.model
        GROUP BY 1, 2 HAVING count(*) >= 4 AND avg(b.wis) > 0) GROUP BY 1""",
    "hub_scores",
)


@query(
    "pairwise_rwis",
    sql(
        f"""SELECT model, {R("theta", "theta")}, {R(f"theta / coalesce((SELECT max(theta) FROM theta WHERE model = '{BASE}'), 1)", "pairwise_rwis")}, n_models, coverage_50, coverage_90
        FROM theta JOIN (SELECT model, {R("avg(cov50)", "coverage_50")}, {R("avg(cov90)", "coverage_90")} FROM hub_scores GROUP BY 1) USING (model)""",
        "theta",
        "hub_scores",
    ),
)
def pairwise_rwis(spark, d):
    return cm.pairwise_rwis(hub_scores(spark, d), BASE)


@query(
    "model_mape",
    sql(
        f"SELECT model, {R('100 * avg(ape)', 'mape_pct')}, "
        + ", ".join(R(f"100 * avg(ape) FILTER (WHERE h = {h})", f"mape_h{h}") for h in range(1, 5))
        + " FROM hub_scores WHERE ape IS NOT NULL GROUP BY 1",
        "hub_scores",
    ),
)
def model_mape(spark, d):
    return cm.model_mape(hub_scores(spark, d))


@query(
    "horizon_rwis_models",
    sql(
        f"SELECT model, {B('h', 'h')}, {R('avg(wis) / nullif(avg(bw), 0)', 'rwis')}, count(*) AS n FROM vs_base WHERE model IN ('MACHINERY', 'HOUSEHOLD', '{BASE}') GROUP BY model, h",
        "vs_base",
    ),
)
def horizon_rwis_models(spark, d):
    return cm.horizon_rwis_models(hub_scores(spark, d), BASE, ["MACHINERY", "HOUSEHOLD", BASE])


@query(
    "best_other_model",
    sql(
        f"""SELECT model, {R("rwis", "rwis")} FROM (SELECT model, avg(wis) / avg(bw) AS rwis FROM vs_base GROUP BY 1)
        WHERE model NOT IN ('{BASE}', 'AUTOMOBILE') ORDER BY rwis, model LIMIT 1""",
        "vs_base",
    ),
)
def best_other_model(spark, d):
    return cm.best_other_model(cm.simple_rwis(hub_scores(spark, d), BASE), [BASE, "AUTOMOBILE"])


part(
    "theta_y",
    """SELECT season, m AS model, exp(avg(ln(ratio))) AS theta FROM (
        SELECT a.round[1:4] AS season, a.model AS m, b.model AS o, avg(a.wis) / avg(b.wis) AS ratio FROM hub_scores a
        JOIN hub_scores b ON a.round = b.round AND a.h = b.h AND a.model <> b.model
        GROUP BY 1, 2, 3 HAVING count(*) >= 4 AND avg(b.wis) > 0) GROUP BY 1, 2""",
    "hub_scores",
)


@query(
    "season_ranking",
    sql(
        f"""SELECT season, rank() OVER (PARTITION BY season ORDER BY pw) AS rank, model, {R("pw", "pairwise_rwis")}, coverage_50, coverage_90
        FROM (SELECT round[1:4] AS season, model, {R("avg(cov50)", "coverage_50")}, {R("avg(cov90)", "coverage_90")} FROM hub_scores GROUP BY 1, 2) JOIN (SELECT t.season, t.model, t.theta / coalesce(b.theta, 1) AS pw FROM theta_y t LEFT JOIN theta_y b ON b.season = t.season AND b.model = '{BASE}') USING (season, model)""",
        "theta_y",
        "hub_scores",
    ),
)
def season_ranking(spark, d):
    scored = hub_scores(spark, d).withColumn("season", F.substring("round", 1, 4))
    return cm.season_ranking(cm.pairwise_rwis(scored, BASE, by=["season"])).select(
        "season", "rank", "model", "pairwise_rwis", "coverage_50", "coverage_90"
    )


# --- experiments --------------------------------------------------------------------------

# orders play evaluation results: an order's key picks the experiment, its nation the series.
# Prime divisors keep means of prices off exact rounding ties, where engines differ.
part(
    "results",
    """SELECT CAST(o_orderkey % 33 AS INT) AS exp_id, n_name AS series_id, avg(o_totalprice) / 100003.0 AS relative_wis, max(o_totalprice) / 997.0 AS wis,
        100.0 * avg((o_orderstatus = 'F')::INT) AS coverage_50, 100.0 * avg((o_orderstatus <> 'O')::INT) AS coverage_95,
        min(o_totalprice) / 997.0 AS mae, avg(o_totalprice) / 997.0 AS mape_pct
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2""",
)
part(
    "h_results",
    """SELECT CAST(o_orderkey % 33 AS INT) AS exp_id, n_name AS series_id, CAST(least(substr(o_orderpriority, 1, 1)::INT, 4) AS INT) AS h, avg(o_totalprice) / 100003.0 AS rwis
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2, 3""",
)
part(
    "grid",
    """SELECT 0 AS exp_id, '' AS covs, 'base-zeroshot' AS suffix, false AS tuned, -1 AS mask UNION ALL
    SELECT row_number() OVER (ORDER BY len(ats), ats), array_to_string([names[i + 1] FOR i IN ats], ','),
        CASE WHEN len(ats) = 0 THEN 'nocov' ELSE array_to_string([short[i + 1] FOR i IN ats], '-') END, true, mask
    FROM (SELECT mask, list_filter([0, 1, 2, 3, 4], lambda i: (mask >> i) & 1 = 1) AS ats,
            ['data_type', 'hemisphere', 'week_of_year', 'weather', 'neighbors'] AS names, ['dt', 'hemi', 'woy', 'weather', 'neighbors'] AS short
          FROM (SELECT unnest(range(0, 32)) AS mask))""",
)


def _results(spark, d, *more):
    orders, customer, nation = (tb.table(spark, d, t) for t in ("orders", "customer", "nation"))
    rows = orders.join(customer, orders.o_custkey == customer.c_custkey).join(
        nation, customer.c_nationkey == nation.n_nationkey
    )
    return rows.groupBy((F.col("o_orderkey") % 33).cast("int").alias("exp_id"), F.col("n_name").alias("series_id"), *more)


def results(spark, d):
    p, s = F.col("o_totalprice"), F.col("o_orderstatus")
    return _results(spark, d).agg(
        (F.avg(p) / 100003.0).alias("relative_wis"),
        (F.max(p) / 997.0).alias("wis"),
        (100 * F.avg((s == "F").cast("double"))).alias("coverage_50"),
        (100 * F.avg((s != "O").cast("double"))).alias("coverage_95"),
        (F.min(p) / 997.0).alias("mae"),
        (F.avg(p) / 997.0).alias("mape_pct"),
    )


def horizon_results(spark, d):
    h = F.least(F.substring("o_orderpriority", 1, 1).cast("int"), F.lit(4))
    return _results(spark, d, h.alias("h")).agg((F.avg("o_totalprice") / 100003.0).alias("rwis"))


@query(
    "experiment_grid",
    sql(
        f"""SELECT {B("exp_id", "exp_id")}, covs, suffix, tuned, coalesce(k, 0) AS n_results FROM grid
        LEFT JOIN (SELECT exp_id, count(*) AS k FROM results GROUP BY 1) USING (exp_id)""",
        "grid",
        "results",
    ),
)
def experiment_grid(spark, d):
    counts = results(spark, d).groupBy("exp_id").agg(F.count("*").alias("n_results"))
    return (
        cm.experiment_grid(spark)
        .join(counts, "exp_id", "left")
        .select("exp_id", F.array_join("covariates", ",").alias("covs"), "suffix", "tuned", F.coalesce("n_results", F.lit(0)).cast("bigint").alias("n_results"))
    )


part(
    "exp_rollup",
    """SELECT g.*, r.* EXCLUDE (exp_id), h.* EXCLUDE (exp_id) FROM grid g LEFT JOIN (SELECT exp_id, avg(relative_wis) AS mean_relative_wis, avg(wis) AS mean_wis,
            avg(coverage_50) AS mean_coverage_50, avg(coverage_95) AS mean_coverage_95, avg(mae) AS mean_mae, avg(mape_pct) AS mean_mape_pct, count(*) AS n_series
        FROM results GROUP BY 1) r USING (exp_id)
    LEFT JOIN (SELECT exp_id, avg(rwis) FILTER (WHERE h = 1) AS mean_rwis_h1, avg(rwis) FILTER (WHERE h = 2) AS mean_rwis_h2,
            avg(rwis) FILTER (WHERE h = 3) AS mean_rwis_h3, avg(rwis) FILTER (WHERE h = 4) AS mean_rwis_h4 FROM h_results GROUP BY 1) h USING (exp_id)""",
    "grid",
    "results",
    "h_results",
)
# hub models that play experiments
RUNS = {"AUTOMOBILE": 1, "FURNITURE": 2, "HOUSEHOLD": 3, "MACHINERY": 5}
part(
    "hub_figures",
    f"""SELECT * FROM (SELECT unnest({list(RUNS)}) AS model, unnest({list(RUNS.values())}) AS exp_id)
    JOIN (SELECT model, avg(wis) / nullif(avg(bw), 0) AS hub_rwis, avg(cov50) AS hub_coverage_50, avg(cov90) AS hub_coverage_90,
            {", ".join(f"sum(wis) FILTER (WHERE h = {h}) / nullif(sum(bw) FILTER (WHERE h = {h}), 0) AS hub_rwis_h{h}" for h in range(1, 5))} FROM vs_base GROUP BY 1) USING (model)
    JOIN (SELECT model, 100 * avg(ape) AS hub_mape_pct, {", ".join(f"100 * avg(ape) FILTER (WHERE h = {h}) AS hub_mape_h{h}" for h in range(1, 5))} FROM hub_scores GROUP BY 1) USING (model)""",
    "vs_base",
    "hub_scores",
)
_HUB = ["hub_rwis", "hub_coverage_50", "hub_coverage_90", "hub_mape_pct"]
_HUB_MAPS = {f"hub_{m}_h{h}": (f"hub_{m}_by_h", h) for m in ("rwis", "mape") for h in range(1, 5)}
_MEANS = ["mean_relative_wis", "mean_wis", "mean_coverage_50", "mean_coverage_95", "mean_mae", "mean_mape_pct"]
_HS = [f"mean_rwis_h{h}" for h in range(1, 5)]


def rollup(spark, d):
    runs = spark.createDataFrame(list(RUNS.items()), "model string, exp_id int")
    figures = cm.hub_figures(hub_scores(spark, d), BASE, runs)
    return cm.experiment_rollup(cm.experiment_grid(spark), results(spark, d), horizon_results(spark, d), hub=figures)


@query(
    "experiment_rollup",
    sql(f"SELECT {B('exp_id', 'exp_id')}, suffix, n_series, " + ", ".join(R(c, c) for c in [*_MEANS, *_HS, *_HUB, *_HUB_MAPS]) + " FROM exp_rollup LEFT JOIN hub_figures USING (exp_id)", "exp_rollup", "hub_figures"),
)
def experiment_rollup(spark, d):
    by_h = [F.try_element_at(m, F.lit(h)).alias(name) for name, (m, h) in _HUB_MAPS.items()]
    return rollup(spark, d).select("exp_id", "suffix", "n_series", *_MEANS, *_HS, *_HUB, *by_h)


@query(
    "experiment_matrix",
    sql(
        "SELECT series_id, " + ", ".join(R(f"max(relative_wis) FILTER (WHERE exp_id = {i})", f'"{i}"') for i in range(33)) + " FROM results GROUP BY 1",
        "results",
    ),
)
def experiment_matrix(spark, d):
    return cm.experiment_matrix(results(spark, d), list(range(33)))


@query(
    "top_bottom_k",
    sql(
        f"""SELECT {B("exp_id", "exp_id")}, side, place, series_id, {R("relative_wis", "relative_wis")} FROM (
            SELECT *, CASE WHEN place <= 5 THEN 'top' WHEN n > 10 AND place > n - 5 THEN 'bottom' END AS side
            FROM (SELECT *, row_number() OVER (PARTITION BY exp_id ORDER BY relative_wis, series_id) AS place, count(*) OVER (PARTITION BY exp_id) AS n FROM results))
        WHERE side IS NOT NULL""",
        "results",
    ),
)
def top_bottom_k(spark, d):
    return cm.top_bottom_k(results(spark, d), 5)


@query(
    "best_config",
    sql(
        f"""(SELECT 'relative_wis' AS metric, {B("exp_id", "exp_id")}, suffix, {R("mean_relative_wis", "value")} FROM exp_rollup WHERE mean_relative_wis IS NOT NULL ORDER BY mean_relative_wis, exp_id LIMIT 1)
        UNION ALL (SELECT 'mape_pct', {B("exp_id", "exp_id")}, suffix, {R("mean_mape_pct", "value")} FROM exp_rollup WHERE mean_mape_pct IS NOT NULL ORDER BY mean_mape_pct, exp_id LIMIT 1)
        UNION ALL (SELECT 'coverage_95', {B("exp_id", "exp_id")}, suffix, {R("mean_coverage_95", "value")} FROM exp_rollup WHERE mean_coverage_95 IS NOT NULL ORDER BY mean_coverage_95 DESC, exp_id LIMIT 1)
        UNION ALL (SELECT 'hub_rwis', {B("exp_id", "exp_id")}, suffix, {R("hub_rwis", "value")} FROM hub_figures JOIN grid USING (exp_id) WHERE hub_rwis IS NOT NULL ORDER BY hub_rwis, exp_id LIMIT 1)
        UNION ALL (SELECT 'hub_mape_pct', {B("exp_id", "exp_id")}, suffix, {R("hub_mape_pct", "value")} FROM hub_figures JOIN grid USING (exp_id) WHERE hub_mape_pct IS NOT NULL ORDER BY hub_mape_pct, exp_id LIMIT 1)""",
        "exp_rollup",
        "hub_figures",
        "grid",
    ),
)
def best_config(spark, d):
    return cm.best_config(rollup(spark, d))


@query(
    "marginal_impact",
    sql(
        f"""SELECT c.name AS covariate, {R("avg(b.mean_relative_wis - a.mean_relative_wis)", "impact")}, count(*) AS n_pairs
        FROM (SELECT unnest([0, 1, 2, 3, 4]) AS bit, unnest(['data_type', 'hemisphere', 'week_of_year', 'weather', 'neighbors']) AS name) c
        JOIN exp_rollup a ON a.tuned AND (a.mask >> c.bit) & 1 = 1 JOIN exp_rollup b ON b.tuned AND b.mask = a.mask - (1 << c.bit)
        WHERE a.mean_relative_wis IS NOT NULL AND b.mean_relative_wis IS NOT NULL GROUP BY 1""",
        "exp_rollup",
    ),
)
def marginal_impact(spark, d):
    return cm.marginal_impact(rollup(spark, d))
