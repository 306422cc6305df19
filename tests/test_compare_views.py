import math
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from seriloom.functions import fixed_values as fv
from seriloom.operators import compare as cm
from seriloom.operators import views as vw


def hub_rows(model, shift=None, drop=None, place="IT", extra=()):
    rows = []
    for i, p in enumerate(fv.LEVELS_23):
        if p == drop:
            continue
        lv = p + (shift or {}).get(p, 0.0)
        rows.append((model, "2024_01", place, "quantile", 1, "ILI", lv, float(i)))
    return rows + [(model, "2024_01", place, "quantile", 1, "ILI", lv, v) for lv, v in extra]


HUB = "model string, round string, luogo string, tipo_valore string, orizzonte int, target string, id_valore double, valore double"


def test_hub_levels(spark):
    rows = (
        hub_rows("exact")
        + hub_rows("near", {0.5: 0.004})
        + hub_rows("far", {0.5: 0.006})
        + hub_rows("gone", drop=0.975)
        + hub_rows("elsewhere", place="FR")
        + hub_rows("both", extra=[(0.501, 99.0)])  # the exact level wins
        + hub_rows("closest", {0.5: 0.003}, extra=[(0.499, 77.0)])
    )
    got = {r.model: r.q for r in cm.hub_quantiles(spark.createDataFrame(rows, HUB)).collect()}
    whole = [float(i) for i in range(23)]
    assert set(got) == {"exact", "near", "both", "closest"}
    assert got["exact"] == got["near"] == got["both"] == whole
    assert got["closest"][11] == 77.0


def scores_of(spark, rows):
    return spark.createDataFrame(rows, "model string, round string, h int, wis double, ape double")


def test_pairwise_needs_four_common_keys(spark):
    rows = []
    for k in range(6):
        rows += [("base", f"r{k}", 1, 2.0, 0.1), ("half", f"r{k}", 1, 1.0, 0.1)]
    rows += [("four", f"r{k}", 1, 4.0, None) for k in range(4)]
    rows += [("three", f"r{k}", 1, 8.0, None) for k in range(3)]
    got = {r.model: r for r in cm.pairwise_rwis(scores_of(spark, rows), "base").collect()}
    assert set(got) == {"base", "half", "four"}
    theta = {"base": math.sqrt(2.0 * 0.5), "half": math.sqrt(0.5 * 0.25), "four": math.sqrt(2.0 * 4.0)}
    for m, t in theta.items():
        assert got[m].pairwise_rwis == pytest.approx(t / theta["base"])
    assert got["base"].pairwise_rwis == 1.0
    simple = {r.model: (r.rwis, r.n) for r in cm.simple_rwis(scores_of(spark, rows), "base").collect()}
    assert simple["half"] == (0.5, 6) and simple["three"] == (4.0, 3)
    assert cm.best_other_model(cm.simple_rwis(scores_of(spark, rows), "base"), ["base", "half"]).first().model == "four"


def test_rounds_over_the_year_border(spark):
    rounds = cm.season_rounds(cm.known_seasons(spark)).filter("season = '2023-24'")
    names = [r["round"] for r in rounds.orderBy("year", "week").collect()]
    assert names[0] == "2023_46" and names[6:8] == ["2023_52", "2024_01"] and names[-1] == "2024_13" and len(names) == 20
    long = cm.season_rounds(cm.known_seasons(spark), extra_weeks=4).filter("season = '2023-24'")
    assert long.count() == 24


def test_truth_precedence(spark):
    v = spark.createDataFrame(
        [("2024_02", 2024, 1, 5.0), ("2024_03", 2024, 1, 6.0), ("2024_03", 2024, 2, 7.0)], "vintage string, year int, week int, value double"
    )
    second = spark.createDataFrame([(2024, 1, 99.0), (2024, 3, 8.0)], "year int, week int, value double")
    got = {(r.year, r.week): r.value for r in cm.truth_latest_vintage(v, second).collect()}
    assert got == {(2024, 1): 6.0, (2024, 2): 7.0, (2024, 3): 8.0}


def test_extend_sorts_numerically(spark):
    base = cm.split_year_week(spark.createDataFrame([("2024-9", 1.0), ("2024-10", 2.0)], "year_week string, value double"))
    truth = spark.createDataFrame([(2024, 10, 50.0), (2023, 52, 3.0)], "year int, week int, value double")
    got = [(r.year, r.week, r.value) for r in cm.extend_series(base, truth).orderBy("idx").collect()]
    assert got == [(2023, 52, 3.0), (2024, 9, 1.0), (2024, 10, 2.0)]


def test_experiment_ids(spark):
    grid = {r.exp_id: r for r in cm.experiment_grid(spark).collect()}
    assert len(grid) == 33
    assert grid[0].suffix == "base-zeroshot" and grid[1].suffix == "nocov" and grid[1].covariates == []
    assert [grid[i].suffix for i in range(2, 9)] == ["dt", "hemi", "woy", "weather", "neighbors", "dt-hemi", "dt-woy"]
    assert grid[32].suffix == "dt-hemi-woy-weather-neighbors"


def test_marginal_impact(spark):
    grid = cm.experiment_grid(spark, ["data_type", "hemisphere"])
    v = spark.createDataFrame([(0, 9.0), (1, 3.0), (2, 2.0), (3, 2.5), (4, 1.0)], "exp_id int, mean_relative_wis double")
    got = {r.covariate: (r.impact, r.n_pairs) for r in cm.marginal_impact(grid.join(v, "exp_id")).collect()}
    assert got == {"data_type": (1.25, 2), "hemisphere": (0.75, 2)}


def test_top_and_bottom(spark):
    rows = [(1, f"s{i:02d}", float(i)) for i in range(12)] + [(2, f"s{i:02d}", float(i)) for i in range(10)] + [(2, "none", None)]
    got = cm.top_bottom_k(spark.createDataFrame(rows, "exp_id int, series_id string, relative_wis double")).collect()
    one = sorted((r.place, r.side) for r in got if r.exp_id == 1)
    assert one == [(i, "top") for i in range(1, 6)] + [(i, "bottom") for i in range(8, 13)]
    assert {r.side for r in got if r.exp_id == 2} == {"top"}


AS_OF = date(2024, 6, 12)  # a Wednesday


def as_of():
    return F.lit(AS_OF.isoformat()).cast("date")


def test_stale_after_56_days(spark):
    rows = [(f"d{k}", AS_OF - timedelta(days=k)) for k in (55, 56, 57)] + [("never", None)]
    got = {r.series_id: r.stale for r in vw.staleness(spark.createDataFrame(rows, "series_id string, obs_date date"), as_of()).collect()}
    assert got == {"d55": False, "d56": True, "d57": True, "never": True}


def hist(spark, rows):
    return spark.createDataFrame(rows, "series_id string, date date, historical double, data_type int")


def test_same_type_baseline_needs_13_weeks(spark):
    rows = []
    for name, k in (("twelve", 12), ("thirteen", 13)):
        for i in range(20):
            new = i >= 20 - k
            rows.append((name, date(2024, 1, 1) + timedelta(days=7 * i), 100.0 + i if new else 1.0, 1 if new else 0))
    df = hist(spark, rows)
    info = vw.type_info(df.select("series_id", F.col("date").alias("obs_date"), F.col("historical").alias("cases"), "data_type"))
    got = {r.series_id: r for r in vw.type_aware_baseline(df.drop("data_type"), df.drop("historical"), info).collect()}
    assert got["thirteen"].mean == pytest.approx(sum(100.0 + i for i in range(7, 20)) / 13)
    assert got["twelve"].mean == pytest.approx((sum(100.0 + i for i in range(8, 20)) + 8) / 20)


def test_activity_of_degenerate_baselines(spark):
    values = spark.createDataFrame([("one", 5.0), ("flat", 5.0), ("hot", 9.0)], "series_id string, value double")
    base = spark.createDataFrame([("one", 5.0, None), ("flat", 1.0, 0.0), ("hot", 1.0, 2.0)], "series_id string, mean double, std double")
    got = {r.series_id: (r.zscore, r.score, r.status) for r in vw.activity_score(values, base).collect()}
    assert got == {"one": (0.0, 0.0, "low"), "flat": (0.0, 0.0, "low"), "hot": (4.0, 1.0, "high")}


def point(name, d, h, f):
    return (name, d, h, f, f, f, f, f)


POINTS = "series_id string, date date, historical double, forecast double, lower double, upper double, lower_50 double, upper_50 double"


def test_nowcast_prefers_reports_and_floors_forecasts(spark):
    week = date(2024, 6, 10)
    rows = [point("a", week, 3.0, 9.0), point("b", week, None, -2.0), point("c", week, None, None), point("d", week, -1.0, None)]
    got = {r.series_id: (r.value, r.source) for r in vw.nowcast_value(spark.createDataFrame(rows, POINTS), F.lit("2024-06-10").cast("date")).collect()}
    assert got == {"a": (3.0, "actual"), "b": (0.0, "forecast"), "c": (None, None), "d": (-1.0, "actual")}


def test_week_calendar(spark):
    got = spark.range(1).select(vw.week_calendar(as_of())).first()[0]
    assert got == [date(2024, 6, 10) + timedelta(days=7 * k) for k in range(5)]


def test_status_rows_and_documents(spark):
    last = date(2024, 6, 3)
    series = spark.createDataFrame(
        [("live", last - timedelta(days=7 * k), 10.0 + k, 0) for k in range(20)]
        + [("old", date(2024, 1, 1), 5.0, 1), ("silent", last, 5.0, 0)],
        "series_id string, obs_date date, cases double, data_type int",
    )
    hist_rows = [point("live", last - timedelta(days=7 * k), 10.0 + k, None) for k in range(20)] + [point("silent", last, 5.0, None)]
    ahead = [point("live", last + timedelta(days=7 * k), None, 40.0) for k in range(1, 10)] + [point("old", AS_OF, None, 1.0)]
    pts = spark.createDataFrame(hist_rows + ahead, POINTS)
    stale = vw.staleness(series, as_of())
    status = vw.status_map(pts, series, stale, as_of())
    rows = {r.series_id: r for r in status.collect()}
    assert set(rows) == {"live", "old"}  # silent has no value for the week
    assert rows["live"].source == "forecast" and rows["live"].status == "high"
    assert rows["old"].status == "stale" and rows["old"].value is None and rows["old"].data_type == "ARI"
    base = vw.type_aware_baseline(pts, vw.type_map(series), vw.type_info(series))
    docs = {r.series_id: r for r in vw.status_documents(status, vw.future_weeks_view(pts, base, stale, as_of())).collect()}
    assert [w.date for w in docs["live"].forecast_weeks] == [date(2024, 6, 17) + timedelta(days=7 * k) for k in range(4)]
    assert not docs["old"].forecast_weeks
    assert vw.latest_data_week(status).first()[0] == last


def test_forecast_reach(spark):
    stale = spark.createDataFrame([("a", date(2024, 4, 29))], "series_id string, last_update date")
    pts = spark.createDataFrame([point("a", date(2024, 6, 17) + timedelta(days=7 * k), None, 4.0) for k in range(4)], POINTS)
    base = spark.createDataFrame([("a", 1.0, 1.0)], "series_id string, mean double, std double")
    got = sorted(r.date for r in vw.future_weeks_view(pts, base, stale, as_of()).collect())
    assert got == [date(2024, 6, 17), date(2024, 6, 24)]  # 56 days after the last report


def test_parts_sum_and_agreement(spark):
    d = date(2024, 6, 3)
    pts = spark.createDataFrame([point("e", d, 1.0, 2.0), point("s", d, None, 3.0), point("n", d, None, None)], POINTS)
    parts = spark.createDataFrame([("gb", x) for x in "esn"], "parent string, series_id string")
    r = vw.combine_parts(pts, parts).first()
    assert (r.historical, r.forecast) == (1.0, 5.0)
    info = spark.createDataFrame([("e", d, "ILI"), ("s", d - timedelta(days=70), "ARI"), ("n", None, "ILI")], "series_id string, last_update date, data_type string")
    none = spark.createDataFrame([], "series_id string, date date, from_type string, to_type string")
    f = vw.combine_facts(info, parts, none, as_of()).first()
    assert (f.data_type, f.last_update, f.stale, f.changes, f.n_parts) == ("ILI", d, False, "", 3)
    one = spark.createDataFrame([("e", d, "ILI", "ARI")], "series_id string, date date, from_type string, to_type string")
    assert vw.combine_facts(info, parts, one, as_of()).first().changes == ""
    same = spark.createDataFrame([(x, d, "ILI", "ARI") for x in "esn"], "series_id string, date date, from_type string, to_type string")
    assert vw.combine_facts(info, parts, same, as_of()).first().changes == f"{d}>ILI>ARI"


def test_merged_types(spark):
    d = date(2024, 6, 3)
    types = spark.createDataFrame([("e", d, 0), ("s", d, 1), ("e", d + timedelta(days=7), 1)], "series_id string, date date, data_type int")
    parts = spark.createDataFrame([("gb", "e"), ("gb", "s")], "parent string, series_id string")
    agree = spark.createDataFrame([("e", 1), ("s", 1)], "series_id string, current_type int")
    got = {r.date: r.data_type for r in vw.merged_type_map(types, agree, parts).collect()}
    assert got == {d: None, d + timedelta(days=7): 1}
    split = spark.createDataFrame([("e", 1), ("s", 0)], "series_id string, current_type int")
    assert vw.merged_type_map(types, split, parts).count() == 0


def test_range_view_bridges_the_forecast(spark):
    d = date(2024, 1, 1)
    rows = [point("a", d + timedelta(days=7 * i), float(i), None) for i in range(10)]
    rows += [point("a", d + timedelta(days=7 * i), None, 50.0 + i) for i in range(10, 22)]
    got = vw.range_view(spark.createDataFrame(rows, POINTS), 3, 8).orderBy("date").collect()
    assert [r.historical for r in got[:3]] == [7.0, 8.0, 9.0] and len(got) == 11
    assert [r.forecast for r in got[:4]] == [None, None, 9.0, 60.0]


def test_list_is_sorted_by_lower_name(spark):
    d = date(2024, 1, 1)
    pts = spark.createDataFrame([point("x", d, 1.0, None), point("y", d, None, 1.0)], POINTS)
    details = spark.createDataFrame([("x", "beta", "ILI", d, False), ("y", "Alpha", "ARI", d, True)], "series_id string, name string, data_type string, last_update date, stale boolean")
    listing = vw.country_list(pts, details, spark.createDataFrame([("x",)], "series_id string"))
    assert [(r.name, r.since, r.on_map) for r in listing.collect()] == [("Alpha", None, False), ("beta", d, True)]
    assert tuple(vw.list_totals(listing).first()) == (2, 1)


def test_iso_weeks_reach_week_53(spark):
    rounds = spark.createDataFrame([(2020, 52, 1), (2020, 52, 2), (2020, 53, 1), (2021, 52, 1)], "year int, week int, h int")
    truth = spark.createDataFrame([(2020, 53, 1.0), (2021, 1, 2.0), (2022, 1, 3.0)], "year int, week int, value double")
    got = sorted((r.year, r.week, r.h, r.target_year, r.target_week, r.actual) for r in cm.target_week_shift(rounds, truth, iso=True).collect())
    assert got == [(2020, 52, 1, 2020, 53, 1.0), (2020, 52, 2, 2021, 1, 2.0), (2020, 53, 1, 2021, 1, 2.0), (2021, 52, 1, 2022, 1, 3.0)]


def test_hub_figures_of_experiments(spark):
    rows = [
        ("base", "r1", 1, 2.0, 0.5, 1, 1),
        ("base", "r1", 2, 4.0, 0.5, 1, 1),
        ("mine", "r1", 1, 1.0, 0.1, 1, 1),
        ("mine", "r1", 2, 6.0, 0.2, 0, 1),
        ("mine", "r2", 1, 9.0, 0.6, 0, 0),  # the baseline has no such key
    ]
    scores = spark.createDataFrame(rows, "model string, round string, h int, wis double, ape double, cov50 int, cov90 int")
    runs = spark.createDataFrame([("mine", 4)], "model string, exp_id int")
    r = cm.hub_figures(scores, "base", runs).first()
    assert (r.exp_id, r.hub_coverage_50, r.hub_coverage_90) == (4, 0.5, 1.0)
    assert r.hub_rwis == pytest.approx(7 / 6) and r.hub_mape_pct == pytest.approx(30.0)
    assert r.hub_rwis_by_h == pytest.approx({1: 0.5, 2: 1.5}) and r.hub_mape_by_h == pytest.approx({1: 35.0, 2: 20.0})
