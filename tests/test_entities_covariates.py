import random
import re
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from seriloom.functions import fixed_values as fv
from seriloom.operators import covariates as cv
from seriloom.operators import entities as en
from seriloom.sources import series_files as sf


def brute(query, ents):
    rules = [
        lambda c, n: query.upper() == c,
        lambda c, n: query.lower() == n.lower(),
        lambda c, n: re.search(rf"\b{re.escape(query)}\b", n, re.I) is not None,
        lambda c, n: len(query) >= 3 and query.lower() in n.lower(),
    ]
    for k, rule in enumerate(rules, 1):
        for code, name in ents:
            if rule(code, name):
                return (code, name, k)
    return (None, None, None)


def test_resolution_matches_brute_force(spark):
    names = [
        "United Kingdom, England", "United Republic of Tanzania", "Congo", "Democratic Republic of the Congo",
        "Guinea", "Guinea-Bissau", "Papua New Guinea", "Niger", "Nigeria", "Côte d'Ivoire", "Türkiye", "Viet Nam",
        "Bolivia (Plurinational State of)", "Netherlands (Kingdom of the)", "Oman", "Romania", "Mali", "Somalia",
    ]
    ents = [(f"X{i:02d}", n) for i, n in enumerate(names)]
    rng = random.Random(4)
    asked = {"x03", "guinea", "GUINEA", "new guinea", "nigeri", "man", "om", "united", "(Plurinational", "of", "d'ivoire", "türkiye", "TÜRK", "mali", "qqq", "(Kingdom of the)", "State of)", "a.c", "\\E", "Viet  Nam"}
    for n in names:
        a = rng.randrange(len(n) - 2)
        asked.add(n[a : a + rng.randint(2, 8)].strip() or "x")
    table = spark.createDataFrame([(c, n, i) for i, (c, n) in enumerate(ents)], "code string, name string, first_seen int")
    got = {r["query"]: (r.code, r.name, r.rule) for r in en.resolve_entity(spark.createDataFrame([(a,) for a in asked], "query string"), table).collect()}
    assert got == {a: brute(a, ents) for a in asked}


def test_code_lookup_rules(spark):
    mapping = spark.createDataFrame([("France", "FR"), ("South Sudan", "SS"), ("Turkey", "TR")], "name string, code string")
    names = ["France", "South_Sudan", "Türkiye", "Congo", "Democratic_Republic_of_the_Congo", "Atlantis", "United_Kingdom,_Scotland"]
    got = {r.name: r.code for r in en.code_lookup(spark.createDataFrame([(n,) for n in names], "name string"), mapping).collect()}
    assert got == {
        "France": "FR", "South_Sudan": "SS", "Türkiye": "TR", "Congo": "CG",
        "Democratic_Republic_of_the_Congo": "CD", "Atlantis": None, "United_Kingdom,_Scotland": "SCT",
    }


def test_dimensions_from_json(spark, tmp_path):
    (tmp_path / "boxes.json").write_text('{"AA": ["Aland", [10.0, 60.0, 20.0, 62.0]], "BB": ["Bland", [-10, -40, 0, -20]]}')
    (tmp_path / "capitals.json").write_text('{"Bland": [-35.5, 149.1]}')
    boxes = sf.read_bounding_boxes(spark, str(tmp_path / "boxes.json"))
    capitals = sf.read_capitals(spark, str(tmp_path / "capitals.json"))
    names = spark.createDataFrame([("Aland",), ("Bland",), ("Nowhere",)], "name string")
    got = {r.name: (r.lat, r.lon) for r in en.coordinates(names, boxes, capitals).collect()}
    assert got == {"Aland": (61.0, 15.0), "Bland": (-35.5, 149.1), "Nowhere": (None, None)}
    flags = {r.name: r.h for r in en.coordinates(names, boxes).select("name", en.hemisphere(F.col("lat")).alias("h")).collect()}
    assert flags == {"Aland": 1.0, "Bland": -1.0, "Nowhere": 0.0}


def test_fixed_tables(spark):
    edges = en.neighbour_edges(spark)
    assert edges.count() == sum(len(v) for v in fv.NEIGHBOURS.values()) and len(fv.NEIGHBOURS) == 28
    assert [r.dst for r in edges.filter("src = 'Italy'").orderBy("rank").collect()] == ["France", "Austria", "Switzerland", "Slovenia"]
    short = en.alias_map(spark.createDataFrame([("Viet Nam",), ("Chad",)], "name string")).collect()
    assert {r.name: r.short_name for r in short} == {"Viet Nam": "Vietnam", "Chad": "Chad"}


D0 = date(2020, 1, 5)  # a Sunday


def daily(spark, n=28):
    rows = [("L", D0 + timedelta(days=i), float(i), float(i + 1), float(-i), 2.0 * i, float(i % 3)) for i in range(n)]
    return spark.createDataFrame(rows, "location string, date date, temp_mean double, temp_max double, temp_min double, humidity_mean double, humidity_min double")


def labels(spark, days):
    rows = [("s", "L", D0 + timedelta(days=k)) for k in days]
    return spark.createDataFrame(rows, "series_id string, location string, week date")


def test_weather_windows(spark):
    regular = labels(spark, [0, 7, 14, 35])
    ahead = {r.week: r for r in cv.weather_weekly(regular, daily(spark)).collect()}
    assert ahead[D0].temp_mean == 3.0 and ahead[D0].temp_max == 7.0 and ahead[D0].temp_min == -6.0
    assert ahead[D0 + timedelta(days=35)].temp_mean is None
    own = {r.week: r for r in cv.weather_weekly(regular, daily(spark), anchor="week").collect()}
    assert own[D0].temp_mean == 0.0 and own[D0 + timedelta(days=7)].temp_mean == 4.0
    odd = {r.week: r for r in cv.weather_irregular(labels(spark, [0, 3, 13]), daily(spark)).collect()}
    assert [odd[D0 + timedelta(days=k)].temp_mean for k in (0, 3, 13)] == [1.0, 7.5, 16.0]
    same = {r.week: r.temp_mean for r in cv.weather_irregular(labels(spark, [0, 7, 14]), daily(spark)).collect()}
    assert same == {w: ahead[w].temp_mean for w in same}


def test_scaler_is_reusable(spark):
    df = spark.createDataFrame([("a", 1.0, 5.0), ("a", 3.0, 5.0), ("a", None, None)], "series_id string, x double, c double")
    fitted = cv.fit_scaler(df, ["x", "c"], ["series_id"])
    got = [(r.x, r.c) for r in cv.apply_scaler(df, fitted, ["x", "c"], ["series_id"]).collect()]
    assert sorted(got, key=str) == sorted([(-1.0, 0.0), (1.0, 0.0), (None, None)], key=str)
    other = spark.createDataFrame([("a", 5.0, 6.0)], "series_id string, x double, c double")
    assert tuple(cv.apply_scaler(other, fitted, ["x", "c"], ["series_id"]).select("x", "c").first()) == (3.0, 1.0)


def test_coverage_choice(spark):
    d = lambda k: D0 + timedelta(days=k)
    cache = spark.createDataFrame([("L", d(0), d(100)), ("L", d(10), d(20)), ("L", d(-5), d(15)), ("M", d(0), d(9))], "location string, start date, end date")
    asks = spark.createDataFrame([("exact", "L", d(10), d(20)), ("inside", "L", d(11), d(15)), ("out", "L", d(10), d(101)), ("none", "X", d(0), d(1))], "series_id string, location string, start date, end date")
    got = {r.series_id: (r.cache_start, r.exact) for r in cv.weather_coverage(asks, cache).collect()}
    assert got == {"exact": (d(10), True), "inside": (d(-5), False), "out": (None, None), "none": (None, None)}


def test_freshness_and_plan(spark):
    d = lambda k: D0 + timedelta(days=k)
    cache = spark.createDataFrame([("A", d(86)), ("B", d(85)), ("B", d(10))], "location string, end date")
    needs = spark.createDataFrame(
        [("f", "A", d(0), d(50)), ("s", "B", d(0), d(50)), ("m", "C", d(0), d(120)), ("n", "A", None, None)],
        "series_id string, location string, start date, end date",
    )
    fresh = cv.cache_freshness(needs, cache, F.lit(str(d(100))).cast("date"))
    assert {r.series_id: r.status for r in fresh.collect()} == {"f": "fresh", "s": "stale", "m": "missing", "n": "no_data"}
    plan = {r.series_id: (r.action, r.fetch_from, r.fetch_to) for r in cv.refresh_plan(fresh).collect()}
    assert plan == {"s": ("tail", d(78), d(100)), "m": ("full", d(0), d(120))}
    assert {r.series_id for r in cv.refresh_plan(fresh, refresh_stale=False).collect()} == {"m"}


def test_old_cache_rows_win(spark):
    old, tail = daily(spark, 10), daily(spark, 14).withColumn("temp_mean", F.lit(-1.0)).filter(F.col("date") >= str(D0 + timedelta(days=5)))
    got = cv.cache_extend(old, tail).orderBy("date").collect()
    assert [r.temp_mean for r in got] == [float(i) for i in range(10)] + [-1.0] * 4


def test_neighbours_need_half_coverage(spark, weekly_of):
    w = weekly_of(a=[1, 2, 3, 4], half=[9, None, 9, None], poor=[9, None, None, None], far=[7, 7, 7, 7])
    edges = spark.createDataFrame([("a", "half", 1), ("a", "poor", 2), ("a", "unknown", 3), ("a", "far", 7)], "src string, dst string, rank int")
    got = cv.neighbour_features(w, edges)
    assert {r.neighbour for r in got.collect()} == {"half"} and got.count() == 4
    assert {r.neighbour for r in cv.neighbour_features(w, edges, max_neighbours=None).collect()} == {"half", "far"}


def test_gate(spark):
    ctx = [("a", 5, "x", 3, 1.0), ("a", 5, "x", 4, None), ("a", 5, "y", 3, None), ("a", 5, "y", 4, 2.0)]
    fut = [("a", 5, "k", 5 + i, 1.0) for i in range(4)]
    cols = "series_id string, cutoff int, name string, idx int, value double"
    got = {r.name: (r.use_past, r.use_future) for r in cv.covariate_gate(spark.createDataFrame(ctx, cols), spark.createDataFrame(fut, cols)).collect()}
    assert got == {"x": (False, True), "y": (True, True)}
    short = cv.covariate_gate(spark.createDataFrame(ctx, cols), spark.createDataFrame(fut[:3], cols))
    assert {r.use_future for r in short.collect()} == {False}


def test_week_angles_over_the_border(spark, weekly_of):
    got = cv.week_sincos(weekly_of(a=[1.0] * 3)).orderBy("idx").collect()
    weeks = [r.week.isocalendar()[1] for r in got]
    assert weeks == [52, 1, 2]
    assert np.allclose([r.week_sin for r in got], np.sin(2 * np.pi * np.array(weeks) / 52))
    ahead = cv.future_week_sincos(weekly_of(a=[1.0])).orderBy("step").collect()
    assert [r.iso_week for r in ahead] == [1, 2, 3, 4]


def test_usage_total_line(spark):
    df = spark.createDataFrame([("a", True), ("a", False), ("b", True)], "g string, used boolean")
    got = {r.g: (r.n_used, r.n_total, r.used_pct) for r in cv.feature_usage(df, "g", "used").collect()}
    assert got == {"a": (1, 2, 50.0), "b": (1, 1, 100.0), "TOTAL": (2, 3, pytest.approx(200 / 3))}
