import math
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from seriloom.operators import screening as sc

SIZES = dict(context=10, target=4, stride=4, held_out=8)


def test_window_counts_and_contents(weekly_of):
    n = 40
    w = weekly_of(a=[float(i) for i in range(n)], short=[1.0] * 21)
    out = sc.build_windows(w, **SIZES)
    train = out.filter("part = 'train'").orderBy("end_ctx").collect()
    val = out.filter("part = 'val'").orderBy("end_ctx").collect()
    T = n - 8
    assert [r.end_ctx for r in train] == list(range(10, T - 3, 4))
    assert len(train) == math.floor((T - 4 - 10) / 4) + 1
    assert [r.end_ctx for r in val] == [32, 36]
    assert train[1].target == [float(x) for x in range(4, 14)] and train[1].future == [14.0, 15.0, 16.0, 17.0]
    assert {r.series_id for r in train + val} == {"a"}  # 21 < 10 + 4 + 8
    assert all(r.repeats == 1 for r in val)


def test_empty_futures_are_skipped(weekly_of):
    v = [float(i) for i in range(40)]
    v[10:14] = [None] * 4
    v[14] = None
    got = sc.build_windows(weekly_of(a=v), **SIZES).filter("part = 'train'").collect()
    assert sorted(r.end_ctx for r in got) == [14, 18, 22, 26]


def test_recency_and_peak_repeats(spark, weekly_of):
    newest = date(2020, 1, 1)
    ages = [0, 434, 436, 1460, 1470]
    rows = [(newest - timedelta(days=a), newest) for a in ages]
    got = spark.createDataFrame(rows, "e date, n date").select(sc.recency_repeats(F.col("e"), F.col("n"))).collect()
    want = []
    for a in ages:
        w = math.exp(-0.3 * a / 365.25)
        want.append(3 if w >= 0.7 else 2 if w >= 0.3 else 1)
    assert [r[0] for r in got] == want == [3, 3, 2, 2, 1]
    v = [1.0] * 40
    v[12] = 50.0
    out = {r.end_ctx: r.repeats for r in sc.build_windows(weekly_of(a=v), **SIZES).filter("part = 'train'").collect()}
    assert out[10] == 9 and out[14] == 3  # a peak week, strictly above the 70% level


def test_oversampled_rows(weekly_of):
    w = sc.build_windows(weekly_of(a=[float(i) for i in range(40)]), **SIZES)
    assert sc.oversample(w).count() == w.agg(F.sum("repeats")).first()[0]
    counts = sc.sample_counts(w).first()
    assert (counts.train_windows, counts.val_windows) == (5, 2)


def test_covariate_slices(weekly_of):
    w = weekly_of(a=[float(i) for i in range(40)]).withColumns({"week_sin": F.col("idx") * 1.0, "extra": F.col("idx") * 2.0})
    r = sc.build_windows(w, ["week_sin", "extra"], **SIZES).filter("end_ctx = 14 AND part = 'train'").first()
    assert r.past_covariates["extra"] == [2.0 * i for i in range(4, 14)]
    assert r.future_covariates == {"week_sin": [14.0, 15.0, 16.0, 17.0]}
    assert {x.feature for x in sc.detect_features(sc.build_windows(w, ["week_sin", "extra"], **SIZES)).collect()} == {"week_sin", "extra"}


def test_peak_threshold_without_positives(weekly_of):
    got = {r.series_id: r.peak_threshold for r in sc.peak_threshold(weekly_of(a=[0.0] * 12, b=[1.0, 2.0] * 6), held_out=2).collect()}
    assert got["a"] == float("inf") and got["b"] == pytest.approx(2.0)


def test_quality_reasons_in_order(weekly_of):
    good = [30.0] * 230
    w = weekly_of(good=good, tiny=[1.0] * 230, brief=[30.0] * 100, holes=[30.0 if i % 5 == 0 else None for i in range(800)])
    got = {r.series_id: r for r in sc.quality_screen(w).collect()}
    assert got["good"].include and got["good"].exclude_reason == ""
    assert got["tiny"].exclude_reason == "too_small_scale(1.0<20.0)"
    assert got["brief"].exclude_reason == "too_few_nonnan(100<156); too_short(1.9yr<4)"
    assert got["holes"].exclude_reason == "high_nan_sporadic(80.0%>50%)"


def test_override_and_list(spark, weekly_of):
    s = sc.quality_screen(weekly_of(a=[30.0] * 230, b=[30.0] * 230, c=[1.0] * 10)).withColumn("data_type", F.lit("combined"))
    out = sc.screen_override(s, spark.createDataFrame([("a",), ("zzz",)], "series_id string"))
    rows = {r.series_id: r for r in out.collect()}
    assert not rows["a"].include and rows["a"].exclude_reason == "manually excluded"
    assert [r.series_id for r in sc.training_list(out).collect()] == ["b"]


def test_seasonal_gaps(spark):
    rows = []
    for i in range(300):
        d = date(2010, 1, 3) + timedelta(days=7 * i)
        rows.append(("summer_gap", d, i, None if d.month in (6, 7, 8) else 5.0))
        rows.append(("random_gap", d, i, None if i % 2 else 5.0))
    w = spark.createDataFrame(rows, "series_id string, week date, idx int, value double")
    assert {r.series_id: r.pattern for r in sc.nan_pattern(w).collect()} == {"summer_gap": "seasonal", "random_gap": "sporadic"}


def test_training_takes_all_five_covariates(spark):
    from datetime import date, timedelta

    from seriloom.plans.training import prepare_training

    days = [date(1995, 1, 1) + timedelta(days=7 * i) for i in range(400)]
    rows = [(s, d, 50.0 + (i * k) % 23, 1) for k, s in enumerate(("a", "b"), 1) for i, d in enumerate(days)]
    series = spark.createDataFrame(rows, "series_id string, obs_date date, cases double, data_type int")
    latitudes = spark.createDataFrame([("a", 1.0), ("b", -1.0)], "series_id string, hemisphere double")
    weather = spark.createDataFrame([(s, d, float(i)) for s in ("a", "b") for i, d in enumerate(days)], "series_id string, week date, temp_mean double")
    edges = spark.createDataFrame([("a", "b", 1), ("b", "nowhere", 1)], "src string, dst string, rank int")
    names = ["data_type", "hemisphere", "week_of_year", "weather", "neighbors"]
    made = prepare_training(series, covariates=names, latitudes=latitudes, weather=weather, neighbors=edges)
    row = made.windows.filter("series_id = 'a' AND part = 'train'").first()
    assert {"data_type_indicator", "hemisphere", "week_sin", "week_cos", "temp_mean", "neighbor_1"} <= set(row.past_covariates)
    assert any(v is not None for v in row.past_covariates["neighbor_1"]) and any(v is not None for v in row.past_covariates["temp_mean"])
    lone = made.windows.filter("series_id = 'b' AND part = 'train'").first()
    assert all(v is None for v in lone.past_covariates["neighbor_1"])
    for bad in (["wether"], ["weather"], ["neighbors"]):
        with pytest.raises(ValueError):
            prepare_training(series, covariates=bad)
