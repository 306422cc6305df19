from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from seriloom.functions import fixed_values as fv
from seriloom.operators import series as se
from seriloom.plans.evaluation import rolling_evaluation
from seriloom.plans.refresh import refresh
from seriloom.plans.training import prepare_training
from seriloom.sources import series_files as sf
from seriloom.sources import testbed as tb
from seriloom.streaming.landing import watch_landing

SF = "/root/testdata/sf0.001"
COLS = ", ".join(f"{c} string" for c in fv.FEED_COLUMNS)


def feed_rows(weeks, names=("Aland", "Bland"), first=date(2022, 1, 3)):
    rows = []
    for j, n in enumerate(names):
        for i in range(weeks):
            day = (first + timedelta(days=7 * i)).isoformat()
            rows.append((n[:2].upper(), n, day, "ALL", str(20 + (7 * i + j) % 13), "0"))
    return rows


def as_of(weeks, first=date(2022, 1, 3)):
    return F.lit((first + timedelta(days=7 * weeks + 2)).isoformat()).cast("date")


def test_refresh_end_to_end(spark, tmp_path):
    new, old = spark.createDataFrame(feed_rows(120), COLS), spark.createDataFrame(feed_rows(119), COLS)
    decision, out = refresh(new, old, as_of(120))
    assert decision == "ok"
    status = {r.series_id: r for r in out.status.collect()}
    assert set(status) == {"Aland", "Bland"} and not status["Aland"].stale
    assert status["Aland"].source == "forecast" and len(status["Aland"].forecast_weeks) == 4
    pts = out.points.filter("series_id = 'Aland'")
    assert pts.filter("historical IS NOT NULL").count() == 120 and pts.filter("forecast IS NOT NULL").count() == 8
    assert pts.filter("lower > forecast OR upper < forecast OR lower_50 < lower").count() == 0
    sf.write_documents(out.details, str(tmp_path / "details"))
    assert spark.read.json(str(tmp_path / "details")).count() == 2
    assert [r.on_map for r in out.listing.collect()] == [True, True]
    assert refresh(new, new, as_of(120)) == ("unchanged", None)
    with pytest.raises(ValueError, match="older"):
        refresh(old, new, as_of(120))


def test_stale_series_lose_their_forecasts(spark):
    new = spark.createDataFrame(feed_rows(60), COLS)
    _, out = refresh(new, None, as_of(70))
    assert {r.status for r in out.status.collect()} == {"stale"}
    assert out.points.filter("forecast IS NOT NULL").count() == 0


def test_rolling_evaluation_on_test_tables(spark):
    series = se.combine_indicators(tb.observations(spark, SF, "segment"))
    ev = rolling_evaluation(se.weekly_resample(series), n_paths=200)
    rows = ev.metrics.collect()
    assert len(rows) == 5 and all(r.n_eval_points > 0 for r in rows)
    assert all(r.per_horizon_rwis and set(r.per_horizon_rwis) <= {"1", "2", "3", "4"} for r in rows)
    assert ev.by_horizon.count() == 5
    assert {r.metric for r in ev.summary.collect()} >= {"wis", "relative_wis"}
    assert [r.sort_key for r in ev.leaderboard.collect()] == sorted(r.sort_key for r in ev.leaderboard.collect())


def test_training_set(spark, tmp_path):
    first = date(2012, 1, 1)
    rows = [(n, first + timedelta(days=7 * i), float(30 + (i * k) % 17), i % 2) for n, k in (("a", 3), ("b", 5)) for i in range(400)]
    rows += [("tiny", first + timedelta(days=7 * i), 1.0, 0) for i in range(400)]
    series = spark.createDataFrame(rows, "series_id string, obs_date date, cases double, data_type int")
    hemi = spark.createDataFrame([("a", 1.0)], "series_id string, hemisphere double")
    out = prepare_training(series, spark.createDataFrame([("b",)], "series_id string"), ["data_type", "week_of_year", "hemisphere"], hemi)
    assert {r.series_id for r in out.windows.select("series_id").distinct().collect()} == {"a"}
    r = out.counts.first()
    n, T = 400, 400 - 104
    assert r.train_windows == (T - 4 - 260) // 4 + 1 and r.val_windows == len(range(T, n - 3, 4))
    sf.write_samples(out.windows, str(tmp_path / "samples"))
    back = spark.read.parquet(str(tmp_path / "samples")).first()
    assert set(back.past_covariates) == set(back.future_covariates) == {"data_type_indicator", "week_sin", "week_cos", "hemisphere"}


def test_landing_stream_takes_each_pull_once(spark, tmp_path):
    landing, store, ckpt = tmp_path / "in", tmp_path / "store", tmp_path / "ckpt"
    landing.mkdir()
    seen = []

    def run():
        watch_landing(spark, str(landing), str(store), str(ckpt), lambda: as_of(120), lambda p: seen.append(p.weekly.count())).awaitTermination()

    def land(name, rows):
        lines = [",".join(fv.FEED_COLUMNS)] + [",".join(r) for r in rows]
        (landing / name).write_text("\n".join(lines) + "\n")

    land("1.csv", feed_rows(110))
    run()
    assert seen == [220]
    run()
    assert seen == [220]  # nothing new
    land("2.csv", feed_rows(110))  # same content
    run()
    assert seen == [220]
    land("3.csv", feed_rows(50))  # older and shorter: refused
    run()
    land("4.csv", feed_rows(112))
    run()
    assert seen == [220, 224]
    assert len([p for p in store.iterdir() if p.name.startswith("pull=")]) == 2
