from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from seriloom.operators import series as se
from seriloom.operators.percentiles import _bucket, grouped_percentiles

MON = date(2020, 1, 6)


def obs_of(spark, rows):
    data = [(s, MON + timedelta(days=7 * w), i, a) for s, w, i, a in rows]
    return spark.createDataFrame(data, "series_id string, obs_date date, ili double, ari double")


def values(df, column="value", order="idx"):
    return [r[column] for r in df.orderBy("series_id", order).collect()]


def test_combine_cases(spark):
    rows = [
        ("only_ili", 0, 3.0, 0.0), ("only_ili", 1, 0.0, None), ("only_ili", 2, None, 0.0),
        ("only_ari", 0, 0.0, 2.0), ("only_ari", 1, None, None),
        ("mixed", 0, 5.0, 9.0), ("mixed", 1, 0.0, 4.0), ("mixed", 2, None, 6.0), ("mixed", 3, 0.0, 0.0), ("mixed", 4, None, None),
        ("none", 0, 0.0, None),
    ]
    got = se.combine_indicators(obs_of(spark, rows)).orderBy("series_id", "obs_date").collect()
    flat = [(r.series_id, r.cases, r.data_type) for r in got]
    assert flat == [
        ("mixed", 5.0, 0), ("mixed", 4.0, 1), ("mixed", 6.0, 1),
        ("only_ari", 2.0, 1), ("only_ari", None, 1),
        ("only_ili", 3.0, 0), ("only_ili", 0.0, 0), ("only_ili", None, 0),
    ]


def test_parallel_guard_thresholds(spark):
    def parallel(name, weeks, big):
        return [(name, w, 1.0, big) for w in range(weeks)]

    rows = (
        parallel("fires", 220, 11.0)  # ratio 11, 220 weeks, 4.2 years
        + parallel("at_ratio", 220, 10.0)  # not strictly above 10
        + parallel("too_short", 156, 11.0)  # enough weeks, under four years
        + parallel("few_both", 25, 11.0)
    )
    got = {r.series_id: r for r in se.indicator_profile(obs_of(spark, rows)).collect()}
    assert got["fires"].keep_only == "ari" and got["fires"].winner_weeks == 220
    assert [got[n].keep_only for n in ("at_ratio", "too_short", "few_both")] == [None] * 3
    assert got["few_both"].n_both == 25
    kept = se.combine_indicators(obs_of(spark, rows)).filter("series_id = 'fires'")
    assert {(r.cases, r.data_type) for r in kept.collect()} == {(11.0, 1)}


def test_weekly_resample_duplicates_gaps_and_labels(spark):
    rows = [
        ("a", date(2020, 1, 8), 2.0), ("a", date(2020, 1, 8), 4.0), ("a", date(2020, 1, 12), None),
        ("a", date(2020, 1, 27), 7.0),
        ("b", date(2020, 1, 6), None),
    ]
    df = spark.createDataFrame(rows, "series_id string, obs_date date, cases double")
    got = [(r.series_id, r.week, r.idx, r.value) for r in se.weekly_resample(df).orderBy("series_id", "idx").collect()]
    assert got == [
        ("a", date(2020, 1, 12), 0, 3.0), ("a", date(2020, 1, 19), 1, None),
        ("a", date(2020, 1, 26), 2, None), ("a", date(2020, 2, 2), 3, 7.0),
        ("b", date(2020, 1, 12), 0, None),
    ]
    again = se.weekly_resample(se.weekly_resample(df).select("series_id", F.col("week").alias("obs_date"), F.col("value").alias("cases")))
    assert sorted(map(tuple, again.collect()), key=str) == sorted(map(tuple, se.weekly_resample(df).collect()), key=str)


def test_zero_runs_of_three_stay_and_four_go(weekly_of):
    w = weekly_of(a=[0, 0, 0, 5, 0, 0, 0, 0, 2, 0, 0, None, 0, 0])
    assert values(se.zero_runs_to_null(w)) == [0, 0, 0, 5, None, None, None, None, 2, 0, 0, None, 0, 0]


def test_trim_leading(weekly_of):
    lead = [0.1] * 6 + [None] + [50.0] * 20
    short = [0.1] * 4 + [50.0] * 4
    w = weekly_of(a=lead, short=short, zero=[0.0] * 12, empty=[None] * 12)
    out = se.trim_leading(w)
    got = {s: values(out.filter(F.col("series_id") == s)) for s in ("a", "short", "zero", "empty")}
    # window 0..7 already holds one 50: mean of its seven values is 7.2, above 10% of 50
    assert got["a"] == lead
    assert got["short"] == short and got["zero"] == [0.0] * 12 and got["empty"] == [None] * 12
    long_lead = se.trim_leading(weekly_of(b=[0.0] * 20 + [100.0] * 30))
    rows = long_lead.orderBy("idx").collect()
    # window 13..20 is the first to reach a 100: 100/8 > 10
    assert len(rows) == 37 and rows[0].idx == 0 and rows[-1].idx == 36


def test_zero_policies(weekly_of):
    w = weekly_of(a=[0, 1, None])
    assert values(se.zero_policy(w, "floor")) == [1e-6, 1.0, None]
    assert values(se.zero_policy(w, "null")) == [None, 1.0, None]
    assert values(se.zero_policy(w, "keep")) == [0.0, 1.0, None]
    with pytest.raises(ValueError):
        se.zero_policy(w, "drop")


def test_clip_outliers_ignores_missing(weekly_of):
    vals = [1, 2, 3, 4, None, 100]
    q1, q3 = np.percentile([1, 2, 3, 4, 100], [25, 75])
    got = values(se.clip_outliers(weekly_of(a=vals)))
    assert got == [1, 2, 3, 4, None, q3 + 1.5 * (q3 - q1)]
    assert values(se.clip_outliers(weekly_of(a=vals), iqr=False, max_value=3)) == [1, 2, 3, 3, None, 3]


def test_split_and_tail(weekly_of):
    w = weekly_of(a=range(10), b=range(3))
    parts = se.train_test_split(w, 0.25).groupBy("series_id").agg(F.sum((F.col("part") == "train").cast("int")).alias("k"))
    assert {r.series_id: r.k for r in parts.collect()} == {"a": 7, "b": 2}
    assert values(se.context_tail(w, 4)) == [6, 7, 8, 9, 0, 1, 2]


def test_indicator_flag_fills_within_and_across_weeks(spark, weekly_of):
    # weeks end on Sundays 2000-01-02, 09, 16, 23, 30
    rows = [
        ("a", date(2000, 1, 2), 1.0, None), ("a", date(2000, 1, 5), 1.0, 1), ("a", date(2000, 1, 12), 1.0, 0),
        ("a", date(2000, 1, 30), 1.0, 1),
    ]
    series = spark.createDataFrame(rows, "series_id string, obs_date date, cases double, data_type int")
    got = values(se.data_type_weekly(series, weekly_of(a=[1, 1, 1, 1, 1])), "data_type_indicator")
    # backfilled, own week, carried 1 beats 0, carried 0, Monday..Saturday 0 then Sunday 1
    assert got == [1, 1, 1, 0, 1]


def test_type_changes(spark):
    rows = [("a", MON + timedelta(days=7 * i), t) for i, t in enumerate([0, 0, None, 1, 1, 0])]
    df = spark.createDataFrame(rows, "series_id string, obs_date date, data_type int")
    got = [(r.date, r.from_type, r.to_type) for r in se.type_changes(df).orderBy("date").collect()]
    assert got == [(MON + timedelta(days=21), "ILI", "ARI"), (MON + timedelta(days=35), "ARI", "ILI")]


def test_source_priority(spark):
    rows = [("a", "ari", "1"), ("a", "ili", "2"), ("b", "ari", "3"), ("b", "combined", "4"), ("c", "other", "5")]
    got = se.source_priority(spark.createDataFrame(rows, "series_id string, kind string, path string"))
    assert sorted(map(tuple, got.collect())) == [("a", "ili", "2"), ("b", "combined", "4")]


def test_percentiles_of_a_hot_group(spark):
    rng = np.random.default_rng(5)
    hot = rng.gamma(2.0, 30.0, 4000).round(3)
    cold = np.array([-3.5, 0.0, 0.0, 2.0, 1e-6])
    rows = [("hot", float(x)) for x in hot] + [("cold", float(x)) for x in cold] + [("cold", None), ("one", 4.0)]
    df = spark.createDataFrame(rows, "k string, v double")
    probs = {"lo": 0.1, "mid": 0.5, "hi": 0.975}
    got = {r.k: (r.lo, r.mid, r.hi) for r in grouped_percentiles(df, ["k"], "v", probs).collect()}
    assert np.allclose(got["hot"], np.quantile(hot, [0.1, 0.5, 0.975]))
    assert np.allclose(got["cold"], np.quantile(cold, [0.1, 0.5, 0.975]))
    assert got["one"] == (4.0, 4.0, 4.0)
    whole = grouped_percentiles(df, [], "v", {"mid": 0.5}).first().mid
    assert np.isclose(whole, np.quantile(np.concatenate([hot, cold, [4.0]]), 0.5))


def test_undated_positions_across_chunks(spark):
    rows = [(("x" if i % 3 else "y"), 7 * i, float(i)) for i in range(100)]
    df = spark.createDataFrame(rows, "series_id string, pos long, v double").repartition(5)
    got = se.undated_series(df, "v", "pos", chunk=50)
    for name in ("x", "y"):
        want = [v for s, _, v in rows if s == name]
        mine = got.filter(F.col("series_id") == name).orderBy("idx").collect()
        assert [r.value for r in mine] == want and [r.idx for r in mine] == list(range(len(want)))


def test_percentiles_of_many_small_values(spark):

    values = [i * 1e-8 for i in range(100_000)] + [-1e-9, -5.0, 0.0]
    df = spark.createDataFrame([("k", v) for v in values], "k string, v double")
    got = grouped_percentiles(df, ["k"], "v", {"low": 0.01, "mid": 0.5, "high": 0.999}).first()
    assert np.allclose([got.low, got.mid, got.high], np.quantile(values, [0.01, 0.5, 0.999]), rtol=1e-12, atol=0)
    buckets = df.select("v", _bucket(F.col("v")).alias("b")).orderBy("v").collect()
    assert all(x.b <= y.b for x, y in zip(buckets, buckets[1:])) and len({r.b for r in buckets}) > 5000
