import numpy as np
import pytest
from pyspark.sql import functions as F

from seriloom.functions import fixed_values as fv
from seriloom.operators import forecast as fc
from seriloom.operators import scoring as so
from seriloom.operators.series import zero_policy


def with_thr(weekly, thr):
    return weekly.withColumn("threshold", F.lit(float(thr)))


def peaks_of(weekly, thr, **kw):
    return [r.idx for r in so.find_peaks(with_thr(weekly, thr), **kw).orderBy("idx").collect()]


def bump(at, height, n=60):
    v = [0.0] * n
    for i, h in zip(at, height):
        v[i] = float(h)
    return v


def test_plateau_peaks_in_the_middle(weekly_of):
    assert peaks_of(weekly_of(a=[0, 1, 5, 5, 5, 5, 2, 0]), 1) == [3]
    assert peaks_of(weekly_of(a=[5, 5, 1, 0, 3]), 1) == []  # ends never qualify
    assert peaks_of(weekly_of(a=[0, None, 4, None, 0]), 1) == [2]  # missing counts as zero


def test_peak_distance(weekly_of):
    assert peaks_of(weekly_of(a=bump([10, 25], [9, 8])), 1) == [10]  # 15 apart: lower one goes
    assert peaks_of(weekly_of(a=bump([10, 26], [9, 8])), 1) == [10, 26]  # 16 apart: both stay
    assert peaks_of(weekly_of(a=bump([10, 20], [7, 7])), 1) == [20]  # equal: the later one wins
    # a peak removed by a neighbour does not remove others
    assert peaks_of(weekly_of(a=bump([10, 22, 34], [9, 8, 7])), 1) == [10, 34]


def test_peak_height_and_prominence(weekly_of):
    v = [0.0] * 5 + [10, 9.5, 9.8, 9.6, 0] + [0.0] * 20 + [3.0] + [0.0] * 5
    assert peaks_of(weekly_of(a=v), 4) == [5]
    shoulder = [0.0] * 3 + [20.0] + [19.0] * 20 + [19.5] + [19.0] * 3 + [0.0]
    # the second summit rises only 0.5 above its saddle
    assert peaks_of(weekly_of(a=shoulder), 2) == [3]
    assert peaks_of(weekly_of(a=shoulder), 1) == [3, 24]


def scipy_like_peaks(v, thr, distance=16, prom=0.3):
    """Plain-Python peaks for comparison on random series."""
    n, cand, i = len(v), [], 1
    while i < n - 1:
        if v[i - 1] < v[i]:
            j = i
            while j < n - 1 and v[j + 1] == v[i]:
                j += 1
            if j < n - 1 and v[j + 1] < v[i]:
                cand.append((i + j) // 2)
            i = j + 1
        else:
            i += 1
    cand = [c for c in cand if v[c] >= thr]
    kept = []
    for c in sorted(cand, key=lambda c: (v[c], c), reverse=True):
        if all(abs(c - k) >= distance for k in kept):
            kept.append(c)
    out = []
    for c in sorted(kept):
        lo, k = v[c], c
        while k >= 0 and v[k] <= v[c]:
            lo, k = min(lo, v[k]), k - 1
        hi, k = v[c], c
        while k < n and v[k] <= v[c]:
            hi, k = min(hi, v[k]), k + 1
        if v[c] - max(lo, hi) >= prom * thr:
            out.append(c)
    return out


def test_peaks_against_brute_force(weekly_of):
    rng = np.random.default_rng(11)
    series = {f"s{k}": [float(x) for x in rng.poisson(3 + 3 * np.sin(np.arange(150) / 8.0) ** 2 * k)] for k in range(1, 7)}
    got = so.find_peaks(with_thr(weekly_of(**series), 3)).collect()
    for name, v in series.items():
        assert sorted(r.idx for r in got if r.series_id == name) == scipy_like_peaks(v, 3.0), name


def test_phases(weekly_of):
    v = bump([10, 40], [50, 60], 55)
    v = [x if x else 5.0 for x in v]
    v[0] = 1.0
    v[11] = None
    w = with_thr(weekly_of(a=v), 2)
    ph = [r.phase for r in so.phase_labels(w, so.find_peaks(w)).orderBy("idx").collect()]
    assert ph[0] == "off_season" and ph[11] == "off_season"  # below threshold, missing beside a peak
    assert ph[8] == ph[10] == ph[12] == "peak_window" and ph[7] == "growth"
    assert ph[13] == ph[24] == "decay"
    assert ph[25] == "growth"  # equal distance to both peaks
    assert ph[54] == "decay"
    flat = with_thr(weekly_of(a=[5.0] * 5), 2)
    assert {r.phase for r in so.phase_labels(flat, so.find_peaks(flat)).collect()} == {"growth"}


def test_threshold_without_positive_values(weekly_of):
    got = {r.series_id: r.threshold for r in fc.season_threshold(weekly_of(a=[0, None], b=[1, 2, 3, 0])).collect()}
    assert got == {"a": 1.0, "b": pytest.approx(1.4)}


def test_diff_pool_history_and_minimum(weekly_of):
    w = weekly_of(a=[1, 2, 4, None, 7, 11, 16, 22, 29])
    got = {r.cutoff: sorted(r.pool) for r in fc.diff_pool(w, history=104).collect()}
    assert min(got) == 7  # four differences (1, 2, 4, 5) first exist before row 7
    assert got[7] == [-5, -4, -2, -1, 1, 2, 4, 5]
    short = {r.cutoff: len(r.pool) for r in fc.diff_pool(w, history=4).collect()}
    assert short == {9: 8}  # the gap leaves cutoff 8 with three


def test_rolling_points(weekly_of):
    v = [float(i + 1) for i in range(40)]
    v[30] = None
    pts = {r.t: r for r in fc.rolling_points(weekly_of(a=v), window=20, threshold=False).collect()}
    assert min(pts) == 20 and max(pts) == 39
    assert 30 not in pts  # missing target
    assert 35 not in pts  # row 30 is the last context value of cutoff 31
    r = pts[39]
    assert (r.cutoff, r.last_value) == (35, 35.0)
    assert r.actuals == [37.0, 38.0, 39.0, 40.0] and r.window_actuals == [36.0, 37.0, 38.0, 39.0]
    aligned = {r.t: r for r in fc.rolling_points(weekly_of(a=v), window=20, threshold=False, target_offset=0).collect()}
    assert aligned[39].actuals == [36.0, 37.0, 38.0, 39.0]


def test_pools_of_whole_histories(weekly_of):
    rng = np.random.default_rng(11)
    v = [None if rng.random() < 0.1 else float(x) for x in rng.integers(0, 90, 520)]
    short = [1.0, 2.0, 3.0]
    weekly = weekly_of(a=v, b=short)

    def plain(at, lag, history):
        first = 0 if history is None else max(0, at - history)
        return [v[i] - v[i - lag] for i in range(first, at) if i >= lag and v[i] is not None and v[i - lag] is not None]

    for history in (None, 104, 7):
        rows = fc.rolling_points(weekly, history=history, threshold=False).collect()
        assert {r.t for r in rows} == {t for t in range(520 - 52, 520) if v[t] is not None and v[t - 5] is not None}
        for r in rows:
            assert (r.series_id, r.target_value, r.last_value) == ("a", v[r.t], v[r.t - 5])
            assert r.pool == plain(r.cutoff, 1, history) and r.season_pool == plain(r.cutoff, 52, history)
            assert r.step_pools == [plain(r.cutoff, h, history) for h in (1, 2, 3, 4)]
        pools = {r.cutoff: r.pool for r in fc.diff_pool(weekly, history).filter("series_id = 'a'").collect()}
        wanted = {t + 1: plain(t + 1, 1, history) for t in range(520) if v[t] is not None}
        assert pools == {c: p + [-d for d in p] for c, p in wanted.items() if len(p) >= 4}
    plan = fc.rolling_points(weekly, history=None)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in "".join(x for x in plan.splitlines() if "Window" in x)


def test_random_walk_is_partition_free_and_close_to_sampling(weekly_of):
    rng = np.random.default_rng(3)
    v = [float(x) for x in 50 + np.cumsum(rng.integers(-4, 5, 80))]
    pts = fc.rolling_points(weekly_of(a=v, b=v[::-1]), window=3, threshold=False)

    def run(parts):
        out = fc.random_walk_quantiles(pts.repartition(parts), n_paths=2000)
        return {(r.series_id, r.cutoff): r.random_walk for r in out.collect()}

    one, many = run(1), run(7)
    assert one == many
    cutoff = 79 - 4
    d = np.diff(v[: cutoff])[-104:]
    pool = np.concatenate([d, -d])
    ends = v[cutoff - 1] + rng.choice(pool, size=(200_000, 4)).cumsum(axis=1)
    got = np.array(one[("a", cutoff)])
    assert np.allclose(got[0], np.quantile(np.maximum(v[cutoff - 1] + pool, 0), fv.LEVELS_7))
    for h in (1, 2, 3):
        want = np.quantile(np.maximum(ends[:, h], 0), fv.LEVELS_7)
        assert np.all(np.abs(got[h] - want) < 1.2)


def test_small_pool_gives_no_walk(weekly_of):
    v = [5.0] + [None, 5.0] * 10
    v[15] = 5.0  # a last context value for row 20, and a single difference
    pts = fc.rolling_points(weekly_of(a=v), window=7, threshold=False)
    assert pts.count() > 0
    assert all(r.random_walk is None for r in fc.random_walk_quantiles(pts, n_paths=50).collect())


def test_seasonal_naive(weekly_of):
    v = [float(i % 52) + (2.0 if i >= 52 else 0.0) for i in range(130)]
    pts = fc.seasonal_naive_quantiles(fc.rolling_points(weekly_of(a=v), window=4, threshold=False))
    r = pts.filter("t = 129").first()
    # cutoff 125: the season before says 73.., plus a change of 2 or 0
    assert [q[3] for q in r.seasonal_naive] == pytest.approx([v[73] + 2, v[74] + 2, v[75] + 2, v[76] + 2], abs=2.0)


def test_long_form_round_trip(weekly_of):
    v = [float(x) for x in np.random.default_rng(1).integers(1, 50, 60)]
    pts = fc.direct_step_quantiles(fc.rolling_points(weekly_of(a=v), window=5, threshold=False))
    back = fc.level_positions(fc.long_quantiles(pts, "direct_step"))
    want = {(r.cutoff, h + 1): q for r in pts.collect() for h, q in enumerate(r.direct_step)}
    assert {(r.cutoff, r.h): r.q for r in back.collect()} == want
    assert back.first().levels == fv.LEVELS_7


def test_scores_skip_off_season_and_missing(weekly_of):
    v = [10.0] * 70
    v[66], v[67] = 1.0, None
    w = with_thr(weekly_of(a=v), 5)
    pts = fc.direct_step_quantiles(fc.rolling_points(w, window=5))
    s = so.score_horizons(pts, "direct_step")
    rows = {(r.cutoff, r.h) for r in s.collect()}
    targets = {c + h for c, h in rows}
    assert 66 not in targets and 67 not in targets and targets
    assert s.filter("wis < 0").count() == 0
    flat = so.score_horizons(fc.direct_step_quantiles(fc.rolling_points(with_thr(weekly_of(a=[10.0] * 70), 5))), "direct_step")
    assert flat.agg(F.max("wis")).first()[0] == 0.0


def test_metrics_keep_series_without_points(spark, weekly_of):
    w = zero_policy(weekly_of(a=[10.0 + (i % 3) for i in range(80)], b=[None] * 80))
    pts = fc.seasonal_naive_quantiles(fc.random_walk_quantiles(fc.rolling_points(w), n_paths=100))
    scores = so.score_horizons(pts, "seasonal_naive", "random_walk")
    names = spark.createDataFrame([("a",), ("b",)], "series_id string")
    got = {r.series_id: r for r in so.metrics_per_series(names, scores, so.peak_timing(pts, "seasonal_naive")).collect()}
    assert got["b"].n_eval_points == 0 and got["b"].wis is None and got["b"].n_peak_timing_points == 0
    assert got["a"].n_eval_points > 0
    board = so.leaderboard(so.metrics_per_series(names, scores)).collect()
    assert board[-1].series_id == "b"


def test_horizon_ratio_needs_equal_counts(spark):
    rows = [("a", 1, 2.0, 1.0), ("a", 1, 4.0, 3.0), ("a", 2, 2.0, 1.0), ("a", 2, 2.0, None), ("a", 3, 1.0, 0.0)]
    df = spark.createDataFrame(rows, "series_id string, h int, wis double, baseline_wis double")
    assert {r.h: r.rwis for r in so.horizon_rwis(df).collect()} == {1: 1.5, 2: None, 3: None}


def test_peak_timing_first_maximum(spark):
    rows = [
        ("late", 1, 4.0, [1.0, 9.0, 9.0, 2.0], [[0.0], [1.0], [7.0], [3.0]]),
        ("small", 1, 4.0, [1.0, 5.0, 2.0, 2.0], [[0.0], [1.0], [7.0], [3.0]]),
        ("gap", 1, 4.0, [1.0, None, 9.0, 2.0], [[0.0], [1.0], [7.0], [3.0]]),
    ]
    df = spark.createDataFrame(
        rows, "series_id string, cutoff int, threshold double, window_actuals array<double>, m array<array<double>>"
    )
    assert [tuple(r) for r in so.peak_timing(df, "m", levels=[0.5]).collect()] == [("late", 1, 1)]


def test_steps_without_a_baseline_are_still_scored(weekly_of):
    v = [None] * 80
    for i in range(0, 80, 2):
        v[i] = float(10 + i % 7)
    v[75] = 10.0  # last context value of row 79 + 1; only single differences exist
    v[79] = 11.0
    pts = fc.rolling_points(weekly_of(a=v), window=2)
    pts = fc.seasonal_naive_quantiles(fc.random_walk_quantiles(pts, n_paths=20))
    assert pts.filter("random_walk IS NOT NULL").count() == 0
    scores = so.score_horizons(pts, "seasonal_naive", "random_walk").collect()
    assert scores and all(r.baseline_wis is None for r in scores)


def test_walk_is_simulated_once_and_after_the_repartition(spark, weekly_of):
    w = fc.with_threshold(weekly_of(a=[float(3 + i % 7) for i in range(80)]))
    long = fc.long_quantiles(fc.random_walk_quantiles(fc.rolling_points(w), n_paths=20), "random_walk")
    lines = long._jdf.queryExecution().optimizedPlan().toString().splitlines()
    at = [i for i, x in enumerate(lines) if "ArrowEvalPython" in x]
    assert len(at) == 1
    assert any("Repartition" in x for x in lines[at[0] :])


def test_walk_runs_where_the_package_cannot_be_imported(tmp_path):
    import os
    import subprocess
    import sys
    from pathlib import Path

    code = """
import sys
sys.path.insert(0, sys.argv[1])
from pyspark.sql import SparkSession
from seriloom.operators import forecast as fc
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "1").getOrCreate()
points = spark.createDataFrame([("a", 5, 3.0, [1.0, -1.0, 2.0, 0.5])], "series_id string, cutoff int, last_value double, pool array<double>")
print("WALKED", len(fc.random_walk_quantiles(points, n_paths=10).first().random_walk))
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    root = str(Path(__file__).resolve().parents[1])
    done = subprocess.run([sys.executable, "-c", code, root], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "WALKED 4" in done.stdout, done.stderr[-1500:]
