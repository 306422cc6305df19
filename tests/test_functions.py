import math
from datetime import date, timedelta

import numpy as np
from pyspark.sql import functions as F

from seriloom.functions import fixed_values as fv
from seriloom.functions.calendar import add_weeks_52, iso_monday, week_end, week_start, wrap_week
from seriloom.functions.cells import pool_quantiles, rounded, to_day, to_number
from seriloom.functions.scores import interval_score, weighted_interval_score


def one(spark, *cols):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()


def test_lenient_parsing(spark):
    rows = spark.createDataFrame([("12",), ("1e3",), ("n/a",), ("NaN",), (None,), ("-",)], "x string")
    got = [r[0] for r in rows.select(to_number("x")).collect()]
    assert got == [12.0, 1000.0, None, None, None, None]
    days = spark.createDataFrame([("2024-02-29",), ("7",), ("2023-02-29",), (None,)], "x string")
    assert [r[0] for r in days.select(to_day("x")).collect()] == [date(2024, 2, 29), None, None, None]


def test_weeks_run_monday_to_sunday(spark):
    first = date(2023, 12, 20)
    days = [(first + timedelta(days=i),) for i in range(30)]
    rows = spark.createDataFrame(days, "d date").select("d", week_start(F.col("d")), week_end(F.col("d"))).collect()
    for d, mon, sun in rows:
        assert mon == d - timedelta(days=d.weekday())
        assert sun == mon + timedelta(days=6)


def test_iso_monday_with_week_53(spark):
    cases = [(2020, 53), (2021, 1), (2015, 53), (2016, 1), (2024, 52), (2026, 1)]
    rows = spark.createDataFrame(cases, "y int, w int").select("y", "w", iso_monday(F.col("y"), F.col("w"))).collect()
    for y, w, monday in rows:
        assert monday == date.fromisocalendar(y, w, 1)


def test_52_week_arithmetic(spark):
    y, w = add_weeks_52(F.lit(2023), F.lit(50), F.lit(4))
    assert tuple(one(spark, y, w)) == (2024, 2)
    assert one(spark, wrap_week(F.lit(54)))[0] == 2


def test_interval_score_hand_values(spark):
    inside = interval_score(F.lit(1.0), F.lit(3.0), F.lit(2.0), 0.5)
    below = interval_score(F.lit(1.0), F.lit(3.0), F.lit(0.0), 0.5)
    assert tuple(one(spark, inside, below)) == (2.0, 6.0)


def test_wis_of_a_point_mass(spark):
    q = F.array(*[F.lit(5.0)] * 7)
    hit = weighted_interval_score(F.lit(5.0), q, fv.LEVELS_7, fv.INTERVALS_7)
    # off by 2: 0.5*2 + sum(a/2 * 2/a * 2) = 1 + 3*2 = 7, over 3.5
    off = weighted_interval_score(F.lit(7.0), q, fv.LEVELS_7, fv.INTERVALS_7)
    q23 = F.array(*[F.lit(5.0)] * 23)
    off23 = weighted_interval_score(F.lit(7.0), q23, fv.LEVELS_23, fv.INTERVALS_23)
    got = one(spark, hit, off, off23)
    assert got[0] == 0.0
    assert math.isclose(got[1], 2.0) and math.isclose(got[2], 2.0)


def test_pool_quantiles_match_numpy(spark):
    pool = [3.0, -1.0, 4.0, 1.5, 9.25, -2.0]
    got = one(spark, pool_quantiles(F.array(*[F.lit(x) for x in pool]), fv.LEVELS_23))[0]
    assert np.allclose(got, np.quantile(pool, fv.LEVELS_23))
    assert all(v is None for v in one(spark, pool_quantiles(F.array().cast("array<double>"), [0.5]))[0])


def test_published_rounding(spark):
    xs = [1.275, 0.125, 2.675, 1.005, -1.275, 12.345678, 0.0]
    df = spark.createDataFrame([(x,) for x in xs], "x double").select("x", rounded("x", 2).alias("r"))
    assert {r.x: r.r for r in df.collect()} == {x: round(x, 2) for x in xs}


def test_rounded_works_on_the_exact_binary_value(spark):
    import random

    from seriloom.functions.cells import rounded

    random.seed(5)
    values = [2.675, 1.275, 0.125, 0.375, -2.675, -0.125, 1e17, 0.0, 1.005, 2.5, 3.5, 1e-9]
    values += [random.randint(-10**6, 10**6) / 1000 + 0.0005 for _ in range(500)] + [random.gauss(0, 100) for _ in range(500)]
    rows = spark.createDataFrame([(v,) for v in values], "v double")
    for places in (0, 1, 2, 3, 4):
        got = [r.x for r in rows.select("v", rounded("v", places).alias("x")).collect()]
        assert got == [round(v, places) + 0.0 for v in values]
    assert rows.select(rounded(F.lit(None).cast("double"), 2).alias("x")).first().x is None
