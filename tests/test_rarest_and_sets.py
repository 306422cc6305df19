"""Entity search by rarest tokens, and the pairwise comparison by key sets, against plain versions."""

import math
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from seriloom.operators import compare as cm
from seriloom.operators import entities as en


def test_a_first_word_of_a_hundred_thousand_names(spark):
    names = spark.range(100_000).select(
        F.concat(F.lit("C"), F.col("id").cast("string")).alias("code"), F.concat(F.lit("Republic of place"), F.col("id").cast("string")).alias("name"), F.col("id").alias("first_seen")
    )
    queries = spark.createDataFrame([("Republic of place77",), ("of place5",), ("lace99999",), ("Republic nowhere",), ("republic",)], "query string")
    got = {r.query: (r.name, r.rule) for r in en.resolve_entity(queries, names).collect()}
    assert got == {
        "Republic of place77": ("Republic of place77", 2),
        "of place5": ("Republic of place5", 3),
        "lace99999": ("Republic of place99999", 4),
        "Republic nowhere": (None, None),
        "republic": ("Republic of place0", 3),
    }
    found = en._by_rarest(queries.filter("query = 'of place5'"), en._words(F.col("query")), names.withColumn("key", F.explode(en._words(F.col("name")))))
    assert found.count() == 1  # the frequent word is not looked up


def test_search_equals_trying_every_name(spark):
    rng = random.Random(5)
    words = ["alpha", "beta", "gam", "delta", "Eps", "zeta-one", "San", "Sant"]
    names = sorted({" ".join(rng.choices(words, k=rng.randint(1, 3))) for _ in range(80)})
    rows = [(f"K{i}", n, i) for i, n in enumerate(names)]
    asked = sorted({q for n in names for q in (n[1:], n[:-1], n.upper(), n.split()[-1], n[2:7])} | {"K3", "k4", "no such", "(alpha", "a"})

    def plain(q):
        best = []
        for code, n, i in rows:
            if code == q.upper():
                best.append((1, i, n))
            if n.lower() == q.lower():
                best.append((2, i, n))
            if re.search(rf"\b{re.escape(q)}\b", n, re.I):
                best.append((3, i, n))
            if len(q) >= 3 and q.lower() in n.lower():
                best.append((4, i, n))
        return (min(best)[2], min(best)[0]) if best else (None, None)

    ents = spark.createDataFrame(rows, "code string, name string, first_seen long")
    got = {r.query: (r.name, r.rule) for r in en.resolve_entity(spark.createDataFrame([(q,) for q in asked], "query string"), ents).collect()}
    assert got == {q: plain(q) for q in asked}


def scores(seed, models, occasions):
    rng = random.Random(seed)
    rows = []
    for k, m in enumerate(models):
        for r in range(occasions):
            for h in (1, 2):
                if (r + k // 2) % 3 and not (k == 4 and r > 2):
                    rows.append((f"20{20 + r // 8}_{r % 8:02d}", h, m, 0.0 if (k, r) == (1, 1) else rng.random() + 0.1, rng.randint(0, 1), rng.randint(0, 1)))
    return rows


def plain_theta(rows, least=4):
    wis = defaultdict(dict)
    for r, h, m, w, *_ in rows:
        wis[m][r, h] = w
    out = {}
    for m in wis:
        logs = []
        for o in wis:
            common = wis[m].keys() & wis[o].keys()
            if o != m and len(common) >= least and sum(wis[o][k] for k in common) > 0:
                logs.append(math.log(sum(wis[m][k] for k in common) / sum(wis[o][k] for k in common)))
        if logs:
            out[m] = math.exp(sum(logs) / len(logs)), len(logs)
    return out


SCHEMA = "round string, h int, model string, wis double, cov50 int, cov90 int"


@pytest.mark.parametrize("seed", [1, 2])
def test_pairwise_equals_opened_pairs(spark, seed):
    rows = scores(seed, [f"m{i}" for i in range(9)], 24)
    got = {r.model: r for r in cm.pairwise_rwis(spark.createDataFrame(rows, SCHEMA), "m0").collect()}
    want = plain_theta(rows)
    assert set(got) == set(want)
    for m, (theta, n) in want.items():
        assert math.isclose(got[m].theta, theta, rel_tol=1e-9) and got[m].n_models == n
        assert math.isclose(got[m].pairwise_rwis, theta / want["m0"][0], rel_tol=1e-9)
        own = [r for r in rows if r[2] == m]
        assert math.isclose(got[m].coverage_50, sum(r[4] for r in own) / len(own), abs_tol=1e-12)
        assert math.isclose(got[m].coverage_90, sum(r[5] for r in own) / len(own), abs_tol=1e-12)


def test_pairwise_by_season(spark):
    rows = scores(3, [f"m{i}" for i in range(6)], 24)
    frame = spark.createDataFrame(rows, SCHEMA).withColumn("season", F.substring("round", 1, 4))
    got = {(r.season, r.model): r.theta for r in cm.pairwise_rwis(frame, "m0", by=["season"]).collect()}
    want = {(y, m): t for y in ("2020", "2021", "2022") for m, (t, _) in plain_theta([r for r in rows if r[0][:4] == y]).items()}
    assert set(got) == set(want) and all(math.isclose(got[k], want[k], rel_tol=1e-9) for k in want)


def test_models_with_the_same_keys_share_a_bitmap(spark):
    rows = [(f"2020_{r:02d}", 1, m, 1.0, 0, 0) for m in ("a", "b", "c") for r in range(12) if m != "c" or r > 3]
    models, sets = cm.key_sets(spark.createDataFrame(rows, SCHEMA))
    keys = {r.model: r["keys"] for r in models.collect()}
    assert keys["a"] == keys["b"] != keys["c"] and sets.count() == 12 + 8


def test_no_pair_of_models_in_the_plan(spark):
    rows = [(f"2020_{r:02d}", 1, f"m{m}", 1.0 + m, 0, 0) for m in range(60) for r in range(8)]
    frame = cm.pairwise_rwis(spark.createDataFrame(rows, SCHEMA), "m0")
    assert frame.count() == 60
    models, sets = cm.key_sets(spark.createDataFrame(rows, SCHEMA))
    on = sets.join(spark.createDataFrame(rows, SCHEMA), ["round", "h"])
    assert on.count() == len(rows)  # models x one set, not models x models
