"""Parts and parents on the map, by hand."""

from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from seriloom.operators import hierarchy as hy
from seriloom.operators import views as vw
from seriloom.plans.refresh import publish

MONDAY = date(2024, 6, 3)
POINTS = "series_id string, date date, " + ", ".join(f"{f} double" for f in vw.FIELDS)


def as_of():
    return F.lit(MONDAY + timedelta(days=2))


@pytest.fixture(scope="module")
def nodes(spark):
    names = spark.createDataFrame([("e", "England_x"), ("s", "scotland"), ("f", "France"), ("u", "nowhere")], "series_id string, name string")
    mapping = spark.createDataFrame([("england x", "ENG"), ("scotland", "SCT"), ("france", "FR")], "name string, code string")
    parents = spark.createDataFrame([("ENG", "GB", "United Kingdom"), ("SCT", "GB", "United Kingdom"), ("NIR", "GB", "United Kingdom")], "part_code string, parent_code string, parent_name string")
    return names, mapping, parents


def weeks(name, n, value, data_type=0, last=MONDAY - timedelta(days=7)):
    return [(name, last - timedelta(days=7 * i), float(value + i % 3), data_type) for i in range(n)]


def points_of(rows, ahead):
    out = [(s, d, v, *[None] * 5) for s, d, v, _ in rows]
    for s, level in ahead:
        out += [(s, MONDAY + timedelta(days=7 * i), None, level + i, level, level + 2.0, level, level) for i in range(8)]
    return out


def test_members(spark, nodes):
    got = {(r.series_id, r.code, r.name, r.parent) for r in hy.members(*nodes).collect()}
    assert got == {("e", "GB", "United Kingdom", None), ("s", "GB", "United Kingdom", None), ("f", "FR", "France", None)}
    shown = {(r.series_id, r.code, r.parent) for r in hy.members(*nodes, show_parts=True).collect()}
    assert shown == {("e", "GB", None), ("s", "GB", None), ("f", "FR", None), ("e", "ENG", "GB"), ("s", "SCT", "GB")}


def build(spark, nodes, rows, ahead, show_parts=True):
    series = spark.createDataFrame(rows, "series_id string, obs_date date, cases double, data_type int")
    points = spark.createDataFrame(points_of(rows, ahead), POINTS)
    return hy.published(points, hy.series_facts(series), hy.members(*nodes, show_parts=show_parts), as_of())


def test_parent_is_the_sum_of_its_parts(spark, nodes):
    rows = weeks("e", 30, 10) + weeks("s", 30, 5) + weeks("f", 30, 1)
    scores = build(spark, nodes, rows, [("e", 20.0), ("s", 7.0), ("f", 1.0)])
    got = {r.code: r for r in hy.status_map(scores).collect()}
    assert set(got) == {"GB", "ENG", "SCT", "FR"}
    gb = got["GB"]
    assert (gb.value, gb.source, gb.status, gb.parent) == (27.0, "forecast", "high", None)
    assert [w.value for w in gb.forecast_weeks] == [29.0, 31.0, 33.0, 35.0]
    assert got["ENG"].parent == "GB" and got["ENG"].value == 20.0
    listing = hy.country_list(scores, hy.members(*nodes, show_parts=True), spark.createDataFrame([("s",)], "series_id string"))
    assert [(r.code, r.excluded) for r in listing.collect()] == [("ENG", False), ("FR", False), ("SCT", True), ("GB", True)]
    assert tuple(hy.list_totals(listing).first()) == (4, 4, 2)


def test_baseline_keeps_to_weeks_where_parts_agree(spark, nodes):
    new = weeks("e", 20, 10, 1) + weeks("s", 20, 10, 1)
    old = weeks("e", 20, 500, 0, MONDAY - timedelta(days=147)) + weeks("s", 20, 500, 0, MONDAY - timedelta(days=147))
    gb = build(spark, nodes, new + old, [("e", 11.0), ("s", 11.0)], False).filter("code = 'GB'").first()
    assert gb.current_type == 1 and gb.data_type == "ARI" and abs(gb.zscore) < 3
    change = (MONDAY - timedelta(days=7 * 20)).isoformat()
    assert gb.changes == f"{change}>ILI>ARI"
    mixed = build(spark, nodes, new + old[:20] + weeks("s", 20, 500, 1, MONDAY - timedelta(days=147)), [("e", 11.0), ("s", 11.0)], False)
    row = mixed.filter("code = 'GB'").first()
    assert row.changes == ""  # one part switched, the other did not


def test_freshest_part_dates_the_parent(spark, nodes):
    rows = weeks("e", 30, 10) + weeks("s", 30, 5, last=MONDAY - timedelta(days=200)) + weeks("f", 30, 5, last=MONDAY - timedelta(days=200))
    got = {r.code: r for r in hy.status_map(build(spark, nodes, rows, [("e", 20.0), ("s", 7.0), ("f", 7.0)])).collect()}
    assert not got["GB"].stale and got["GB"].value == 20.0  # the stale part's forecast does not count
    assert got["SCT"].status == "stale" and got["SCT"].value is None and got["SCT"].forecast_weeks == []
    assert got["FR"].stale


def test_refresh_publishes_places(spark, nodes):
    rows = [("e", MONDAY - timedelta(days=7 * i), float(20 + i % 7), 0.0) for i in range(1, 80)]
    rows += [("s", MONDAY - timedelta(days=7 * i), float(9 + i % 5), 0.0) for i in range(1, 80)]
    obs = spark.createDataFrame(rows, "series_id string, obs_date date, ili double, ari double")
    out = publish(obs, as_of(), nodes=hy.members(*nodes))
    status = out.status.collect()
    assert [(r.code, r.name, r.stale) for r in status] == [("GB", "United Kingdom", False)]
    assert out.points.filter("historical IS NOT NULL").count() == 79
    detail = out.details.first()
    assert detail.code == "GB" and len(detail.points) == 87 and detail.data_type_changes == []
    assert [r.on_map for r in out.listing.collect()] == [True]
