from datetime import date

import pytest

from seriloom.functions import fixed_values as fv
from seriloom.functions.storage import cut_lineage, shared_folder
from seriloom.sources import feed as fd
from seriloom.sources import series_files as sf

HEAD = ",".join(fv.FEED_COLUMNS)


def write(path, *lines):
    path.write_text("\n".join(lines) + "\n")
    return str(path)


def feed_of(spark, rows):
    return spark.createDataFrame(rows, ", ".join(f"{c} string" for c in fv.FEED_COLUMNS))


def test_read_feed_comments_and_missing_columns(spark, tmp_path):
    good = write(tmp_path / "a.csv", "# pulled today", HEAD, "AA,Aland,2024-01-01,ALL,5,x", "# middle", 'BB,"B, land",2024-01-08,all,,7')
    rows = fd.read_feed(spark, good).collect()
    assert [tuple(r) for r in rows] == [("AA", "Aland", "2024-01-01", "ALL", "5", "x"), ("BB", "B, land", "2024-01-08", "all", None, "7")]
    bad = write(tmp_path / "b.csv", "COUNTRY_CODE,ILI_CASE", "AA,1")
    with pytest.raises(ValueError, match="ARI_CASE"):
        fd.read_feed(spark, bad)


def test_long_lines_are_bad_and_short_ones_are_padded(spark, tmp_path):
    path = write(
        tmp_path / "f.csv",
        HEAD,
        "AA,Aland,2024-01-01,ALL,5,6",
        "AA,Aland,2024-01-08,ALL",  # short
        "AA,Aland,2024-01-15,ALL,5,6,7,8",  # long
        'BB,"B, land",2024-01-01,ALL,1,2',  # a quoted comma is not a separator
    )
    good, bad = fd.split_malformed(spark, path)
    rows = {(r.COUNTRY_AREA_TERRITORY, r.ISO_WEEKSTARTDATE): (r.ILI_CASE, r.ARI_CASE) for r in good.collect()}
    assert rows == {("Aland", "2024-01-01"): ("5", "6"), ("Aland", "2024-01-08"): (None, None), ("B, land", "2024-01-01"): ("1", "2")}
    assert [r.line for r in bad.collect()] == ["AA,Aland,2024-01-15,ALL,5,6,7,8"]
    report = fd.malformed_report(good, bad).first()
    assert (report.n_lines, report.n_bad, report.bad_share, report.accepted) == (4, 1, 0.25, False)
    assert fd.malformed_report(good, bad, limit=0.25).first().accepted


def test_profile_and_all_ages(spark):
    f = feed_of(spark, [("AA", "Aland", "7", "all", "1", None), ("AA", "Aland", "2024-01-01", "0-4", "n/a", "2"), ("BB", "Bland", "2023-12-25", "All", "3", "0")])
    p = fd.feed_profile(f, min_rows=3).first()
    assert (p.n_rows, p.n_entities, p.latest_week, p.accepted) == (3, 2, date(2024, 1, 1), True)
    assert not fd.feed_profile(f).first().accepted
    assert fd.feed_profile(f.drop("ARI_CASE"), min_rows=1).first().n_missing_columns == 1
    assert fd.all_ages(f).count() == 2
    s = {r.country: (r.total_ili_cases, r.total_ari_cases, r.data_types) for r in fd.summary_by_entity(f).collect()}
    assert s == {"Aland": (1.0, 2.0, "ILI, ARI"), "Bland": (3.0, 0.0, "ILI")}
    assert fd.summary_by_entity(f, only_all_ages=True).filter("country = 'Aland'").first().data_types == "ILI"
    assert fd.to_observations(f).count() == 1  # the row dated "7" has no date


def test_guard_verdicts(spark):
    day = lambda d, n: feed_of(spark, [("AA", "A", d, "ALL", str(i), "1") for i in range(n)])
    base = day("2024-01-08", 10)
    assert fd.refresh_guard(base, base.repartition(3)).first().verdict == "unchanged"
    assert fd.refresh_guard(day("2024-01-15", 5), base).first().verdict == "ok"
    assert fd.refresh_guard(day("2024-01-15", 4), base).first().verdict == "shrunk"
    assert fd.refresh_guard(day("2024-01-01", 10), base).first().verdict == "older"
    assert fd.refresh_guard(day("junk", 10), base).first().verdict == "no_dates"
    assert fd.refresh_guard(base, None).first().verdict == "first_pull"
    changed = feed_of(spark, [("AA", "A", "2024-01-08", "ALL", str(i), "2") for i in range(10)])
    assert fd.refresh_guard(changed, base).first().verdict == "ok"


def test_series_round_trip(spark, tmp_path):
    rows = [("Côte d'Ivoire", date(2024, 1, 1), 1.5, 0), ("A/B", date(2024, 1, 8), None, 1)]
    df = spark.createDataFrame(rows, "series_id string, obs_date date, cases double, data_type int")
    sf.write_series(df, str(tmp_path / "s"))
    assert sorted(map(tuple, sf.read_series(spark, str(tmp_path / "s")).collect())) == sorted(rows)


def test_legacy_series_and_vintages(spark, tmp_path):
    (tmp_path / "ari" / "series_id=A").mkdir(parents=True)
    write(tmp_path / "ari" / "series_id=A" / "x.csv", "Time,ARI_Cases", "2024-01-01,4")
    assert tuple(sf.read_legacy_series(spark, str(tmp_path / "ari"), "ARI").first()) == ("A", date(2024, 1, 1), 4.0, 1)
    for v, x in (("2024_01", 1.0), ("2024_02", 2.0)):
        (tmp_path / "t" / f"vintage={v}").mkdir(parents=True)
        write(tmp_path / "t" / f"vintage={v}" / "x.csv", "anno,settimana,incidenza", f"2024,1,{x}")
    got = sorted(map(tuple, sf.read_vintages(spark, str(tmp_path / "t")).collect()))
    assert got == [("2024_01", 2024, 1, 1.0), ("2024_02", 2024, 1, 2.0)]


def test_rounds_with_different_columns(spark, tmp_path):
    for model, rnd, lines in (
        ("m1", "2024_01", ["luogo,tipo_valore,orizzonte,target,id_valore,valore", "IT,quantile,1,ILI,0.5,3.25"]),
        ("m2", "2024_01", ["luogo,valore,id_valore,tipo_valore,orizzonte", "IT,4.5,0.5,quantile,2"]),
    ):
        (tmp_path / f"model={model}" / f"round={rnd}").mkdir(parents=True)
        write(tmp_path / f"model={model}" / f"round={rnd}" / "x.csv", *lines)
    got = {r.model: (r["round"], r.orizzonte, r.target, r.id_valore, r.valore) for r in sf.read_rounds(spark, str(tmp_path)).collect()}
    assert got == {"m1": ("2024_01", 1, "ILI", 0.5, 3.25), "m2": ("2024_01", 2, None, 0.5, 4.5)}


def test_shared_folder_is_taken_from_the_session(spark):
    class Named:
        class conf:  # noqa: N801
            @staticmethod
            def get(key, default=None):
                return "hdfs://shared/ckpt" if key == "spark.checkpoint.dir" else default

    assert shared_folder(Named()) == "hdfs://shared/ckpt"

    class Unset:
        class conf:  # noqa: N801
            @staticmethod
            def get(key, default=None):
                return default

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"
            getCheckpointDir = staticmethod(lambda: None)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(Unset())
    assert shared_folder(spark) == shared_folder(spark)  # unset here: one folder of our own
    kept = cut_lineage(spark.range(3))
    assert kept.count() == 3 and kept.inputFiles()[0].removeprefix("file://").startswith(shared_folder(spark))


def test_rounds_by_header(spark, tmp_path):
    for model, rnd, lines in (
        ("m 1", "2024_01", ["luogo,tipo_valore,orizzonte,target,id_valore,valore", 'IT,"quantile",1,"ILI, all",0.5,"3.25"', "IT,quantile,2,,0.5,4"]),
        ("m2", "2024_01", ['"valore","note","id_valore","luogo","tipo_valore","orizzonte"', '4.5,"a, ""b""",0.5,IT,quantile,2', ""]),
        ("m2", "2024_02", ["luogo,tipo_valore,orizzonte,id_valore,valore", "IT,quantile,3,0.5,x"]),
        ("m3", "2024_01", ["no header here,1,2"]),
    ):
        (tmp_path / f"model={model}" / f"round={rnd}").mkdir(parents=True)
        write(tmp_path / f"model={model}" / f"round={rnd}" / "x.csv", *lines)
    rows = sf.read_rounds(spark, str(tmp_path))
    got = sorted((r.model, r["round"], r.orizzonte, r.target, r.id_valore, r.valore) for r in rows.collect())
    assert got == [
        ("m 1", "2024_01", 1, "ILI, all", 0.5, 3.25),
        ("m 1", "2024_01", 2, "", 0.5, 4.0),
        ("m2", "2024_01", 2, None, 0.5, 4.5),
        ("m2", "2024_02", 3, None, 0.5, None),
    ]
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()
    (tmp_path / "none" / "model=a" / "round=b").mkdir(parents=True)
    write(tmp_path / "none" / "model=a" / "round=b" / "x.csv", "nothing")
    assert sf.read_rounds(spark, str(tmp_path / "none")).count() == 0


def test_records_with_line_breaks(spark, tmp_path):
    path = write(
        tmp_path / "f.csv",
        "# pulled today",
        HEAD,
        'AA,"Aland\nand isles",2024-01-01,ALL,5,6',
        'AA,"Aland\nand, isles",2024-01-08,ALL,5,6,7',
        "AA,Aland,2024-01-15",
        "alone",
    )
    good, bad = fd.split_malformed(spark, path)
    rows = [(r.COUNTRY_CODE, r.COUNTRY_AREA_TERRITORY, r.ARI_CASE) for r in good.collect()]
    assert sorted(rows, key=str) == sorted([("AA", "Aland\nand isles", "6"), ("AA", "Aland", None), ("alone", None, None)], key=str)
    assert [r.line for r in bad.collect()] == ['AA,"Aland\nand, isles",2024-01-08,ALL,5,6,7']
    plain = write(tmp_path / "g.csv", HEAD, "AA,Aland,2024-01-01,ALL,5,6", "AA,Aland,2024-01-08,ALL,5,6,7")
    good, bad = fd.split_malformed(spark, plain, multiline=False)
    assert (good.count(), bad.count()) == (1, 1)


def test_series_in_buckets(spark, tmp_path):
    rows = [(f" name, {i}", date(2024, 1, 1), float(i), 0) for i in range(500)] + [(None, date(2024, 1, 1), 1.0, 1)]
    df = spark.createDataFrame(rows, "series_id string, obs_date date, cases double, data_type int")
    sf.write_series(df, str(tmp_path / "s"), buckets=8)
    assert len(list((tmp_path / "s").glob("bucket=*"))) <= 8
    back = sf.read_series(spark, str(tmp_path / "s"), buckets=8)
    assert sorted(map(tuple, back.collect()), key=str) == sorted(rows, key=str)
    wanted = spark.createDataFrame([(" name, 7",), (" name, 7",), ("unknown",)], "series_id string")
    some = sf.read_series(spark, str(tmp_path / "s"), wanted, buckets=8)
    assert [tuple(r) for r in some.collect()] == [rows[7]]


def test_finished_versions(spark, tmp_path):
    from seriloom.streaming.landing import _last_version

    store = str(tmp_path / "store")
    assert _last_version(spark, store, 5) is None
    for n in (1, 3, 5):
        spark.range(n).write.parquet(f"{store}/pull={n:09d}")
    (tmp_path / "store" / "pull=000000003" / "_SUCCESS").unlink()  # an attempt that was lost half-way
    assert _last_version(spark, store, 5).count() == 1  # the retried batch 5 does not see itself
    assert _last_version(spark, store, 6).count() == 5
