"""Archives and source mixing."""

import base64
import gzip
import hashlib
import math
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from seriloom.functions.storage import fresh_path
from seriloom.llm import catalog, mixing, warc
from tests.llm.conftest import SF
from tools.check import TABLES, rows_of


def test_equal_rows_and_nameless_pages_keep_their_rows(spark):
    rows = [(1, "http://a", "same"), (1, "http://a", "same"), (None, "http://b", "other"), (None, "http://c", "other"), (0, "http://d", "same")]
    path = fresh_path(spark, "warc-rows")
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"), path)
    records = warc.read_archives(spark, path)
    got = warc.pages_of(warc.captures(records)).collect()
    assert sorted((str(r.page_id), r.record_type, str(r.refers_to)) for r in got) == [
        ("0", "revisit", "1"), ("1", "response", "None"), ("1", "response", "None"), ("None", "response", "None"), ("None", "response", "None"),
    ]
    ids = {r.record_id for r in records.collect()}
    assert all(r.refers_to in ids for r in records.filter("refers_to IS NOT NULL").collect())


def test_large_pages_get_archives_of_their_own(spark):
    rows = spark.range(5).select(F.col("id").alias("page_id"), F.lit("http://x").alias("url"), F.repeat(F.concat(F.lit("page "), F.col("id").cast("string")), F.when(F.col("id") < 3, 8_500_000).otherwise(3)).alias("html"))
    path = fresh_path(spark, "warc-large")
    warc.write_archives(rows, path)
    got = {r.page_id: r.payload_bytes for r in warc.pages_of(warc.captures(warc.read_archives(spark, path, with_payload=False))).collect()}
    assert got == {0: 51_000_000, 1: 51_000_000, 2: 51_000_000, 3: 18, 4: 18}
    assert spark.read.format("binaryFile").load(path).select("path").count() >= 4


@pytest.mark.parametrize("name", ["op9_warc", "op10_mixing"])
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = catalog.QUERIES[name](spark, SF).toArrow(), con.sql(catalog.SQL[name]).to_arrow_table()
    assert rows_of(got) == rows_of(want)
    assert {f.name: str(f.type) for f in got.schema} == {f.name: str(f.type) for f in want.schema}


PAGES = [
    (1, "http://a.example/x?q=1#f", "<p>same</p>"),
    (2, "http://b.example", "<p>same</p>"),
    (9, "http://c.example/ü x\r\nWARC-Type: evil", "<p>same</p>"),
    (3, None, None),
    (4, "nonsense", ""),
    (5, "http://d.example/", "line\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\nüñ🙂"),
    (6, "http://e.example/", "y" * 300_000),
    (None, "http://f.example/", "alone"),
    (7, "http://g.example/", "twice"),
    (7, "http://g.example/", "twice"),
]


def test_round_trip(spark):
    pages = spark.createDataFrame([(*p, "x", 1) for p in PAGES], "page_id long, url string, html string, payload string, digest int")
    path = fresh_path(spark, "warc-test")
    warc.write_archives(pages, path, records_per_archive=4)
    records = warc.read_archives(spark, path)
    assert records.count() == 3 * len(PAGES)
    whole = {r.capture: r for r in warc.captures(records).collect()}
    assert len(whole) == len(PAGES)  # a repeated row is a capture of its own
    for r in whole.values():
        assert r.request.record_type == "request" and r.metadata.pageId is not None
        assert r.response.target_uri is None or not set(r.response.target_uri) & set("\r\n \t")
    rows = {r.page_id: r for r in warc.pages_of(warc.captures(records)).collect()}
    by_id = {i: (h or "").encode() for i, _, h in PAGES}
    for i, data in by_id.items():
        assert rows[i].payload_bytes == len(data)
        assert rows[i].payload_digest == base64.b32encode(hashlib.sha1(data).digest()).decode()
    assert {i: rows[i].refers_to for i in by_id} == {1: 9, 2: 9, 9: None, 3: 4, 4: None, 5: None, 6: None, None: None, 7: None}
    assert all((r.record_type == "revisit") == (r.refers_to is not None) for r in rows.values())
    payloads = {r.metadata.pageId: bytes(r.response.payload) for r in whole.values()}
    assert payloads["5"] == by_id[5] and payloads["1"] == b""
    files = [x.path for x in spark.read.format("binaryFile").load(path).select("path").collect()]
    assert len(files) >= len(PAGES) * 3 // 4


def test_small_payloads_are_all_responses(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    plan = warc.planned(pages, least_bytes=6)
    assert {r.page_id: r.original for r in plan.collect()} == {1: 9, 2: 9, 9: None, 3: None, 4: None, 5: None, 6: None, None: None, 7: None}


def test_no_pages(spark):
    path = fresh_path(spark, "warc-none")
    warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.pages_of(warc.captures(warc.read_archives(spark, path))).collect() == []


def test_damaged_archives_are_errors():
    good = b"WARC/1.1\r\nWARC-Type: x\r\nContent-Length: 2\r\n\r\nab\r\n\r\n"
    assert [b for _, b in warc.walk(good * 2)] == [b"ab", b"ab"]
    for bad in (good[:-2], b"HTTP/1.1\r\n\r\n", good.replace(b": 2", b": 1")):
        with pytest.raises(ValueError):
            list(warc.walk(bad))
    assert gzip.decompress(gzip.compress(good)) == good


def skewed(spark):
    rows = [(i, "a" if i < 60 else "b" if i < 85 else f"s{i % 4}", " ".join(["w"] * (i % 17 + 1))) for i in range(120)]
    return spark.createDataFrame(rows, "doc_id long, source string, text string")


def test_entropy_and_repetition_targets(spark):
    docs = skewed(spark)
    totals = {r.source: r.n for r in docs.groupBy("source").agg(F.sum(mixing.tokens_of(F.col("text"))).alias("n")).collect()}
    sources = spark.createDataFrame(list(totals.items()), "source string, total long")
    whole = sum(totals.values())

    def weights(a):
        w = {s: (n / whole) ** a for s, n in totals.items()}
        return {s: x / sum(w.values()) for s, x in w.items()}

    a = mixing.exponent(sources, 0.9, 100.0, "whole")
    w = weights(a)
    assert math.isclose(-sum(x * math.log(x) for x in w.values()), 0.9 * math.log(len(w)), rel_tol=1e-6)
    a = mixing.exponent(sources, 1.0, 1.5, "whole")
    assert math.isclose(max(whole * x / totals[s] for s, x in weights(a).items()), 1.5, rel_tol=1e-6)

    served = mixing.schedule(docs, entropy=0.9, repetition=100.0, block_tokens=64).collect()
    given, streams = defaultdict(int), defaultdict(lambda: defaultdict(int))
    for r in served:
        given[r.source] += r.tokens
        streams[r.stream_block][r.source] += r.tokens
    for s, x in w.items():
        assert abs(given[s] - whole * x) <= 17 + 1
    # every epoch is a permutation: no document twice in one
    assert len({(r.doc_id, r.epoch) for r in served}) == len(served)
    starts = sorted((r.start, r.tokens) for r in served if r.source == "a")
    assert all(x + n == y for (x, n), (y, _) in zip(starts, starts[1:]))
    for part in list(streams.values())[:-1]:  # each block of the stream has the weights, up to a document
        assert all(abs(part[s] - 64 * x) <= 2 * 17 for s, x in w.items())


def test_cover_serves_every_document(spark):
    docs = skewed(spark)
    times = {r.doc_id: r.n for r in mixing.schedule(docs, entropy=None, repetition=2.0, budget="cover").groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert set(times) == set(range(120)) and set(times.values()) == {1, 2} and all(times[i] == 1 for i in range(60))


def test_odd_rows(spark, odd, odd_rows, none):
    rows = mixing.schedule(odd, entropy=None, repetition=1.0, budget="cover").collect()
    assert len(rows) == len(odd_rows)
    mixed = mixing.mixed_rows(odd, entropy=None, repetition=1.0, budget="cover")
    assert mixed.columns == odd.columns and sorted(map(repr, mixed.collect())) == sorted(map(repr, odd.collect()))
    assert mixing.schedule(none).collect() == [] and mixing.mixed_rows(none).collect() == []


def test_no_python_in_the_plan(spark):
    plan = mixing.schedule(skewed(spark))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))
