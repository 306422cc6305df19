"""Every registered query against its SQL on the smallest tables."""

import sys

import duckdb
import pytest

from seriloom.catalog import load
from tools.check import TABLES, rows_of

SF = "/root/testdata/sf0.001"
REG = load()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def test_every_query_has_sql():
    assert set(REG.QUERIES) == set(REG.SQL) and len(REG.QUERIES) == 118


@pytest.mark.parametrize("name", sorted(REG.QUERIES))
def test_query_matches_sql(spark, con, name):
    got = REG.QUERIES[name](spark, SF).toArrow()
    want = con.sql(REG.SQL[name]).to_arrow_table()
    cols, rows = rows_of(got)
    want_cols, want_rows = rows_of(want)
    assert cols == want_cols
    assert [str(got.schema.field(c).type) for c in cols] == [str(want.schema.field(c).type) for c in cols]
    assert len(rows) == len(want_rows)
    for a, b in zip(rows, want_rows):
        assert list(map(repr, a)) == list(map(repr, b))


def test_entry(spark):
    sys.path.insert(0, str(__file__).rsplit("/tests/", 1)[0])
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.columns == ["series_id", "value", "source", "zscore", "score", "status"]
    assert df.count() > 0
