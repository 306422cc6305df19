"""Compare registered queries with their SQL in DuckDB.

usage: python tools/check.py [--sf DIR] [name or chapter prefix ...]
"""

from __future__ import annotations

import argparse
import importlib
import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb  # noqa: E402
from pyspark.sql import SparkSession  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def session() -> SparkSession:
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def rows_of(table):
    cols = sorted(table.column_names)
    data = [table.column(c).to_pylist() for c in cols]

    def key(v):
        if v is None:
            return (0, "")
        if isinstance(v, bool):
            return (1, str(v))
        if isinstance(v, (int, float)):
            return (2, repr(float(v)) if not math.isnan(v) else "nan")
        return (3, str(v))

    return cols, sorted(zip(*data), key=lambda r: [key(v) for v in r])


def main() -> int:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("--chapter")
    ap.add_argument("names", nargs="*")
    a = ap.parse_args()
    if a.chapter:
        importlib.import_module(f"seriloom.catalog.{a.chapter}")
        reg = importlib.import_module("seriloom.catalog.registry")
        mod = f"seriloom.catalog.{a.chapter}"
    else:
        from seriloom.catalog import load

        reg, mod = load(), None
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{a.sf}/{t}.parquet'")
    spark = session()
    bad = 0
    names = a.names or list(reg.QUERIES)
    for name in names:
        t0 = time.time()
        try:
            got = reg.QUERIES[name](spark, a.sf).toArrow()
        except Exception as e:  # report and go on with the next query
            bad += 1
            print(f"FAIL {name}: spark: {str(e)[:1500]}", flush=True)
            continue
        t1 = time.time()
        if name not in reg.SQL:
            print(f"rows {name}: {got.num_rows} rows, {t1 - t0:.1f}s, no SQL", flush=True)
            continue
        try:
            want = con.sql(reg.SQL[name]).to_arrow_table()
        except Exception as e:
            bad += 1
            print(f"FAIL {name}: sql: {str(e)[:1500]}", flush=True)
            continue
        t2 = time.time()
        ca, ra = rows_of(got)
        cb, rb = rows_of(want)
        ta = {c: str(got.schema.field(c).type) for c in ca}
        tb = {c: str(want.schema.field(c).type) for c in cb}
        note = ""
        if ca != cb:
            note = f"columns {ca} != {cb}"
        elif ta != tb:
            note = "types " + str({c: (ta[c], tb[c]) for c in ca if ta[c] != tb[c]})
        elif len(ra) != len(rb):
            note = f"rows {len(ra)} != {len(rb)}"
            miss = [r for r in ra if r not in set(rb)][:3] if len(ra) < 20000 else []
            extra = [r for r in rb if r not in set(ra)][:3] if len(rb) < 20000 else []
            note += f"\n   spark only {miss}\n   sql only   {extra}"
        else:
            diff = [(x, y) for x, y in zip(ra, rb) if list(map(repr, x)) != list(map(repr, y))]
            if diff:
                note = f"{len(diff)} of {len(ra)} rows differ {ca}\n   {diff[0][0]}\n   {diff[0][1]}"
        if note:
            bad += 1
            print(f"DIFF {name}: {note}", flush=True)
        else:
            print(f"ok   {name}: {len(ra)} rows, spark {t1 - t0:.1f}s, sql {t2 - t1:.1f}s", flush=True)
    print(f"{len(names)} queries, {bad} not matching")
    return bad


if __name__ == "__main__":
    sys.exit(min(main(), 1))
