import os
import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
os.environ.setdefault("PYTHONPATH", str(ROOT))


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .appName("seriloom-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def weekly_of(spark):
    """weekly(series_id, week, idx, value) from plain lists."""
    from datetime import date, timedelta

    def make(**series):
        first = date(2000, 1, 2)  # a Sunday
        rows = [
            (name, first + timedelta(days=7 * i), i, None if v is None else float(v))
            for name, values in series.items()
            for i, v in enumerate(values)
        ]
        return spark.createDataFrame(rows, "series_id string, week date, idx int, value double")

    return make
