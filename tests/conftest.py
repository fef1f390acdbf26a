import os
import sys
import tempfile

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "6g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="barloom-"))
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


def wave(n: int, symbol: str = "A"):
    """close = 100 + 0.1 i + sin(i), high/low two around it."""
    import datetime as dt
    import math

    start = dt.date(2020, 1, 1)
    rows = []
    for i in range(n):
        c = 100 + 0.1 * i + math.sin(i)
        rows.append((symbol, start + dt.timedelta(days=i), c, c + 2, c - 2, c, 100000.0))
    return rows


BAR_SCHEMA = "symbol string, date date, open double, high double, low double, close double, volume double"
