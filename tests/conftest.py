import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
DATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    from lodestem.sources.staging import ship_package

    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    ship_package(s)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    """DuckDB with the tables of the smallest data as views."""
    import duckdb

    c = duckdb.connect()
    for f in os.listdir(f"{DATA}/sf0.001"):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/sf0.001/{f}'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if v != v else round(v, 5) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


def same_rows(df, cursor):
    """Whether a DataFrame and a DuckDB result hold the same bag of rows under the same column names."""
    names = [x[0] for x in cursor.description]
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    got = sorted(repr(plain(tuple(r))) for r in df.select(*order).collect())
    want = sorted(repr(plain(tuple(r[names.index(c)] for c in order))) for r in cursor.fetchall())
    return got == want
