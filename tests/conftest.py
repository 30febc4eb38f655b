import os
import sys

import duckdb
import pytest
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, os.environ.get("PYTHONPATH", "")]))
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF}/{name}')")
    return con


@pytest.fixture(scope="session")
def same_rows(spark, duck):
    """Compare a Spark frame with DuckDB SQL as multisets of rows."""

    def plain(value):
        value = value.item() if hasattr(value, "item") else value
        return "nan" if value != value else round(value, 9) if isinstance(value, float) else value

    def check(df, sql):
        result = duck.execute(sql)
        names = [d[0] for d in result.description]
        assert sorted(df.columns) == sorted(names)
        got = sorted((tuple(plain(r[n]) for n in names) for r in df.collect()), key=repr)
        assert got == sorted((tuple(map(plain, r)) for r in result.fetchall()), key=repr)

    return check
