import os
import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.driver.memory", "6g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def data():
    return DATA


def norm(rows):
    """Rows as sorted texts, so that engines and orders compare."""

    def text(x):
        if isinstance(x, dict):
            return "{" + ",".join(text(v) for v in x.values()) + "}"
        if isinstance(x, (list, tuple)):
            return "[" + ",".join(map(text, x)) + "]"
        if isinstance(x, float):
            return "NULL" if x != x else f"{x:.6f}"
        if isinstance(x, int) and not isinstance(x, bool):
            return f"{x:.6f}"
        return "NULL" if x is None else str(x)

    return sorted("|".join(text(v) for v in r) for r in rows)


@pytest.fixture(scope="session")
def duck(data):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in sorted(Path(data).glob("*.parquet")):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def same_as_oracle(spark, duck, data, query, sql):
    got = query(spark, data)
    names = sorted(got.columns)
    rows = norm(tuple(r[c] for c in names) for r in got.collect())
    found = duck.sql(sql)
    order = [found.columns.index(c) for c in names]
    assert sorted(found.columns) == names
    assert rows == norm(tuple(r[i] for i in order) for r in found.fetchall())
