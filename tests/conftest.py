import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parents[1])
if ROOT not in sys.path:
    sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, os.environ.get("PYTHONPATH", "")) if x)

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "6g")
        .config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for f in Path(DATA).glob("*.parquet"):
        con.sql(f"create view {f.stem} as from '{f}'")
    return con


@pytest.fixture(scope="session")
def same(spark, duck):
    """Compare a query with its SQL: columns and rows, in any order."""
    def check(make, sql):
        df = make(spark, DATA)
        names = sorted(df.columns)
        got = sorted(repr(tuple(r[c] for c in names)) for r in df.collect())
        rel = duck.sql(sql)
        assert names == sorted(rel.columns)
        at = [rel.columns.index(c) for c in names]
        assert got == sorted(repr(tuple(r[i] for i in at)) for r in rel.fetchall())
        return len(got)

    return check
