import glob
import os
import tempfile

import pytest
from pyspark.sql import SparkSession

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    folder = tempfile.mkdtemp(prefix="spark-")
    session = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.local.dir", folder)
        .config("spark.sql.warehouse.dir", f"{folder}/warehouse").config("spark.checkpoint.dir", f"file://{folder}/shared").config("spark.driver.memory", "4g").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return DATA


@pytest.fixture(scope="session")
def duck(sf_dir):
    import duckdb

    c = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


def plain(v):
    """Values that can be compared across engines."""
    if isinstance(v, float):
        return round(v, 9) + 0.0
    return [plain(x) for x in v] if isinstance(v, list | tuple) else v


@pytest.fixture(scope="session")
def same_rows(spark, sf_dir, duck):
    """Asserts that a query gives the rows of its SQL."""

    def check(query, sql):
        df = query(spark, sf_dir)
        got = df.collect()
        cursor = duck.execute(sql)
        names = [d[0] for d in cursor.description]
        want = cursor.fetchall()
        columns = sorted(df.columns)
        assert sorted(names) == columns
        at = [names.index(c) for c in columns]
        a = sorted(str([plain(r[c]) for c in columns]) for r in got)
        b = sorted(str([plain(r[i]) for i in at]) for r in want)
        assert len(a) == len(b)
        assert a == b

    return check
