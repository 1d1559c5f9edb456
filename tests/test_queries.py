"""Every query beside its SQL on the smallest test tables."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))
import __spark_entry__ as entry  # noqa: E402
from compare import bag  # noqa: E402

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
NULLABLE = {"decompose_translate_stub"}  # its reason is null for rows kept
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for f in os.listdir(SF):
        if f.endswith(".parquet"):
            c.execute(f"create view {f[:-8]} as select * from '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query(spark, con, name):
    df = entry.queries()[name](spark, SF)
    rows = df.collect()
    sql = entry.oracle_sql().get(name)
    assert rows and all(v is not None for v in next(zip(*rows, strict=True))) or sql is not None or name in NULLABLE, "a query without SQL has rows, each with a key"
    if sql is None:
        return
    cursor = con.execute(sql)
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert bag(df.columns, rows) == bag(columns, cursor.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
