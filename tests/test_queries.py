"""Every named query against its SQL, on the smallest tables."""

import os

import duckdb
import pytest
from meterlake import agent_oracle, oracle, rule_oracle
from meterlake.queries import QUERIES

ORACLE_SQL = oracle.ORACLE_SQL | agent_oracle.ORACLE_SQL | rule_oracle.ORACLE_SQL
pytestmark = pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="needs the test tables")
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


def plain(row):
    return tuple(round(x, 9) if isinstance(x, float) else x for x in row)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, sf_dir, con, name):
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    key = lambda row: tuple((x is not None, str(x)) for x in row)
    got = sorted((plain(r) for r in df.select(*columns).collect()), key=key)
    want = con.execute(f"select {', '.join(columns)} from ({ORACLE_SQL[name]}) x").fetchall()
    assert got == sorted(map(plain, want), key=key)


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert {"day", "provider_code", "model_code", "cost", "level"} <= set(df.columns)


def test_no_query_reads_all_columns(spark, sf_dir):
    """Only the needed columns of events reach the scan, and the day range reaches it too."""
    plan = QUERIES["since_until"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.splitlines() if "ReadSchema" in line)
    assert "props" not in scan.split("ReadSchema")[1] and "GreaterThanOrEqual(ts" in scan and "LessThan(ts" in scan
