"""Every registered query against its SQL counterpart on the smallest test tables."""
import duckdb
import pytest

import __spark_entry__ as entry
from noticeboard.catalog.queries import QUERIES
from check_queries import TABLES, compare

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    verdict = compare(spark, con, SF, name, entry.queries()[name], entry.oracle_sql().get(name))
    assert verdict.startswith("ok") and "types" not in verdict, verdict


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["query_id", "id", "date", "score", "rank", "position"] and df.count() > 0
