import duckdb
import pytest

import __spark_entry__ as entry
from credtrace.plans.queries import Q as CORE
from tools.check_oracle import TABLES, compare

SF = "/root/testdata/sf0.001"


def test_every_query_has_sql():
    assert set(CORE) <= set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(CORE))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    answer = compare(spark, con, name, entry.queries()[name], entry.oracle_sql()[name], SF)
    assert answer.startswith(("OK", "EMPTY")), answer
