"""Queries against the SQL that they are registered with."""

import duckdb
import pytest

from tessella.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    cursor = c.execute(queries.oracle_sql()[name])
    names, wanted = [d[0] for d in cursor.description], cursor.fetchall()
    df = queries.queries()[name](spark, SF)
    assert sorted(df.columns) == sorted(names)
    assert sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr) == sorted(wanted, key=repr)
