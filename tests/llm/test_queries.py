"""The registered queries of this package, against their SQL where there is any."""

import duckdb
import pytest

from tributary.llm import oracle, queries


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, small, name):
    df = queries.QUERIES[name](spark, small)
    if name not in oracle.ORACLE:
        assert df.count() > 0
        return
    sql = oracle.ORACLE[name]
    for table in ("test_newest_by_group", "documents", "eval_items"):
        sql = sql.replace(f"from {table}", f"from '{small}/{table}.parquet'")
    found = duckdb.sql(sql)
    assert sorted(found.columns) == sorted(df.columns)
    assert sorted(map(tuple, df.select(*found.columns).collect())) == sorted(map(tuple, found.fetchall()))
