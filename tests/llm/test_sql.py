import duckdb
import pytest

from loomspark.llm import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", registry.SQL)
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.sql(registry.SQL[name])
    columns = sorted(want.columns)
    got = registry.QUERIES[name](spark, SF)
    assert sorted(got.columns) == columns
    at = [want.columns.index(c) for c in columns]
    assert sorted(map(tuple, got.select(columns).collect()), key=repr) == sorted((tuple(r[k] for k in at) for r in want.fetchall()), key=repr)
