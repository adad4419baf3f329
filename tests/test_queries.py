import duckdb
import pytest

from loomspark.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.mark.parametrize("name", registry.QUERIES)
def test_query(spark, name):
    df = registry.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
    if name not in registry.SQL:
        assert got
        return
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    r = con.sql(registry.SQL[name])
    there = list(r.columns)
    assert sorted(there) == columns
    assert got == sorted((tuple(x[there.index(c)] for c in columns) for x in r.fetchall()), key=repr)


def test_entry_and_names():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
