"""Every registered query runs on the small tables and equals its SQL."""

import duckdb
import pytest

from plumbago.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def plain(v):
        if isinstance(v, float):
            return f"{v:.9g}"
        if isinstance(v, (list, tuple)):
            return str([plain(x) for x in v])
        return str(v)

    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_equals_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    rows = df.collect()
    if name not in registry.ORACLE_SQL:
        return
    want = duck.sql(registry.ORACLE_SQL[name])
    assert sorted(want.columns) == sorted(df.columns)
    assert canonical(rows, df.columns) == canonical(want.fetchall(), want.columns)
