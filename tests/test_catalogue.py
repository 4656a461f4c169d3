"""Every query with SQL is compared with it on the smallest tables."""

import duckdb
import pytest

from semloom import catalogue

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, duck, name):
    df = catalogue.queries()[name](spark, D)
    rows = df.collect()
    if name in catalogue.oracle_sql():
        want = duck.execute(catalogue.oracle_sql()[name])
        names = [c[0] for c in want.description]
        assert sorted(names) == sorted(df.columns)
        order = sorted(names)
        key = lambda r: tuple(map(str, r))
        assert sorted((tuple(r[c] for c in order) for r in rows), key=key) == sorted((tuple(r[names.index(c)] for c in order) for r in want.fetchall()), key=key)
    else:
        assert rows
