"""Every registered query against its SQL, on the smallest tables."""

import duckdb
import pytest

from filelake.plans.registry import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    got = QUERIES[name](spark, SF).toPandas()
    if name in ORACLE_SQL:
        want = con.sql(ORACLE_SQL[name]).df()
        cols = sorted(got.columns)
        assert cols == sorted(want.columns)
        tidy = lambda df: sorted(map(tuple, df[cols].astype(str).values.tolist()))
        assert tidy(got) == tidy(want)
