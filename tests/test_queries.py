"""Every query with SQL gives the same rows as the SQL does, on the smallest tables."""

import math
import os

import duckdb
import pytest

from adspark import queries, queries_learned, queries_ranking, queries_temporal  # noqa: F401

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def values(frame):
    def plain(v):
        if v is None or (isinstance(v, float) and math.isnan(v)) or str(v) == "NaT":
            return "-"
        return f"{v:.9g}" if isinstance(v, float) else str(v)

    return sorted(tuple(plain(v) for v in r) for r in frame[sorted(frame.columns)].itertuples(index=False))


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, sql, name):
    found = queries.QUERIES[name](spark, DATA).toPandas()
    if name not in queries.ORACLES:
        assert len(found) > 0
        return
    want = sql.execute(queries.ORACLES[name]).fetchdf()
    assert sorted(found.columns) == sorted(want.columns)
    assert values(found) == values(want)


def test_entry_module():
    import __spark_entry__

    assert queries.FLAGSHIP in __spark_entry__.queries() and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
