"""Every query with SQL gives DuckDB's rows on the small tables."""

import duckdb
import pytest

from stemforge.plans.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def canonical(frame):
    frame = frame[sorted(frame.columns)]
    show = lambda x: "NULL" if x is None or x != x else f"{x:.9g}" if isinstance(x, float) else str(x)
    return list(frame.columns), sorted(tuple(map(show, r)) for r in frame.itertuples(index=False))


@pytest.fixture(scope="module")
def tables():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, tables, name):
    got = QUERIES[name](spark, DATA).toPandas()
    if name in ORACLE_SQL:
        assert canonical(got) == canonical(tables.sql(ORACLE_SQL[name]).df())
