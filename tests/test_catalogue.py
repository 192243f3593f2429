from pathlib import Path

import duckdb
import pytest

from textquarry.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="needs the test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    tidy = lambda x: None if x is None or x != x else round(float(x), 6) if isinstance(x, float) or type(x).__name__ == "Decimal" else x
    return sorted((tuple(str(tidy(v[i])) for i in order) for v in values))


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_same_as_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    got = duck.execute(catalogue.SQL[name])
    columns = [d[0] for d in got.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(columns, got.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_runs(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() > 0
