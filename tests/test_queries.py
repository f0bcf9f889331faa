"""Every registered query that has SQL, against DuckDB."""

import duckdb
import pytest

from gridloom.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(frame):
    frame = frame[sorted(frame.columns)]
    clean = lambda v: None if v is None or v != v else v.item() if hasattr(v, "item") else v
    return sorted((tuple(map(clean, r)) for r in frame.itertuples(index=False)), key=str)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_against_sql(spark, sf, duck, name):
    got, want = catalog.QUERIES[name](spark, sf).toPandas(), duck.sql(catalog.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
