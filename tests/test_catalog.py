"""Every query with SQL against DuckDB on the same files, and the others by running."""

import duckdb
import pytest

from isogon.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_mid):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_mid}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", [n for n in catalog.QUERIES if n in catalog.ORACLE_SQL])
def test_against_sql(spark, duck, sf_mid, name):
    df = catalog.QUERIES[name](spark, sf_mid)
    cols = sorted(df.columns)
    got = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)
    cur = duck.execute(catalog.ORACLE_SQL[name])
    names = [x[0] for x in cur.description]
    assert sorted(names) == cols
    assert got == sorted((tuple(dict(zip(names, x, strict=True))[c] for c in cols) for x in cur.fetchall()), key=repr)


@pytest.mark.parametrize("name", [n for n in catalog.QUERIES if n not in catalog.ORACLE_SQL])
def test_runs(spark, sf_mid, name):
    assert catalog.QUERIES[name](spark, sf_mid).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
