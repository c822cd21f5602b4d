import importlib

import duckdb
import pytest

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

catalog = importlib.import_module("pathforge.plans.catalog")


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SMALL}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_matches_its_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SMALL)
    cols = sorted(df.columns)
    got = sorted(str(tuple(r[c] for c in cols)) for r in df.collect())
    cur = duck.execute(catalog.ORACLE_SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    assert got == sorted(str(tuple(r[names.index(c)] for c in cols)) for r in cur.fetchall())


def test_cycle_check_where_there_is_a_cycle(spark):
    """On SMALL supplier 1 lies outside region 0, and both sides are empty; here it lies inside."""
    larger = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for t in ("region", "nation", "supplier"):
        con.execute(f"create view {t} as select * from read_parquet('{larger}/{t}.parquet')")
    want = con.execute(catalog.ORACLE_SQL["cycle_check"]).fetchall()
    got = catalog.QUERIES["cycle_check"](spark, larger).select("src", "dst").collect()
    assert len(want) == 3 and sorted(map(tuple, got)) == sorted(want)


def test_entry_registers_the_catalog(spark):
    entry = importlib.import_module("__spark_entry__")
    assert set(catalog.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() == 100
