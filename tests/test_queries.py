"""Every query of the library against its SQL, on the smallest tables."""

import decimal

import duckdb
import pytest

from lodegraph.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(rows):
    return sorted(tuple(repr(float(x)) if isinstance(x, float | decimal.Decimal) else str(x) for x in r) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    rows = plain(df.select(*cols).collect())
    if name in registry.oracle_sql():
        cur = duck.execute(registry.oracle_sql()[name])
        names = [c[0] for c in cur.description]
        assert sorted(names) == cols
        assert rows == plain(tuple(r[names.index(c)] for c in cols) for r in cur.fetchall())
    else:
        assert rows


def test_entry(spark):
    assert registry.entry(spark, SF).count() == 1
