"""Every registered query of the core against its SQL on DuckDB, value by value; the others must give rows."""

import decimal
from collections import Counter

import duckdb
import pytest

from tessera import registry
from tests.conftest import DATA

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(x):
    return round(x, 6) if isinstance(x, float) else float(x) if isinstance(x, decimal.Decimal) else x


def counted(rows, places):
    return Counter(tuple(plain(r[i]) for i in places) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.sql()))
def test_matches_sql(spark, duck, name):
    df = registry.queries()[name](spark, DATA)
    want = duck.sql(registry.sql()[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    assert counted(df.collect(), [df.columns.index(c) for c in columns]) == counted(want.fetchall(), [want.columns.index(c) for c in columns])


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.sql())))
def test_gives_rows(spark, name):
    df = registry.queries()[name](spark, DATA)
    assert df.count() > 0
