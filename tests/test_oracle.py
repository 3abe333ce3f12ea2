"""Every query with SQL gives the rows that DuckDB gives."""

import math
from pathlib import Path

import duckdb
import pytest

from ferrule import catalog

DATA = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")


def plain(x):
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 6) + 0.0
    return x


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    connection.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        connection.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_same_rows(spark, duck, name):
    frame = catalog.queries()[name](spark, DATA)
    columns = sorted(frame.columns)
    found = sorted(([plain(v) for v in r] for r in frame.select(*columns).collect()), key=str)
    wanted = duck.sql(catalog.oracle_sql()[name])
    assert sorted(wanted.columns) == columns
    order = [wanted.columns.index(c) for c in columns]
    assert found
    assert found == sorted(([plain(r[i]) for i in order] for r in wanted.fetchall()), key=str)


def test_flagship(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
