"""Every registered query against its SQL on the smallest tables."""

import math

import duckdb
import pytest

from notelake.plans import registry
from notelake.plans.fixtures import TABLES

SF = "/root/testdata/sf0.001"
SQL = registry.oracle_sql()


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6) + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return value if isinstance(value, (int, bool, type(None))) else str(value)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_equals_its_sql(name, spark, duck):
    made = registry.queries()[name](spark, SF)
    columns = sorted(made.columns)
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in made.collect()), key=repr)
    if name in SQL:
        cursor = duck.execute(SQL[name])
        names = [d[0] for d in cursor.description]
        assert sorted(names) == columns
        assert rows == sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in cursor.fetchall()), key=repr)
