"""Every query of the catalog against its SQL form in DuckDB, over the smallest test tables."""

import datetime
from pathlib import Path

import duckdb
import pytest

from evidentia.plans import derived

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for f in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def plain(value):
    if isinstance(value, float):
        return round(value, 6)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    return value


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(derived.QUERIES) + [f"literal {n}" for n in derived.FIXTURES])
def test_query(spark, db, name):
    literal = name.startswith("literal ")
    name = name.removeprefix("literal ")
    queries, sql = (derived.FIXTURES, derived.FIXTURE_SQL) if literal else (derived.QUERIES, derived.ORACLE_SQL)
    df = queries[name](spark, SF)
    found = rows(df.columns, df.collect())
    if name not in sql:
        assert found
        return
    cursor = db.execute(sql[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    wanted = rows(columns, cursor.fetchall())
    assert len(found) == len(wanted)
    assert [[float(v) if isinstance(v, int) and not isinstance(v, bool) else v for v in map(_number, r)] for r in found] == [
        [float(v) if isinstance(v, int) and not isinstance(v, bool) else v for v in map(_number, r)] for r in wanted
    ]


def _number(v):
    from decimal import Decimal

    return float(v) if isinstance(v, Decimal) else v
