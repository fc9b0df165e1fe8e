"""Every registered query of the library against its SQL, or that it runs where there is none."""

import datetime

import pytest

from attesta.plans import ORACLE_SQL, QUERIES


def value(v):
    if isinstance(v, float):
        return round(v, 6)
    return v.replace(tzinfo=None) if isinstance(v, datetime.datetime) else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, duck, name):
    got = QUERIES[name](spark, sf)
    columns = sorted(got.columns)
    rows = sorted((tuple(map(value, r)) for r in got.select(*(f"`{c}`" for c in columns)).collect()), key=repr)
    if name not in ORACLE_SQL:
        return
    want = duck.sql(ORACLE_SQL[name])
    assert sorted(want.columns) == columns
    assert rows == sorted((tuple(map(value, r)) for r in want.project(", ".join(f'"{c}"' for c in columns)).fetchall()), key=repr)


def test_entry_has_all_queries(spark):
    import __spark_entry__

    assert set(QUERIES) <= set(__spark_entry__.queries())
    assert set(ORACLE_SQL) <= set(__spark_entry__.oracle_sql())
    assert __spark_entry__.entry(spark).columns
