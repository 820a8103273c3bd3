"""Every query against its SQL in DuckDB on the small tables."""

import math
from pathlib import Path

import duckdb
import pytest

from fieldglass.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6) + 0.0)
    return str(v)


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_matches_sql(spark, db, name):
    df = registry.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    want = db.sql(registry.ORACLE[name])
    assert columns == sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    assert sorted(tuple(plain(r[c]) for c in columns) for r in df.collect()) == sorted(tuple(plain(r[k]) for k in at) for r in want.fetchall())


def test_queries_without_sql_have_a_test_of_their_own():
    """signal_scan: tests/test_followup.py holds it against a plain pass."""
    assert set(registry.QUERIES) - set(registry.ORACLE) == {"signal_scan"}


def test_results_name_no_person(spark):
    for name, f in registry.QUERIES.items():
        assert not {"first_name", "last_name", "child", "patient", "household", "home_address", "birth_date"} & set(f(spark, SF).columns), name
