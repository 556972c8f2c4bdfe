"""Every registered analytics query against its SQL in DuckDB on the smallest tables."""

from __future__ import annotations

import math

import duckdb
import pytest

from fieldspark.plans import queries as plans
from fieldspark.sources.views import TABLES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return con


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return "-"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (int, float)) or type(value).__name__ == "Decimal":
        return f"{float(value):.12g}"
    return str(value)[:10] if type(value).__name__ in ("date", "datetime") else str(value)


@pytest.mark.parametrize("name", list(plans.QUERIES))
def test_query(spark, duck, name):
    df = plans.QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    rows = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    if name not in plans.ORACLE_SQL:
        assert rows
        return
    got = duck.execute(plans.ORACLE_SQL[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == columns
    want = sorted(tuple(plain(dict(zip(names, r, strict=True))[c]) for c in columns) for r in got.fetchall())
    assert len(rows) == len(want)
    wrong = [(a, b) for a, b in zip(rows, want, strict=True) if a != b]
    assert not wrong, wrong[:3]


def test_whole_tables_are_covered(spark, duck):
    from fieldspark.sources.views import with_views

    def ids(name, column):
        return {r[0] for r in plans.QUERIES[name](spark, FOLDER).select(column).distinct().collect()}

    assert ids("j21_interval_fallback_all", "obs_id") == {r[0] for r in duck.execute(with_views("select obs_id from yield_obs")).fetchall()}
    assert ids("u3_time_windows_all", "field_id") == {r[0] for r in duck.execute(with_views("select field_id from yield_obs")).fetchall()}
