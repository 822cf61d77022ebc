"""Every registered query against its DuckDB oracle on the smallest tables."""

import datetime as dt
import math

import duckdb
import pytest

import __spark_entry__ as E
from shiftspark.plans import catalog
from shiftspark.sources.tables import TABLES

from conftest import SF_SMALL


SPARK_TO_DUCK = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE",
                 "boolean": "BOOLEAN", "date": "DATE", "timestamp_ntz": "TIMESTAMP"}


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None)
    return v


def canon(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(repr(norm(r[i])) for i in order) for r in rows))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


def test_entry_registers_the_catalog():
    assert set(catalog.queries()) <= set(E.queries())


def test_every_query_has_oracle_or_is_known_rows_only():
    assert set(catalog.queries()) - set(catalog.oracle_sql()) == {"forecast_model", "dataset_inventory"}


def test_dataset_inventory_matches_the_store(spark):
    """Rows-only query: one row per stored week, sizes positive and equal to the files."""
    df = E.queries()["dataset_inventory"](spark, SF_SMALL)
    rows = df.collect()
    weeks = duckdb.sql(f"SELECT count(DISTINCT weekofyear(ts)) FROM "
                       f"read_parquet('{SF_SMALL}/events.parquet') "
                       f"WHERE hour(ts)*60 + minute(ts) > 0").fetchall()[0][0]
    assert len(rows) == weeks
    assert all(r.files >= 1 and r.bytes > 0 and r.size_mb == r.bytes / 1048576.0 for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_matches_oracle(spark, duck, name):
    df = E.queries()[name](spark, SF_SMALL)
    got = canon(df.columns, [tuple(r) for r in df.collect()])
    cur = duck.execute(E.oracle_sql()[name])
    ocols = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(ocols)
    assert got == canon(ocols, cur.fetchall())
    rel = duck.sql(E.oracle_sql()[name])
    duck_types = dict(zip(rel.columns, map(str, rel.types)))
    spark_types = {c: SPARK_TO_DUCK.get(t, t) for c, t in df.dtypes}
    assert spark_types == duck_types


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() >= 0
    assert df.columns == ["id", "target_date", "window_size", "day", "date", "weekday",
                          "start_time", "end_time", "historical"]
