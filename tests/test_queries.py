"""Every query of the registry against its SQL on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from evidencelake.plans.registry import ORACLE_SQL, QUERIES

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def tables():
    connection = duckdb.connect()
    for name in os.listdir(DATA):
        connection.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{name}'")
    return connection


def rows(frame):
    frame = frame[sorted(frame.columns)]

    def value(v):
        if pd.isna(v):
            return "null"
        if isinstance(v, bool) or type(v).__name__ in ("bool_", "bool"):
            return str(bool(v))
        if isinstance(v, str):
            return v
        try:
            return f"{round(float(v), 6) + 0.0:.6f}"
        except (TypeError, ValueError):
            return str(v)

    return sorted(tuple(map(value, r)) for r in frame.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_sql(spark, tables, name):
    got = QUERIES[name](spark, DATA).toPandas()
    if name not in ORACLE_SQL:
        assert len(got.columns) > 0
        return
    wanted = tables.sql(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(wanted.columns)
    assert rows(got) == rows(wanted)


def test_entry_point_has_what_the_registry_has():
    import __spark_entry__

    assert set(QUERIES) <= set(__spark_entry__.queries())
    assert set(ORACLE_SQL) <= set(__spark_entry__.oracle_sql())
