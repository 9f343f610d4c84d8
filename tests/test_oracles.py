"""Every registered query of the engine against its SQL in DuckDB."""

from __future__ import annotations

import duckdb
import pytest

from vellum import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    text = lambda v: str(int(v)) if isinstance(v, float) and v == int(v) else str(v)
    return sorted(tuple(text(r[i]) for i in order) for r in values)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_matches_sql(spark, sf, duck, name):
    got = registry.queries()[name](spark, sf)
    want = duck.sql(registry.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall())


@pytest.mark.parametrize("status", ["P", "O", None])
def test_lot_on_store_whatever_order_5_is(spark, duck, tmp_path, status):
    """The order that it deletes is one of those that its nested cas looks for, or not, or absent."""
    changed = f"SELECT * REPLACE (CASE WHEN o_orderkey = 5 THEN '{status}' ELSE o_orderstatus END AS o_orderstatus) FROM orders" if status else "FROM orders WHERE o_orderkey <> 5"
    duck.sql(f"COPY ({changed}) TO '{tmp_path}/orders.parquet'")
    duck.sql(f"COPY (FROM customer) TO '{tmp_path}/customer.parquet'")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW orders AS FROM '{tmp_path}/orders.parquet'")
    got = registry.queries()["lot_on_store"](spark, str(tmp_path))
    want = con.sql(registry.oracle_sql()["lot_on_store"])
    assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall())
