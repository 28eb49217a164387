"""Every registered query of the library against its DuckDB twin on the smallest tables."""

import math
import os

import duckdb
import pytest

from tracewright.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return None
    if isinstance(value, float):
        return round(value, 4) + 0.0
    return list(map(plain, value)) if isinstance(value, list) else value


def table(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(repr([plain(r[k]) for k in order]) for r in rows)


@pytest.fixture(scope="session")
def duck(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.oracles()))
def test_equals_duckdb(spark, sf_dir, duck, name):
    got = registry.queries()[name](spark, sf_dir)
    want = duck.sql(registry.oracles()[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert table(got.columns, [tuple(r) for r in got.collect()]) == table(want.columns, want.fetchall())


def test_queries_without_a_twin_return_rows(spark, sf_dir):
    # No group has ten observations in the smallest tables.
    larger = {"i6_intervals": sf_dir.replace("0.001", "0.01")}
    for name in sorted(set(registry.queries()) - set(registry.oracles())):
        assert registry.queries()[name](spark, larger.get(name, sf_dir)).count() > 0, name
