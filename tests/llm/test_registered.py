"""Every registered query of this subpackage runs over the smallest tables, and equals its DuckDB twin where there is one."""

import os

import duckdb
import pytest

from tracewright.llm import queries


def rounded(rows, columns):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(repr([round(r[k], 6) if isinstance(r[k], float) else r[k] for k in order]) for r in rows)


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, sf_dir, name):
    got = queries.queries()[name](spark, sf_dir)
    rows = [tuple(r) for r in got.collect()]
    assert rows
    if name in queries.oracle_sql():
        con = duckdb.connect()
        for table in ("documents", "benchmark", "conversations"):
            path = f"{sf_dir}/{table}.parquet"
            con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
        want = con.sql(queries.oracle_sql()[name])
        assert sorted(want.columns) == sorted(got.columns)
        assert rounded(rows, got.columns) == rounded(want.fetchall(), want.columns)
