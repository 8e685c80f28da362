"""Queries of the training-data operators with SQL give the same rows as DuckDB."""

from __future__ import annotations

import duckdb
import pytest

from kinemill.llm.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows(name, spark):
    c = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got, want = QUERIES[name](spark, DATA).toArrow(), c.sql(ORACLE_SQL[name]).to_arrow_table()
    names = sorted(got.column_names)
    assert names == sorted(want.column_names)
    plain = lambda t: sorted(map(repr, zip(*(t.column(n).to_pylist() for n in names), strict=True)))
    assert plain(got) == plain(want)
