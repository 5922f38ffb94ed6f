"""Queries that have SQL against DuckDB, on the small tables."""

import duckdb
import pytest

from ledgerline.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df, found = queries.queries()[name](spark, SF), con.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in found.description]
    assert sorted(df.columns) == sorted(columns)
    order = sorted(range(len(columns)), key=columns.__getitem__)
    want = sorted(str([r[i] for i in order]) for r in found.fetchall())
    assert sorted(str([r[c] for c in sorted(columns)]) for r in df.collect()) == want
