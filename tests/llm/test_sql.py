"""The operators that SQL can express, against their SQL."""

import duckdb
import pytest

from saxframe.llm.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows_as_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "embeddings"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want = c.sql(ORACLE_SQL[name])
    df = QUERIES[name](spark, DATA)
    assert sorted(df.columns) == sorted(want.columns)
    rows = lambda columns, found: sorted(repr(tuple(dict(zip(columns, r, strict=True))[k] for k in sorted(columns))) for r in found)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(want.columns, want.fetchall())
