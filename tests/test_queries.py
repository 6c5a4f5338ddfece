"""Every registered query of the event model against its SQL, on the smallest tables."""

import duckdb
import pytest

from saxframe.operators.documents import doc_status, parse_documents
from saxframe.plans import ORACLE_SQL, QUERIES
from saxframe.sources.documents import from_table

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def rows(names, records):
    return sorted(repr(tuple(dict(zip(names, r, strict=True))[k] for k in sorted(names))) for r in records)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows_as_sql(spark, sql, name):
    df = QUERIES[name](spark, DATA)
    found = rows(df.columns, [tuple(r) for r in df.collect()])
    assert name in ORACLE_SQL
    want = sql.sql(ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert found == rows(want.columns, want.fetchall())


def test_pages_with_references_of_html(spark, tmp_path):
    """A reference that XML forbids, or doesn't know, before the first wrong tag: its own error raw, the tag's in the query."""
    pages = ["<html><head><title>x &amp</title><br></head></html>", "<html><head><title>&copy; x &#0;</title><br></head></html>", "<html><head><br></head></html>"]
    df = spark.createDataFrame(list(enumerate(pages)), "page_id long, html string")
    df.write.parquet(str(tmp_path / "pages.parquet"))
    raw = doc_status(parse_documents(from_table(df, "page_id", "html"))).collect()
    assert {r["doc_id"]: r["error_code"] for r in raw} == {"0": 4, "1": 11, "2": 7}
    found = QUERIES["q_pages_verdict"](spark, str(tmp_path)).collect()
    c = duckdb.connect()
    c.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert [tuple(r) for r in found] == c.sql(ORACLE_SQL["q_pages_verdict"]).fetchall() == [(7, 3)]
