"""Plans: filters and columns reach the scan, structure costs one exchange on the document."""

from pyspark.sql import functions as F

from saxframe.functions import expressions as X
from saxframe.operators import documents as D
from saxframe.operators import lexing as L
from saxframe.operators.machine import Options
from saxframe.sources.documents import from_files, from_table, from_text, split_chunks, write_events


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filter_and_columns_reach_the_scan(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    p = plan(L.tokens(pages, "page_id", "html").where("doc_id = 3"))
    assert "EqualTo(page_id,3)" in p and "url" not in p


def test_structure_is_one_exchange(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    assert plan(L.positions(L.tokens(pages, "page_id", "html"))).count("Exchange hashpartitioning") == 1


def test_nulls_empties_and_extra_columns(spark):
    docs = spark.createDataFrame([("a", b"<r/>", 1, "x"), ("b", None, 2, "y"), (None, b"", 3, None), ("a", b"<r>", 4, "z")], "doc_id string, content binary, status2 int, note string")
    got = {r["status2"]: r for r in D.doc_status(D.parse_documents(docs)).collect()}
    assert [got[k]["error_code"] for k in (1, 2, 3, 4)] == [0, 3, 3, 3]
    assert got[4]["note"] == "z"
    assert D.events(D.parse_documents(docs.limit(0))).count() == 0


def test_dtd_relations(spark):
    body = b"<!DOCTYPE r [<!ENTITY a 'x'><!ENTITY % p 'y'><!ENTITY e SYSTEM 's'><!NOTATION n SYSTEM 'm'><!ENTITY u SYSTEM 'f' NDATA n><!ATTLIST r k (a|b) 'a'><!ELEMENT r ANY>]><r/>"
    tables = D.dtd(D.parse_documents(spark.createDataFrame([("d", body)], "doc_id string, content binary")))
    assert {k: v.count() for k, v in tables.items()} == {"entities": 1, "external_entities": 1, "param_entities": 1, "unparsed_entities": 1, "notations": 1, "attlist": 1, "elements": 1}
    assert tables["attlist"].first()["att_type"] == "(a|b)"


def test_encoding_column(spark):
    docs = spark.createDataFrame([("a", "<r>é</r>".encode("latin-1"), "ISO-8859-1"), ("b", b"<r/>", "nope"), ("c", b"<r/>", None)], "doc_id string, content binary, enc string")
    got = {r["doc_id"]: r["error_code"] for r in D.parse_documents(docs, Options(), "enc").collect()}
    assert got == {"a": 0, "b": 18, "c": 0}


def test_sources_and_sink(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.xml").write_bytes(b"<r>1</r>")
    assert [bytes(r["content"]) for r in from_files(spark, str(tmp_path / "in"), "*.xml").collect()] == [b"<r>1</r>"]
    assert [bytes(r["content"]) for r in from_text(spark, str(tmp_path / "in")).collect()] == [b"<r>1</r>"]
    docs = from_table(spark.createDataFrame([(1, "<r>abc</r>")], "k int, t string"), "k", "t")
    parts = split_chunks(docs, 4).orderBy("chunk_no").collect()
    assert b"".join(bytes(p["bytes"]) for p in parts) == b"<r>abc</r>" and [p["is_final"] for p in parts] == [False, False, True]
    write_events(D.events(D.parse_documents(docs)), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).where("event_type = 'character_data'").first()["text"] == "abc"


def test_expressions(spark):
    df = spark.createDataFrame([("a&#65;&#x20AC;&lt;&none;&#xD800;", "x\r\ny\rz")], "t string, l string")
    r = df.select(
        X.resolved("t").alias("t"), X.normal_lines("l").alias("l"), X.line_of("l").alias("line"), X.column_of("l").alias("col"), X.is_name(F.lit("a:b-1")).alias("n"), X.is_name(F.lit("1a")).alias("m"),
        X.is_public_id(F.lit("-//T//EN")).alias("p"), X.expanded_name(F.lit("u"), F.lit("l")).alias("e"), X.stripped_triplet(F.lit("u l p")).alias("s"), X.error_text(F.lit(7)).alias("err"),
        X.amplification(F.lit(0), F.lit(22)).alias("amp"), X.normal_value(F.lit(" a\t\tb &amp; "), tokens=True).alias("v"),
    ).first()
    assert (r.t, r.l, r.line, r.col) == ("aA€<&none;&#xD800;", "x\ny\nz", 3, 1)
    assert (r.n, r.m, r.p, r.e, r.s, r.err, r.amp, r.v) == (True, False, True, "u l", "u l", "tag mismatch", 2.0, "a b &")
    assert X.error_table(spark).count() == 45 and X.feature_table(spark).count() == 16
