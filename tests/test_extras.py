"""Stopping and resuming, raw bytes, namespace scopes, further encodings, functions for SQL."""

from saxframe.functions.sql import register
from saxframe.operators import documents as D
from saxframe.operators.machine import Machine, Options, parse


def test_stop_and_resume():
    body = b"<r><a/><b/>text<c/></r>"
    whole = parse(body)
    kinds = [(e[0], e[1]) for e in whole.events]
    gone = parse(body, Options(stop_after=3))
    assert gone.code == 35 and [(e[0], e[1]) for e in gone.events] == kinds[:3]
    m = Machine(Options(stop_after=2, resumable=True))
    m.feed(body, True)
    stops = 0
    while m.code == 33:
        stops += 1
        m.resume()
    assert m.code == 0 and stops >= 3 and [(e[0], e[1]) for e in m.events] == kinds
    assert m.resume() == 0 and m.code == 34


def test_raw_bytes(spark):
    docs = spark.createDataFrame([("d", "<r>é<a b='1'/><!--c--></r>".encode())], "doc_id string, content binary")
    rows = D.with_raw(D.events(D.parse_documents(docs)), docs).orderBy("seq").collect()
    assert b"".join(bytes(r["raw"]) for r in rows).decode() == "<r>é<a b='1'/><!--c--></r>"


def test_namespace_scopes(spark):
    body = b"<p:a xmlns:p='u1' xmlns='d'><p:b xmlns:p='u2'/><p:c/></p:a>"
    parsed = D.parse_documents(spark.createDataFrame([("d", body)], "doc_id string, content binary"), Options(namespaces=True))
    got = {(r["prefix"], r["uri"]): (r["start_seq"], r["end_seq"], r["level"]) for r in D.namespace_bindings(parsed).collect()}
    assert set(got) == {("p", "u1"), ("p", "u2"), (None, "d")}
    assert got["p", "u1"][0] < got["p", "u2"][0] < got["p", "u2"][1] < got["p", "u1"][1] and got["p", "u2"][2] == 2


def test_characters_of_several_bytes():
    points = [b if b < 0x80 else -2 for b in range(256)]
    options = Options(encodings={"two": (points, lambda b: (b[0] & 0x7F) << 7 | b[1] & 0x7F)})
    body = b"<?xml version='1.0' encoding='two'?><r>\xc2\x80\x81\x80</r><x/>"
    m = parse(body, options)
    assert [e[2] for e in m.events if e[0] == "character_data"] == [chr(0x42 << 7) + chr(1 << 7)]
    assert m.code == 9 and m.where[2] == body.index(b"<x/>")
    for k in range(1, len(body)):
        n = Machine(options)
        n.feed(body[:k])
        n.feed(body[k:], True)
        assert (n.code, n.where) == (m.code, m.where)


def test_sql_functions(spark):
    register(spark)
    assert spark.sql("SELECT event_type, name FROM xml_events(CAST('<r><a/></r>' AS BINARY), false) ORDER BY seq").count() == 4
    r = spark.sql("SELECT xml_error(CAST('<r></s>' AS BINARY)) AS e, xml_text(CAST('<r>a&amp;b</r>' AS BINARY)) AS t").first()
    assert (r.e, r.t) == (7, "a&b")
    assert spark.sql("SELECT error FROM xml_errors WHERE error_code = 7").first()[0] == "tag mismatch"
