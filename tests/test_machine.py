"""The event machine against the documents and traces of FIXTURES.md, whole and cut at every byte."""

import pickle

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from saxframe.operators.machine import Machine, Options, content_model, parse
from tests.goldens import rows, trace, unescaped

ROWS = rows()


def options(fixture: str, namespaces: bool) -> Options:
    return Options(namespaces=namespaces, encodings={"ISO-8859-2": "iso8859-2"} if fixture == "d05" else {})


def test_all_fixtures_are_read():
    assert len(ROWS) == 93


@pytest.mark.parametrize("row", ROWS, ids=[r[0] for r in ROWS])
def test_golden(row):
    fixture, body, status, error, where, want, namespaces = row
    m = parse(body, options(fixture, namespaces))
    want = "" if want == "(none)" else unescaped(want)
    got = trace(m)
    assert (0 if m.code else 1, m.code) == (status, error)
    assert got.startswith(want.split("…")[0].rstrip()) if "…" in want else got == want
    assert (f"{m.where[0]}:{m.where[1]}" if m.code else "") == where


@pytest.mark.parametrize("row", [r for r in ROWS if len(r[1]) <= 100], ids=lambda r: r[0])
def test_any_split_gives_the_same(row):
    fixture, body, *_, namespaces = row
    whole = parse(body, options(fixture, namespaces))
    for k in range(1, len(body)):
        m = Machine(options(fixture, namespaces))
        m.feed(body[:k])
        m = pickle.loads(pickle.dumps(m))
        m.feed(body[k:], True)
        assert (m.code, m.where, trace(m)) == (whole.code, whole.where, trace(whole)), body[:k]


def test_amplification_limit():
    laughs = b'<!DOCTYPE l [<!ENTITY l0 "lol">' + b"".join(b'<!ENTITY l%d "%s">' % (i, b"&l%d;" % (i - 1) * 10) for i in range(1, 10)) + b"]><l>&l9;</l>"
    m = parse(laughs, Options(max_amplification=10, activation_bytes=1024))
    assert m.code == 43
    assert m.acc.indirect < 10 * len(laughs) + 1024


def test_options_are_checked():
    for bad in (float("nan"), -1.0, 0.5):
        with pytest.raises(ValueError):
            Options(max_amplification=bad)
    with pytest.raises(ValueError):
        Options(encodings={"x": [0] * 255})
    with pytest.raises(ValueError):
        Options(encodings={"x": [0] * 256})


def test_input_after_the_end():
    m = parse(b"<r/>")
    assert m.feed(b"x") == 0 and m.code == 36


def test_parameter_entities_and_external_subset():
    store = {"t.dtd": b"<!ENTITY % kind 'INCLUDE'><![%kind;[<!ENTITY e 'in'>]]><![IGNORE[<!ENTITY e 'out'><![x[]]>]]><!ATTLIST r a CDATA 'd'>"}
    m = parse(b"<!DOCTYPE r SYSTEM 't.dtd'><r>&e;</r>", Options(param_entities=2, store=store))
    assert m.code == 0
    start = next(e for e in m.events if e[0] == "start_element")
    assert start[3] == [("a", "d", False, "CDATA")]
    assert "".join(e[2] for e in m.events if e[0] == "character_data") == "in"
    never = parse(b"<!DOCTYPE r SYSTEM 't.dtd'><r>&e;</r>", Options(store=store))
    assert never.code == 0 and any(e[0] == "skipped_entity" for e in never.events)


def test_missing_external_entity():
    body = b"<!DOCTYPE r [<!ENTITY e SYSTEM 'f.xml'>]><r>&e;</r>"
    assert parse(body).code == 0
    assert parse(body, Options(strict_entities=True)).code == 21
    assert parse(body, Options(store={"f.xml": b"<a>"})).code == 13
    assert parse(b"<!DOCTYPE r [<!ENTITY e '<a>'>]><r>&e;</a></r>").code == 13


def test_triplets_and_not_standalone():
    m = parse(b"<p:r xmlns:p='u'/>", Options(namespaces=True, triplets=True, separator="|"))
    assert [e[1] for e in m.events if e[0] == "start_element"] == ["u|r|p"]
    assert parse(b"<!DOCTYPE r SYSTEM 'x'><r/>", Options(reject_not_standalone=True)).code == 22


def test_id_and_specified_counts():
    m = parse(b"<!DOCTYPE r [<!ATTLIST r x CDATA 'd' i ID #IMPLIED>]><r b='1' i='2'/>")
    start = next(e for e in m.events if e[0] == "start_element")
    assert start[-1]["n_specified"] == 4 and start[-1]["id_index"] == 2


def test_content_models():
    assert content_model("EMPTY") == [(0, None, 0, 1, 0, None)]
    assert [n[3:] for n in content_model("(#PCDATA|a|b)*")] == [(3, 2, None), (4, 0, "a"), (4, 0, "b")]
    for bad in ("(a,b|c)", "(a", "a)", "()", "(#PCDATA|a)"):
        assert content_model(bad) is None


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["<a>", "</a>", "<b x='1'>", "</b>", "<c/>", "text", "&amp;", "&#65;", "]]", ">", "<!--c-->", "<![CDATA[", "]]>", "\r\n", "<?p d?>", "é"]), max_size=12), st.integers(1, 7))
def test_chunks_never_matter(parts, size):
    body = ("<r>" + "".join(parts) + "</r>").encode()
    whole = parse(body)
    m = Machine()
    for k in range(0, len(body), size):
        m.feed(body[k : k + size], k + size >= len(body))
    assert (m.code, trace(m)) == (whole.code, trace(whole))
