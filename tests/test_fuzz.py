"""The machine against the standard library's parser, and what no document may do to it."""

import time

import pytest

from saxframe.functions import names
from saxframe.operators.machine import Machine, Options, parse
from tests.stdlib import by_library, by_machine, documents


@pytest.mark.parametrize("seed", range(4))
def test_small_broken_documents(seed):
    """Verdict, position and events, the declarations among them, of 5,000 documents each: no difference."""
    for body in documents(100 + seed, 5000):
        assert by_machine(parse(body)) == by_library(body), body


def test_broken_documents_in_pieces():
    for body in documents(7, 1500):
        whole = by_machine(parse(body))
        m = Machine()
        for k in range(0, len(body), 3):
            m.feed(body[k : k + 3], k + 3 >= len(body))
        assert by_machine(m) == whole, body


def test_every_character_of_the_plane_as_a_name():
    start, more = names._classes()
    for c in range(0x80, 0xFFFE):
        if not 0xD800 <= c < 0xE000:
            assert (by_library(f"<{chr(c)}/>".encode())[0] == 0, by_library(f"<a{chr(c)}/>".encode())[0] == 0) == (c in start, c in start or c in more), hex(c)


def chain(n, wrap="<r>&e%d;</r>"):
    return ("<!DOCTYPE r [<!ENTITY e0 'x'>" + "".join(f"<!ENTITY e{k} '&e{k - 1};'>" for k in range(1, n + 1)) + "]>" + wrap % n).encode()


def test_deep_chains_of_entities():
    m = parse(chain(10_000))
    assert m.code == 0 and m.acc.deepest == 10_001 and "".join(e[2] for e in m.events if e[0] == "character_data") == "x"
    m = parse(chain(10_000, '<r a="&e%d;"/>'))
    assert m.code == 0 and next(e for e in m.events if e[0] == "start_element")[3][0][1] == "x"
    loop = b"<!DOCTYPE r [<!ENTITY a '&b;'><!ENTITY b '&a;'>]><r>&a;</r>"
    assert by_machine(parse(loop)) == by_library(loop) and parse(loop).code == 12
    params = b"<!DOCTYPE r SYSTEM 's'><r/>"
    subset = b"<!ENTITY % p0 '<!ENTITY e \"v\">'>" + b"".join(b"<!ENTITY %% p%d '&#37;p%d;'>" % (k, k - 1) for k in range(1, 3001)) + b"%p3000;"
    m = parse(params, Options(param_entities=2, store={"s": subset}))
    assert m.code == 0 and m.entities["e"][0] == "v"


def test_a_token_in_small_pieces_takes_linear_time():
    def seconds(n, deferral=True):
        body = b"<r><!--" + b"x" * n + b"--></r>"
        m = Machine(Options(reparse_deferral=deferral))
        began = time.process_time()
        for k in range(0, len(body), 64):
            m.feed(body[k : k + 64], k + 64 >= len(body))
        assert m.code == 0 and [e[0] for e in m.events] == ["start_element", "comment", "end_element"]
        return time.process_time() - began

    seconds(1000)
    assert seconds(640_000) < 0.5 * seconds(640_000, deferral=False)
    assert seconds(1_280_000) < 6 * max(seconds(320_000), 0.01)


def test_calls_out_of_turn():
    m = Machine()
    assert m.stop() == 0 and m.code == 44
    m.reset()
    assert m.code == 0 and m.use_foreign_dtd("x.dtd") == 0 and m.o.foreign_dtd == "x.dtd"
    assert m.feed_leased(3) == 0 and m.code == 42
    m.reset()
    m.lease(8)[:4] = b"<r/>"
    assert m.feed_leased(4) == 1 and m.use_foreign_dtd("y") == 26
    assert m.feed(b"", True) == 1 and m.stop() == 0 and m.code == 36
    m.reset()
    m.feed(b"<r>")
    assert m.stop(resumable=True) == 1 and m.code == 33 and m.resume() == 1 and m.code == 0
    assert m.feed(b"</r>", True) == 1
    m.reset()
    m.feed(b"<a/>", True)
    assert [e[0] for e in m.events] == ["start_element", "end_element"]


def test_an_exception_is_one_documents_verdict(spark, monkeypatch):
    from saxframe.operators import documents as D

    docs = spark.createDataFrame([("a", b"<r/>"), ("b", b"<?xml version='1.0' encoding='odd'?><r>\xff</r>"), ("c", b"<r/>")], "doc_id string, content binary")
    options = Options(encodings={"odd": ([k if k < 128 else -2 for k in range(256)], fails)})
    assert {r["doc_id"]: r["error_code"] for r in D.doc_status(D.parse_documents(docs, options)).collect()} == {"a": 0, "b": 23, "c": 0}


def fails(_):
    raise KeyError("a converter of the caller's")


def test_paths_grow_with_the_document_alone(spark):
    from saxframe.operators import lexing as L

    text = "<r>" + "<a><b/></a>" * 3000 + "</r>"
    found = L.paths(L.elements(L.tokens(spark.createDataFrame([("d", text)], "doc_id string, text string"))))
    assert {r["path"]: r["count"] for r in found.groupBy("path").count().collect()} == {"/r": 1, "/r/a": 3000, "/r/a/b": 3000}
