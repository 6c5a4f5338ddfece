"""The standard library's parser as an oracle: verdict, position and merged events of a document."""

from __future__ import annotations

import random
from xml.parsers import expat

from saxframe.operators.machine import Machine

PARTS = [
    "<a>", "</a>", "<b x='1'>", "</b>", "<c/>", "<d y=\"&lt;&#65;\"/>", "text", "\t", "\n", "\r\n", " ", "&amp;", "&#65;", "&#0;", "&e;", "&", ";", "]]>", "]]", "]", ">", "<", "\"", "'", "<!--c-->", "<!-- - -->", "<!--",
    "-->", "<![CDATA[", "<?p d?>", "<?xml?>", "<?xml version='1.0'?>", "<?XML x?>", "<!DOCTYPE a>", "<!DOCTYPE a [", "]>", "<!ELEMENT a ANY>", "<!ELEMENT a (b|c)*>", "<!ENTITY e 'v'>", "<!ENTITY e '<c/>'>", "<!ATTLIST a x CDATA 'd'>",
    "<!NOTATION n SYSTEM 's'>", "<!", "%", "%p;", "#", "(", ")", ",", "|", "name", "1", "=", "é", "\x01", "<a x='1' x='2'/>", "<a x=\"&e;\"/>", "<a x='<'/>", "<1>", "</", "<a", "/>",
]


def documents(seed: int, n: int) -> list[bytes]:
    """Small documents, most of them broken, some of them whole but for one part."""
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        parts = [rng.choice(PARTS) for _ in range(rng.randint(1, 6))]
        if rng.random() < 0.6:
            whole = ["<a>", "t", "<b>", "</b>", "</a>"]
            if rng.random() < 0.4:
                whole = ["<!DOCTYPE a [", "<!ENTITY e 'v'>", "<!ATTLIST a x CDATA 'd'>", "]>", *whole]
            at = rng.randint(0, len(whole))
            parts = whole[:at] + parts[: rng.randint(0, 2)] + whole[at:]
        out.append("".join(parts).encode())
    return out


def by_library(body: bytes) -> tuple[int, tuple[int, int] | None, list[tuple]]:
    events: list[tuple] = []

    def text(data: str) -> None:
        if events and events[-1][0] == "CD":
            events[-1] = ("CD", events[-1][1] + data)
        else:
            events.append(("CD", data))

    p = expat.ParserCreate()
    p.ordered_attributes = True
    p.StartElementHandler = lambda name, attrs: events.append(("SE", name, *attrs))
    p.EndElementHandler = lambda name: events.append(("EE", name))
    p.CharacterDataHandler = text
    p.ProcessingInstructionHandler = lambda target, data: events.append(("PI", target, data))
    p.CommentHandler = lambda data: events.append(("CM", data))
    p.StartCdataSectionHandler = lambda: events.append(("SCD",))
    p.EndCdataSectionHandler = lambda: events.append(("ECD",))
    p.StartDoctypeDeclHandler = lambda name, *_: events.append(("SDT", name))
    p.EndDoctypeDeclHandler = lambda: events.append(("EDT",))
    p.EntityDeclHandler = lambda name, param, value, *_: events.append(("ED", name, value))
    p.AttlistDeclHandler = lambda element, name, kind, default, required: events.append(("AD", element, name, kind, default))
    p.NotationDeclHandler = lambda name, base, system, public: events.append(("ND", name, system))
    p.ElementDeclHandler = lambda name, model: events.append(("EL", name))
    try:
        p.Parse(body, True)
        return 0, None, events
    except expat.ExpatError as e:
        return e.code, (e.lineno, e.offset), events


def by_machine(m: Machine) -> tuple[int, tuple[int, int] | None, list[tuple]]:
    out: list[tuple] = []
    for kind, name, text, attrs, *_, more in m.events:
        more = more or {}
        row = {
            "start_element": lambda: ("SE", name, *[x for a in attrs for x in a[:2]]), "end_element": lambda: ("EE", name), "character_data": lambda: ("CD", text), "processing_instruction": lambda: ("PI", name, text),
            "comment": lambda: ("CM", text), "start_cdata": lambda: ("SCD",), "end_cdata": lambda: ("ECD",), "start_doctype": lambda: ("SDT", name), "end_doctype": lambda: ("EDT",), "entity_decl": lambda: ("ED", name, more["value"]),
            "attlist_decl": lambda: ("AD", name, more["attribute"], more["att_type"], more["default_value"]), "notation_decl": lambda: ("ND", name, more["system_id"]), "element_decl": lambda: ("EL", name),
        }.get(kind)
        if row:
            out.append(row())
    return m.code, (m.where[0], m.where[1]) if m.code else None, out
