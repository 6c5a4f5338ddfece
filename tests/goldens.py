"""The documents and expected traces of FIXTURES.md."""

from __future__ import annotations

import ast
import re
from pathlib import Path

from saxframe.operators.machine import Machine

FILE = Path(__file__).resolve().parent.parent / "FIXTURES.md"


def rows() -> list[tuple[str, bytes, int, int, str, str, bool]]:
    """(id, content, status, error, "line:col" or "", trace, whether namespaces are on)."""
    out = []
    section = ""
    for line in FILE.read_text().splitlines():
        if line.startswith("## "):
            section = line
        m = re.match(r"\| ([a-z]\d\d) \| (.*?) \| (?:`(.*)`|(\(zero bytes\)|`   `)|(`.*….*)) ?\| (\d) \| (\d+) \| (\S*) ?\| `(.*)` \|$", line)
        if not m:
            continue
        if m[1] == "d08":
            body = ("<r " + " ".join(f'a{k}="{k}"' for k in range(65)) + "/>").encode()
        elif m[3] is None:
            body = b""
        else:
            text = m[3].replace("\\|", "|")
            body = ast.literal_eval("b'''" + text.replace("'", "\\'") + "'''")
        out.append((m[1], body, int(m[6]), int(m[7]), m[8], m[9], "Namespaces" in section))
    return out


def trace(machine: Machine) -> str:
    out = []
    for kind, name, text, attrs, *_, more in machine.events:
        more = more or {}
        if kind == "start_element":
            out.append(" ".join([f"SE:{name}", *[f"{k}={v}" for k, v, *_ in attrs]]))
        elif kind == "end_element":
            out.append(f"EE:{name}")
        elif kind == "character_data":
            out.append(f"CD:{text}")
        elif kind == "processing_instruction":
            out.append(f"PI:{name}:{text}")
        elif kind == "comment":
            out.append(f"CM:{text}")
        elif kind in ("start_cdata", "end_cdata"):
            out.append({"start_cdata": "SCD", "end_cdata": "ECD"}[kind])
        elif kind == "start_doctype":
            out.append(f"SDT:{name}:{more['system_id'] or ''}:{more['public_id'] or ''}:{str(more['has_internal_subset']).lower()}")
        elif kind == "end_doctype":
            out.append("EDT")
        elif kind == "start_namespace":
            out.append(f"SNS:{name or ''}={more['ns_uri']}")
        elif kind == "end_namespace":
            out.append(f"ENS:{name or ''}")
    return ", ".join(out)


def unescaped(cell: str) -> str:
    return re.sub(r"\\u[0-9a-f]{4}|\\U[0-9a-f]{8}|\\x[0-9a-f]{2}|\\[ntr]", lambda m: ast.literal_eval(f"'{m[0]}'"), cell.replace("\\|", "|"))
