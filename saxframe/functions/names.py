"""Name characters of XML 1.0, fourth edition, from the rule of its Appendix B.

The rule names Unicode categories of version 2.0 and exceptions. The oldest database at hand is 3.2, so
blocks that came after 2.0 are left out by range.
"""

from __future__ import annotations

from functools import cache
from unicodedata import ucd_3_2_0 as ucd

# Blocks of the Basic Multilingual Plane that are younger than Unicode 2.0.
YOUNGER = [(0x0700, 0x07BF), (0x0D80, 0x0DFF), (0x1000, 0x109F), (0x1200, 0x18AF), (0x2800, 0x2FFF), (0x31A0, 0x31BF), (0x31F0, 0x31FF), (0x3400, 0x4DBF), (0xA000, 0xA4CF), (0xFB1D, 0xFB1D)]
# The exceptions of Appendix B.
ALSO_START = {0x02BB, 0x02BC, 0x02BD, 0x02BE, 0x02BF, 0x02C0, 0x02C1, 0x0559, 0x06E5, 0x06E6}
ALSO_NAME = {0x00B7, 0x0387}
# Characters that the appendix leaves out though their category has them, most of them younger than Unicode 2.0.
LEFT_OUT = [
    (0x01F6, 0x01F9), (0x0218, 0x0220), (0x0222, 0x0233), (0x02A9, 0x02AD), (0x02EE, 0x02EE), (0x0346, 0x034F), (0x0362, 0x036F), (0x03D7, 0x03D9),
    (0x03DB, 0x03DB), (0x03DD, 0x03DD), (0x03DF, 0x03DF), (0x03E1, 0x03E1), (0x0400, 0x0400), (0x040D, 0x040D), (0x0450, 0x0450), (0x045D, 0x045D),
    (0x0488, 0x048F), (0x04C5, 0x04C6), (0x04C9, 0x04CA), (0x04CD, 0x04CE), (0x04EC, 0x04ED), (0x0500, 0x050F), (0x0653, 0x0655), (0x066E, 0x066F),
    (0x06B8, 0x06B9), (0x06BF, 0x06BF), (0x06CF, 0x06CF), (0x06FA, 0x06FC), (0x0950, 0x0950), (0x0AD0, 0x0AD0), (0x0E2F, 0x0E2F), (0x0EAF, 0x0EAF),
    (0x0F00, 0x0F00), (0x0F6A, 0x0F6A), (0x0F96, 0x0F96), (0x0FAE, 0x0FB0), (0x0FB8, 0x0FB8), (0x0FBA, 0x0FBC), (0x0FC6, 0x0FC6), (0x10F7, 0x10F8),
    (0x1101, 0x1101), (0x1104, 0x1104), (0x1108, 0x1108), (0x110A, 0x110A), (0x110D, 0x110D), (0x1113, 0x113B), (0x113D, 0x113D), (0x113F, 0x113F),
    (0x1141, 0x114B), (0x114D, 0x114D), (0x114F, 0x114F), (0x1151, 0x1153), (0x1156, 0x1158), (0x1162, 0x1162), (0x1164, 0x1164), (0x1166, 0x1166),
    (0x1168, 0x1168), (0x116A, 0x116C), (0x116F, 0x1171), (0x1174, 0x1174), (0x1176, 0x119D), (0x119F, 0x11A2), (0x11A9, 0x11AA), (0x11AC, 0x11AD),
    (0x11B0, 0x11B6), (0x11B9, 0x11B9), (0x11BB, 0x11BB), (0x11C3, 0x11EA), (0x11EC, 0x11EF), (0x11F1, 0x11F8), (0x20E2, 0x20EA), (0x2183, 0x2183),
    (0x3006, 0x3006), (0x303B, 0x303C), (0x3095, 0x3096),
]
# Letters and marks that the rule would drop, as compatibility characters or by category, and that the appendix keeps.
KEPT_START = [(0x03D0, 0x03D2), (0x03D5, 0x03D6), (0x03F0, 0x03F2), (0x0675, 0x0678), (0x0E33, 0x0E33), (0x0EB3, 0x0EB3), (0x1E9A, 0x1E9A), (0x212E, 0x212E)]
KEPT_NAME = [(0x06DD, 0x06DD), (0x0B83, 0x0B83), (0x0F77, 0x0F77), (0x0F79, 0x0F79), (0x0F88, 0x0F8B)]


def _classes() -> tuple[set[int], set[int]]:
    inside = lambda c, ranges: any(a <= c <= b for a, b in ranges)
    start, more = set(), set()
    for c in range(0x80, 0xF900):
        if inside(c, YOUNGER) or 0xD800 <= c < 0xE000 or inside(c, LEFT_OUT):
            continue
        kind, parts = ucd.category(chr(c)), ucd.decomposition(chr(c))
        if inside(c, KEPT_START):
            start.add(c)
        elif inside(c, KEPT_NAME):
            more.add(c)
        elif parts.startswith("<") or 0x20DD <= c <= 0x20E0:
            continue
        elif c in ALSO_START or kind in ("Ll", "Lu", "Lo", "Lt", "Nl"):
            start.add(c)
        elif c in ALSO_NAME or kind in ("Mc", "Me", "Mn", "Lm", "Nd"):
            more.add(c)
    return start, more


def _ranges(points: set[int]) -> str:
    out, at = [], sorted(points)
    k = 0
    while k < len(at):
        e = k
        while e + 1 < len(at) and at[e + 1] == at[e] + 1:
            e += 1
        out.append(f"\\u{at[k]:04X}" if e == k else f"\\u{at[k]:04X}-\\u{at[e]:04X}")
        k = e + 1
    return "".join(out)


@cache
def name_start() -> str:
    """The inside of a character class; no colon."""
    return "A-Za-z_" + _ranges(_classes()[0])


@cache
def name_more() -> str:
    return name_start() + r"0-9.\-" + _ranges(_classes()[1])
