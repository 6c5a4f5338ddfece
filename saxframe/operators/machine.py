"""The event machine: bytes of one document in, events and a verdict out, resumable between any two bytes.

Whole-document lexing that needs no state is done in Catalyst (see lexing.py). What depends on what came
before - declared entities and defaults, open elements, namespaces, the first error - is done here, by one
instance per document, which streaming keeps as state.
"""

from __future__ import annotations

import codecs
import re
from dataclasses import dataclass, field, replace

from saxframe.functions import constants as C
from saxframe.functions.names import name_more, name_start

S = "[ \\t\\r\\n]"
NC = f"[{name_start()}][{name_more()}]*"
NAME = f"[:{name_start()}][:{name_more()}]*"
NMTOKEN = f"[:{name_more()}]+"
_name = re.compile(NAME)
_char = re.compile(f"[:{name_more()}]")
_tag = re.compile(f"<({NAME})((?:{S}+{NAME}{S}*={S}*(?:\"[^<\"]*\"|'[^<']*'))*){S}*(/?)>")
_attribute = re.compile(f"{S}+({NAME}){S}*={S}*(\"[^<\"]*\"|'[^<']*')")
_end = re.compile(f"</({NAME}){S}*>")
_ref = re.compile(f"&(?:#x([0-9a-fA-F]+)|#([0-9]+)|({NAME}));")
_pi = re.compile(f"<\\?({NAME})(?:{S}+(.*?))?\\?>", re.S)
_half_reference = re.compile(f"&(?:#x[0-9a-fA-F]*|#[0-9]*|{NAME})?")
_run = re.compile("[^<&]+")
# What most of a document is made of: tags whose values need no normalising, and text without references.
_plain = re.compile(f"<({NAME})((?:{S}+{NAME}{S}*={S}*(?:\"[^<\"&\\t\\r\\n]*\"|'[^<'&\\t\\r\\n]*'))*){S}*(/?)>|</({NAME}){S}*>|([^<&\\r]+)")
_pairs = re.compile("([^ \\t\\r\\n=]+)[ \\t\\r\\n]*=[ \\t\\r\\n]*(?:\"([^\"]*)\"|'([^']*)')")
_bad = re.compile("[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\ud800-\\udfff\\ufffe\\uffff]")
_space = re.compile(f"{S}+")
_piece = re.compile(f"&(?:#x([0-9a-fA-F]+)|#([0-9]+)|({NAME}));|(\\r\\n|[\\t\\r\\n])|([^&\\t\\r\\n]+)|(&)")
_public = re.compile(r"[^ \r\na-zA-Z0-9\-'()+,./:=?;!*#@$_%]")
_xml_decl = re.compile(f"<\\?xml(?:{S}+version{S}*={S}*(?:\"([a-zA-Z0-9_.:-]+)\"|'([a-zA-Z0-9_.:-]+)'))?(?:{S}+encoding{S}*={S}*(?:\"([A-Za-z][A-Za-z0-9._-]*)\"|'([A-Za-z][A-Za-z0-9._-]*)'))?(?:{S}+standalone{S}*={S}*(?:\"(yes|no)\"|'(yes|no)'))?{S}*\\?>")
# A whole declaration of the subset: literals and comments may hold what would end it.
_decl = re.compile("<!(?:[^\"'<>]|\"[^\"]*\"|'[^']*')*>")
_other = re.compile("<!(?!(?:ENTITY|ATTLIST|ELEMENT|NOTATION)[ \\t\\r\\n])[A-Za-z_:]+[ \\t\\r\\n]")
_lit = "(\"[^\"]*\"|'[^']*')"
_external = f"(?:SYSTEM{S}+{_lit}|PUBLIC{S}+{_lit}{S}+{_lit})"
_doctype = re.compile(f"<!DOCTYPE{S}+({NAME})(?:{S}+{_external})?{S}*([\\[>])")
_entity = re.compile(f"<!ENTITY{S}+(%{S}+)?({NAME}){S}+(?:{_lit}|{_external}(?:{S}+NDATA{S}+({NAME}))?){S}*>")
_notation = re.compile(f"<!NOTATION{S}+({NAME}){S}+(?:SYSTEM{S}+{_lit}|PUBLIC{S}+{_lit}(?:{S}+{_lit})?){S}*>")
_element = re.compile(f"<!ELEMENT{S}+({NAME}){S}+(EMPTY|ANY|\\(.*\\)[?*+]?){S}*>", re.S)
_attlist = re.compile(f"<!ATTLIST{S}+({NAME})(.*?){S}*>$", re.S)
_att = re.compile(f"{S}+({NAME}){S}+(CDATA|IDREFS|IDREF|ID|ENTITIES|ENTITY|NMTOKENS|NMTOKEN|NOTATION{S}*\\([^)]*\\)|\\([^)]*\\)){S}+(?:(#REQUIRED|#IMPLIED)|(#FIXED{S}+)?{_lit})")
_pe = re.compile(f"%({NAME});")
_value_piece = re.compile(f"&#x([0-9a-fA-F]+);|&#([0-9]+);|(&{NAME};)|%({NAME});|(\\r\\n?)|([^&%\\r]+)|([&%])")
LATIN = {"ISO-8859-1", "LATIN1", "ISO8859-1"}
BUILT_IN = {"UTF-8": "utf-8", "UTF8": "utf-8", "US-ASCII": "ascii", "ASCII": "ascii", "ISO-8859-1": "latin-1", "UTF-16": "utf-16", "UTF-16LE": "utf-16-le", "UTF-16BE": "utf-16-be"}


class Stop(Exception):  # noqa: N818
    """The first error: its code, and where, as an offset in the text at hand (None: where the token begins)."""

    def __init__(self, code: int, at: int | None = None) -> None:
        self.code, self.at = code, at


@dataclass
class Options:
    """What a caller may set before the first byte; after it, nothing changes."""

    encoding: str | None = None
    namespaces: bool = False
    separator: str = " "
    triplets: bool = False
    #: 0 never reads parameter entities and external subsets, 1 unless the document is standalone, 2 always.
    param_entities: int = 0
    foreign_dtd: str | None = None
    base: str | None = None
    max_amplification: float = C.MAX_AMPLIFICATION
    activation_bytes: int = C.ACTIVATION_BYTES
    #: Contents of external entities by system id; what isn't there is skipped, or an error if strict.
    store: dict[str, bytes] = field(default_factory=dict)
    strict_entities: bool = False
    reject_not_standalone: bool = False
    expand_entities: bool = True
    #: Further encodings: for a name, its Python codec or the code points of the 256 bytes (-1: none), or
    #: these and a function from bytes to a code point, for characters of 2 to 4 bytes (-2 to -4).
    encodings: dict[str, str | list[int] | tuple] = field(default_factory=dict)
    #: Events after which a document is stopped: for good, or suspended until resume().
    stop_after: int | None = None
    resumable: bool = False
    #: Whether a token that goes on beyond the input is tried again only when twice as much has come in.
    reparse_deferral: bool = True

    def __post_init__(self) -> None:
        if self.max_amplification != self.max_amplification or self.max_amplification < 1 and self.max_amplification != 0:
            raise ValueError("max_amplification must be 0 or at least 1")
        if self.max_amplification == 0:
            self.max_amplification = C.MAX_AMPLIFICATION
        for name, points in self.encodings.items():
            if not isinstance(points, str):
                points, convert = points if isinstance(points, tuple) else (points, None)
                if convert is None and any(p < -1 for p in points):
                    raise ValueError(f"{name}: a function is needed for characters of several bytes")
                if len(points) != 256 or any(not -4 <= p <= 0xFFFF for p in points):
                    raise ValueError(f"{name}: 256 code points up to 65535 are needed")
                if any(points[b] != b for b in b"\t\n\r !\"#%&'()*+,-./0123456789:;<=>?ABCDEFGHIJKLMNOPQRSTUVWXYZ[]_abcdefghijklmnopqrstuvwxyz|"):
                    raise ValueError(f"{name}: the characters of markup must stand for themselves")


def known_encoding(name: str, options: Options) -> str | list[int] | None:
    custom = {k.upper(): v for k, v in options.encodings.items()}
    return custom.get(name.upper()) or BUILT_IN.get(name.upper())


class Decoder:
    """Bytes to text, piece by piece; remembers what it could not decode instead of raising."""

    def __init__(self, kind: str | list[int]) -> None:
        self.points, self.convert = (None, None) if isinstance(kind, str) else kind if isinstance(kind, tuple) else (kind, None)
        self.name = "custom" if self.points else kind
        self.rest = b""
        self.code = 0
        self.widths: dict[str, int] = {}

    def __call__(self, data: bytes, final: bool) -> str:
        if self.code:
            return ""
        data, self.rest = self.rest + data, b""
        if self.points:
            out, at = [], 0
            while at < len(data):
                point, width = self.points[data[at]], 1
                if point < -1:
                    width = -point
                    if at + width > len(data):
                        self.rest = data[at:]
                        break
                    point = self.convert(data[at : at + width])
                if point < 0:
                    self.code = C.INVALID_TOKEN
                    break
                out.append(chr(point))
                self.widths[chr(point)] = width
                at += width
            if final and self.rest and not self.code:
                self.code = C.PARTIAL_CHAR
            return "".join(out)
        decode = codecs.getincrementaldecoder(self.name)("strict")
        try:
            text = decode.decode(data, False)
        except UnicodeDecodeError as e:
            self.code = C.INVALID_TOKEN
            return data[: e.start].decode(self.name)
        self.rest = decode.getstate()[0]
        if final and self.rest:
            self.code = C.PARTIAL_CHAR
        return text

    def size(self, text: str) -> int:
        if self.convert:
            return sum(self.widths.get(c, 1) for c in text)
        if self.points or self.name in ("latin-1", "ascii") or text.isascii() and self.name == "utf-8":
            return len(text)
        return len(text.encode(self.name, "surrogatepass"))


@dataclass
class Accounting:
    direct: int = 0
    indirect: int = 0
    opened: int = 0
    deepest: int = 0


class Machine:
    """feed() bytes in order; events gather in .events until take(); .code is the verdict so far."""

    def __init__(self, options: Options | None = None, accounting: Accounting | None = None) -> None:
        self.o = options or Options()
        self.acc = accounting or Accounting()
        self.raw, self.decoder, self.text = b"", None, ""
        self.pos = 0
        self.line, self.col, self.byte = 1, 0, 0
        self.mark = 0  # offset in text of line, col, byte
        self.events: list[tuple] = []
        self.pieces: list[str] = []
        self.n_events = 0
        self.code = 0
        self.where = (1, 0, 0)
        self.phase = "start"
        self.stack: list[str] = []
        self.rooted = False
        self.cdata = False
        self.finished = False
        self.entities: dict[str, tuple] = {}
        self.params: dict[str, tuple] = {}
        self.attlists: dict[str, dict[str, tuple]] = {}
        self.standalone: int | None = None
        self.has_pe_refs = False
        self.keep = True
        self.doctype: tuple | None = None
        self.scope: dict[str, str] = {"xml": C.XML_URI}
        self.bound: list[tuple[int, str, str | None]] = []
        self.open: list[str] = []
        self.levels: list[int] = []
        self.encoding: str | None = None
        self.safe, self.narrow = 0, False
        self.stopped_at = 0
        #: input that waits for more of it, its bytes, and how much text was tried in vain
        self.later: list[bytes] = []
        self.n_later = self.tried = 0
        #: replacement texts being read: what was being read before each, from the document itself on
        self.frames: list[tuple] = []
        #: where in pieces the text began that no markup has ended yet, None after markup
        self.run: int | None = None
        self.leased: bytearray | None = None
        #: texts of the subset being read: [text, place, open sections]
        self.subsets: list[list] = []

    # -- input ------------------------------------------------------------------------------------

    def feed(self, data: bytes, final: bool = False) -> int:
        """Status 1 or 0. After an error or the final piece, further input changes nothing but the code (finished)."""
        if self.code:
            return 0
        if self.finished:
            self.code = C.FINISHED
            return 0
        self.acc.direct += len(data)
        self.finished = final
        try:
            if self.decoder is None:
                self.raw += data
                if not self._detect(final):
                    return 1
                data, self.raw = self.raw, b""
            self.later.append(data)
            self.n_later += len(data)
            if not final and self.o.reparse_deferral and len(self.text) - self.pos + self.n_later < 2 * self.tried:
                return 1
            data = b"".join(self.later)
            self.later, self.n_later = [], 0
            self._move(self.pos)
            self.text = self.text[self.pos :] + self.decoder(data, final)
            self.mark -= self.pos
            self.pos = 0
            # found once for each piece of input: how far it is free of illegal characters, and whether a character is a byte
            unsafe = _bad.search(self.text)
            self.safe = unsafe.start() if unsafe else len(self.text)
            self.narrow = not self.decoder.convert and (self.text.isascii() if self.decoder.name == "utf-8" else self.decoder.size("\u00e9") == 1)
            self._parse(final)
            self.tried = 0 if self.pos else len(self.text)
        except Stop as e:
            self._fail(e)
        if self.code or final:
            self._whole()
        return 0 if self.code else 1

    def _fail(self, e: Stop) -> None:
        """An error in replacement text counts where the document refers to it."""
        at = e.at
        if self.frames:
            self.text, self.pos, self.mark, *_ = self.frames[0]
            self.frames, at = [], None
        self._stop(e.code, self.pos if at is None else at)

    def reset(self) -> None:
        """Clears everything but the options, for another document."""
        self.__init__(self.o)

    def stop(self, resumable: bool = False) -> int:
        """Stops between two feeds: 1 if that can be done, else 0 and .code says why not."""
        if self.decoder is None and not self.raw and not self.finished:
            self.code = C.NOT_STARTED
        elif self.code == C.SUSPENDED and not resumable:
            self.code = C.ABORTED
            return 1
        elif self.code or self.finished:
            self.code = self.code or C.FINISHED
        else:
            self.code = C.SUSPENDED if resumable else C.ABORTED
            return 1
        return 0

    def use_foreign_dtd(self, system_id: str) -> int:
        """0, or the code for a change once input has come in."""
        if self.decoder is not None or self.raw or self.finished:
            return C.CANT_CHANGE_FEATURE
        self.o = replace(self.o, foreign_dtd=system_id)
        return 0

    def lease(self, size: int) -> bytearray:
        """A buffer to fill; feed_leased() takes it."""
        self.leased = bytearray(size)
        return self.leased

    def feed_leased(self, size: int, final: bool = False) -> int:
        if self.leased is None or size > len(self.leased):
            self.code = self.code or C.NO_BUFFER
            return 0
        data, self.leased = bytes(self.leased[:size]), None
        return self.feed(data, final)

    def resume(self) -> int:
        """Goes on after stop_after events; the limit counts anew from here."""
        if self.code != C.SUSPENDED:
            self.code = self.code or C.NOT_SUSPENDED
            return 0
        self.code, self.stopped_at = 0, self.n_events + len(self.events)
        try:
            self._parse(self.finished)
        except Stop as e:
            self._fail(e)
        if self.code or self.finished:
            self._whole()
        return 0 if self.code else 1

    def _limit(self) -> bool:
        return self.o.stop_after is not None and self.n_events + len(self.events) - self.stopped_at >= self.o.stop_after

    def _stop(self, code: int, at: int) -> None:
        self.code = code
        self._move(at)
        self.where = (self.line, self.col, self.byte)

    def _detect(self, final: bool) -> bool:
        raw = self.raw
        if not final and len(raw) < 4 and not (self.o.encoding and raw):
            return False
        kind, skip = None, 0
        if raw.startswith(b"\xef\xbb\xbf"):
            kind, skip = "utf-8", 3
        elif raw.startswith(b"\xff\xfe"):
            kind, skip = "utf-16-le", 2
        elif raw.startswith(b"\xfe\xff"):
            kind, skip = "utf-16-be", 2
        elif raw[:2] == b"<\0":
            kind = "utf-16-le"
        elif raw[:2] == b"\0<":
            kind = "utf-16-be"
        named = self.o.encoding
        if named:
            found = known_encoding(named, self.o)
            if found is None:
                self.byte = 0
                raise Stop(C.UNKNOWN_ENCODING, 0)
            if found == "utf-16":
                found = kind if kind and kind.startswith("utf-16") else "utf-16-be"
            kind = found
            if skip and (kind == "utf-8") != (skip == 3):
                skip = 0
        elif kind is None or skip == 3:
            if not final and len(raw) < skip + 6 and b"<?xml".startswith(raw[skip : skip + 5]):
                return False
            if raw[skip : skip + 5] == b"<?xml" and (raw[skip + 5 : skip + 6] in (b" ", b"\t", b"\r", b"\n") or not final and len(raw) == skip + 5):
                end = raw.find(b"?>")
                if end < 0 and not final:
                    return False
                m = _xml_decl.match(raw[skip : end + 2].decode("latin-1")) if end >= 0 else None
                name = m and (m[3] or m[4])
                if name:
                    found = known_encoding(name, self.o)
                    if found is None:
                        self.events.append(self._row("unknown_encoding", encoding=name))
                        raise Stop(C.UNKNOWN_ENCODING, len(m[0][: m.start(3) if m[3] else m.start(4)]))
                    if not isinstance(found, str) or not found.startswith("utf-16"):
                        if skip and found != "utf-8":
                            raise Stop(C.INCORRECT_ENCODING, 0)
                        kind = found
        self.decoder = Decoder(kind or "utf-8")
        self.raw = raw[skip:]
        self.byte = skip
        return True

    # -- positions and events -----------------------------------------------------------------------

    def _move(self, to: int) -> None:
        part = self.text[self.mark : to]
        if part:
            self.byte += self.decoder.size(part)
            lines = part.count("\n")
            if "\r" in part:
                lines = part.replace("\r\n", "\n").replace("\r", "\n").count("\n")
                part = part.replace("\r", "\n")
            if lines:
                self.line += lines
                self.col = len(part) - part.rfind("\n") - 1
            else:
                self.col += len(part)
            self.mark = to

    def _row(self, kind: str, name=None, text=None, attrs=None, size=None, **more) -> tuple:
        return (kind, name, text, attrs, len(self.stack), self.byte, self.line, self.col, size, tuple(self.open), more or None)

    def emit(self, kind: str, name=None, text=None, attrs=None, **more) -> None:
        """Adjacent character data is one event: its pieces gather until another event comes."""
        if kind == "character_data":
            if not self.pieces:
                if not self.open:
                    self._move(self.pos)
                self.events.append(self._row(kind))
            self.pieces.append(text)
            return
        self._whole()
        if not self.open:
            self._move(self.pos)
        self.events.append(self._row(kind, name, text, attrs, **more))

    def _whole(self) -> None:
        if self.pieces:
            last = self.events[-1]
            self.events[-1] = (*last[:2], "".join(self.pieces), *last[3:])
            self.pieces = []

    def take(self) -> list[tuple]:
        """The events so far; what may still grow (character data at the end) stays unless the input is over."""
        held = []
        if self.code or self.finished:
            self._whole()
        elif self.pieces:
            held = [self.events.pop()]
        out, self.events = self.events, held
        self.n_events += len(out)
        return out

    def _check(self, text: str, at: int) -> None:
        bad = _bad.search(text)
        if bad:
            raise Stop(C.INVALID_TOKEN, at + bad.start())

    # -- document ----------------------------------------------------------------------------------

    def _parse(self, final: bool) -> None:
        text = self.text
        if self.phase == "start":
            if not final and len(text) < 6 and "<?xml".startswith(text[:5]):
                return
            if text.startswith("<?xml") and (len(text) == 5 or text[5] in " \t\r\n?"):
                end = text.find("?>")
                if end < 0 and not final:
                    return
                if end >= 0:
                    self._declaration(text[: end + 2])
                    self.pos = end + 2
            self.phase = "prolog"
        while True:
            before = self.pos
            if self.frames:
                self._in_frame()
                continue
            if self._limit():
                raise Stop(C.SUSPENDED if self.o.resumable else C.ABORTED)
            if self.phase == "prolog":
                more = self._prolog(final)
            elif self.phase == "subset":
                more = self._subset(final)
            elif self.phase == "content":
                more = self._content(final)
            else:
                more = self._epilog(final)
            if not more:
                break
            if self.pos == before and self.phase == "epilog" and self.pos >= len(self.text):
                break
        if final:
            if self.decoder.code:
                raise Stop(self.decoder.code, len(self.text))
            if self.phase == "subset":
                raise Stop(C.UNCLOSED_TOKEN if self.pos < len(text) else C.NO_ELEMENTS, None)
            if self.phase in ("start", "prolog") or self.phase == "content":
                if self.cdata:
                    raise Stop(C.UNCLOSED_CDATA)
                end = len(text)
                if text.endswith("\r") and self.stack:
                    end -= 1
                raise Stop(C.NO_ELEMENTS, end)
        elif self.decoder.code:
            # everything before it has been read, or waits for what can't come
            raise Stop(self.decoder.code, len(self.text))

    def _declaration(self, text: str) -> None:
        m = _xml_decl.fullmatch(text)
        if not m or not (m[1] or m[2]):
            raise Stop(C.XML_DECL, self._decl_error(text))
        name = m[3] or m[4]
        wide = self.decoder.name.startswith("utf-16")
        if name and not self.o.encoding:
            found = known_encoding(name, self.o)
            says_wide = isinstance(found, str) and found.startswith("utf-16")
            if found is not None and says_wide != wide:
                raise Stop(C.INCORRECT_ENCODING, m.start(3) if m[3] else m.start(4))
            if found is None:
                self.emit("unknown_encoding", encoding=name)
                raise Stop(C.UNKNOWN_ENCODING, m.start(3) if m[3] else m.start(4))
        alone = m[5] or m[6]
        self.standalone = None if alone is None else int(alone == "yes")
        self.encoding = name
        self.emit("xml_decl", version=m[1] or m[2], encoding=name, standalone=self.standalone)

    @staticmethod
    def _decl_error(text: str) -> int:
        m = re.match(f"<\\?xml{S}*", text)
        return m.end()

    def _blank(self) -> None:
        m = _space.match(self.text, self.pos)
        if m:
            self.pos = m.end()

    def _misc(self, final: bool) -> bool | None:
        """A comment or processing instruction at pos: True if read, False if it isn't one, None if more is needed."""
        text, at = self.text, self.pos
        if text.startswith("<!--", at):
            return self._comment(final)
        if text.startswith("<?", at):
            return self._instruction(final)
        short = text[at : at + 4]
        if not final and ("<!--".startswith(short) or short == "<"):
            return None
        return False

    def _comment(self, final: bool) -> bool | None:
        text, at = self.text, self.pos
        end = text.find("--", at + 4)
        if end < 0 or end + 2 >= len(text):
            self._check(text[at + 4 : end if end >= 0 else len(text)], at + 4)
            return self._wait(final)
        self._check(text[at + 4 : end], at + 4)
        if text[end + 2] != ">":
            raise Stop(C.INVALID_TOKEN, end + 2)
        self.emit("comment", text=text[at + 4 : end].replace("\r\n", "\n").replace("\r", "\n"))
        self.pos = end + 3
        return True

    def _instruction(self, final: bool) -> bool | None:
        text, at = self.text, self.pos
        m = _name.match(text, at + 2)
        if not m:
            if at + 2 >= len(text):
                return self._wait(final)
            raise Stop(C.INVALID_TOKEN, at + 2)
        after = m.end()
        if after >= len(text):
            return self._wait(final)
        if text[after] not in " \t\r\n?":
            raise Stop(C.INVALID_TOKEN, after)
        if m[0].lower() == "xml":
            if m[0] != "xml":
                raise Stop(C.INVALID_TOKEN, after)
            end = text.find("?>", after)
            if end < 0:
                return self._wait(final)
            raise Stop(C.JUNK_AFTER_ROOT if self.phase == "epilog" else C.MISPLACED_XML_PI)
        end = text.find("?>", after)
        if end < 0:
            self._check(text[after:], after)
            return self._wait(final)
        if text[after] == "?" and end != after:
            raise Stop(C.INVALID_TOKEN, after + 1)
        self._check(text[after:end], after)
        body = text[after:end].lstrip(" \t\r\n").replace("\r\n", "\n").replace("\r", "\n")
        self.emit("processing_instruction", m[0], body)
        self.pos = end + 2
        return True

    def _wait(self, final: bool, code: int = C.UNCLOSED_TOKEN) -> None:
        """The token at pos goes on beyond the text: more is awaited, or at the end it is an error."""
        if self.decoder.code == C.INVALID_TOKEN:
            raise Stop(self.decoder.code, len(self.text))
        if final:
            if self.decoder.code:
                raise Stop(self.decoder.code, len(self.text))
            raise Stop(code)

    def _prolog(self, final: bool) -> bool:
        self._blank()
        text, at = self.text, self.pos
        if at >= len(text):
            return False
        got = self._misc(final)
        if got or got is None:
            return bool(got)
        if text[at] != "<":
            self._junk(at, final, C.SYNTAX)
            return False
        if text.startswith("<!", at):
            if "<!DOCTYPE".startswith(text[at : at + 9]) and len(text) < at + 9:
                self._wait(final)
                return False
            if self.doctype or not text.startswith("<!DOCTYPE", at):
                self._odd_declaration(at, final)
                return False
            return self._doctype(final)
        if at + 1 >= len(text):
            self._wait(final)
            return False
        if not _name.match(text, at + 1):
            raise Stop(C.INVALID_TOKEN, at + 1)
        self._begin_content()
        return True

    def _begin_content(self) -> None:
        if self.doctype is None and self.o.foreign_dtd is not None and self.o.param_entities:
            self._external_subset(self.o.foreign_dtd, None)
        self.phase = "content"

    def _odd_declaration(self, at: int, final: bool) -> None:
        kind, end = dtd_token(self.text, at, final)
        if kind == "wait":
            self._wait(final)
        elif kind == "invalid":
            raise Stop(C.INVALID_TOKEN, end)
        else:
            raise Stop(C.SYNTAX, at)

    def _junk(self, at: int, final: bool, code: int) -> None:
        """What may not stand outside the root: an error of its own kind if it isn't even a token."""
        kind, end = dtd_token(self.text, at, final)
        if kind == "wait":
            if final and not self.decoder.code:
                raise Stop(C.UNCLOSED_TOKEN, at)
            self._wait(final)
        elif kind == "invalid":
            raise Stop(C.INVALID_TOKEN, end)
        else:
            raise Stop(C.PARAM_ENTITY_REF if kind == "pe_ref" and code == C.SYNTAX else code, at)

    def _cut_short(self, at: int) -> None:
        """The end of the input inside a declaration: the first thing that is no token, or no elements."""
        text, begin = self.text, at
        while at < len(text):
            kind, end = dtd_token(text, at, True)
            if kind == "wait":
                raise Stop(C.UNCLOSED_TOKEN, at)
            if kind == "invalid":
                raise Stop(C.INVALID_TOKEN, end)
            if kind in ("instance", "section_open", "section_close") or at > begin and kind in ("declaration", "pi"):
                raise Stop(C.SYNTAX, at)
            at = end
        raise Stop(C.NO_ELEMENTS, len(text))

    def _doctype(self, final: bool) -> bool:
        text, at = self.text, self.pos
        m = _doctype.match(text, at)
        if not m:
            end = _decl.match(text, at) or re.match("<!DOCTYPE(?:[^\"'<>\\[]|\"[^\"]*\"|'[^']*')*\\[", text[at:])
            if not end:
                if final and not self.decoder.code:
                    self._cut_short(at)
                self._wait(final)
                return False
            raise Stop(C.SYNTAX, at + len("<!DOCTYPE"))
        system, public = m[2] or m[4], m[3]
        if public:
            self._public(public[1:-1], m.start(3) + 1)
        system, public = system and system[1:-1], public and " ".join(public[1:-1].split())
        inside = m[5] == "["
        self.doctype = (m[1], system, public)
        self.has_pe_refs = system is not None
        self.emit("start_doctype", m[1], system_id=system, public_id=public, has_internal_subset=inside)
        self.pos = m.end()
        if inside:
            self.phase = "subset"
        else:
            self._end_doctype()
        return True

    def _public(self, text: str, at: int) -> None:
        bad = _public.search(text)
        if bad:
            raise Stop(C.PUBLIC_ID, at + bad.start())

    def _end_doctype(self) -> None:
        _, system, public = self.doctype
        if system is not None or self.has_pe_refs:
            if self.standalone != 1 and self.o.reject_not_standalone:
                self.emit("not_standalone")
                raise Stop(C.NOT_STANDALONE)
            if self.standalone != 1:
                self.emit("not_standalone")
        if system is not None and (self.o.param_entities == 2 or self.o.param_entities == 1 and self.standalone != 1):
            self._external_subset(system, public)
        self.emit("end_doctype")
        self.phase = "prolog"

    def _external_subset(self, system: str, public: str | None) -> None:
        self.emit("external_entity_ref", None, system_id=system, public_id=public, base=self.o.base)
        got = self.o.store.get(system)
        if got is None:
            if self.o.strict_entities:
                raise Stop(C.EXTERNAL_ENTITY_HANDLING)
            self.keep = self.standalone == 1
            return
        self._read_subset(self._outside(got), external=True)

    def _outside(self, data: bytes) -> str:
        """The text of an external entity, its text declaration reported and taken off."""
        self._account(len(data))
        reader = Machine(Options(encodings=self.o.encodings))
        reader.raw = data
        reader._detect(True)
        text = reader.decoder(reader.raw, True)
        if reader.decoder.code:
            raise Stop(C.EXTERNAL_ENTITY_HANDLING)
        if text.startswith("<?xml") and text[5:6] in (" ", "\t", "\r", "\n"):
            end = text.find("?>")
            m = _xml_decl.fullmatch(text[: end + 2])
            if not m or not (m[3] or m[4]) or m[5] or m[6]:
                raise Stop(C.EXTERNAL_ENTITY_HANDLING)
            self.emit("xml_decl", version=m[1] or m[2], encoding=m[3] or m[4], standalone=None)
            text = text[end + 2 :]
        return text.replace("\r\n", "\n").replace("\r", "\n")

    # -- declarations --------------------------------------------------------------------------------

    def _subset(self, final: bool) -> bool:
        self._blank()
        text, at = self.text, self.pos
        if at >= len(text):
            return False
        if text[at] == "]":
            if text.startswith("]]", at):
                if text[at + 2 : at + 3] in ("", ">"):
                    self._junk(at, final, C.SYNTAX)
                    return False
                raise Stop(C.SYNTAX, at + 1)
            m = re.compile(f"\\]{S}*>").match(text, at)
            if not m:
                gap = _space.match(text, at + 1)
                after = gap.end() if gap else at + 1
                if after == len(text):
                    if final and not self.decoder.code:
                        raise Stop(C.NO_ELEMENTS, after)
                    self._wait(final)
                elif re.match(f"<\\?xml(?:{S}|\\?)", text[after:]):
                    raise Stop(C.MISPLACED_XML_PI, after)
                else:
                    self._junk(after, final, C.SYNTAX)
                return False
            self.pos = m.end() - 1
            self._end_doctype()
            self.pos = m.end()
            return True
        got = self._misc(final)
        if got or got is None:
            return bool(got)
        if text[at] == "%":
            m = _pe.match(text, at)
            if not m:
                self._junk(at, final, C.SYNTAX)
                return False
            level = len(self.subsets)
            self._reference_pe(m[1])
            if len(self.subsets) > level:
                value = self.subsets.pop()[0]
                self._read_subset(value, external=True)
                self.open.pop()
            self.pos = m.end()
            return True
        m = _decl.match(text, at)
        odd = _other.match(text, at)
        if odd:
            raise Stop(C.SYNTAX)
        if not m:
            if text[at] != "<":
                self._junk(at, final, C.SYNTAX)
                return False
            if final and not self.decoder.code:
                self._cut_short(at)
            self._wait(final)
            return False
        kind, end = dtd_token(text, at, final)
        if kind == "invalid":
            raise Stop(C.INVALID_TOKEN, end)
        if kind == "section_open":
            raise Stop(C.SYNTAX)
        self._declare(m[0], at, False)
        self.pos = m.end()
        return True

    def _reference_pe(self, name: str) -> None:
        self.has_pe_refs = True
        got = self.params.get(name)
        if not self.o.param_entities or got is None:
            if got is None and self.standalone == 1:
                raise Stop(C.UNDEFINED_ENTITY)
            self.emit("skipped_entity", name, is_param=True)
            self.keep = self.standalone == 1
            return
        if "%" + name in self.open:
            raise Stop(C.RECURSIVE_ENTITY)
        value, system, public = got
        if value is None:
            self.emit("external_entity_ref", name, system_id=system, public_id=public, base=self.o.base)
            data = self.o.store.get(system)
            if data is None:
                if self.o.strict_entities:
                    raise Stop(C.EXTERNAL_ENTITY_HANDLING)
                self.keep = self.standalone == 1
                return
            value = self._outside(data)
        else:
            self._account(len(value.encode("utf-8", "surrogatepass")))
        self._enter("%" + name)
        self.subsets.append([value, 0, 0])

    def _enter(self, name: str) -> None:
        self._move(self.pos) if not self.open else None
        self.open.append(name)
        self.acc.opened += 1
        self.acc.deepest = max(self.acc.deepest, len(self.open))

    def _account(self, n: int) -> None:
        self.acc.indirect += n
        direct, total = self.acc.direct, self.acc.direct + self.acc.indirect
        factor = total / direct if direct else (C.SMALLEST_INPUT + self.acc.indirect) / C.SMALLEST_INPUT
        if total >= self.o.activation_bytes and factor > self.o.max_amplification:
            raise Stop(C.AMPLIFICATION)

    def _read_subset(self, text: str, external: bool) -> None:
        """Declarations of an external subset or of a parameter entity's text; errors count where it is referred to.

        What a reference in it stands for is read next, on a list of texts: no depth of entities is too deep.
        """
        floor = len(self.subsets)
        self.subsets.append([text, 0, 0])
        while len(self.subsets) > floor:
            here = self.subsets[-1]
            at, depth = self._read_some(*here, external)
            here[1:] = at, depth
            if self.subsets[-1] is here:
                if depth:
                    raise Stop(C.INCOMPLETE_PE)
                self.subsets.pop()
                if len(self.subsets) > floor:
                    self.open.pop()

    def _read_some(self, text: str, at: int, depth: int, external: bool) -> tuple[int, int]:
        """Declarations up to the end or to a reference that is to be read first."""
        n, held = len(text), len(self.subsets)
        while at < n and len(self.subsets) == held:
            m = _space.match(text, at)
            if m:
                at = m.end()
                continue
            if text.startswith("]]>", at) and depth:
                depth -= 1
                at += 3
            elif text.startswith("<!--", at):
                end = text.find("-->", at + 4)
                if end < 0:
                    raise Stop(C.INCOMPLETE_PE)
                self.emit("comment", text=text[at + 4 : end])
                at = end + 3
            elif m := _pi.match(text, at):
                self.emit("processing_instruction", m[1], m[2] or "")
                at = m.end()
            elif m := _pe.match(text, at):
                self._reference_pe(m[1])
                at = m.end()
            elif text.startswith("<![", at):
                head = re.compile(f"<!\\[{S}*(?:%({NAME});|(INCLUDE|IGNORE)){S}*\\[").match(text, at)
                if not head:
                    raise Stop(C.SYNTAX)
                word = head[2] or ((self.params.get(head[1]) or ("",))[0] or "").strip()
                at = head.end()
                if word == "INCLUDE":
                    depth += 1
                elif word == "IGNORE":
                    level = 1
                    for m in re.compile(r"<!\[|\]\]>").finditer(text, at):
                        level += 1 if m[0] == "<![" else -1
                        if not level:
                            at = m.end()
                            break
                    else:
                        raise Stop(C.SYNTAX)
                else:
                    raise Stop(C.SYNTAX)
            elif m := _decl.match(text, at):
                body = m[0]
                if external and not body.startswith("<!ENTITY"):
                    body = self._expand_params(body)
                self._declare(body, None, external)
                at = m.end()
            else:
                raise Stop(C.SYNTAX if text[at] != "<" else C.INCOMPLETE_PE)
        return at, depth

    def _expand_params(self, text: str) -> str:
        """References to internal parameter entities inside a declaration, replaced with a space on both sides."""
        seen = 0
        while m := _pe.search(text):
            got = self.params.get(m[1])
            if got is None or got[0] is None:
                raise Stop(C.UNDEFINED_ENTITY)
            self._account(len(got[0].encode("utf-8", "surrogatepass")))
            text = f"{text[: m.start()]} {got[0]} {text[m.end() :]}"
            seen += 1
            if seen > 10_000:
                raise Stop(C.RECURSIVE_ENTITY)
        return text

    def _declare(self, text: str, at: int | None, external: bool) -> None:
        where = (lambda k: None) if at is None else (lambda k: at + k)
        self._check(text, at if at is not None else self.pos)
        if text.startswith("<!ENTITY"):
            m = _entity.fullmatch(text)
            if not m:
                raise Stop(C.SYNTAX, where(8))
            self._declare_entity(m, where, external)
        elif text.startswith("<!ATTLIST"):
            m = _attlist.fullmatch(text)
            if not m:
                raise Stop(C.SYNTAX, where(9))
            self._declare_attributes(m, where)
        elif text.startswith("<!ELEMENT"):
            m = _element.fullmatch(text)
            if not m:
                raise Stop(C.PARAM_ENTITY_REF if not external and _pe.search(text) else C.SYNTAX, where(9))
            odd: list[int] = []
            if content_model(m[2], odd) is None:
                raise Stop(C.PARAM_ENTITY_REF if not external and _pe.search(text) else C.SYNTAX, where(m.start(2) + (odd or [0])[0]))
            self.emit("element_decl", m[1], value="".join(m[2].split()))
        elif text.startswith("<!NOTATION"):
            m = _notation.fullmatch(text)
            if not m:
                raise Stop(C.SYNTAX, where(10))
            if m[3]:
                self._public(m[3][1:-1], where(m.start(3) + 1))
            system, public = m[2] or m[4], m[3]
            self.emit("notation_decl", m[1], system_id=system and system[1:-1], public_id=public and " ".join(public[1:-1].split()), base=self.o.base)
        else:
            raise Stop(C.SYNTAX, where(0))

    def _declare_entity(self, m: re.Match, where, external: bool) -> None:
        param, name, literal = bool(m[1]), m[2], m[3]
        system, public, note = m[4] or m[6], m[5], m[7]
        if param and note:
            raise Stop(C.SYNTAX, where(m.start(7)))
        if public:
            self._public(public[1:-1], where(m.start(5) + 1))
        system, public = system and system[1:-1], public and " ".join(public[1:-1].split())
        value = None if literal is None else self._entity_value(literal[1:-1], external, where(m.start(3)))
        if not self.keep:
            return
        into = self.params if param else self.entities
        fresh = name not in into and (param or name not in C.PREDEFINED)
        if fresh:
            into[name] = (value, system, public) if param else (value, system, public, note)
            if note:
                self.emit("unparsed_entity_decl", name, system_id=system, public_id=public, notation=note, base=self.o.base)
            else:
                self.emit("entity_decl", name, value=value, is_param=param, system_id=system, public_id=public, base=self.o.base)

    def _entity_value(self, text: str, external: bool, at: int | None) -> str:
        out = []
        for m in _value_piece.finditer(text):
            if m[1] or m[2]:
                out.append(self._character(m[1], m[2], None if at is None else at + 1 + m.start()))
            elif m[3] or m[6]:
                out.append(m[3] or m[6])
            elif m[4]:
                if not external:
                    raise Stop(C.PARAM_ENTITY_REF, at)
                got = self.params.get(m[4])
                if got is None:
                    raise Stop(C.UNDEFINED_ENTITY, at)
                if "%" + m[4] in self.open:
                    raise Stop(C.RECURSIVE_ENTITY, at)
                value = got[0] if got[0] is not None else self._outside(self.o.store[got[1]]) if got[1] in self.o.store else ""
                self._account(len(value.encode("utf-8", "surrogatepass")))
                self._enter("%" + m[4])
                out.append(self._entity_value(value, True, at) if got[0] is None else value)
                self.open.pop()
            elif m[5]:
                out.append("\n")
            else:
                raise Stop(C.INVALID_TOKEN, None if at is None else at + 1 + m.start())
        return "".join(out)

    def _character(self, hexa: str | None, deci: str | None, at: int | None) -> str:
        digits = (hexa or deci).lstrip("0") or "0"
        n = int(digits, 16 if hexa else 10) if len(digits) < 9 else 1 << 30
        if n > 0x10FFFF or 0xD800 <= n < 0xE000 or n in (0xFFFE, 0xFFFF) or n < 32 and n not in (9, 10, 13):
            raise Stop(C.BAD_CHAR_REF, at)
        return chr(n)

    def _declare_attributes(self, m: re.Match, where) -> None:
        element, body, at = m[1], m[2], 0
        while at < len(body) and body[at:].strip(" \t\r\n"):
            a = _att.match(body, at)
            if not a:
                raise Stop(C.SYNTAX, where(m.start(2) + at))
            name, kind = a[1], "".join(a[2].split())
            if a[2].startswith("NOTATION"):
                kind = "NOTATION" + kind[8:]
            default = None
            if a[5]:
                base = m.start(2) + a.start(5)
                default = self._value(a[5][1:-1], kind, where(base), default=True)
            if self.keep:
                known = self.attlists.setdefault(element, {})
                if name not in known:
                    known[name] = (kind, default)
                self.emit("attlist_decl", element, attribute=name, att_type=kind, default_value=default, required=a[3] == "#REQUIRED" or bool(a[4]))
            at = a.end()

    # -- content -----------------------------------------------------------------------------------

    def _content(self, final: bool) -> bool:
        """One token of the document's own content."""
        text, at = self.text, self.pos
        if at >= len(text):
            return False
        if self.cdata:
            return self._cdata(final)
        if self.stack and text[at] != "\r" and self.o.stop_after is None and not (self.open or self.attlists or self.o.namespaces):
            self._plain_content(final)
            if self.phase != "content" or self.pos >= len(text):
                return self.pos > at
            at = self.pos
        c = text[at]
        if c == "<":
            two = text[at : at + 2]
            if two == "<":
                self._wait(final)
                return False
            if two == "</":
                return self._end_tag(final)
            if two == "<?":
                return bool(self._instruction(final))
            if two == "<!":
                if text.startswith("<!--", at):
                    return bool(self._comment(final))
                if text.startswith("<![CDATA[", at):
                    self.emit("start_cdata")
                    self.cdata = True
                    self.pos = at + 9
                    return True
                short = text[at : at + 9]
                if "<!--".startswith(short) or "<![CDATA[".startswith(short):
                    self._wait(final)
                    return False
                k = next(k for k in range(2, len(short) + 1) if not ("<!--".startswith(short[: k + 1]) or "<![CDATA[".startswith(short[: k + 1])))
                raise Stop(C.INVALID_TOKEN, at + k)
            return self._start_tag(final)
        if c == "&":
            m = _ref.match(text, at)
            if not m:
                return self._odd_reference(at, final)
            self.run = None
            depth = len(self.frames)
            self._reference(m)
            if len(self.frames) == depth:
                self.pos = m.end()
            return True
        m = _run.match(text, at)
        end = m.end()
        closes = text.find("]]>", at, end)
        if closes >= 0:
            self._check(text[at:closes], at)
            if closes > at:
                self._said(text[at:closes])
            self._unsay()
            raise Stop(C.INVALID_TOKEN, closes + 2)
        if end == len(text) and not final:
            tail = 2 if text.endswith("]]") else 1 if text[-1] in "]\r" else 0
            end -= tail
            if end <= at:
                return False
        bad = _bad.search(text, at, end)
        if bad:
            if bad.start() > at:
                self.emit("character_data", text=lines(text[at : bad.start()]))
            raise Stop(C.INVALID_TOKEN, bad.start())
        self._said(text[at:end])
        self.pos = end
        if end < len(text) and text[end] in "<&":
            self.run = None
        return end < len(text)

    def _said(self, text: str) -> None:
        if self.run is None or not self.pieces:
            self.run = len(self.pieces)
        self.emit("character_data", text=lines(text))

    def _unsay(self) -> None:
        """Takes back the line of text that an illegal end of a section stands on: it is one token with it."""
        if self.run is None or not self.pieces:
            return
        text = "".join(self.pieces[self.run :])
        self.pieces[self.run :] = [text[: text.rfind("\n") + 1]]
        self.run = None
        if not "".join(self.pieces):
            self.pieces = []
            self.events.pop()

    def _plain_content(self, final: bool) -> None:
        """Plain tags and text from pos on, in one loop; it leaves what is anything else, and all errors, to the rest."""
        text, stack, out, match = self.text, self.stack, self.events, _plain.match
        n, pos = self.safe, self.pos
        self._move(pos)
        line, col, byte, narrow = self.line, self.col, self.byte, self.narrow
        while pos < n:
            m = match(text, pos)
            if m is None:
                m = _ref.match(text, pos)
                if m is None or m[3] not in C.PREDEFINED:
                    break
            end = m.end()
            if end > n:
                break
            which = m.lastindex
            if m.re is _ref:
                if not self.pieces:
                    out.append(("character_data", None, None, None, len(stack), byte, line, col, None, (), None))
                self.pieces.append(C.PREDEFINED[m[3]])
            elif which == 5:
                if end == len(text) and not final or text.find("]]>", pos, end) >= 0:
                    break
                piece = m[5]
                if self.pieces:
                    self.pieces.append(piece)
                else:
                    out.append(("character_data", None, None, None, len(stack), byte, line, col, None, (), None))
                    self.pieces.append(piece)
            elif which == 4:
                name = m[4]
                if stack[-1] != name:
                    break
                if self.pieces:
                    self._whole()
                out.append(("end_element", name, None, None, len(stack), byte, line, col, None, (), None))
                stack.pop()
            else:
                attrs = []
                if m.end(2) > m.start(2):
                    attrs = [(k, a or b, True, "CDATA") for k, a, b in _pairs.findall(text, m.start(2), m.end(2))]
                    if len(attrs) > 1 and len({a[0] for a in attrs}) < len(attrs):
                        break
                if self.pieces:
                    self._whole()
                name = m[1]
                stack.append(name)
                out.append(("start_element", name, None, attrs, len(stack), byte, line, col, end - pos, (), None))
                if m[3]:
                    out.append(("end_element", name, None, None, len(stack), byte, line, col, None, (), None))
                    stack.pop()
            byte += end - pos if narrow else self.decoder.size(text[pos:end])
            breaks = text.count("\n", pos, end)
            if breaks:
                line += breaks
                col = end - text.rfind("\n", pos, end) - 1
            else:
                col += end - pos
            pos = end
            if not stack:
                self.phase = "epilog"
                break
        if pos > self.pos:
            self.run = None
        self.pos = self.mark = pos
        self.line, self.col, self.byte = line, col, byte

    def _cdata(self, final: bool) -> bool:
        text, at = self.text, self.pos
        end = text.find("]]>", at)
        stop = end
        if end < 0:
            stop = len(text)
            # brackets may begin the end; at the end of the input they are no text either
            stop -= 2 if text.endswith("]]") else 1 if text.endswith("]") or text.endswith("\r") else 0
        bad = _bad.search(text, at, stop)
        if bad:
            stop = bad.start()
        if stop > at:
            self.emit("character_data", text=lines(text[at:stop]))
        if bad:
            raise Stop(C.INVALID_TOKEN, stop)
        self.pos = stop
        if end < 0:
            return False
        self.emit("end_cdata")
        self.cdata = False
        self.pos = end + 3
        return True

    def _odd_reference(self, at: int, final: bool) -> bool:
        text = self.text
        m = re.compile(f"&(?:#x[0-9a-fA-F]*|#[0-9]*|{NAME})?").match(text, at)
        if m.end() >= len(text):
            self._wait(final)
            return False
        raise Stop(C.INVALID_TOKEN, m.end())

    def _start_tag(self, final: bool) -> bool:
        text, at = self.text, self.pos
        m = _tag.match(text, at)
        if not m:
            self._odd_tag(at, final)
            return False
        if _bad.search(m[0]):
            raise Stop(C.INVALID_TOKEN, at + _bad.search(m[0]).start())
        pairs = [(a[1], a[2], a.start(1)) for a in _attribute.finditer(text, m.start(2), m.end(2))] if m[2] else []
        self._open_element(m[1], pairs, bool(m[3]), len(m[0]))
        self.pos = m.end()
        if not self.stack:
            self.phase = "epilog"
        return True

    def _odd_tag(self, at: int, final: bool) -> None:
        """Where a start tag breaks the rules, or that it isn't complete."""
        text, n = self.text, len(self.text)
        m = _name.match(text, at + 1)
        if not m:
            raise Stop(C.INVALID_TOKEN, at + 1)
        k = m.end()
        names = set()
        while k < n:
            gap = _space.match(text, k)
            after = gap.end() if gap else k
            if after >= n:
                break
            if text[after] == ">":
                raise Stop(C.INVALID_TOKEN, after)
            if text[after] == "/":
                if after + 1 < n:
                    raise Stop(C.INVALID_TOKEN, after + 1)
                break
            m = _name.match(text, after)
            if not gap or not m:
                raise Stop(C.INVALID_TOKEN, after)
            names.add(m[0])
            k = m.end()
            eq = re.compile(f"{S}*=?{S}*").match(text, k)
            if "=" not in eq[0]:
                if eq.end() >= n:
                    break
                raise Stop(C.INVALID_TOKEN, eq.end())
            k = eq.end()
            if k >= n:
                break
            if text[k] not in "\"'":
                raise Stop(C.INVALID_TOKEN, k)
            close = text.find(text[k], k + 1)
            less = text.find("<", k + 1, close if close >= 0 else n)
            if less >= 0:
                raise Stop(C.INVALID_TOKEN, less)
            if close < 0:
                break
            k = close + 1
        bad = _bad.search(text, at)
        if bad:
            raise Stop(C.INVALID_TOKEN, bad.start())
        self._wait(final)

    def _value(self, raw: str, kind: str, at: int | None, default: bool = False) -> str:
        """A normalised attribute value: white space, character and entity references, collapse of token types."""
        if "&" not in raw and not ("\n" in raw or "\t" in raw or "\r" in raw):
            out = raw
        else:
            parts: list[str] = []
            # the literal and, inside it, the replacement texts that are being read
            reading = [_piece.finditer(raw)]
            while reading:
                inside = len(reading) > 1
                m = next(reading[-1], None)
                if m is None:
                    reading.pop()
                    if inside:
                        self.open.pop()
                    continue
                spot = None if at is None or inside else at if default else at + 1 + m.start()
                if m[5]:
                    parts.append(m[5])
                elif m[4]:
                    parts.append(" " if not (inside and m[4] == "\r\n") else "  ")
                elif m[1] or m[2]:
                    parts.append(self._character(m[1], m[2], spot))
                elif m[6]:
                    odd = _half_reference.match(m.string, m.start())
                    raise Stop(C.INVALID_TOKEN, None if at is None or inside else at + 1 + odd.end())
                elif m[3] in C.PREDEFINED:
                    parts.append(C.PREDEFINED[m[3]])
                else:
                    text = self._value_entity(m[3], spot, default)
                    if text is not None:
                        reading.append(_piece.finditer(text))
            out = "".join(parts)
        if kind != "CDATA":
            out = " ".join(out.split(" ")).strip(" ") if "  " not in out else " ".join(x for x in out.split(" ") if x)
        return out

    def _value_entity(self, name: str, at: int | None, default: bool) -> str | None:
        """The replacement text of an entity in an attribute value, which is then open; None if it is skipped."""
        got = self.entities.get(name)
        if got is None:
            if self.has_pe_refs and self.standalone != 1:
                self.emit("skipped_entity", name, is_param=False)
                return None
            raise Stop(C.UNDEFINED_ENTITY, at if default else None)
        if name in self.open:
            raise Stop(C.RECURSIVE_ENTITY, at)
        value, _, _, note = got
        if note:
            raise Stop(C.BINARY_ENTITY_REF, at)
        if value is None:
            raise Stop(C.ATTRIBUTE_EXTERNAL_REF, at)
        if "<" in value:
            raise Stop(C.INVALID_TOKEN)
        self._account(len(value.encode("utf-8", "surrogatepass")))
        self._enter(name)
        return value

    def _open_element(self, name: str, pairs: list[tuple[str, str, int]], empty: bool, size: int) -> None:
        declared = self.attlists.get(name, {})
        attrs, seen = [], set()
        for key, literal, at in pairs:
            kind = declared[key][0] if key in declared else "CDATA"
            value = self._value(literal[1:-1], kind, None if self.open else self.text.find(literal[0], at + len(key)))
            if key in seen:
                raise Stop(C.DUPLICATE_ATTRIBUTE, None if self.open else at)
            seen.add(key)
            attrs.append((key, value, True, kind))
        for key, (kind, default) in declared.items():
            if key not in seen and default is not None:
                attrs.append((key, default, False, kind))
        specified = 2 * len(pairs)
        ids = next((2 * k for k, a in enumerate(attrs) if a[3] == "ID"), -1)
        shown = name
        if self.o.namespaces:
            mark = len(self.bound)
            self.stack.append(name)
            try:
                shown, attrs = self._namespaces(name, attrs)
            except Stop:
                if empty:
                    self._unbind(mark)
                raise
            finally:
                self.stack.pop()
        self.stack.append(name)
        self.emit("start_element", shown, attrs=attrs, n_specified=specified, id_index=ids, size=size)
        self.rooted = True
        if empty:
            self.emit("end_element", shown)
            self.stack.pop()
            if self.o.namespaces:
                self._unbind(mark)

    def _namespaces(self, name: str, attrs: list[tuple]) -> tuple[str, list[tuple]]:
        rest, level = [], len(self.stack)
        for a in attrs:
            key, uri = a[0], a[1]
            if key != "xmlns" and not key.startswith("xmlns:"):
                rest.append(a)
                continue
            prefix = key[6:]
            if key == "xmlns:xmlns":
                raise Stop(C.RESERVED_XMLNS)
            if prefix and not uri:
                raise Stop(C.UNDECLARING_PREFIX)
            if prefix == "xml" and uri != C.XML_URI:
                raise Stop(C.RESERVED_XML)
            if uri == C.XMLNS_URI or uri == C.XML_URI and prefix != "xml":
                raise Stop(C.RESERVED_URI)
            if self.o.separator and self.o.separator in uri and not re.fullmatch(r"[A-Za-z0-9\-._~:/?#\[\]@!$&'()*+,;=%]", self.o.separator):
                raise Stop(C.SYNTAX)
            self.bound.append((level, prefix, self.scope.get(prefix)))
            self.scope[prefix] = uri
            self.emit("start_namespace", prefix or None, ns_uri=uri)
        shown = self._expanded(name, True)
        out, seen = [], set()
        for a in rest:
            key = self._expanded(a[0], False)
            if key in seen:
                raise Stop(C.DUPLICATE_ATTRIBUTE)
            seen.add(key.rsplit(self.o.separator, 1)[0] if self.o.triplets and key.count(self.o.separator) > 1 else key)
            out.append((key, *a[1:]))
        return shown, out

    def _expanded(self, name: str, element: bool) -> str:
        sep = self.o.separator
        if ":" not in name:
            uri = self.scope.get("") if element else None
            return f"{uri}{sep}{name}" if uri else name
        prefix, local = name.split(":", 1)
        if not prefix or not local or ":" in local or not re.match(f"[{name_start()}]", local):
            raise Stop(C.INVALID_TOKEN)
        uri = self.scope.get(prefix)
        if uri is None:
            raise Stop(C.UNBOUND_PREFIX)
        return f"{uri}{sep}{local}{sep}{prefix}" if self.o.triplets else f"{uri}{sep}{local}"

    def _unbind(self, mark: int) -> None:
        while len(self.bound) > mark:
            _, prefix, before = self.bound.pop()
            if before is None:
                del self.scope[prefix]
            else:
                self.scope[prefix] = before
            self.emit("end_namespace", prefix or None)

    def _end_tag(self, final: bool) -> bool:
        text, at = self.text, self.pos
        m = _end.match(text, at)
        if not m:
            name = _name.match(text, at + 2)
            k = name.end() if name else at + 2
            if name:
                gap = _space.match(text, k)
                k = gap.end() if gap else k
            if k >= len(text):
                self._wait(final)
                return False
            raise Stop(C.INVALID_TOKEN, k)
        self._close_element(m[1], at)
        self.pos = m.end()
        if not self.stack:
            self.phase = "epilog"
        return True

    def _close_element(self, name: str, at: int | None) -> None:
        if self.levels and len(self.stack) <= self.levels[-1]:
            raise Stop(C.ASYNC_ENTITY)
        if not self.stack or self.stack[-1] != name:
            raise Stop(C.TAG_MISMATCH, None if at is None else at + 2)
        self.emit("end_element", self._expanded(name, True) if self.o.namespaces else name)
        level = len(self.stack)
        self.stack.pop()
        if self.o.namespaces:
            mark = len(self.bound)
            while mark and self.bound[mark - 1][0] == level:
                mark -= 1
            self._unbind(mark)

    def _reference(self, m: re.Match) -> None:
        at = None if self.open else m.start()
        if m[1] or m[2]:
            self.emit("character_data", text=self._character(m[1], m[2], at))
            return
        name = m[3]
        if name in C.PREDEFINED:
            self.emit("character_data", text=C.PREDEFINED[name])
            return
        got = self.entities.get(name)
        if got is None:
            if self.has_pe_refs and self.standalone != 1:
                self.emit("skipped_entity", name, is_param=False)
                return
            raise Stop(C.UNDEFINED_ENTITY, at)
        if name in self.open:
            raise Stop(C.RECURSIVE_ENTITY)
        value, system, public, note = got
        if note:
            raise Stop(C.BINARY_ENTITY_REF, at)
        if not self.o.expand_entities:
            self.emit("skipped_entity", name, is_param=False)
            return
        if value is None:
            self.emit("external_entity_ref", name, system_id=system, public_id=public, base=self.o.base)
            data = self.o.store.get(system)
            if data is None:
                if self.o.strict_entities:
                    raise Stop(C.EXTERNAL_ENTITY_HANDLING)
                self.emit("skipped_entity", name, is_param=False)
                return
            value = self._outside(data)
        else:
            self._account(len(value.encode("utf-8", "surrogatepass")))
        self._move(self.pos) if not self.open else None
        self._enter(name)
        # the reference is read: what follows it waits, with the place to report for anything inside
        self.frames.append((self.text, self.pos, self.mark, m.end(), self.cdata, self.safe))
        self.text, self.pos, self.mark = value, 0, 0
        self.levels.append(len(self.stack))

    def _in_frame(self) -> None:
        """One token of the replacement text at hand, or its end: what it opens it must close."""
        if self.pos < len(self.text):
            before, depth = self.pos, len(self.frames)
            self._content(True)
            self.phase = "content"
            if self.pos > before or len(self.frames) > depth:
                return
        if self.cdata:
            raise Stop(C.UNCLOSED_CDATA)
        if len(self.stack) != self.levels[-1]:
            raise Stop(C.ASYNC_ENTITY)
        self.levels.pop()
        self.text, _, self.mark, self.pos, self.cdata, self.safe = self.frames.pop()
        self.open.pop()
        if not self.stack and self.rooted and not self.open:
            self.phase = "epilog"

    def _epilog(self, final: bool) -> bool:
        self._blank()
        text, at = self.text, self.pos
        if at >= len(text):
            return False
        got = self._misc(final)
        if got or got is None:
            if got is None and final:
                raise Stop(C.UNCLOSED_TOKEN)
            return bool(got)
        self._junk(at, final, C.JUNK_AFTER_ROOT)
        return False


def dtd_token(text: str, at: int, final: bool) -> tuple[str, int]:
    """(kind, end) of the token of a prolog or declaration at a place: "invalid" with where, "wait" if it may go on."""
    n, c = len(text), text[at]
    if c in " \t\r\n":
        return "space", _space.match(text, at).end()
    if c in "\"'":
        end = text.find(c, at + 1)
        bad = _bad.search(text, at + 1, end if end >= 0 else n)
        if bad:
            return "invalid", bad.start()
        if end < 0:
            return "wait", n
        if end + 1 >= n:
            return ("literal", n) if final else ("wait", n)
        return ("literal", end + 1) if text[end + 1] in " \t\r\n>%[" else ("invalid", end + 1)
    if c == "<":
        if at + 1 >= n:
            return "wait", n
        if text[at + 1] == "!":
            return _declaration_open(text, at, final)
        if text[at + 1] == "?":
            end = text.find("?>", at + 2)
            return ("pi", end + 2) if end >= 0 else ("wait", n)
        return ("instance", at) if _name.match(text, at + 1) else ("invalid", at + 1)
    if c == "%":
        if at + 1 >= n:
            return "wait", n
        if text[at + 1] in " \t\r\n%":
            return "percent", at + 1
        m = _name.match(text, at + 1)
        if not m:
            return "invalid", at + 1
        if m.end() >= n:
            return "wait", n
        return ("pe_ref", m.end() + 1) if text[m.end()] == ";" else ("invalid", m.end())
    if c == "#":
        if at + 1 >= n:
            return "wait", n
        m = _name.match(text, at + 1)
        if not m:
            return "invalid", at + 1
        return _ended(text, m.end(), final, " \t\r\n)>%|", "pound_name")
    if c == ")":
        end = at + 2 if text[at + 1 : at + 2] in ("?", "*", "+") else at + 1
        return ("close_paren", end) if end > at + 1 else _ended(text, end, final, " \t\r\n>,|)", "close_paren")
    if c == "]":
        if text[at : at + 3] == "]]" or not final and text[at : at + 3] == "]":
            return "wait", n
        return ("section_close", at + 3) if text.startswith("]]>", at) else ("close_bracket", at + 1)
    if c in ",|>([":
        return c, at + 1
    m = re.compile(NMTOKEN).match(text, at)
    if not m:
        return "invalid", at
    if m.end() < n and text[m.end()] in "?*+" and _name.match(text, at):
        return "name", m.end() + 1
    return _ended(text, m.end(), final, " \t\r\n>),|[%", "name")


def _ended(text: str, end: int, final: bool, after: str, kind: str) -> tuple[str, int]:
    """A token that only certain characters may follow."""
    if end >= len(text):
        return (kind, end) if final else ("wait", end)
    return (kind, end) if text[end] in after else ("invalid", end)


def _declaration_open(text: str, at: int, final: bool) -> tuple[str, int]:
    n = len(text)
    if text.startswith("<!--", at):
        end = text.find("--", at + 4)
        bad = _bad.search(text, at + 4, end if end >= 0 else n)
        if bad:
            return "invalid", bad.start()
        if end < 0 or end + 2 >= n:
            return "wait", n
        return ("comment", end + 3) if text[end + 2] == ">" else ("invalid", end + 2)
    if text.startswith("<![", at):
        return "section_open", at + 3
    m = re.compile("<!(?:-|[A-Za-z_:][A-Za-z_:]*)?").match(text, at)
    if m.end() >= n:
        return "wait", n
    if m.end() == at + 2 or text[at + 2] == "-":
        return "invalid", m.end()
    if text[m.end()] == "%":
        if m.end() + 1 >= n:
            return "wait", n
        return ("declaration", m.end()) if text[m.end() + 1] not in " \t\r\n%" else ("invalid", m.end())
    return ("declaration", m.end()) if text[m.end()] in " \t\r\n" else ("invalid", m.end())


def lines(text: str) -> str:
    return text.replace("\r\n", "\n").replace("\r", "\n") if "\r" in text else text


_model = re.compile(f"{S}*(?:(\\()|(\\))([?*+]?)|([,|])|(#PCDATA)|({NAME})([?*+]?)){S}*")


def _fail(m: re.Match, odd: list[int] | None) -> None:
    if odd is not None:
        odd.append(m.end() - len(m[0].lstrip(" \t\r\n")))


def content_model(text: str, odd: list[int] | None = None) -> list[tuple[int, int | None, int, int, int, str | None]] | None:
    """(node, parent, ordinal, type, quantifier, name) of a content model, breadth below parents; None if it isn't one, and then where in odd."""
    if text in ("EMPTY", "ANY"):
        return [(0, None, 0, C.CONTENT_TYPES[text], 0, None)]
    nodes: list[list] = []
    stack: list[int] = []
    marks: dict[int, str] = {}
    children: dict[int, int] = {}
    at, want = 0, True
    while at < len(text):
        m = _model.match(text, at)
        if not m:
            return None
        at = m.end()
        if m[1] or m[5] or m[6]:
            if not want or not stack and (nodes or not m[1]):
                return _fail(m, odd)
            parent = stack[-1] if stack else None
            ordinal = children.get(parent, 0)
            children[parent] = ordinal + 1
            if m[5]:
                if ordinal or len(stack) != 1:
                    return _fail(m, odd)
                nodes[parent][3] = C.CONTENT_TYPES["MIXED"]
                children[parent] = 0
            else:
                nodes.append([len(nodes), parent, ordinal, C.CONTENT_TYPES["NAME" if m[6] else "SEQ"], C.QUANTIFIERS[m[7] or ""], m[6]])
            if m[1]:
                stack.append(len(nodes) - 1)
            want = bool(m[1])
        elif m[4]:
            if want or not stack or marks.setdefault(stack[-1], m[4]) != m[4]:
                return _fail(m, odd)
            want = True
            if m[4] == "|" and nodes[stack[-1]][3] == C.CONTENT_TYPES["SEQ"]:
                nodes[stack[-1]][3] = C.CONTENT_TYPES["CHOICE"]
            elif m[4] == "," and nodes[stack[-1]][3] == C.CONTENT_TYPES["MIXED"]:
                return _fail(m, odd)
        else:
            if want or not stack:
                return _fail(m, odd)
            k = stack.pop()
            nodes[k][4] = C.QUANTIFIERS[m[3] or ""]
            if nodes[k][3] == C.CONTENT_TYPES["MIXED"] and children.get(k, 0) and m[3] != "*":
                return _fail(m, odd)
    return None if stack or want else [tuple(n) for n in nodes]


def parse(data: bytes, options: Options | None = None) -> Machine:
    machine = Machine(options)
    machine.feed(data, True)
    return machine
