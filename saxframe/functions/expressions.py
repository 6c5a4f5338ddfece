"""Scalar functions of the event model as Catalyst expressions: no Python runs for any of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from saxframe.functions import constants as C
from saxframe.functions.names import name_more, name_start

#: Tokens of content: comments, CDATA sections, instructions, tags, text. No lookaround, so RE2 reads it alike.
CONTENT_RE = r"(<!--(?s:.*?)-->|<!\[CDATA\[(?s:.*?)\]\]>|<\?(?s:.*?)\?>|<[^>]*>|[^<]+)"
ATTRIBUTE_RE = r"""([A-Za-z_:][-A-Za-z0-9_:.]*)\s*=\s*("[^"]*"|'[^']*')"""
REFERENCE_RE = r"(&#x[0-9A-Fa-f]+;|&#[0-9]+;|&[A-Za-z_:][-A-Za-z0-9_:.]*;)"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def detected_encoding(content: Column | str) -> Column:
    """From the first bytes: a byte order mark, or the zero bytes of UTF-16, else UTF-8."""
    head = F.hex(F.substring(_col(content), 1, 3))
    return (
        F.when(head == "EFBBBF", "UTF-8").when(head.startswith("FFFE"), "UTF-16LE").when(head.startswith("FEFF"), "UTF-16BE")
        .when(head.startswith("3C00"), "UTF-16LE").when(head.startswith("003C"), "UTF-16BE").otherwise("UTF-8")
    )


def declared_encoding(content: Column | str) -> Column:
    """The encoding that an XML declaration names, upper case; null without one."""
    head = F.decode(F.substring(_col(content), 1, 200), "ISO-8859-1")
    name = F.regexp_extract(head, r"""^(?:ï»¿)?<\?xml[^>]*\sencoding\s*=\s*["']([A-Za-z][A-Za-z0-9._-]*)["']""", 1)
    return F.when(name != "", F.upper(name))


def decoded(content: Column | str, encoding: Column | None = None) -> Column:
    """The document's text, without its byte order mark; the caller's encoding wins over what is found."""
    content = _col(content)
    kind = detected_encoding(content) if encoding is None else F.coalesce(encoding, detected_encoding(content))
    kind = F.when(kind == "UTF-8", F.coalesce(declared_encoding(content), kind)).otherwise(kind)
    marked = F.hex(F.substring(content, 1, 3))
    skip = F.when(marked == "EFBBBF", 3).when(marked.startswith("FFFE") | marked.startswith("FEFF"), 2).otherwise(0)
    body = F.substring(content, skip + 1, F.octet_length(content))
    return (
        F.when(kind == "UTF-16LE", F.decode(body, "UTF-16LE")).when(kind == "UTF-16BE", F.decode(body, "UTF-16BE"))
        .when(kind.isin("ISO-8859-1", "LATIN1"), F.decode(body, "ISO-8859-1")).otherwise(F.decode(body, "UTF-8"))
    )


def token_kind(raw: Column | str) -> Column:
    raw = _col(raw)
    return (
        F.when(raw.startswith("<!--"), "comment").when(raw.startswith("<![CDATA["), "cdata").when(raw.startswith("<!"), "decl")
        .when(raw.startswith("<?xml ") | raw.startswith("<?xml\t"), "xmldecl").when(raw.startswith("<?"), "pi").when(raw.startswith("</"), "end")
        .when(raw.startswith("<") & raw.endswith("/>"), "empty").when(raw.startswith("<"), "start").otherwise("text")
    )


def tag_name(raw: Column | str) -> Column:
    return F.regexp_extract(_col(raw), r"^</?([A-Za-z_:][-A-Za-z0-9_:.]*)", 1)


def attributes(raw: Column | str) -> Column:
    """The attributes of a start tag in order, duplicates included: array of (name, value), values as written."""
    raw = _col(raw)
    names, values = F.regexp_extract_all(raw, F.lit(ATTRIBUTE_RE), 1), F.regexp_extract_all(raw, F.lit(ATTRIBUTE_RE), 2)
    return F.zip_with(names, values, lambda n, v: F.struct(n.alias("name"), F.substring(v, F.lit(2), F.length(v) - 2).alias("value")))


def has_duplicate_attribute(attrs: Column | str) -> Column:
    names = F.transform(_col(attrs), lambda a: a["name"])
    return F.size(F.array_distinct(names)) < F.size(names)


def code_point(reference: Column | str) -> Column:
    """The number in a character reference, decimal or hexadecimal; null if the text isn't one."""
    reference = _col(reference)
    hexa, deci = F.regexp_extract(reference, r"^&#x([0-9A-Fa-f]{1,8});$", 1), F.regexp_extract(reference, r"^&#([0-9]{1,10});$", 1)
    return F.when(hexa != "", F.conv(hexa, 16, 10).cast("long")).when(deci != "", deci.cast("long"))


def legal_code_point(n: Column | str) -> Column:
    n = _col(n)
    return (n <= 0x10FFFF) & ~n.between(0xD800, 0xDFFF) & ~n.isin(0xFFFE, 0xFFFF) & ((n >= 32) | n.isin(9, 10, 13))


def character(n: Column | str) -> Column:
    """The character of a code point."""
    return F.decode(F.unhex(F.lpad(F.hex(_col(n)), 8, "0")), "UTF-32")


def resolved(text: Column | str, entities: dict[str, str] | None = None) -> Column:
    """Text with predefined, given and character references replaced, each once; others stay as written.

    The text is cut at its references; each piece is resolved on its own and the pieces are joined.
    """
    text = _col(text)
    known = {f"&{k};": v for k, v in (C.PREDEFINED | (entities or {})).items()}
    table = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    pieces = F.regexp_extract_all(text, F.lit(REFERENCE_RE[:-1] + "|[^&]+|&)"), 1)
    def one(p: Column) -> Column:
        n = code_point(p)
        return F.when(F.substring(p, 1, 1) != "&", p).when(n.isNotNull(), F.when(legal_code_point(n), character(n)).otherwise(p)).otherwise(F.coalesce(F.try_element_at(table, p), p))
    return F.array_join(F.transform(pieces, one), "")


def normal_lines(text: Column | str) -> Column:
    return F.regexp_replace(_col(text), r"\r\n?", "\n")


def normal_value(text: Column | str, entities: dict[str, str] | None = None, tokens: bool = False) -> Column:
    """An attribute value: white space characters become spaces, references are replaced, token types collapse."""
    out = resolved(F.regexp_replace(_col(text), r"\r\n|[\t\n\r]", " "), entities)
    return F.trim(F.regexp_replace(out, " +", " ")) if tokens else out


def is_public_id(text: Column | str) -> Column:
    return _col(text).rlike(r"^[ \r\na-zA-Z0-9\-'()+,./:=?;!*#@$_%]*$")


def is_name(text: Column | str) -> Column:
    return _col(text).rlike(f"^[:{name_start()}][:{name_more()}]*$")


def local_name(name: Column | str) -> Column:
    return F.element_at(F.split(_col(name), ":"), -1)


def prefix(name: Column | str) -> Column:
    name = _col(name)
    return F.when(name.contains(":"), F.substring_index(name, ":", 1))


def expanded_name(uri: Column | str, local: Column | str, pre: Column | None = None, separator: str = " ") -> Column:
    """uri and local name, and with a prefix the triplet; the local name alone without a uri."""
    parts = [_col(uri), _col(local)] + ([pre] if pre is not None else [])
    return F.when(_col(uri).isNull() | (_col(uri) == ""), _col(local)).otherwise(F.concat_ws(separator, *parts))


def stripped_triplet(name: Column | str, separator: str = " ") -> Column:
    return F.substring_index(_col(name), separator, 2)


def line_of(before: Column | str) -> Column:
    """The line, from 1, of what follows this text."""
    return F.length(F.regexp_replace(normal_lines(before), r"[^\n]+", "")) + 1


def column_of(before: Column | str) -> Column:
    """The column, from 0 and in code points, of what follows this text."""
    return F.length(F.substring_index(normal_lines(before), "\n", -1))


def amplification(direct: Column | str, indirect: Column | str) -> Column:
    direct, indirect = _col(direct), _col(indirect)
    least = C.SMALLEST_INPUT
    return F.when(direct > 0, (direct + indirect) / direct).otherwise((least + indirect) / F.lit(least))


def amplification_breached(direct: Column | str, indirect: Column | str, factor: float = C.MAX_AMPLIFICATION, threshold: int = C.ACTIVATION_BYTES) -> Column:
    return (_col(direct) + _col(indirect) >= threshold) & (amplification(direct, indirect) > factor)


def error_text(code: Column | str) -> Column:
    return F.element_at(F.array(*[F.lit(t) for t in C.ERRORS]), _col(code) + 1)


def error_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(C.ERRORS)), "error_code int, error string")


#: Optional abilities, in the order of the published list, with their values: 0 is what this engine does without.
FEATURES = [
    ("unicode", 0), ("dtd", 1), ("context bytes", 0), ("min size", 0), ("size of a character", 1), ("size of an error text character", 1), ("namespaces", 1), ("large size", 1), ("attribute info", 0),
    ("amplification limit: factor", int(C.MAX_AMPLIFICATION)), ("amplification limit: bytes", C.ACTIVATION_BYTES), ("general entities", 1), ("allocation limit: factor", 0), ("allocation limit: bytes", 0), ("end", 0),
]


def feature_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("version", ".".join(map(str, C.VERSION)))] + [(k, str(v)) for k, v in FEATURES], "feature string, value string")
