"""Queries on what documents declare: doctype, entities, attributes, content, notations, namespaces, encodings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from saxframe.operators import documents as D
from saxframe.operators.machine import Options
from saxframe.plans.queries import _attr, _t, _text, query
from saxframe.sources.documents import from_table


def _parts(spark: SparkSession, sf_dir: str, content: Column, options: Options | None = None, **more) -> DataFrame:
    return D.parse_documents(from_table(_t(spark, sf_dir, "part"), "p_partkey", content), options, **more)


def _key() -> Column:
    return F.col("doc_id").cast("long").alias("p_partkey")


def _dtd(*declarations: str | Column) -> Column:
    return _text("<!DOCTYPE r [", *declarations, "]><r/>")


@query("SELECT p_partkey, p_brand AS name_, CASE WHEN p_partkey % 2 = 0 THEN p_type || '.dtd' END AS system_id, CASE WHEN p_partkey % 4 = 0 THEN '-//T//EN' END AS public_id, p_partkey % 3 = 0 AS inside, CAST(1 AS BIGINT) AS ends FROM (SELECT p_partkey, p_type, 'r' AS p_brand FROM part)")
def q_doctype_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    external = F.when(F.col("p_partkey") % 4 == 0, _text(" PUBLIC '-//T//EN' '", F.col("p_type"), ".dtd'")).when(F.col("p_partkey") % 2 == 0, _text(" SYSTEM '", F.col("p_type"), ".dtd'")).otherwise("")
    inside = F.when(F.col("p_partkey") % 3 == 0, " [<!-- -->]").otherwise("")
    parsed = _parts(spark, sf_dir, _text("<!DOCTYPE r", external, inside, "><r/>"), types=["start_doctype", "end_doctype"])
    e = F.element_at("events", 1)
    ends = F.size(F.filter("events", lambda x: x["event_type"] == "end_doctype")).cast("long")
    return parsed.select(_key(), e["name"].alias("name_"), e["system_id"].alias("system_id"), e["public_id"].alias("public_id"), e["has_internal_subset"].alias("inside"), ends.alias("ends"))


@query("SELECT p_partkey, '1.0' AS version, CASE WHEN p_partkey % 2 = 0 THEN 'UTF-8' END AS encoding, CAST(CASE p_partkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 0 END AS INT) AS standalone FROM part")
def q_xml_declaration(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    text = _text("<?xml version='1.0'", F.when(k % 2 == 0, " encoding='UTF-8'").otherwise(""), F.when(k % 3 == 0, " standalone='yes'").when(k % 3 == 1, " standalone='no'").otherwise(""), "?><r/>")
    parsed = _parts(spark, sf_dir, text, types=["xml_decl"], columns=["version", "encoding", "standalone"])
    return parsed.select(_key(), F.inline("events"))


@query(
    """SELECT p_partkey, 'entities' AS relation, 'a' AS name, p_brand AS value, CAST(NULL AS VARCHAR) AS system_id FROM part UNION ALL SELECT p_partkey, 'external_entities', 'b', NULL, p_type FROM part
 UNION ALL SELECT p_partkey, 'param_entities', 'c', '<!-- ' || p_size || ' -->', NULL FROM part UNION ALL SELECT p_partkey, 'unparsed_entities', 'd', 'n', p_name FROM part UNION ALL SELECT p_partkey, 'notations', 'n', NULL, 'm' FROM part"""
)
def q_entity_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = _dtd(
        "<!NOTATION n SYSTEM 'm'><!ENTITY a '", F.col("p_brand"), "'><!ENTITY a 'second'><!ENTITY b SYSTEM '", F.col("p_type"), "'><!ENTITY % c '<!-- ", F.col("p_size"), " -->'><!ENTITY d SYSTEM '", F.col("p_name"), "' NDATA n>"
    )
    tables = D.dtd(_parts(spark, sf_dir, text))
    null = F.lit(None).cast("string")
    has = {"entities": ("value", None), "external_entities": (None, "system_id"), "param_entities": ("value", "system_id"), "unparsed_entities": ("notation", "system_id"), "notations": (None, "system_id")}
    out = None
    for name, (value, system) in has.items():
        part = tables[name].select(_key(), F.lit(name).alias("relation"), "name", (F.col(value) if value else null).alias("value"), (F.col(system) if system else null).alias("system_id"))
        out = part if out is None else out.unionByName(part)
    return out


# Declared types as written and as reported, and whether a default may stand.
TYPES = [("CDATA", "CDATA"), ("ID", "ID"), ("IDREF", "IDREF"), ("IDREFS", "IDREFS"), ("ENTITY", "ENTITY"), ("ENTITIES", "ENTITIES"), ("NMTOKEN", "NMTOKEN"), ("NMTOKENS", "NMTOKENS"), ("( x | y )", "(x|y)"), ("NOTATION (n|m)", "NOTATION(n|m)")]
DEFAULTS = [("#IMPLIED", "NULL", "false"), ("#REQUIRED", "NULL", "true"), ("'x'", "'x'", "false"), ("#FIXED 'x'", "'x'", "true")]


@query(
    f"""SELECT p_partkey, CAST('a' AS VARCHAR) AS attribute, att_type, CAST(default_value AS VARCHAR) AS default_value, required FROM part
 JOIN (VALUES {', '.join(f"({n}, '{t[1]}')" for n, t in enumerate(TYPES))}) t(n, att_type) ON p_partkey % {len(TYPES)} = n
 JOIN (VALUES {', '.join(f"({n}, {d[1]}, {d[2]})" for n, d in enumerate(DEFAULTS))}) d(m, default_value, required) ON (p_partkey // {len(TYPES)}) % {len(DEFAULTS)} = m"""
)
def q_attribute_declarations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every declared type with every kind of default."""
    kind = F.element_at(F.array(*[F.lit(t[0]) for t in TYPES]), (F.col("p_partkey") % len(TYPES) + 1).cast("int"))
    default = F.element_at(F.array(*[F.lit(d[0]) for d in DEFAULTS]), (F.floor(F.col("p_partkey") / len(TYPES)) % len(DEFAULTS) + 1).cast("int"))
    found = D.dtd(_parts(spark, sf_dir, _dtd("<!ATTLIST r a ", kind, " ", default, ">")))["attlist"]
    return found.select(_key(), "attribute", "att_type", "default_value", "required")


# Content models as written, and of the root of each its type, quantifier and number of children.
MODELS = [("EMPTY", 1, 0, 0), ("ANY", 2, 0, 0), ("(#PCDATA)", 3, 0, 0), ("(#PCDATA|a|b)*", 3, 2, 2), ("(a,b)", 6, 0, 2), ("(a|b|c)?", 5, 1, 3), ("((a,b)|c+)*", 5, 2, 2), ("(a?,b*,(c|d)+)+", 6, 3, 3)]


@query(
    f"""SELECT p_partkey, CAST(t AS INT) AS type, CAST(q AS INT) AS quant, CAST(c AS BIGINT) AS children FROM part JOIN (VALUES {', '.join(f"({n}, {m[1]}, {m[2]}, {m[3]})" for n, m in enumerate(MODELS))}) v(n, t, q, c) ON p_partkey % {len(MODELS)} = n"""
)
def q_element_declarations(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = F.element_at(F.array(*[F.lit(m[0]) for m in MODELS]), (F.col("p_partkey") % len(MODELS) + 1).cast("int"))
    nodes = D.content_models(_parts(spark, sf_dir, _dtd("<!ELEMENT r ", model, ">")))
    root = F.col("parent_id").isNull()
    first = lambda c: F.max(F.when(root, F.col(c))).alias(c)
    return nodes.groupBy(_key()).agg(first("type"), first("quant"), F.sum(F.when(F.col("parent_id") == 0, 1).otherwise(0)).alias("children"))


@query("SELECT p_partkey, CAST(3 AS INT) AS n_attrs, CAST(4 AS INT) AS n_specified, CAST(2 AS INT) AS id_index, 'dv' AS missing FROM part")
def q_id_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = _text("<!DOCTYPE r [<!ATTLIST r i ID #IMPLIED d CDATA 'dv'>]><r b='1' i='k", F.col("p_partkey"), "'/>")
    e = D.events(_parts(spark, sf_dir, text, types=["start_element"], columns=["attrs", "n_specified", "id_index"]))
    return e.select(_key(), F.size("attrs").alias("n_attrs"), "n_specified", "id_index", _attr(F.col("attrs"), "d").alias("missing"))


@query(
    """SELECT p_partkey, CAST(seq AS BIGINT) AS seq, event_type, name, CAST(text AS VARCHAR) AS text, CAST(depth AS INT) AS depth FROM part, LATERAL (VALUES (0, 'start_element', 'r', NULL, 1), (1, 'comment', NULL, p_brand, 1), (2, 'start_cdata', NULL, NULL, 1),
 (3, 'character_data', NULL, '<' || p_type || '>', 1), (4, 'end_cdata', NULL, NULL, 1), (5, 'start_element', 'b', NULL, 2), (6, 'end_element', 'b', NULL, 2), (7, 'end_element', 'r', NULL, 1)) v(seq, event_type, name, text, depth)"""
)
def q_event_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = _text("<r><!--", F.col("p_brand"), "--><![CDATA[<", F.col("p_type"), ">]]><b/></r>")
    return D.events(_parts(spark, sf_dir, text)).select(_key(), "seq", "event_type", "name", "text", "depth")


@query(
    """SELECT p_partkey, prefix, uri, CAST(starts AS BIGINT) AS start_seq, CAST(ends AS BIGINT) AS end_seq FROM part, LATERAL (VALUES (NULL, 'd', 0, 9), ('p', 'u' || p_size, 1, 8), ('p', 'v', 3, 6)) v(prefix, uri, starts, ends)"""
)
def q_namespace_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scopes of prefixes as intervals of events."""
    text = _text("<r xmlns='d' xmlns:p='u", F.col("p_size"), "'><p:a xmlns:p='v'/></r>")
    found = D.namespace_bindings(_parts(spark, sf_dir, text, Options(namespaces=True)))
    return found.select(_key(), "prefix", "uri", "start_seq", "end_seq")


@query("SELECT p_partkey, 'u' || p_size || '|r|p' AS name, 'u' || p_size || '|a|p' AS attribute FROM part")
def q_namespace_triplets(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = _text("<p:r xmlns:p='u", F.col("p_size"), "' p:a='1'/>")
    e = D.events(_parts(spark, sf_dir, text, Options(namespaces=True, triplets=True, separator="|"), types=["start_element"], columns=["name", "attrs"]))
    return e.select(_key(), "name", F.col("attrs")[0]["name"].alias("attribute"))


_SUBSET = b"<?xml version='1.0' encoding='UTF-8'?><!ENTITY % yes 'INCLUDE'><!ENTITY % no 'IGNORE'><![%yes;[<!ENTITY e 'in'>]]><![%no;[<!ENTITY e 'out'><![INCLUDE[]]>]]><!ENTITY % more '<!ATTLIST r k NMTOKEN \"d\">'>%more;"


@query("SELECT p_partkey, 'd' AS k, 'in' || p_brand AS text, CAST(NULL AS VARCHAR) AS skipped, 'base' AS base FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT p_partkey, NULL, p_brand, 'e', NULL FROM part WHERE p_partkey % 2 = 1")
def q_parameter_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An external subset with parameter entities and conditional sections, read for even keys and never for odd ones."""
    text = _text("<!DOCTYPE r SYSTEM 's.dtd'><r>&e;", F.col("p_brand"), "</r>")
    out = None
    for rest, options in ((0, Options(param_entities=2, base="base", store={"s.dtd": _SUBSET})), (1, Options(store={"s.dtd": _SUBSET}))):
        docs = from_table(_t(spark, sf_dir, "part").where(F.col("p_partkey") % 2 == rest), "p_partkey", text)
        parsed = D.parse_documents(docs, options)
        of = lambda kind: F.filter("events", lambda e: e["event_type"] == kind)  # noqa: E731, B023
        one = lambda kind: F.try_element_at(of(kind), F.lit(1))
        said = F.array_join(F.transform(of("character_data"), lambda e: e["text"]), "")
        part = parsed.select(_key(), _attr(one("start_element")["attrs"], "k").alias("k"), said.alias("text"), one("skipped_entity")["name"].alias("skipped"), one("external_entity_ref")["base"].alias("base"))
        out = part if out is None else out.unionByName(part)
    return out


@query("SELECT p_partkey, CAST(CASE p_partkey % 3 WHEN 0 THEN 22 ELSE 0 END AS INT) AS error_code, CAST(CASE p_partkey % 3 WHEN 0 THEN 1 ELSE 0 END AS BIGINT) AS asked FROM part")
def q_not_standalone(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey") % 3
    text = _text(F.when(k == 1, "<?xml version='1.0' standalone='yes'?>").otherwise(""), "<!DOCTYPE r", F.when(k == 2, "").otherwise(" SYSTEM 's'"), "><r/>")
    parsed = _parts(spark, sf_dir, text, Options(reject_not_standalone=True), types=["not_standalone"], columns=["event_type"])
    return parsed.select(_key(), "error_code", F.size("events").cast("long").alias("asked"))


@query("SELECT p_partkey, CAST(0 AS INT) AS error_code, CASE WHEN p_partkey % 2 = 0 THEN 'Ж' ELSE 'é' END || p_brand AS text FROM part")
def q_custom_encodings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of code points for one encoding, and for every odd key the caller's word for another: it wins over the document's."""
    points = [*range(128), *[0x416 if b == 0xC6 else -1 for b in range(128, 256)]]
    own = F.concat(F.encode(F.lit("<?xml version='1.0' encoding='x-own'?><r>"), "UTF-8"), F.unhex(F.lit("C6")), F.encode(_text(F.col("p_brand"), "</r>"), "UTF-8"))
    latin = F.encode(_text("<r>é", F.col("p_brand"), "</r>"), "ISO-8859-1")
    part = _t(spark, sf_dir, "part").withColumn("even", F.col("p_partkey") % 2 == 0)
    docs = part.select(F.col("p_partkey").cast("string").alias("doc_id"), F.when(F.col("even"), own).otherwise(latin).alias("content"), F.when(~F.col("even"), "ISO-8859-1").alias("charset"))
    parsed = D.parse_documents(docs, Options(encodings={"x-own": points}), "charset", types=["character_data"], columns=["text"])
    return parsed.select(_key(), "error_code", F.element_at("events", 1)["text"].alias("text"))


@query("SELECT p_partkey, CAST(18 AS INT) AS error_code, 'x-none' AS encoding FROM part")
def q_unknown_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = _parts(spark, sf_dir, _text("<?xml version='1.0' encoding='x-none'?><r>", F.col("p_name"), "</r>"), types=["unknown_encoding"], columns=["encoding"])
    return parsed.select(_key(), "error_code", F.element_at("events", 1)["encoding"].alias("encoding"))


@query("SELECT p_partkey, 'fd' AS k, CAST('f.dtd' AS VARCHAR) AS system_id FROM part")
def q_foreign_dtd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A subset for documents that name none."""
    options = Options(param_entities=2, foreign_dtd="f.dtd", store={"f.dtd": b"<!ATTLIST r k CDATA 'fd'>"})
    parsed = _parts(spark, sf_dir, _text("<r>", F.col("p_name"), "</r>"), options)
    one = lambda kind: F.element_at(F.filter("events", lambda e: e["event_type"] == kind), 1)
    return parsed.select(_key(), _attr(one("start_element")["attrs"], "k").alias("k"), one("external_entity_ref")["system_id"].alias("system_id"))


@query("SELECT p_partkey, '-//A//B EN' AS public_id, p_type AS system_id FROM part")
def q_public_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """White space in a public identifier is one space."""
    found = D.dtd(_parts(spark, sf_dir, _dtd("<!NOTATION n PUBLIC ' -//A//B\n  EN ' '", F.col("p_type"), "'>")))["notations"]
    return found.select(_key(), "public_id", "system_id")
