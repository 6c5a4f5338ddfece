"""Queries on verdicts, positions, input in pieces, stopping and entities, on documents made of the tables' rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from saxframe.functions import constants as C
from saxframe.functions import expressions as X
from saxframe.operators import documents as D
from saxframe.operators import lexing as L
from saxframe.operators.machine import Options
from saxframe.plans.queries import _attr, _order_docs, _t, _text, query
from saxframe.sources.documents import from_table

# Documents with a key at {k}, the error code of each and the column of the error for a key of one
# character (one more for each further character where the key stands before it): as the C library has them.
CASES = [
    ("hello{k}", 2, 0, 0), ("<!DOCTYPE r [<!ELEMENT r (a,b|{k})>]><r/>", 2, 29, 0), ("<r>{k}", 3, 4, 1), ("", 3, 0, 0), ("  <r>{k}</r>&", 4, 10, 1), ("<r>{k}]]></r>", 4, 6, 1), ("<r a='{k}<'/>", 4, 7, 1),
    ("<r {k}/>", 4, 3, 0), ("<r>{k}</r></r>", 4, 9, 1), ("<!DOCTYPE r [<!ENTITY e '{k}'>]><r>&e</r>", 4, 35, 1), ("<r>{k}<!-- a -- b --></r>", 4, 13, 1), ("<r>{k}<![CDAT[x]]></r>", 4, 11, 1), ("<r>{k}</r", 5, 4, 1),
    ("<r>{k}</s>", 7, 6, 1), ("<r a='{k}' a='1'/>", 8, 9, 1), ("<r>{k}</r><s/>", 9, 8, 1), ("<r>{k}&none;</r>", 11, 4, 1), ("<!DOCTYPE r [<!ENTITY e '{k}&e;'>]><r>&e;</r>", 12, 36, 1),
    ("<!DOCTYPE r [<!ENTITY e '<a>{k}'>]><r>&e;</a></r>", 13, 36, 1), ("<r>{k}&#xD800;</r>", 14, 4, 1), ("<!DOCTYPE r [<!NOTATION n SYSTEM 's'><!ENTITY e SYSTEM '{k}' NDATA n>]><r>&e;</r>", 15, 72, 1),
    ("<!DOCTYPE r [<!ENTITY e SYSTEM '{k}'>]><r a='&e;'/>", 16, 43, 1), ("<!--{k}--><?xml version='1.0'?><r/>", 17, 8, 1), ("<r><?xml {k}?></r>", 17, 3, 0), ("<?xml version='1.0' encoding='UTF-16'?><r>{k}</r>", 19, 30, 0),
    ("<r><![CDATA[{k}", 20, 13, 1), ("<?xml versio='{k}'?><r/>", 30, 6, 0), ("<!DOCTYPE r PUBLIC '{k}{}' 's'><r/>", 32, 21, 1),
]
# The same with namespaces on; no columns.
NAMESPACE_CASES = [
    ("<r>{k}</r>", 0), ("<p:r>{k}</p:r>", 27), ("<r xmlns:p=''>{k}</r>", 28), ("<r xmlns:xml='u'>{k}</r>", 38), ("<r xmlns:xmlns='u'>{k}</r>", 39), ("<r xmlns:p='http://www.w3.org/2000/xmlns/'>{k}</r>", 40),
    ("<r xmlns:p='u' xmlns:q='u' p:a='{k}' q:a='1'/>", 8),
]


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")


def _cases(bodies: list[str]) -> F.Column:
    """The body of a customer's number, its key put in."""
    k = F.col("c_custkey").cast("string")
    return F.replace(F.element_at(F.array(*[F.lit(b) for b in bodies]), (F.col("c_custkey") % len(bodies) + 1).cast("int")), F.lit("{k}"), k)


def _values(rows: list[tuple]) -> str:
    return ", ".join(f"({', '.join(map(str, r))})" for r in rows)


@query(
    f"""SELECT c_custkey, CAST(code AS INT) AS error_code, CAST(col + more * (length(CAST(c_custkey AS VARCHAR)) - 1) AS BIGINT) AS col, CAST(1 AS BIGINT) AS line
 FROM customer JOIN (VALUES {_values([(n, *c[1:]) for n, c in enumerate(CASES)])}) t(n, code, col, more) ON c_custkey % {len(CASES)} = n"""
)
def q_error_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = D.parse_documents(from_table(_customers(spark, sf_dir), "c_custkey", _cases([c[0] for c in CASES])), types=[], columns=["seq"])
    return D.doc_status(parsed).select(F.col("doc_id").cast("long").alias("c_custkey"), "error_code", "col", "line")


@query(f"SELECT c_custkey, CAST(code AS INT) AS error_code FROM customer JOIN (VALUES {_values([(n, c[1]) for n, c in enumerate(NAMESPACE_CASES)])}) t(n, code) ON c_custkey % {len(NAMESPACE_CASES)} = n")
def q_namespace_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = D.parse_documents(from_table(_customers(spark, sf_dir), "c_custkey", _cases([c[0] for c in NAMESPACE_CASES])), Options(namespaces=True), types=[], columns=["seq"])
    return D.doc_status(parsed).select(F.col("doc_id").cast("long").alias("c_custkey"), "error_code")


@query(
    """SELECT n_nationkey, CAST(CASE n_nationkey % 5 WHEN 0 THEN 6 WHEN 1 THEN 18 WHEN 2 THEN 21 WHEN 3 THEN 0 ELSE 4 END AS INT) AS error_code, CASE n_nationkey % 5 WHEN 0 THEN 'partial character' WHEN 1 THEN 'unknown encoding'
 WHEN 2 THEN 'external entity handling' WHEN 3 THEN 'no error' ELSE 'invalid token' END AS error FROM nation"""
)
def q_input_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes that end inside a character, encodings that nobody knows, missing entities, a byte that is no character."""
    nation = _t(spark, sf_dir, "nation")
    kind, name = F.col("n_nationkey") % 5, F.col("n_name")
    body = (
        F.when(kind == 0, F.concat(F.encode(_text("<r>", name), "UTF-8"), F.unhex(F.lit("C3")))).when(kind == 1, F.encode(_text("<?xml version='1.0' encoding='no-such'?><r>", name, "</r>"), "UTF-8"))
        .when(kind == 2, F.encode(_text("<!DOCTYPE r [<!ENTITY e SYSTEM 'gone'>]><r>", name, "&e;</r>"), "UTF-8")).when(kind == 3, F.encode(_text("<r>", name, "&lt;</r>"), "UTF-8"))
        .otherwise(F.concat(F.encode(_text("<r>", name), "UTF-8"), F.unhex(F.lit("FF3C2F723E"))))
    )
    parsed = D.parse_documents(from_table(nation, "n_nationkey", body), Options(strict_entities=True), types=[], columns=["seq"])
    return D.doc_status(parsed).select(F.col("doc_id").cast("int").alias("n_nationkey"), "error_code", X.error_text("error_code").alias("error"))


@query("SELECT c_custkey, CAST(c_custkey % 60 + 1 AS INT) AS entity_depth, CAST(c_custkey % 60 + 1 AS BIGINT) AS entities_opened, c_name AS text FROM customer")
def q_entity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains of entities, as long as the key says."""
    n = (F.col("c_custkey") % 60).cast("int")
    links = F.array_join(F.transform(F.sequence(F.lit(0), n), lambda k: F.when(k == 0, F.concat(F.lit("<!ENTITY e0 '"), F.col("c_name"), F.lit("'>"))).otherwise(F.concat(F.lit("<!ENTITY e"), k, F.lit(" '&e"), k - 1, F.lit(";'>")))), "")
    docs = from_table(_customers(spark, sf_dir), "c_custkey", _text("<!DOCTYPE r [", links, "]><r>&e", n, ";</r>"))
    parsed = D.parse_documents(docs, types=["character_data"], columns=["text"])
    return parsed.select(F.col("doc_id").cast("long").alias("c_custkey"), "entity_depth", "entities_opened", F.element_at("events", 1)["text"].alias("text"))


@query("SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_orderkey // 100 ORDER BY o_orderkey) + 0 AS BIGINT) AS line FROM orders")
def q_machine_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The machine's positions: each order of a document stands on a line of its own."""
    parsed = D.parse_documents(from_table(_order_docs(spark, sf_dir), "doc_id", "text"), types=["start_element"], columns=["name", "attrs", "line"])
    return D.events(parsed).where("name = 'o'").select(_attr(F.col("attrs"), "k").cast("long").alias("o_orderkey"), "line")


@query("SELECT o_orderkey // 100 AS doc, '/orders/o/p' AS path, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY 1 UNION ALL SELECT o_orderkey // 100, '/orders/o', count(*) FROM orders GROUP BY 1 UNION ALL SELECT DISTINCT o_orderkey // 100, '/orders', 1 FROM orders")
def q_element_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = L.paths(L.elements(L.tokens(_order_docs(spark, sf_dir))))
    return found.groupBy(F.col("doc_id").cast("long").alias("doc"), "path").agg(F.count(F.lit(1)).alias("n"))


_PIECES = X.CONTENT_RE.replace("'", "''")


@query(
    f"""SELECT page_id, CASE WHEN ref LIKE '&#%' THEN 'charref' ELSE 'ref' END AS kind, CAST(count(*) AS BIGINT) AS n FROM (
 SELECT page_id, unnest(regexp_extract_all(raw, '{X.REFERENCE_RE}', 1)) AS ref FROM (SELECT page_id, unnest(regexp_extract_all(html, '{_PIECES}')) AS raw FROM pages)
 WHERE raw NOT LIKE '<!%' AND raw NOT LIKE '<?%' AND raw NOT LIKE '</%') GROUP BY ALL"""
)
def q_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.references(L.tokens(_t(spark, sf_dir, "pages"), "page_id", "html")).groupBy(F.col("doc_id").alias("page_id"), "kind").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT c_custkey, CAST(CASE WHEN c_custkey % 2 = 0 THEN 35 ELSE 0 END AS INT) AS error_code, CAST(CASE WHEN c_custkey % 2 = 0 THEN 3 ELSE 2 END AS BIGINT) AS n_events FROM customer")
def q_stop_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents are aborted after their third event; those of two events end by themselves."""
    body = F.when(F.col("c_custkey") % 2 == 0, _text("<r><a/>", F.col("c_name"), "</r>")).otherwise("<r/>")
    parsed = D.parse_documents(from_table(_customers(spark, sf_dir), "c_custkey", body), Options(stop_after=3), types=[], columns=["seq"])
    return D.doc_status(parsed).select(F.col("doc_id").cast("long").alias("c_custkey"), "error_code", "n_events")


@query("SELECT p_partkey, p_name AS text, CAST(5 AS BIGINT) AS n_events, CAST(0 AS INT) AS error_code FROM part")
def q_input_in_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in UTF-16 that come three bytes at a time, a token cut wherever it falls, retried only as input doubles."""
    text = _text("<p><!--", F.col("p_brand"), "-->", F.col("p_name"), "<?x ", F.col("p_type"), "?></p>")
    content = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.unhex(F.lit("FFFE")), F.encode(text, "UTF-16LE"))).otherwise(F.concat(F.unhex(F.lit("FEFF")), F.encode(text, "UTF-16BE")))
    parsed = D.parse_documents(from_table(_t(spark, sf_dir, "part"), "p_partkey", content), types=["character_data"], columns=["text"], piece=3)
    return parsed.select(F.col("doc_id").cast("long").alias("p_partkey"), F.element_at("events", 1)["text"].alias("text"), "n_events", "error_code")


@query("SELECT c_custkey, 'a' || chr(10) || c_name || chr(10) || chr(10) || 'é€A' AS text FROM customer")
def q_newlines_and_char_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = _text("<r>a\r\n", F.col("c_name"), "\r\n\r&#233;&#x20AC;&#x41;</r>")
    parsed = D.parse_documents(from_table(_customers(spark, sf_dir), "c_custkey", body), types=["character_data"], columns=["text"])
    return parsed.select(F.col("doc_id").cast("long").alias("c_custkey"), F.element_at("events", 1)["text"].alias("text"))


@query("SELECT c_custkey, '<r><!--' || c_name || '-->x<a b=\"1\"/></r>' AS raw FROM customer")
def q_raw_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a default handler gets of all tokens, put together: the document."""
    docs = from_table(_customers(spark, sf_dir), "c_custkey", _text("<r><!--", F.col("c_name"), '-->x<a b="1"/></r>'))
    rows = D.with_raw(D.events(D.parse_documents(docs)), docs)
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", F.decode("raw", "UTF-8").alias("raw")))), lambda s: s["raw"]), "")
    return rows.groupBy("doc_id").agg(whole.alias("raw")).select(F.col("doc_id").cast("long").alias("c_custkey"), "raw")


@query(
    """SELECT c_custkey, kind, event_type, text FROM (
 SELECT c_custkey, 'default' AS kind, 'default' AS event_type, '&e;' AS text FROM customer UNION ALL SELECT c_custkey, 'default_expand', 'default_expand', c_name FROM customer)"""
)
def q_default_handlers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """"default" alone gets a reference as it is written, "default_expand" what it stands for."""
    docs = from_table(_customers(spark, sf_dir), "c_custkey", _text("<!DOCTYPE r [<!ENTITY e '", F.col("c_name"), "'>]><r>&e;</r>"))
    out = None
    for kind in ("default", "default_expand"):
        parsed = D.parse_for(docs, ["start_element", "end_element", "entity_decl", "start_doctype", "end_doctype", kind])
        rows = D.handlers(parsed, ["start_element", "end_element", "entity_decl", "start_doctype", "end_doctype", kind]).where(F.col("event_type") == kind)
        part = rows.select(F.col("doc_id").cast("long").alias("c_custkey"), F.lit(kind).alias("kind"), "event_type", "text")
        out = part if out is None else out.unionByName(part)
    return out


@query(f"SELECT CAST(error_code AS INT) AS error_code, error FROM (VALUES {', '.join(f'({n}, {chr(39)}{e.replace(chr(39), chr(39) * 2)}{chr(39)})' for n, e in enumerate(C.ERRORS))}) t(error_code, error)")
def q_error_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.range(len(C.ERRORS)).select(F.col("id").cast("int").alias("error_code"), X.error_text(F.col("id").cast("int")).alias("error"))
