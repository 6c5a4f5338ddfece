"""Parsing documents: one row per document with its verdict and its events, by the event machine."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import replace
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from saxframe.deploy import ship
from saxframe.functions import constants as C
from saxframe.operators.machine import Machine, Options, content_model

ATTRS = "array<struct<name string, value string, specified boolean, type string>>"
DECL = "struct<kind string, element string, attribute string, att_type string, default_value string, required boolean, is_param boolean, value string>"
#: The columns of an event, in order.
EVENT = {
    "seq": "bigint", "event_type": "string", "name": "string", "attrs": ATTRS, "n_specified": "int", "id_index": "int", "text": "string", "target": "string", "public_id": "string", "system_id": "string", "base": "string", "notation": "string",
    "has_internal_subset": "boolean", "version": "string", "encoding": "string", "standalone": "int", "decl": DECL, "ns_uri": "string", "depth": "int", "byte_index": "bigint", "byte_count": "int", "line": "bigint", "col": "bigint", "entity_path": "array<string>",
}
VERDICT = "status int, error_code int, error string, line bigint, col bigint, byte_index bigint, n_events bigint, direct_bytes bigint, indirect_bytes bigint, entities_opened bigint, entity_depth int"


def parsed_ddl(columns: list[str]) -> str:
    return f"{VERDICT}, events array<struct<{', '.join(f'{c} {EVENT[c]}' for c in columns)}>>"


_attrs = pa.list_(pa.struct([("name", pa.string()), ("value", pa.string()), ("specified", pa.bool_()), ("type", pa.string())]))
_decl = pa.struct([("kind", pa.string()), ("element", pa.string()), ("attribute", pa.string()), ("att_type", pa.string()), ("default_value", pa.string()), ("required", pa.bool_()), ("is_param", pa.bool_()), ("value", pa.string())])
FIELDS: list[tuple[str, pa.DataType]] = [
    ("seq", pa.int64()), ("event_type", pa.string()), ("name", pa.string()), ("attrs", _attrs), ("n_specified", pa.int32()), ("id_index", pa.int32()), ("text", pa.string()), ("target", pa.string()),
    ("public_id", pa.string()), ("system_id", pa.string()), ("base", pa.string()), ("notation", pa.string()), ("has_internal_subset", pa.bool_()), ("version", pa.string()), ("encoding", pa.string()),
    ("standalone", pa.int32()), ("decl", _decl), ("ns_uri", pa.string()), ("depth", pa.int32()), ("byte_index", pa.int64()), ("byte_count", pa.int32()), ("line", pa.int64()), ("col", pa.int64()), ("entity_path", pa.list_(pa.string())),
]
_DECLS = {"element_decl", "attlist_decl", "entity_decl", "unparsed_entity_decl", "notation_decl", "skipped_entity"}


_MORE = ("public_id", "system_id", "base", "notation", "has_internal_subset", "version", "encoding", "standalone", "ns_uri")


def event_arrays(seqs: list[int], rows: list[tuple], wanted: list[str] | None = None) -> pa.StructArray:
    """The machine's events as one array of structs, built column by column, the wanted ones only."""
    fields = [(c, t) for c, t in FIELDS if wanted is None or c in wanted]
    n = len(rows)
    kinds, names, texts, attrs, depths, offsets, lines, cols, sizes, paths, mores = zip(*rows, strict=True) if rows else ((),) * 11
    names, targets, decls = list(names), [None] * n, [None] * n
    more: dict[str, list] = {k: [None] * n for k in _MORE}
    specified = [None if a is None else 2 * len(a) for a in attrs]
    ids = [None if a is None else -1 for a in attrs]
    for k, extra in enumerate(mores):
        kind = kinds[k]
        if kind == "processing_instruction":
            targets[k], names[k] = names[k], None
        if kind in _DECLS:
            decls[k] = {"kind": kind, "element": names[k] if kind in ("element_decl", "attlist_decl") else None} | {c: (extra or {}).get(c) for c in ("attribute", "att_type", "default_value", "required", "is_param", "value")}
        if extra:
            for c in more.keys() & extra.keys():
                more[c][k] = extra[c]
            if "n_specified" in extra:
                specified[k], ids[k] = extra["n_specified"], extra["id_index"]
    needs = {c for c, _ in fields}
    flat = [a for some in attrs if some for a in some] if "attrs" in needs else []
    columns = list(zip(*flat, strict=True)) if flat else [(), (), (), ()]
    ends = np.cumsum([0, *[len(a) if a and "attrs" in needs else 0 for a in attrs]]).astype(np.int32)
    pieces = pa.StructArray.from_arrays([pa.array(c, t.type) for c, t in zip(columns, _attrs.value_type, strict=True)], fields=list(_attrs.value_type))
    lists = pa.ListArray.from_arrays(pa.array(ends), pieces, type=_attrs, mask=pa.array([a is None for a in attrs], pa.bool_()))
    given = {"seq": seqs, "event_type": kinds, "name": names, "attrs": lists, "n_specified": specified, "id_index": ids, "text": texts, "target": targets, "decl": decls, "depth": depths, "byte_index": offsets, "byte_count": sizes, "line": lines, "col": cols, "entity_path": paths} | more
    made = []
    for name, kind in fields:
        values = given[name]
        if not isinstance(values, pa.Array):
            values = pa.array(values, kind) if name in _ALWAYS or values.count(None) < n else pa.nulls(n, kind)
        made.append(values)
    return pa.StructArray.from_arrays(made, fields=[pa.field(c, t) for c, t in fields])


_ALWAYS = {"seq", "event_type", "depth", "byte_index", "line", "col", "entity_path"}


def verdict(machine: Machine) -> dict:
    line, col, byte = machine.where if machine.code else (None, None, None)
    return {
        "status": 0 if machine.code else 1, "error_code": machine.code, "error": C.ERRORS[machine.code], "line": line, "col": col, "byte_index": byte, "n_events": machine.n_events,
        "direct_bytes": machine.acc.direct, "indirect_bytes": machine.acc.indirect, "entities_opened": machine.acc.opened, "entity_depth": machine.acc.deepest,
    }


_verdict_types = {k: pa.int32() if k in ("status", "error_code", "entity_depth") else pa.string() if k == "error" else pa.int64() for k in ("status", "error_code", "error", "line", "col", "byte_index", "n_events", "direct_bytes", "indirect_bytes", "entities_opened", "entity_depth")}


def slices(batches: Iterator[pa.RecordBatch], most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The rows of batches in parts of about so many bytes of content: the events of a part are one array."""
    for batch in batches:
        held = batch["content"]
        size = np.cumsum([0 if v is None else v for v in pa.compute.binary_length(held).to_pylist()]) if batch.num_rows else np.zeros(0)
        at = 0
        while True:
            before = size[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(size, before + most, side="right")))
            yield batch.slice(at, end - at)
            at = end
            if at >= batch.num_rows:
                break


def _parsed(batches: Iterator[pa.RecordBatch], options: Options, per_row: str | None, types: frozenset | None, columns: list[str], piece: int | None) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        rows, seqs, ends, verdicts = [], [], [0], []
        codes = batch[per_row].to_pylist() if per_row else [None] * batch.num_rows
        for content, encoding in zip(batch["content"].to_pylist(), codes, strict=True):
            machine = Machine(options if encoding is None else Options(**{**options.__dict__, "encoding": encoding}))
            try:
                content = content or b""
                for at in range(0, len(content), piece) if piece else ():
                    machine.feed(content[at : at + piece])
                machine.feed(b"" if piece else content, True)
            except Exception:  # one document must not end the job of all
                machine.code = C.UNEXPECTED_STATE
            found = machine.take()
            if types is None:
                rows += found
                seqs += range(len(found))
            else:
                kept = [(k, e) for k, e in enumerate(found) if e[0] in types]
                rows += [e for _, e in kept]
                seqs += [k for k, _ in kept]
            ends.append(len(rows))
            verdicts.append(verdict(machine))
        out = {c: batch[c] for c in batch.schema.names if c not in ("content", per_row)}
        out |= {k: pa.array([v[k] for v in verdicts], t) for k, t in _verdict_types.items()}
        yield pa.RecordBatch.from_pydict(out | {"events": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), event_arrays(seqs, rows, columns))})


def parse_documents(docs: DataFrame, options: Options | None = None, encoding_column: str | None = None, types: list[str] | None = None, columns: list[str] | None = None, piece: int | None = None) -> DataFrame:
    """docs (doc_id, content; further columns are carried along) with the verdict and the events of each document.

    types is what handlers are registered for and columns what they look at: other events and columns
    are not built. n_events and seq count all events. piece is how many bytes the machine gets at a time: all, or so many.
    An exception that a document causes is its verdict (code 23).

    Events that come before the first error are delivered. Documents are independent, so nothing is
    shuffled; filter documents before this step, as no predicate passes through it. Store contents of
    external entities in the options only up to some MB: they travel with the task.
    """
    options = options or Options()
    if sum(map(len, options.store.values())) > 64 << 20:
        raise ValueError("entity contents above 64 MB: parse the documents in groups that share fewer entities")
    ship(docs.sparkSession)
    kept = [f for f in docs.schema.fields if f.name not in ("content", encoding_column)]
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    wanted = [c for c in EVENT if columns is None or c in columns]
    run = partial(_parsed, options=options, per_row=encoding_column, types=None if types is None else frozenset(types), columns=wanted, piece=piece)
    return docs.mapInArrow(run, f"{ddl}, {parsed_ddl(wanted)}")


def events(parsed: DataFrame, types: list[str] | None = None) -> DataFrame:
    """One row per event: doc_id and what carries along, then the event's columns; types is what handlers are registered for."""
    carried = [c for c in parsed.columns if c != "events" and c not in _verdict_types]
    source = F.filter("events", lambda e: e["event_type"].isin(*types)) if types else F.col("events")
    return parsed.select(*carried, F.inline(source))


def doc_status(parsed: DataFrame) -> DataFrame:
    return parsed.drop("events")


def parse_for(docs: DataFrame, registered: list[str], options: Options | None = None, **more) -> DataFrame:
    """parse_documents() as these handlers ask for it: "default" gets references to internal entities as they are
    written, "default_expand" and no default handler at all get their replacement text."""
    options = options or Options()
    if "default" in registered and "default_expand" not in registered:
        options = replace(options, expand_entities=False)
    return parse_documents(docs, options, **more)


def handlers(parsed: DataFrame, registered: list[str]) -> DataFrame:
    """Events of the registered types as they are; all others, if default or default_expand is registered, as that."""
    fallback = next((k for k in ("default_expand", "default") if k in registered), None)
    rows = events(parsed)
    kept = rows.where(F.col("event_type").isin(*registered))
    if not fallback:
        return kept
    own = F.col("event_type").isin(*registered)
    reference = ~own & (F.col("event_type") == "skipped_entity") & F.col("text").isNull()
    said = F.when(reference, F.concat(F.when(F.col("decl.is_param"), "%").otherwise("&"), "name", F.lit(";"))).otherwise(F.col("text"))
    return rows.withColumn("text", said).withColumn("event_type", F.when(own, F.col("event_type")).otherwise(F.lit(fallback)))


def with_raw(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """Events with raw, the bytes of the document from the event's place to the next one's: what a default handler gets.

    Several events of one token share its place; the last of them has the bytes, the others none. An
    event inside an entity has the bytes of the reference.
    """
    order = Window.partitionBy("doc_id").orderBy("seq")
    until = F.lead("byte_index").over(order)
    cut = rows.withColumn("__to", until).join(docs.select("doc_id", F.col("content").alias("__content")), "doc_id")
    end = F.coalesce("__to", F.octet_length("__content"))
    return cut.withColumn("raw", F.substring("__content", (F.col("byte_index") + 1).cast("int"), (end - F.col("byte_index")).cast("int"))).drop("__to", "__content")


def namespace_bindings(parsed: DataFrame) -> DataFrame:
    """Namespace scopes as intervals: doc_id, prefix (null: default), uri, start_seq, end_seq, level (1: outermost of its prefix).

    Starts and ends of one prefix nest, so at one level they alternate and a start's partner is the next row.
    """
    key = ("doc_id", F.coalesce("name", F.lit("")))
    order = Window.partitionBy(*key).orderBy("seq")
    step = F.when(F.col("event_type") == "start_namespace", 1).otherwise(-1)
    rows = events(parsed, ["start_namespace", "end_namespace"]).withColumn("__after", F.sum(step).over(order))
    rows = rows.withColumn("level", F.when(F.col("event_type") == "start_namespace", F.col("__after")).otherwise(F.col("__after") + 1))
    ends = F.lead("seq").over(Window.partitionBy(*key, "level").orderBy("seq"))
    return rows.withColumn("end_seq", ends).where("event_type = 'start_namespace'").select("doc_id", F.col("name").alias("prefix"), F.col("ns_uri").alias("uri"), F.col("seq").alias("start_seq"), "end_seq", "level")


def dtd(parsed: DataFrame) -> dict[str, DataFrame]:
    """The relations of the documents' type definitions, by name."""
    rows = events(parsed, ["entity_decl", "unparsed_entity_decl", "attlist_decl", "notation_decl", "element_decl"])
    of = lambda kind, *cols: rows.where(F.col("event_type") == kind).select("doc_id", "seq", *cols)
    entity = of("entity_decl", "name", F.col("decl.value").alias("value"), "system_id", "public_id", F.col("decl.is_param").alias("is_param"))
    return {
        "entities": entity.where("NOT is_param AND value IS NOT NULL").drop("is_param", "system_id", "public_id"),
        "external_entities": entity.where("NOT is_param AND value IS NULL").drop("is_param", "value"),
        "param_entities": entity.where("is_param").drop("is_param"),
        "unparsed_entities": of("unparsed_entity_decl", "name", "system_id", "public_id", "notation"),
        "notations": of("notation_decl", "name", "system_id", "public_id"),
        "attlist": of("attlist_decl", F.col("decl.element").alias("element"), F.col("decl.attribute").alias("attribute"), F.col("decl.att_type").alias("att_type"), F.col("decl.default_value").alias("default_value"), F.col("decl.required").alias("required")),
        "elements": of("element_decl", F.col("decl.element").alias("element"), F.col("decl.value").alias("model")),
    }


def _models(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(k, *n) for k, text in enumerate(batch["model"].to_pylist()) for n in content_model(text) or ()]
        cols = list(zip(*rows, strict=True)) if rows else [()] * 7
        at = pa.array(cols[0], pa.int32())
        out = {c: batch[c].take(at) for c in ("doc_id", "element")}
        yield pa.RecordBatch.from_pydict(out | {n: pa.array(v, pa.string() if n == "name" else pa.int32()) for n, v in zip(("node_id", "parent_id", "ordinal", "type", "quant", "name"), cols[1:], strict=True)})


def content_models(parsed: DataFrame) -> DataFrame:
    """Element declarations as rows of their trees: doc_id, element, node_id, parent_id, ordinal, type, quant, name."""
    return dtd(parsed)["elements"].select("doc_id", "element", "model").mapInArrow(_models, "doc_id string, element string, node_id int, parent_id int, ordinal int, type int, quant int, name string")
