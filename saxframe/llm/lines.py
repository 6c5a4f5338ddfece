"""Line dedup: content-defined chunks of lines, removed where they repeat anywhere in the corpus."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from saxframe.llm.common import row_key, slices, stage, table, texts

#: One in so many windows of lines ends a chunk.
DIVISOR = 4
#: Line hashes that the rolling hash covers.
WINDOW = 2
#: Lines of a chunk at least; only a text of fewer lines has a smaller one.
LEAST = 2
_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15
_OUT = pow(_BASE, WINDOW, 1 << 64)


def chunks(text: bytes) -> list[tuple[int, int, int]]:
    """(start, end, lines) of the chunks of a text, the line feed between two chunks in neither.

    A rolling hash runs over the hashes of the last lines; where its finalised value is divisible,
    a chunk ends. So a boundary depends on the lines just before it and stays with them when lines
    are added or removed elsewhere. What is left at the end and too short joins the last chunk.
    """
    if not text:
        return []
    out: list[tuple[int, int, int]] = []
    at = start = lines = 0
    roll, last = 0, [0] * WINDOW
    for k, line in enumerate(text.split(b"\n")):
        h = xxhash.xxh64_intdigest(line)
        roll = (roll * _BASE + h - last[k % WINDOW] * _OUT) & _MASK
        last[k % WINDOW] = h
        lines += 1
        end = at + len(line)
        at = end + 1
        final = (roll ^ roll >> 32) * 0xD6E8FEB86659FD93 & _MASK
        if lines >= LEAST and (final >> 32) % DIVISOR == 0:
            out.append((start, end, lines))
            start, lines = at, 0
    if lines:
        if out and lines < LEAST:
            first, _, n = out.pop()
            out.append((first, len(text), n + lines))
        else:
            out.append((start, len(text), lines))
    return out


def _chunk_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        rows: list[tuple] = []
        for k, text in enumerate(texts(batch["text"])):
            for n, (start, end, lines) in enumerate(chunks(text)):
                if lines >= LEAST:
                    d = xxhash.xxh128_intdigest(text[start:end])
                    rows.append((k, n, start, end, (d >> 64) - (1 << 63), (d & _MASK) - (1 << 63)))
        row, n, start, end, d1, d2 = map(list, zip(*rows, strict=True)) if rows else ([],) * 6
        taken = pa.array(row, pa.int32())
        out = {name: batch[name].take(taken) for name in batch.schema.names if name != "text"}
        yield pa.RecordBatch.from_pydict(out | {"n": pa.array(n, pa.int32()), "start": pa.array(start, pa.int64()), "end": pa.array(end, pa.int64()), "d1": pa.array(d1, pa.int64()), "d2": pa.array(d2, pa.int64())})


def _flagged_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of repeated chunks, once for each batch and digest unless the bytes differ."""
    for batch in slices(batches):
        seen: set[tuple[int, int, bytes]] = set()
        for text, ranges in zip(texts(batch["text"]), batch["__ranges"].to_pylist(), strict=True):
            for r in ranges or ():
                seen.add((r["d1"], r["d2"], text[r["start"] : r["end"]]))
        d1, d2, body = map(list, zip(*seen, strict=True)) if seen else ([], [], [])
        yield pa.RecordBatch.from_pydict({"d1": pa.array(d1, pa.int64()), "d2": pa.array(d2, pa.int64()), "body": pa.array(body, pa.binary())})


def _without(batches: Iterator[pa.RecordBatch], unequal: frozenset) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        kept, removed, lines = [], [], []
        for text, ranges in zip(texts(batch["text"]), batch["__ranges"].to_pylist(), strict=True):
            gone = {r["start"] for r in ranges or () if not r["first"] and (r["d1"], r["d2"]) not in unequal}
            if not gone:
                kept.append(text)
                removed.append(0)
                lines.append(0)
                continue
            parts, n = [], 0
            for start, end, count in chunks(text):
                if start in gone:
                    n += count
                else:
                    parts.append(text[start:end])
            kept.append(b"\n".join(parts))
            removed.append(len(gone))
            lines.append(n)
        body = pa.array(kept, pa.binary()).cast(pa.string())
        body = pa.compute.if_else(batch["text"].is_null(), pa.scalar(None, pa.string()), body)
        out = {name: batch[name] for name in batch.schema.names if name not in ("text", "__ranges")}
        yield pa.RecordBatch.from_pydict(out | {"text": body, "removed_chunks": pa.array(removed, pa.int32()), "removed_lines": pa.array(lines, pa.int32())})


def dedup_lines(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text; further columns stay, but for removed_chunks and removed_lines) without repeated chunks.

    A chunk of two lines or more whose bytes also stand elsewhere, in the same text or another, stays
    where it is first: in the row of the least id (null last), then of the least content hash, then
    at the least place in the text. Everywhere else it goes, with one line feed. removed_chunks and
    removed_lines count what went. A null text stays null, an empty one empty; a text of one line is
    never changed. Rows that agree in id and text are one document and treated alike. An empty table
    has no rows.

    Digests find the repeats and only their bytes are compared: once for each batch and digest, by
    grouping. A digest that stands for two different byte strings removes nothing.
    """
    k1, k2 = row_key("doc_id", "text")
    given = [c for c in docs.columns if c not in ("removed_chunks", "removed_lines")]
    keyed = docs.select(F.struct(*[c for c in given if c != "text"]).alias("given"), "doc_id", "text", k1.alias("__k1"), k2.alias("__k2"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    slim = keyed.select("doc_id", F.col("__k1").alias("k1"), F.col("__k2").alias("k2"), "text").where("text IS NOT NULL AND instr(text, '\n') > 0")
    found = stage(slim.mapInArrow(_chunk_rows, f"doc_id {kind}, k1 long, k2 long, n int, start long, end long, d1 long, d2 long"), "line-chunks")
    at = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k1", "k2", "n")
    # Written first, so that the join has exchanges of its own and Spark can split a frequent chunk's partition.
    repeated = stage(found.groupBy("d1", "d2").agg(F.count(F.lit(1)).alias("c"), F.min(at).alias("first")).where("c > 1"), "line-repeats")
    flagged = found.join(repeated, ["d1", "d2"]).select("k1", "k2", F.struct("start", "end", "d1", "d2", ((F.col("first.k1") == F.col("k1")) & (F.col("first.k2") == F.col("k2")) & (F.col("first.n") == F.col("n"))).alias("first")).alias("r"))
    per_row = flagged.groupBy(F.col("k1").alias("__k1"), F.col("k2").alias("__k2")).agg(F.collect_set("r").alias("__ranges"))
    held = keyed.join(per_row, ["__k1", "__k2"], "left")
    held = stage(held, "line-rows")
    bodies = held.where("__ranges IS NOT NULL").select("text", "__ranges").mapInArrow(_flagged_bytes, "d1 long, d2 long, body binary")
    unequal = bodies.groupBy("d1", "d2", "body").agg(F.lit(1).alias("one")).groupBy("d1", "d2").count().where("count > 1")
    # Two byte strings of one 128-bit digest: none are expected, so this set is empty.
    differ = frozenset((r[0], r[1]) for r in unequal.select("d1", "d2").collect())
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in held.schema.fields if f.name not in ("text", "__ranges")) + ", text string, removed_chunks int, removed_lines int"
    out = held.mapInArrow(partial(_without, unequal=differ), ddl)
    return out.select("given.*", "text", "removed_chunks", "removed_lines").select(*given, "removed_chunks", "removed_lines")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "text", "removed_chunks", "removed_lines")
