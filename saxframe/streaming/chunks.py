"""Documents in a stream of chunks: the event machine is the state of its document."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from functools import partial

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from saxframe.deploy import ship
from saxframe.operators.machine import Machine, Options

OUT = "doc_id string, seq bigint, event_type string, name string, text string, attrs string, depth int, byte_index bigint, line bigint, col bigint, error_code int"
STATE = "machine binary, next int, seq bigint, waiting binary"


def _advance(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState, options: Options, timeout_ms: int | None) -> Iterator[pd.DataFrame]:
    """Chunks are taken in order of their number: one that comes early waits, one that was seen is dropped.

    The state of a closed document is its number of chunks alone; when its time is over it goes, and a
    document whose next chunk never came is closed as it stands.
    """
    machine, expected, seq, waiting = Machine(options), 0, 0, {}
    if state.exists:
        blob, expected, seq, held = state.get
        machine = pickle.loads(blob) if blob else None
        waiting = pickle.loads(held) if held else {}
    rows: list[tuple] = []

    def deliver() -> None:
        nonlocal seq
        for kind, name, text, attrs, depth, byte, line, col, *_ in machine.take():
            rows.append((key[0], seq, kind, name, text, None if attrs is None else " ".join(f"{a[0]}={a[1]}" for a in attrs), depth, byte, line, col, None))
            seq += 1
        if machine.code or machine.finished:
            line, col, byte = machine.where if machine.code else (machine.line, machine.col, machine.byte)
            rows.append((key[0], seq, "verdict", None, None, None, 0, byte, line, col, machine.code))

    if state.hasTimedOut:
        if machine:
            machine.feed(b"", True)
            deliver()
        state.remove()
    else:
        for part in parts:
            for no, data, final in zip(part["chunk_no"], part["bytes"], part["is_final"], strict=True):
                if machine and no >= expected:
                    waiting.setdefault(int(no), (bytes(data or b""), bool(final)))
        while machine and expected in waiting:
            data, final = waiting.pop(expected)
            machine.feed(data, final)
            expected += 1
            deliver()
            if machine.code or machine.finished:
                machine, waiting = None, {}
        state.update((pickle.dumps(machine) if machine else b"", expected, seq, pickle.dumps(waiting) if waiting else b""))
        if timeout_ms:
            state.setTimeoutDuration(timeout_ms)
    yield pd.DataFrame(rows, columns=[c.split()[0] for c in OUT.split(", ")])


def parse_stream(chunks: DataFrame, options: Options | None = None, timeout_ms: int | None = None) -> DataFrame:
    """Events of documents as their chunks (doc_id, chunk_no, bytes, is_final) arrive; last, a row "verdict" with the error code.

    The events are those of the whole document, however it is cut. What goes on beyond a chunk waits
    in the state, which holds the unread tail, open elements, namespaces and declarations; of a closed document it
    holds two numbers. With a timeout, a document that gets no chunk for so long is closed, with the verdict on
    what came, and forgotten; a chunk that comes later still begins it anew. A query with a timeout never ends by
    itself: Spark runs batches for what may time out, so leave it out with a trigger that takes what is there.
    """
    ship(chunks.sparkSession)
    run = partial(_advance, options=options or Options(), timeout_ms=timeout_ms)
    return chunks.groupBy("doc_id").applyInPandasWithState(run, OUT, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout if timeout_ms else GroupStateTimeout.NoTimeout)


def event_counts(stream: DataFrame) -> DataFrame:
    return stream.groupBy("event_type").agg(F.count(F.lit(1)).alias("n_events"))
