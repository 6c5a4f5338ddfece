"""Benchmark decontamination: the q-gram lemma in overlapping diagonal bands, then banded alignment."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from saxframe.llm.common import runs, slices, table, texts

Q = 8
#: Edits that an occurrence of an item may have, as a share of the item's length.
EDIT_RATE = 0.1
#: Item text that goes to the executors at once; more items are taken in blocks of this size.
BLOCK_BYTES = 8 << 20
#: Document text that is looked through at once.
RUN_BYTES = 1 << 21
FILTER_BITS = 22
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def normal(text: str) -> str:
    """Lower-cased, white space as single spaces."""
    return " ".join(text.lower().split())


def _units(text: str) -> bytes:
    return text.encode("utf-16-le", "surrogatepass")


def _grams(units: bytes) -> np.ndarray:
    """A 64-bit hash of the q-gram that starts at each character but the last Q - 1."""
    n = len(units) // 2 - Q + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    low = np.ndarray((n,), np.uint64, units, 0, (2,))
    high = np.ndarray((n,), np.uint64, units, 8, (2,))
    h = low * _A
    h ^= h >> np.uint64(32)
    h += high * _B
    h *= _A
    return h


def budget(length: int, rate: float) -> int:
    """Edits that an item of this length may have, such that one q-gram at least survives them."""
    return max(0, min(int(rate * length), (length - Q) // Q))


class Items:
    """An index from q-grams to (item, place), with each item's edit budget and q-gram threshold."""

    def __init__(self, rows: list[tuple[object, str]], rate: float) -> None:
        kept = [(i, t) for i, t in ((i, normal(t or "")) for i, t in rows) if t]
        self.short = [(i, t) for i, t in kept if len(_units(t)) // 2 < Q]
        self.rows = [(i, t) for i, t in kept if len(_units(t)) // 2 >= Q]
        self.units = [np.frombuffer(_units(t), np.uint16) for _, t in self.rows]
        self.edits = np.array([budget(len(u), rate) for u in self.units], np.int64)
        self.least = np.array([len(u) - Q + 1 - Q * e for u, e in zip(self.units, self.edits, strict=True)], np.int64)
        self.step = np.maximum(16, self.edits + 1)
        grams = [_grams(_units(t)) for _, t in self.rows]
        key = np.concatenate([np.empty(0, np.uint64), *grams])
        item = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
        place = np.concatenate([np.empty(0, np.int64), *[np.arange(len(g)) for g in grams]])
        order = np.argsort(key, kind="stable")
        self.item, self.place = item[order], place[order]
        self.keys, self.first, self.count = np.unique(key[order], return_index=True, return_counts=True)
        self.there = np.zeros(1 << FILTER_BITS, bool)
        self.there[(self.keys >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True

    def regions(self, docs: list[str]) -> list[tuple[int, int, int, int]]:
        """(document, item, from, to) of the parts that may hold an occurrence: the q-gram lemma misses none."""
        if not self.rows:
            return []
        units = [_units(t) for t in docs]
        start = np.cumsum([0, *[len(u) // 2 + Q for u in units]])
        gap = b"\n\0" * Q
        whole = gap.join([*units, b""])
        grams = _grams(whole)
        at = np.flatnonzero(self.there[(grams >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
        found = np.searchsorted(self.keys, grams[at])
        hit = (found < len(self.keys)) & (self.keys[np.minimum(found, len(self.keys) - 1)] == grams[at])
        at, found = at[hit], found[hit]
        many = self.count[found]
        each = np.repeat(self.first[found] + many - np.cumsum(many), many) + np.arange(int(many.sum()))
        pos, item, place = np.repeat(at, many), self.item[each], self.place[each]
        doc = np.searchsorted(start, pos, side="right") - 1
        diagonal = pos - start[doc] - place + (1 << 30)
        step, edits = self.step[item], self.edits[item]
        band = diagonal // step
        # A band reaches edits diagonals into the next one: an alignment within the budget is inside one band.
        lap = (diagonal % step < edits) & (band > 0)
        doc, item, band = (np.concatenate([x, x[lap] - k]) for x, k in ((doc, 0), (item, 0), (band, 1)))
        width = np.int64(1 << 32)
        key = (doc * len(self.rows) + item) * width + band
        key, n = np.unique(key, return_counts=True)
        item = key // width % len(self.rows)
        enough = n >= self.least[item]
        key, item = key[enough], item[enough]
        doc, low = key // width // len(self.rows), key % width * self.step[item] - (1 << 30)
        out = []
        for d, i, x in zip(doc.tolist(), item.tolist(), low.tolist(), strict=True):
            reach = len(self.units[i]) + int(self.step[i]) + 2 * int(self.edits[i])
            out.append((d, i, max(0, x - int(self.edits[i])), min(len(units[d]) // 2, x + reach)))
        return out

    def matches(self, docs: list[str]) -> list[tuple[int, object, int, int, int]]:
        """(document, item id, edits, from, to): the best occurrence of each item in each document, in UTF-16 units of its normal text."""
        best: dict[tuple[int, object], tuple[int, int, int]] = {}
        for d, i, low, high in self.regions(docs):
            name, item = self.rows[i]
            part = np.frombuffer(_units(docs[d])[2 * low : 2 * high], np.uint16)
            exact = _units(docs[d]).find(_units(item), 2 * low)
            if exact >= 0 and exact % 2 == 0 and exact < 2 * high:
                found = (0, exact // 2, exact // 2 + len(self.units[i]))
            else:
                edits, begin, end = align(self.units[i], part, int(self.edits[i]))
                found = (edits, low + begin, low + end)
            if found[0] <= self.edits[i]:
                best[d, name] = min(best.get((d, name), found), found)
        for name, item in self.short:
            for d, text in enumerate(docs):
                where = f" {text} ".find(f" {item} ")
                if where >= 0:
                    best[d, name] = (0, where, where + len(item))
        return [(d, name, *found) for (d, name), found in best.items()]


def _banded(item: np.ndarray, part: np.ndarray, below: int, above: int, anchored: bool, most: int) -> np.ndarray:
    """Edit distances of the whole item to what ends at each diagonal (end less item length) from -below to above.

    Only diagonals of the band are filled, a row of them for each character of the item, until none is within most
    edits. An alignment begins anywhere in the part, or anchored at its first character. Around the part stands what
    no character equals: to go there costs as much as to leave the item's character out.
    """
    far = 1 << 29
    t = np.arange(below + above + 1, dtype=np.int32)
    padded = np.full(len(item) + len(t) + len(part), -1, np.int32)
    padded[below : below + len(part)] = part
    differs = np.lib.stride_tricks.sliding_window_view(padded, len(t))[: len(item)] != item[:, None]
    row = np.where(t >= below, t - below, far).astype(np.int32) if anchored else np.zeros(len(t), np.int32)
    now = np.empty_like(row)
    for k in range(len(item)):
        np.add(row[1:], 1, out=now[:-1])  # a character of the item that the part lacks
        now[-1] = far
        row += differs[k]
        np.minimum(now, row, out=now)
        now -= t
        np.minimum.accumulate(now, out=now)
        now += t
        row, now = now, row
        if k % 8 == 7 and row.min() > most:
            break
    return row


def align(item: np.ndarray, part: np.ndarray, most: int) -> tuple[int, int, int]:
    """The least edit distance of the item to a substring of the part, and where that begins and ends.

    Of equally near ones that which ends first and, of these, the shortest. The band holds every
    alignment of most edits; where none is that near, the distance is above most and the places mean nothing.
    """
    above = max(0, len(part) - len(item)) + most
    row = _banded(item, part, most, above, False, most)
    edits = int(row.min())
    if edits > most:
        return most + 1, 0, 0
    end = min(len(part), max(0, int(row.argmin()) - most + len(item)))
    # backwards from there: the shortest beginning that is as near
    back = part[max(0, end - len(item) - most) : end][::-1]
    sizes = np.arange(2 * most + 1) - most + len(item)
    found = _banded(item[::-1], back, most, most, True, most)
    return edits, end - min(len(back), max(0, int(sizes[np.flatnonzero(found == edits)[0]]))), end


def _matches(batches: Iterator[pa.RecordBatch], items) -> Iterator[pa.RecordBatch]:
    index = items.value
    for batch in slices(batches):
        all_docs = [normal(t.decode()) for t in texts(batch["text"])]
        rows: list[tuple] = []
        for a, b in runs(all_docs, RUN_BYTES):
            rows += [(a + d, *rest) for d, *rest in index.matches(all_docs[a:b])]
        doc, item, edits, low, high = map(list, zip(*rows, strict=True)) if rows else ([],) * 5
        out = {name: batch[name].take(pa.array(doc, pa.int32())) for name in batch.schema.names if name != "text"}
        yield pa.RecordBatch.from_pydict(out | {"item_id": pa.array(item, pa.int64()), "edits": pa.array(edits, pa.int32()), "from": pa.array(low, pa.int64()), "to": pa.array(high, pa.int64())})


def blocks(items: DataFrame) -> Iterator[list[tuple[object, str]]]:
    """The items in blocks of about BLOCK_BYTES, so that what goes to the executors has a bound."""
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text IS NOT NULL").distinct()
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-size // BLOCK_BYTES))
    for k in range(n):
        yield [(r[0], r[1]) for r in rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).collect()]


def leaks(docs: DataFrame, items: DataFrame, rate: float = EDIT_RATE, columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per row of docs and item that it holds: the named columns, item_id, edits, from and to.

    An item (item_id, text) is held if a substring of the text is within its edit budget: rate times
    its length, but so few that the q-gram lemma asks for one q-gram at least. Texts and items are
    compared lower-cased and with single spaces; from and to count UTF-16 units of that form. Items
    shorter than Q must stand as whole words. Null and empty texts hold nothing, null and empty items
    are held by nothing; equal rows each have their rows. An empty table on either side gives no rows.
    """
    spark = docs.sparkSession
    read = docs.select(*columns, F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in read.schema.fields if f.name != "text") + ", item_id long, edits int, from long, to long"
    out = None
    for block in blocks(items):
        part = read.mapInArrow(partial(_matches, items=spark.sparkContext.broadcast(Items(block, rate))), ddl)
        out = part if out is None else out.unionByName(part)
    return out


def _clean(batches: Iterator[pa.RecordBatch], items) -> Iterator[pa.RecordBatch]:
    index = items.value
    for batch in slices(batches):
        docs = [normal(t.decode()) for t in texts(batch["text"])]
        held = {a + d for a, b in runs(docs, RUN_BYTES) for d, *_ in index.matches(docs[a:b])}
        yield batch.filter(pa.array([k not in held for k in range(batch.num_rows)], pa.bool_()))


def without_leaks(docs: DataFrame, items: DataFrame, rate: float = EDIT_RATE) -> DataFrame:
    """The rows of docs that hold no item, with all their columns."""
    for block in blocks(items):
        docs = docs.mapInArrow(partial(_clean, items=docs.sparkSession.sparkContext.broadcast(Items(block, rate))), docs.schema)
    return docs


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "edits", F.col("from").alias("start_unit"), F.col("to").alias("end_unit"))
