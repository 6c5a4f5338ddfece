"""Suffix-array dedup: bytes that stand in a long string which also starts elsewhere are removed.

Every window of LENGTH bytes owns one of its short substrings, the one of the least hash, as its
anchor; equal windows have equal anchors. So repeats are looked for among the windows of one anchor:
anchors that occur once need no text at all, equal stretches are counted by digest, and of the others
one stretch of each kind goes to a shard, where a suffix array and its common prefixes tell which
windows repeat. An anchor of very many kinds is dealt anew by more of the text around it, so that no
shard grows with the input.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from saxframe.llm.common import prefix_sums, range_hashes, release, row_key, slices, stage, table, texts

LENGTH = 400
GRAM = 32
#: Window starts that are looked at together.
PIECE = 1 << 19
#: Bytes of a shard, about, after which the next anchor begins a new one.
SHARD = 1 << 20
#: Kinds of stretches, of under 800 bytes each, that one anchor brings to a shard at most.
KINDS = 1024
#: Those of an anchor with more are cut into windows with the anchor within so many places of one another, then of one.
WIDTHS = (24, 1)
SEPARATOR = 0xFF


# --- suffix arrays -----------------------------------------------------------------------------


def types(t: np.ndarray) -> np.ndarray:
    """True for S-type suffixes (less than the one that follows); the last is L-type, as the empty suffix is least."""
    n = len(t)
    differs = np.flatnonzero(t[:-1] != t[1:])
    out = np.zeros(n, bool)
    if len(differs):
        nearest = np.searchsorted(differs, np.arange(differs[-1] + 1))
        where = differs[nearest]
        out[: differs[-1] + 1] = t[where] < t[where + 1]
    return out


def _spread(found: np.ndarray, keys: np.ndarray, into: list[list[np.ndarray]]) -> None:
    """Appends found, in order, to the lists that keys name."""
    order = np.argsort(keys, kind="stable")
    keys, found = keys[order], found[order]
    cuts = np.flatnonzero(np.diff(keys)) + 1
    for part, key in zip(np.split(found, cuts), keys[np.concatenate([[0], cuts])] if len(keys) else [], strict=False):
        into[int(key)].append(part)


def induce(t: np.ndarray, s_type: np.ndarray, starred: np.ndarray, letters: int) -> np.ndarray:
    """The order of all suffixes that follows from the order of the starred ones (leftmost S-type).

    L-type suffixes come bucket by bucket in rising order, each bucket's list growing as it is read;
    then S-type ones in falling order from those. A bucket is read as arrays, not place by place.
    """
    def of(bucket: list[np.ndarray]) -> np.ndarray:
        return np.concatenate(bucket) if bucket else np.empty(0, np.int64)

    seeds: list[list[np.ndarray]] = [[] for _ in range(letters)]
    _spread(starred, t[starred], seeds)
    large: list[list[np.ndarray]] = [[] for _ in range(letters)]
    large[int(t[-1])].append(np.array([len(t) - 1]))  # it follows from the empty suffix
    l_order: list[np.ndarray] = []
    for c in range(letters):
        front, read = of(large[c]), []
        while len(front):
            read.append(front)
            before = front[front > 0] - 1
            before = before[~s_type[before]]
            front = before[t[before] == c]
        whole = of(read)
        l_order.append(whole)
        both = np.concatenate([whole, of(seeds[c])])
        before = both[both > 0] - 1
        before = before[~s_type[before] & (t[before] > c)]
        _spread(before, t[before], large)
    small: list[list[np.ndarray]] = [[] for _ in range(letters)]
    s_order: list[np.ndarray] = [np.empty(0, np.int64)] * letters
    for c in range(letters - 1, -1, -1):
        front, read = of(small[c]), []
        while len(front):
            read.append(front)
            before = front[front > 0] - 1
            before = before[s_type[before]]
            front = before[t[before] == c]
        whole = of(read)
        s_order[c] = whole[::-1]
        both = np.concatenate([whole, l_order[c][::-1]])
        before = both[both > 0] - 1
        before = before[s_type[before] & (t[before] < c)]
        _spread(before, t[before], small)
    return np.concatenate([x for pair in zip(l_order, s_order, strict=True) for x in pair])


def _doubled(names: np.ndarray) -> np.ndarray:
    """Suffix array by doubling ranks; for the reduced strings, whose letters are too many for buckets."""
    n = len(names)
    _, rank = np.unique(names, return_inverse=True)
    rank = rank.astype(np.int64) + 1
    width = 1
    while True:
        second = np.zeros(n, np.int64)
        second[: n - width if width < n else 0] = rank[width:]
        key = rank * (n + 2) + second
        order = np.argsort(key, kind="stable")
        fresh = np.concatenate([[1], (np.diff(key[order]) != 0).astype(np.int64)])
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(fresh)
        if rank[order[-1]] == n or width >= n:
            return order
        width *= 2


def suffix_array(t: np.ndarray, letters: int = 256) -> np.ndarray:
    """Induced sorting: starred substrings are sorted by a first induction, named, their string of names
    sorted by recursion, and all suffixes induced from that."""
    n = len(t)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: t[i:].tolist()), np.int64)
    s_type = types(t)
    star = np.flatnonzero(s_type[1:] & ~s_type[:-1]) + 1
    if len(star) < 2:
        return induce(t, s_type, star, letters)
    first = induce(t, s_type, star, letters)
    is_star = np.zeros(n, bool)
    is_star[star] = True
    ordered = first[is_star[first]]
    # starred substrings run to the next star; neighbours in order are equal if length and bytes are
    ends = np.append(star[1:] + 1, n)
    place = np.empty(n, np.int64)
    place[star] = np.arange(len(star))
    size = (ends - star)[place[ordered]]
    hashed = range_hashes(prefix_sums(t.astype(np.uint64) + np.uint64(1)), ordered, ordered + size)
    last = ordered + size == n
    same = (size[1:] == size[:-1]) & (hashed[1:] == hashed[:-1]) & ~last[1:] & ~last[:-1]
    name = np.concatenate([[0], np.cumsum(~same)])
    if name[-1] + 1 == len(star):
        return induce(t, s_type, ordered, letters)
    reduced = np.empty(len(star), np.int64)
    reduced[place[ordered]] = name
    few = int(name[-1]) + 1
    deeper = suffix_array(reduced, few) if few <= 1024 else _doubled(reduced)
    return induce(t, s_type, star[deeper], letters)


def permuted_prefixes(t: np.ndarray, order: np.ndarray) -> np.ndarray:
    """For each text position the length of the common prefix with the suffix before it in the order.

    Only where the bytes before a suffix and before its predecessor differ are bytes compared, eight at
    a time; elsewhere the length is one less than at the position before.
    """
    n = len(t)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    known = np.ones(n, bool)
    known[1:] = (before[1:] <= 0) | (t[:-1] != t[np.maximum(before[1:], 1) - 1])
    at = np.flatnonzero(known)
    padded = np.concatenate([t.astype(np.uint8), np.zeros(16, np.uint8)]).tobytes()
    words = np.ndarray((n + 8,), np.uint64, padded, 0, (1,))
    length = np.zeros(len(at), np.int64)
    live = np.flatnonzero(before[at] >= 0)
    while len(live):
        x, y = at[live] + length[live], before[at[live]] + length[live]
        room = n - np.maximum(x, y)
        x, y = np.minimum(x, n), np.minimum(y, n)
        odd = words[x] ^ words[y]
        # the lowest set bit says how many bytes agree
        low = odd & (~odd + np.uint64(1))
        agree = np.where(odd == 0, 8, np.bitwise_count(low - np.uint64(1)).astype(np.int64) // 8)
        agree = np.minimum(agree, np.maximum(room, 0))
        length[live] += agree
        live = live[agree == 8]
    run = np.maximum.accumulate(np.where(known, np.arange(n), 0))
    full = np.zeros(n, np.int64)
    full[at] = length
    out = full[run] - (np.arange(n) - run)
    return np.maximum(out, 0)


def repeated_starts(stretches: list[bytes], owned: list[int], length: int) -> list[np.ndarray]:
    """Of each stretch, which of its first owned windows are equal to a window that another or the same stretch owns."""
    sizes = np.array([len(s) + 1 for s in stretches])
    begin = np.cumsum(sizes) - sizes
    t = np.frombuffer(b"\xff".join([*stretches, b""]), np.uint8)
    order = suffix_array(t)
    prefix = permuted_prefixes(t, order)[order]
    mine = np.zeros(len(t), bool)
    for b, k in zip(begin.tolist(), owned, strict=True):
        mine[b : b + k] = True
    group = np.cumsum(prefix < length)
    counts = np.bincount(group[mine[order]], minlength=int(group[-1]) + 1)
    hit = np.zeros(len(t), bool)
    hit[order] = counts[group] > 1
    hit &= mine
    return [np.flatnonzero(hit[b : b + k]) for b, k in zip(begin.tolist(), owned, strict=True)]


# --- anchors -----------------------------------------------------------------------------------


def anchors(items: list[bytes], length: int, gram: int) -> Iterator[tuple[int, int, int, int, int]]:
    """(item, first window start, last window start, anchor place, anchor hash): windows in a row with one anchor."""
    reach = length - gram + 1
    group: list[tuple[int, int, int]] = []
    size = 0

    def flush() -> Iterator[tuple[int, int, int, int, int]]:
        data = np.frombuffer(b"".join(items[k][a:b] for k, a, b in group), np.uint8)
        spans = np.array([b - a for _, a, b in group])
        begin = np.cumsum(spans) - spans
        grams = np.arange(len(data) - gram + 1)
        h = range_hashes(prefix_sums(data + np.uint8(1)), grams, grams + gram)
        v = (h & ~np.uint64((1 << 24) - 1)) | grams.astype(np.uint64)
        pad = -len(v) % reach
        square = np.concatenate([v, np.full(pad, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, reach)
        ahead = np.minimum.accumulate(square, axis=1).reshape(-1)
        back = np.minimum.accumulate(square[:, ::-1], axis=1)[:, ::-1].reshape(-1)
        n = len(v) - reach + 1
        least = np.minimum(back[:n], ahead[reach - 1 : reach - 1 + n])
        place = (least & np.uint64((1 << 24) - 1)).astype(np.int64)
        real = np.zeros(n, bool)
        for b, s in zip(begin.tolist(), spans.tolist(), strict=True):
            real[b : b + s - length + 1] = True
        change = np.ones(n, bool)
        change[1:] = (place[1:] != place[:-1]) | ~real[:-1]
        first = np.flatnonzero(change & real)
        stop = np.ones(n, bool)
        stop[:-1] = (place[1:] != place[:-1]) | ~real[1:]
        last = np.flatnonzero(stop & real)
        owner = np.searchsorted(begin, first, side="right") - 1
        signed = h.view(np.int64)
        for o, f, e, p in zip(owner.tolist(), first.tolist(), last.tolist(), place[first].tolist(), strict=True):
            k, a, _ = group[o]
            move = a - int(begin[o])
            yield k, f + move, e + move, p + move, int(signed[p])

    for k, text in enumerate(items):
        for a in range(0, len(text) - length + 1, PIECE):
            b = min(len(text), a + PIECE + length - 1)
            if size and size + b - a > 2 * PIECE:
                yield from flush()
                group, size = [], 0
            group.append((k, a, b))
            size += b - a
    if group:
        yield from flush()


_MASK = (1 << 64) - 1
#: Of a stretch: its windows' first and last start, the anchor's place in it, the anchor's hash and the stretch's digest.
MARK = ("lo", "hi", "at", "h", "d1", "d2")
MARK_DDL = "k1 long, k2 long, " + ", ".join(f"{c} long" for c in MARK)


def _anchor_rows(batches: Iterator[pa.RecordBatch], length: int, gram: int) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        items = texts(batch["text"])
        rows: list[tuple] = []
        for k, lo, hi, place, h in anchors(items, length, gram):
            d = xxhash.xxh128_intdigest(items[k][lo : hi + length], place - lo)
            rows.append((k, lo, hi, place - lo, h, (d >> 64) - (1 << 63), (d & _MASK) - (1 << 63)))
        cols = list(zip(*rows, strict=True)) if rows else [()] * 7
        row = pa.array(cols[0], pa.int32())
        out = {c: batch[c].take(row) for c in ("k1", "k2")}
        yield pa.RecordBatch.from_pydict(out | {c: pa.array(v, pa.int64()) for c, v in zip(MARK, cols[1:], strict=True)})


def pieces(text: bytes, lo: int, hi: int, place: int, length: int, width: int) -> Iterator[tuple[int, int, int, int]]:
    """(first window start, last window start, key, digest) of the parts of a stretch of windows lo to hi.

    A part's windows begin width * k to width * (k + 1) - 1 bytes before the anchor. The key is of the bytes that all
    such windows hold: equal windows lie in parts of one key, as the anchor stands at the same place in both.
    """
    for k in range((place - hi) // width, (place - lo) // width + 1):
        a, b = max(lo, place - width * (k + 1) + 1), min(hi, place - width * k)
        core = text[place - width * k : place - width * (k + 1) + 1 + length]
        yield a, b, xxhash.xxh64_intdigest(core, k) - (1 << 63), xxhash.xxh128_intdigest(text[a : b + length], place - a)


def _pieces(batches: Iterator[pa.RecordBatch], length: int, width: int) -> Iterator[pa.RecordBatch]:
    """The parts of stretches, as marks in a body that the stretch's digest names."""
    for batch in slices(batches, "body"):
        rows: list[tuple] = []
        for k, (body, at, owned) in enumerate(zip(texts(batch["body"]), batch["at"].to_pylist(), batch["owned"].to_pylist(), strict=True)):
            for a, b, key, d in pieces(body, 0, owned - 1, at, length, width):
                rows.append((k, a, b, at - a, key, (d >> 64) - (1 << 63), (d & _MASK) - (1 << 63)))
        cols = list(zip(*rows, strict=True)) if rows else [()] * 7
        row = pa.array(cols[0], pa.int32())
        out = {new: batch[c].take(row) for new, c in (("k1", "d1"), ("k2", "d2"), ("of", "h"))}
        yield pa.RecordBatch.from_pydict(out | {c: pa.array(v, pa.int64()) for c, v in zip(MARK, cols[1:], strict=True)})


def _stretches(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        cols: dict[str, list] = {c: [] for c in ("h", "d1", "d2", "at", "heavy", "owned", "body")}
        for text, marks in zip(texts(batch["text"]), batch["marks"].to_pylist(), strict=True):
            for m in marks:
                for c in ("h", "d1", "d2", "at", "heavy"):
                    cols[c].append(m[c])
                cols["owned"].append(m["hi"] - m["lo"] + 1)
                cols["body"].append(text[m["lo"] : m["hi"] + length])
        yield pa.RecordBatch.from_pydict({c: pa.array(v, {"body": pa.binary(), "heavy": pa.bool_()}.get(c, pa.int64())) for c, v in cols.items()})


def _shards(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Rows come in order of their anchor; a shard ends between two anchors."""
    held: list[dict] = []
    size = 0

    def flush() -> pa.RecordBatch:
        found = repeated_starts([r["body"] for r in held], [r["owned"] for r in held], length)
        cols: dict[str, list] = {c: [] for c in ("h", "d1", "d2", "from", "to")}
        for r, starts in zip(held, found, strict=True):
            if len(starts):
                cuts = np.flatnonzero(np.diff(starts) > length) + 1
                for part in np.split(starts, cuts):
                    for c in ("h", "d1", "d2"):
                        cols[c].append(r[c])
                    cols["from"].append(int(part[0]))
                    cols["to"].append(int(part[-1]) + length)
        return pa.RecordBatch.from_pydict({c: pa.array(v, pa.int64()) for c, v in cols.items()})

    for batch in batches:
        for r in batch.to_pylist():
            if held and all(r[c] == held[-1][c] for c in ("h", "d1", "d2")):
                continue  # equal rows show the same stretch
            if size > SHARD and r["h"] != held[-1]["h"]:
                yield flush()
                held, size = [], 0
            held.append(r)
            size += len(r["body"])
    if held:
        yield flush()


def _kept(batches: Iterator[pa.RecordBatch], with_text: bool) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        size, removed, spans, digest, left = [], [], [], [], []
        for text, ranges in zip(texts(batch["text"]), batch["ranges"].to_pylist(), strict=True):
            merged: list[list[int]] = []
            for a, b in sorted((r["from"], r["to"]) for r in ranges or ()):
                if merged and a <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], b)
                else:
                    merged.append([a, b])
            at, parts = 0, []
            for a, b in merged:
                parts.append(text[at:a])
                at = b
            kept = b"".join([*parts, text[at:]])
            size.append(len(text))
            removed.append(len(text) - len(kept))
            spans.append(len(merged))
            digest.append(hashlib.sha256(kept).hexdigest())
            if with_text:
                left.append(kept)
        out = {c: batch[c] for c in batch.schema.names if c not in ("text", "ranges")}
        out |= {"n_bytes": pa.array(size, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(spans, pa.int64()), "kept_sha256": pa.array(digest, pa.string())}
        yield pa.RecordBatch.from_pydict(out | ({"kept": pa.array(left, pa.binary())} if with_text else {}))


def dealt(members: DataFrame, most: int | None) -> tuple[DataFrame, DataFrame]:
    """One row (k1, k2 and MARK's columns, c its number) per kind of stretch; and those of anchors with several kinds, heavy if with more than most (None: no bound)."""
    kinds = stage(members.groupBy("h", "d1", "d2").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("k1", "k2", "lo", "hi", "at")).alias("s")).select("s.*", "h", "d1", "d2", "c"), "suffix-kinds")
    several = kinds.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h", F.lit(False).alias("heavy") if most is None else (F.col("n") > most).alias("heavy"))
    return kinds, kinds.join(several, "h")


def repeats(rows: DataFrame, members: DataFrame, length: int, most: int, widths: tuple[int, ...], n: int) -> DataFrame:
    """(h, d1, d2, from, to): in stretches of this kind, bytes from to to are in repeated windows; a null to is the end.

    members are marks in rows (k1, k2, text).
    """
    kinds, shown = dealt(members, most if widths else None)
    # a stretch that occurs twice is repeated throughout; among several of one anchor, the array decides
    found = kinds.where("c > 1").select("h", "d1", "d2", F.lit(0).cast("long").alias("from"), F.lit(None).cast("long").alias("to"))
    per_row = shown.groupBy("k1", "k2").agg(F.collect_list(F.struct(*MARK, "heavy")).alias("marks"))
    cut = rows.join(per_row, ["k1", "k2"]).select("text", "marks").mapInArrow(partial(_stretches, length=length), "h long, d1 long, d2 long, at long, heavy boolean, owned long, body binary")
    held = stage(cut, "suffix-stretches") if widths else cut
    light = held.where("NOT heavy").select("h", "d1", "d2", "owned", "body").repartition(n, "h").sortWithinPartitions("h", "d1", "d2")
    found = found.unionByName(light.mapInArrow(partial(_shards, length=length), "h long, d1 long, d2 long, from long, to long"))
    if widths and not (heavy := held.where("heavy").dropDuplicates(["h", "d1", "d2"])).isEmpty():
        parts = stage(heavy.mapInArrow(partial(_pieces, length=length, width=widths[0]), "k1 long, k2 long, of long, " + ", ".join(f"{c} long" for c in MARK)), "suffix-pieces")
        inner = repeats(heavy.select(F.col("d1").alias("k1"), F.col("d2").alias("k2"), F.col("body").alias("text")), parts.drop("of"), length, most, widths[1:], n)
        back = parts.join(inner, ["h", "d1", "d2"]).select(F.col("of").alias("h"), F.col("k1").alias("d1"), F.col("k2").alias("d2"), (F.col("lo") + F.col("from")).alias("from"), (F.col("lo") + F.coalesce("to", F.col("hi") - F.col("lo") + F.lit(length))).alias("to"))
        found = found.unionByName(back)
    out = stage(found, "suffix-found")
    release(kinds)
    release(held)
    return out


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, with_text: bool = False, kinds: int = KINDS, widths: tuple[int, ...] = WIDTHS) -> DataFrame:
    """One row per row of docs (doc_id, text; others are not read): doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    A byte is removed if a string of length bytes covers it that also starts at any other place of the
    table, in the same text or another; strings are judged on the input. n_spans counts the maximal
    removed runs, kept_sha256 is of the bytes that are left (with_text adds them as kept; a cut may
    fall inside a character). A null text is empty; shorter texts lose nothing. Rows that agree in id
    and text are two places. An empty table has no rows.
    """
    keyed = docs.select("doc_id", F.col("text").cast("string").alias("text"), *row_key("doc_id", "text"))
    long_enough = keyed.where(F.octet_length("text") >= length).select("k1", "k2", "text")
    marks = stage(long_enough.mapInArrow(partial(_anchor_rows, length=length, gram=gram), MARK_DDL), "suffix-anchors")
    # Written first, so that the join has exchanges of its own and Spark can split a frequent anchor's partition.
    more = stage(marks.groupBy("h").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("h"), "suffix-anchors-again")
    members = stage(marks.join(more, "h"), "suffix-members")
    release(marks)
    n = max(8, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    found = repeats(long_enough, members, length, kinds, widths, n)
    ranges = members.join(found, ["h", "d1", "d2"]).select("k1", "k2", F.struct((F.col("lo") + F.col("from")).alias("from"), F.coalesce(F.col("lo") + F.col("to"), F.col("hi") + F.lit(length)).alias("to")).alias("r"))
    per_row = ranges.groupBy("k1", "k2").agg(F.collect_set("r").alias("ranges"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    ddl = f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text
    return keyed.join(per_row, ["k1", "k2"], "left").select("doc_id", "text", "ranges").mapInArrow(partial(_kept, with_text=with_text), ddl)


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))


OP2_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT r, i, md5(substr(h, 2 * i + 1, 800)) AS m FROM (SELECT r, h, unnest(range(0, greatest(0, length(h) // 2 - 399))) AS i FROM d)),
starts AS (SELECT r, i FROM w WHERE m IN (SELECT m FROM w GROUP BY m HAVING count(*) > 1)),
marked AS (SELECT r, i, CASE WHEN i <= lag(i) OVER (PARTITION BY r ORDER BY i) + 400 THEN 0 ELSE 1 END AS fresh FROM starts),
runs AS (SELECT r, i, sum(fresh) OVER (PARTITION BY r ORDER BY i) AS g FROM marked),
spans AS (SELECT r, min(i) AS a, max(i) + 400 AS b FROM runs GROUP BY r, g),
gaps AS (SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS p FROM spans),
kept AS (
  SELECT d.r, count(a) AS n, coalesce(sum(b - a), 0) AS gone,
         coalesce(string_agg(substr(h, CAST(2 * p + 1 AS BIGINT), CAST(2 * (a - p) AS BIGINT)), '' ORDER BY a), '') || substr(any_value(h), CAST(2 * coalesce(max(b), 0) + 1 AS BIGINT)) AS k
  FROM d LEFT JOIN gaps ON d.r = gaps.r GROUP BY d.r)
SELECT d.doc_id, CAST(length(d.h) // 2 AS BIGINT) AS n_bytes, CAST(kept.gone AS BIGINT) AS n_removed, CAST(kept.n AS BIGINT) AS n_spans, sha256(unhex(kept.k)) AS kept_sha256
FROM d JOIN kept ON d.r = kept.r
"""
