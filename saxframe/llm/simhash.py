"""SimHash near-dedup: fingerprints over word shingles, compared exactly tile against tile."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from saxframe.llm.common import row_key, slices, stage, table, texts
from saxframe.llm.graph import Forest, components

#: Fingerprints of a tile at most, about; a tile is a few MB with its sketches.
TILE = 65_536
SKETCH = 256


def shingle_hashes(text: bytes, words: int, seed: int = 42) -> np.ndarray:
    """XXH64 of each run of so many words, A-Z lower-cased and joined by a space, in order and with repeats.

    A text of fewer words has one run, all of it; a text without words has none.
    """
    parts = text.lower().split()
    if not parts:
        return np.empty(0, np.uint64)
    joined = b" ".join(parts)
    if len(parts) <= words:
        return np.array([xxhash.xxh64_intdigest(joined, seed)], np.uint64)
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    start = [0, *(gaps[: len(parts) - words] + 1).tolist()]
    end = [*gaps[words - 1 :].tolist(), len(joined)]
    view, digest = memoryview(joined), xxhash.xxh64_intdigest
    return np.array([digest(view[s:e], seed) for s, e in zip(start, end, strict=True)], np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """A bit is 1 if it is set in over half of the hashes; 0 without hashes."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)]
        counts += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


#: Odd multipliers of the sketch's hash functions, from a rule.
SKETCH_MULTIPLIERS = np.array([pow(0x9E3779B97F4A7C15, 2 * k + 1, 1 << 64) | 1 for k in range(SKETCH)], np.uint64)


def sketch(hashes: np.ndarray) -> bytes:
    """One byte of the least hash under each of SKETCH functions: texts agree in a share J + (1 - J) / 256 of them."""
    least = np.full(SKETCH, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 4096):
        part = hashes[at : at + 4096, None]
        np.minimum(least, ((part ^ (part >> np.uint64(32))) * SKETCH_MULTIPLIERS).min(axis=0), out=least)
    return ((least * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(56)).astype(np.uint8).tobytes()


def _fingerprints(batches: Iterator[pa.RecordBatch], words: int, sketched: bool) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        fp, sketches = [], []
        for text in texts(batch["text"]):
            hashes = shingle_hashes(text, words)
            fp.append(fingerprint(hashes))
            if sketched:
                sketches.append(sketch(hashes))
        out = {name: batch[name] for name in batch.schema.names if name != "text"} | {"fp": pa.array(np.array(fp, np.uint64).view(np.int64))}
        if sketched:
            out["sketch"] = pa.array(sketches, pa.binary())
        yield pa.RecordBatch.from_pydict(out)


def fingerprints(docs: DataFrame, words: int = 4, sketched: bool = False) -> DataFrame:
    """docs without its text column, with fp (the 64 bits as a long) and, if asked for, a min-hash sketch."""
    kept = [f for f in docs.schema.fields if f.name != "text"]
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", fp long" + ", sketch binary" * sketched
    return docs.mapInArrow(partial(_fingerprints, words=words, sketched=sketched), ddl)


def _cells(fp: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int, int]]]:
    """An order by the population counts of both halves, and (high, low, from, to) of each cell in it."""
    high, low = np.bitwise_count(fp >> np.uint64(32)).astype(np.int64), np.bitwise_count(fp & np.uint64(0xFFFFFFFF)).astype(np.int64)
    key = high * 64 + low
    order = np.argsort(key, kind="stable")
    edges = np.flatnonzero(np.diff(key[order], prepend=-1, append=1 << 20))
    return order, [(int(key[order[a]]) // 64, int(key[order[a]]) % 64, int(a), int(b)) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def tile_edges(a: np.ndarray, b: np.ndarray, radius: int, same: bool, sketches: tuple | None = None, agree: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest of the pairs of a and b within the radius (and, with sketches, of so many agreeing bytes).

    Every pair is compared by exclusive-or and bit count, but for cells whose population counts
    differ by more than the radius. Only links that join two trees are given, so that a group of n
    near copies gives n - 1 of them.
    """
    both = a if same else np.concatenate([a, b])
    forest, shift = Forest(len(both)), 0 if same else len(a)
    (order_a, cells_a), (order_b, cells_b) = _cells(a), _cells(b)
    fa, fb = a[order_a], b[order_b]
    if sketches:
        sa, sb = sketches[0][order_a], sketches[1][order_b]
    for ah, al, a0, a1 in cells_a:
        for bh, bl, b0, b1 in cells_b:
            if abs(ah - bh) + abs(al - bl) > radius or same and (bh, bl) < (ah, al):
                continue
            right = fb[b0:b1]
            step = max(1, (1 << 18) // (b1 - b0))
            for at in range(a0, a1, step):
                near = np.bitwise_count(fa[at : min(a1, at + step), None] ^ right) <= radius
                i, j = np.nonzero(near)
                if not len(i):
                    continue
                i, j = i + at, j + b0
                x, y = order_a[i], order_b[j] + shift
                far = forest.apart(x, y)
                if sketches and far.any():
                    far[far] = (sa[i[far]] == sb[j[far]]).sum(axis=1) >= agree
                forest.join(x[far], y[far])
    i, root = forest.edges()
    return both[i], both[root]


def _compare(batches: Iterator[pa.RecordBatch], radius: int, agree: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in range(batch.num_rows):
            at = {name: batch[name][row] for name in batch.schema.names}
            a, b = (at[n].values.to_numpy(zero_copy_only=False).view(np.uint64) for n in ("fps", "other_fps"))
            sketches = None
            if agree:
                sketches = tuple(np.frombuffer(b"".join(at[n].values.to_pylist()), np.uint8).reshape(-1, SKETCH) for n in ("sketches", "other_sketches"))
            x, y = tile_edges(a, b, radius, at["tile"].as_py() == at["other"].as_py(), sketches, agree)
            yield pa.RecordBatch.from_pydict({"a": pa.array(x.view(np.int64)), "b": pa.array(y.view(np.int64))})


def links(classes: DataFrame, radius: int, agree: int = 0) -> DataFrame:
    """Links (a, b) between the distinct fingerprints fp of classes that connect what all pairs within the radius connect.

    Fingerprints are dealt to tiles by population count (65 counts, so a histogram of 65 rows
    says how many tiles each count needs) and within a count by hash. A tile meets the tiles of
    population counts within the radius and no others.
    """
    spark = classes.sparkSession
    population = F.bit_count("fp")
    histogram = {r[0]: r[1] for r in classes.groupBy(population.alias("p")).count().collect()}
    # Counts of few fingerprints share tiles; last[t] is the last tile that tile t meets.
    share, size = {}, 0
    merged: list[tuple[int, int]] = []
    for p in range(65):
        n = histogram.get(p, 0)
        if not n:
            continue
        if merged and size + n <= TILE:
            share[p], size = (len(merged) - 1, 1), size + n
            merged[-1] = (merged[-1][0], p)
        else:
            parts = -(-n // TILE)
            share[p], size = (len(merged), parts), n if parts == 1 else TILE
            merged += [(p, p)] * parts
    if not merged:
        return spark.createDataFrame([], "a long, b long")
    last = [max(u for u in range(t, len(merged)) if merged[u][0] - merged[t][1] <= radius) for t in range(len(merged))]
    first = F.create_map(*[F.lit(int(x)) for p, (t, _) in share.items() for x in (p, t)])[population]
    parts = F.create_map(*[F.lit(int(x)) for p, (_, n) in share.items() for x in (p, n)])[population]
    tile = (first + F.pmod(F.xxhash64("fp"), parts)).cast("int")
    held = [F.collect_list("fp").alias("fps")] if not agree else [F.collect_list(F.struct("fp", "sketch")).alias("both")]
    made = classes.withColumn("tile", tile).groupBy("tile").agg(*held)
    if agree:
        made = made.select("tile", F.col("both.fp").alias("fps"), F.col("both.sketch").alias("sketches"))
    made = stage(made, "simhash-tiles")
    until = F.element_at(F.array(*[F.lit(t) for t in last]), F.col("tile") + 1)
    others = made.select(*[F.col(c).alias("other" if c == "tile" else f"other_{c}") for c in made.columns])
    pairs = made.select("*", F.explode(F.sequence(F.col("tile"), until)).alias("other")).repartition(min(4096, 2 * len(last)), "other").join(others, "other")
    return pairs.mapInArrow(partial(_compare, radius=radius, agree=agree), "a long, b long")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", words: int = 4, radius: int = 4, similarity: float = 0.0) -> DataFrame:
    """One row per row of docs (columns doc_id and text; others are not read): doc_id, fp and component_id.

    component_id is the smallest doc_id that can be reached over links between fingerprints that
    differ in radius bits at most. With a similarity, a link also needs that Jaccard similarity of
    the shingle sets, as min-hash sketches estimate it. A null text is empty; texts without words
    have fingerprint zero and are linked with one another. Rows with equal ids, equal texts or a
    null id are rows like any other; null ids are never the smallest. An empty table has no rows.
    """
    verify = similarity > 0
    agree = int(np.ceil(SKETCH * (similarity + (1 - similarity) / 256) - 2 * np.sqrt(SKETCH * similarity * (1 - similarity)))) if verify else 0
    held = stage(fingerprints(docs.select(F.col(doc_id).alias("doc_id"), F.col("text").cast("string").alias("text")), words, verify), "simhash")
    classes = held.groupBy("fp").agg(F.min("doc_id").alias("least"), *([F.min("sketch").alias("sketch")] if verify else []))
    found = components(links(classes, radius, agree), "simhash-links").withColumnRenamed("node", "fp")
    named = classes.select("fp", "least").join(found, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    members = stage(named.select("fp", "component").join(least, "component").select("fp", "component_id"), "simhash-members")
    return held.select("doc_id", "fp").join(members, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, words: int = 5, radius: int = 20, similarity: float = 0.8) -> DataFrame:
    """docs without near copies: of each component one row stays, that of the least id and, among equal ids, of the least content hash.

    Of rows that agree in id and text that one stays whose columns, as JSON, have the least hash. Rows of a null id
    are told apart by their text. The columns of docs are kept as they are, whatever their names.

    The radius is wide: texts whose shingle sets have a similarity of 0.8 differ in 10 of 64 bits, give or take 3. Whether they
    are that similar is decided by the sketches: their estimate's deviation is 0.025 there, and a pair is taken from two
    deviations below the bound on.
    """
    k1, k2 = row_key("doc_id", "text")
    keyed = docs.select(F.struct(*docs.columns).alias("given"), "doc_id", "text", k1.alias("__k1"), k2.alias("__k2"))
    rows = keyed.select(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.col("__k1").alias("k1"), F.col("__k2").alias("k2")).alias("at"), F.col("text").cast("string").alias("text"))
    verify = similarity > 0
    agree = int(np.ceil(SKETCH * (similarity + (1 - similarity) / 256) - 2 * np.sqrt(SKETCH * similarity * (1 - similarity)))) if verify else 0
    held = stage(fingerprints(rows, words, verify), "simhash-keep")
    classes = held.groupBy("fp").agg(F.min("at").alias("least"), *([F.min("sketch").alias("sketch")] if verify else []))
    found = components(links(classes, radius, agree), "simhash-keep-links").withColumnRenamed("node", "fp")
    first = classes.join(found, "fp", "left").groupBy(F.coalesce("component", "fp").alias("component")).agg(F.min("least").alias("at"))
    kept = first.select(F.col("at.k1").alias("__k1"), F.col("at.k2").alias("__k2")).distinct()
    once = keyed.join(kept, ["__k1", "__k2"], "left_semi")
    # Rows of equal id and text share a key: one of them stays.
    return once.groupBy("__k1", "__k2").agg(F.min_by("given", F.xxhash64(F.to_json("given"))).alias("given")).select("given.*")


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
