"""Embedding near-dedup: randomised-rotation binary codes decide which pairs are recomputed exactly."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from saxframe.llm.common import stage, table
from saxframe.llm.graph import Forest, components

#: Vectors of a tile, about; a tile of 64 dimensions is 4 MB.
TILE = 16_384
COSINE = 0.9
#: Width of the confidence bound in standard deviations of the estimate.
CONFIDENCE = 6.0
SEED = 20


def rotation(dimensions: int, seed: int = SEED) -> np.ndarray:
    """A random orthogonal matrix: Q of a Gaussian matrix, its columns' signs made unique by R."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dimensions, dimensions)))
    return q * np.where(np.diag(r) < 0, -1.0, 1.0)


def encode(unit: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sign bits of the rotated unit vectors, packed, and each one's correction factor: its inner product with its code."""
    turned = unit @ turn
    return np.packbits(turned >= 0, axis=1), np.abs(turned).sum(axis=1) / np.sqrt(unit.shape[1])


def code_thresholds(factor: np.ndarray, dimensions: int, cosine: float, confidence: float) -> np.ndarray:
    """The inner product of code and query from which on a pair must be recomputed.

    With the code o' of o and f = <o, o'>, <o', q> / f is an unbiased estimate of <o, q> with a
    standard deviation of about sqrt((1 - f^2) / f^2 / (D - 1)); the pair can be left out where the
    estimate and so many deviations stay below the cosine. It can also be left out, with certainty,
    where the angles forbid it: angle(o', q) > angle(o', o) + angle(o, q). The laxer test would only
    add work, so the stricter one is taken; with the defaults it misses nothing that a test has found.
    """
    f = np.clip(factor, 1e-6, 1.0)
    wide = confidence * np.sqrt((1 - f * f) / (f * f) / max(1, dimensions - 1))
    by_confidence = f * (cosine - wide)
    angle = np.arccos(f) + np.arccos(cosine)
    by_angle = np.where(angle >= np.pi, -1.0, np.cos(np.minimum(angle, np.pi)))
    return np.maximum(by_confidence, by_angle) - 1e-5


def tile_links(a: np.ndarray, b: np.ndarray, codes: np.ndarray, factor: np.ndarray, same: bool, cosine: float, confidence: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j) of the pairs of a and b whose cosine, in double precision, reaches the bound; within one tile i < j."""
    dimensions = a.shape[1]
    unit_a, unit_b = (x / np.linalg.norm(x, axis=1)[:, None] for x in (a, b))
    queries = np.ascontiguousarray((unit_b @ rotation(dimensions)).astype(np.float32).T)
    signs = (np.unpackbits(codes, axis=1, count=dimensions).astype(np.float32) * 2 - 1) / np.float32(np.sqrt(dimensions))
    least = code_thresholds(factor, dimensions, cosine, confidence).astype(np.float32)
    for at in range(0, len(a), 256):
        rows = slice(at, at + 256)
        from_row = at if same else 0
        maybe = (signs[rows] @ queries[:, from_row:]) >= least[rows, None]
        i, j = np.nonzero(maybe)
        i, j = i + at, j + from_row
        if same:
            i, j = i[i < j], j[i < j]
        for part in range(0, len(i), 1 << 16):
            x, y = i[part : part + (1 << 16)], j[part : part + (1 << 16)]
            near = np.einsum("nd,nd->n", unit_a[x], unit_b[y]) >= cosine
            yield x[near], y[near]


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        codes, factors = [b""] * batch.num_rows, np.zeros(batch.num_rows)
        vectors = batch["embedding"].to_pylist()
        by_size: dict[int, list[int]] = {}
        for k, v in enumerate(vectors):
            by_size.setdefault(len(v), []).append(k)
        for size, rows in by_size.items():
            x = np.array([vectors[k] for k in rows], np.float64)
            x /= np.abs(x).max(axis=1)[:, None]
            code, factor = encode(x / np.linalg.norm(x, axis=1)[:, None], rotation(size))
            factors[rows] = factor
            for k, c in zip(rows, code, strict=True):
                codes[k] = c.tobytes()
        yield pa.RecordBatch.from_pydict({name: batch[name] for name in batch.schema.names} | {"code": pa.array(codes, pa.binary()), "factor": pa.array(factors)})


def _matrix(value: pa.ListScalar, n: int) -> np.ndarray:
    flat = value.values.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat.reshape(n, -1)
    return x / np.abs(x).max(axis=1)[:, None]


def _compare(batches: Iterator[pa.RecordBatch], cosine: float, confidence: float) -> Iterator[pa.RecordBatch]:
    """Per pair of tiles: how many rows of vectors each class is linked with, and the links of a spanning forest."""
    for batch in batches:
        for row in range(batch.num_rows):
            at = {name: batch[name][row] for name in batch.schema.names}
            same = at["tile"].as_py() == at["other"].as_py()
            nodes = [at[k].values.to_numpy(zero_copy_only=False) for k in ("nodes", "other_nodes")]
            sizes = [at[k].values.to_numpy(zero_copy_only=False) for k in ("sizes", "other_sizes")]
            a, b = (_matrix(at[k], len(n)) for k, n in zip(("vectors", "other_vectors"), nodes, strict=True))
            codes = np.frombuffer(b"".join(at["codes"].values.to_pylist()), np.uint8).reshape(len(a), -1)
            factor = at["factors"].values.to_numpy(zero_copy_only=False)
            shift = 0 if same else len(a)
            n = len(a) + (0 if same else len(b))
            forest, linked = Forest(n), np.zeros(n, np.int64)
            for i, j in tile_links(a, b, codes, factor, same, cosine, confidence):
                np.add.at(linked, i, sizes[1][j])
                np.add.at(linked, j + shift, sizes[0][i])
                far = forest.apart(i, j + shift)
                forest.join(i[far], j[far] + shift)
            both = nodes[0] if same else np.concatenate(nodes)
            child, root = forest.edges()
            some = np.flatnonzero(linked)
            out = [both[child], both[some]], [both[root], np.full(len(some), -1)], [np.zeros(len(child), np.int64), linked[some]]
            x, y, z = (np.concatenate(v).astype(np.int64) for v in out)
            yield pa.RecordBatch.from_pydict({"a": pa.array(x), "b": pa.array(y), "linked": pa.array(z)})


def near_vectors(vectors: DataFrame, cosine: float = COSINE, confidence: float = CONFIDENCE) -> DataFrame:
    """One row per row of vectors (vec_id, embedding; others are not read): vec_id, n_links, component_id and kept.

    Two rows are linked if their vectors' cosine in double precision is at least the bound, labels
    aside. A vector that is null, empty or zero or holds a null, NaN or infinity is linked with
    nothing; neither are vectors of different lengths. n_links counts the other rows that a row is
    linked with, component_id is the least vec_id that it reaches (its own included), and kept says
    whether that is its own. Equal vectors are compared once, as a class. A null vec_id is never the
    least, and a row whose component has only null ids has a null component_id. An empty table has
    no rows.

    All pairs of classes are estimated from their codes, tile against tile; what the bounds don't
    rule out is recomputed. A pair of tiles gives counts and the links of a spanning forest, not its
    pairs.
    """
    spark = vectors.sparkSession
    rows = vectors.select("vec_id", "embedding")
    usable = F.col("embedding").isNotNull() & F.coalesce(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))), F.lit(False)) & F.coalesce(F.exists("embedding", lambda x: x != 0), F.lit(False))
    classes = rows.where(usable).groupBy("embedding").agg(F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("least"))
    # The number is drawn as the table is written, and is the class's from then on.
    held = stage(classes.withColumn("node", F.monotonically_increasing_id()), "vector-classes")
    coded = held.mapInArrow(_encode, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in held.schema.fields) + ", code binary, factor double")
    by_size = {r[0]: r[1] for r in held.groupBy(F.size("embedding")).count().collect()}
    base, parts, at = {}, {}, 0
    for size, n in sorted(by_size.items()):
        base[size], parts[size] = at, -(-n // TILE)
        at += parts[size]
    if not at:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    size = F.size("embedding")
    first = F.create_map(*[F.lit(x) for s in base for x in (s, base[s])])[size]
    many = F.create_map(*[F.lit(x) for s in base for x in (s, parts[s])])[size]
    last = F.array(*[F.lit(base[s] + parts[s] - 1) for s in sorted(base) for _ in range(parts[s])])
    tile = (first + F.pmod(F.xxhash64("node"), many)).cast("int")
    packed = coded.withColumn("tile", tile).groupBy("tile").agg(F.collect_list(F.struct("node", "n", "embedding", "code", "factor")).alias("v"))
    tiles = stage(packed.select("tile", F.col("v.node").alias("nodes"), F.col("v.n").alias("sizes"), F.col("v.embedding").alias("vectors"), F.col("v.code").alias("codes"), F.col("v.factor").alias("factors")), "vector-tiles")
    others = tiles.select(F.col("tile").alias("other"), *[F.col(c).alias(f"other_{c}") for c in ("nodes", "sizes", "vectors")])
    met = tiles.select("*", F.explode(F.sequence("tile", F.element_at(last, F.col("tile") + 1))).alias("other"))
    met = met.repartition(min(4096, 2 * at), "other").join(others, "other")
    found = stage(met.mapInArrow(partial(_compare, cosine=cosine, confidence=confidence), "a long, b long, linked long"), "vector-links")
    reached = components(found.where("b >= 0").select("a", "b"), "vector-components")
    links = found.where("b < 0").groupBy(F.col("a").alias("l")).agg(F.sum("linked").alias("linked"))
    named = held.select("embedding", "node", "n", "least").join(reached, "node", "left").join(links, F.col("node") == F.col("l"), "left").withColumn("component", F.coalesce("component", "node"))
    least = named.groupBy(F.col("component").alias("c")).agg(F.min("least").alias("component_id"))
    result = stage(named.join(least, F.col("component") == F.col("c")).select("embedding", (F.coalesce("linked", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id"), "vector-result")
    joined = rows.join(result, "embedding", "left")
    alone = F.col("n_links").isNull()
    component = F.when(alone, F.col("vec_id")).otherwise(F.col("component_id"))
    return joined.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


OP7_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e,
         embedding IS NOT NULL AND len(embedding) > 0 AND coalesce(list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))), false)
           AND coalesce(list_bool_or(list_transform(embedding, lambda x: x <> 0)), false) AS fit
  FROM embeddings),
pairs AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b
  ON a.fit AND b.fit AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id AND CASE WHEN a.fit AND b.fit AND len(a.e) = len(b.e) THEN list_cosine_similarity(a.e, b.e) >= 0.9 END),
reach(x, y) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.x, p.y FROM reach r JOIN pairs p ON r.y = p.x)
SELECT v.vec_id, coalesce(n.n, 0) AS n_links, c.c AS component_id, v.vec_id = c.c AS kept
FROM v LEFT JOIN (SELECT x, count(*) AS n FROM pairs GROUP BY x) n ON n.x = v.vec_id
JOIN (SELECT x, min(y) AS c FROM reach GROUP BY x) c ON c.x = v.vec_id
"""
