"""Mixing sources to target weights by capped water-filling, with whole and fractional repetitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from saxframe.llm.common import WORD, stage, table

#: Of the sources in code point order, null last: these weights, repeating.
WEIGHTS = (5, 2, 1)
EPOCHS = 3
SEED = "mix-1"


def targets(sizes: DataFrame, weights: Column, epochs: int = EPOCHS) -> DataFrame:
    """sizes (source, source_size, and what weights reads) with target and wanted, its whole number of units.

    The targets share the sum of all sizes by weight. A source whose share is above epochs times its
    size is clamped there, what it leaves is shared anew among the others, and so on until none is
    above. Each round brings three numbers to the driver; the table of sources stays distributed.
    """
    now = sizes.select("*", weights.cast("long").alias("weight"), (F.lit(epochs).cast("long") * F.col("source_size")).alias("cap"))
    total, weight, clamped = now.agg(F.sum("source_size"), F.sum("weight"), F.lit(0)).first()
    left, per = total or 0, weight or 0
    while per:
        share = F.col("weight") * F.lit(float(left)) / F.lit(float(per))
        caps, heavy, n = now.where(F.col("cap") < share).agg(F.sum("cap"), F.sum("weight"), F.count(F.lit(1))).first()
        if n == clamped:
            break
        left, per, clamped = total - caps, weight - heavy, n
    share = F.col("weight") * F.lit(float(left)) / F.lit(float(per)) if per else F.col("cap").cast("double")
    return now.withColumn("target", F.least(F.col("cap").cast("double"), share)).withColumn("wanted", F.floor(F.col("target") + 0.5).cast("long"))


def ranked_weights(weights: tuple[int, ...]) -> Column:
    """The weight of a source by its rank, over the table of sources (one row each)."""
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    return F.element_at(F.array(*[F.lit(w) for w in weights]), (rank % len(weights) + 1).cast("int"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS, seed: str = SEED) -> DataFrame:
    """docs (doc_id, text, source; further columns stay, but for those of the four names) with size, source_size, target and taken.

    size is the number of words; a null or empty text has none. taken is the number of words that
    the mix takes of a document, repeats counted: all documents of a source are taken as often as
    its target holds its size, and of the rest, in an order of seeded hashes, documents are taken
    whole once more until the next would exceed the target, and of that one as many words as are
    missing. So the words taken of a source are its target, rounded, and no document is taken more
    than epochs times. Rows that agree in id and text share a hash and are interchangeable. A null
    source is a source. An empty table has no rows.

    The running sum over a source is cut in 4096 buckets by hash, so that no task sorts a source.
    """
    given = [c for c in docs.columns if c not in ("size", "source_size", "target", "taken")]
    order = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("|"), F.coalesce("text", F.lit(""))).cast("binary"))
    sized = docs.select(F.struct(*given).alias("given"), "doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), order.alias("__key"))
    slim = sized.select(F.col("source").alias("s"), "size", F.conv(F.substring("__key", 1, 3), 16, 10).cast("int").alias("bucket"))
    buckets = stage(slim.groupBy("s", "bucket").agg(F.sum("size").alias("held")), "mix-buckets")
    by_source = stage(buckets.groupBy(F.col("s").alias("source")).agg(F.sum("held").alias("source_size")), "mix-sources")
    filled = stage(targets(by_source, ranked_weights(weights), epochs).select(F.col("source").alias("t"), "source_size", "target", "wanted"), "mix-targets")
    before = F.sum("held").over(Window.partitionBy("s").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    starts = buckets.select("s", F.col("bucket").alias("b"), F.coalesce(before, F.lit(0)).alias("before"))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("wanted") / F.col("source_size"))).otherwise(0).cast("long")
    plan = starts.join(filled, F.col("s").eqNullSafe(F.col("t"))).select(
        F.col("s").alias("__s"), F.col("b").alias("__b"), "source_size", "target", whole.alias("__whole"), (F.col("wanted") - whole * F.col("source_size") - F.col("before")).alias("__rest")
    )
    plan = stage(plan, "mix-plan")
    joined = sized.withColumn("__bucket", F.conv(F.substring("__key", 1, 3), 16, 10).cast("int")).join(plan, F.col("source").eqNullSafe(F.col("__s")) & (F.col("__bucket") == F.col("__b")))
    inside = F.sum("size").over(Window.partitionBy("source", "__bucket").orderBy("__key", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size")
    extra = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), F.col("__rest") - inside))
    return joined.select("given.*", "size", "source_size", "target", (F.col("__whole") * F.col("size") + extra).alias("taken"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return _slim(docs)


def _slim(docs: DataFrame) -> DataFrame:
    """mix() over what its figures need: the text goes into a size and a hash before any shuffle."""
    out = mix(docs.select("doc_id", "text", "source"))
    return out.select("doc_id", "size", "source_size", "target", "taken")


OP8_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5('mix-1|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(text, '')) AS k
  FROM documents),
sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT source, source_size, 3 * source_size AS cap,
         CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight
  FROM sources),
ordered AS (
  SELECT *, row_number() OVER o AS n, sum(cap) OVER o AS caps, sum(weight) OVER o AS heavy,
         sum(source_size) OVER () AS total, sum(weight) OVER () AS weights, count(*) OVER () AS sources
  FROM weighed WINDOW o AS (ORDER BY cap / weight, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
-- the first k such that with k sources clamped, the share of the next is not above its cap
level AS (
  SELECT CAST(total - coalesce(lag_caps, 0) AS DOUBLE) AS rest, CAST(weights - coalesce(lag_heavy, 0) AS DOUBLE) AS per
  FROM (SELECT *, lag(caps) OVER (ORDER BY n) AS lag_caps, lag(heavy) OVER (ORDER BY n) AS lag_heavy FROM ordered)
  WHERE weight * CAST(total - coalesce(lag_caps, 0) AS DOUBLE) / CAST(weights - coalesce(lag_heavy, 0) AS DOUBLE) <= cap
  ORDER BY n LIMIT 1),
filled AS (
  SELECT w.source, w.source_size, least(CAST(w.cap AS DOUBLE), w.weight * l.rest / l.per) AS target
  FROM weighed w CROSS JOIN level l),
planned AS (
  SELECT source, source_size, target, CAST(floor(target + 0.5) AS BIGINT) AS wanted,
         CASE WHEN source_size > 0 THEN CAST(floor(target + 0.5) AS BIGINT) // source_size ELSE 0 END AS whole
  FROM filled)
SELECT d.doc_id, d.size, p.source_size, p.target,
       CAST(p.whole * d.size + greatest(0, least(d.size, p.wanted - p.whole * p.source_size
         - (sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id ROWS UNBOUNDED PRECEDING) - d.size))) AS BIGINT) AS taken
FROM sized d JOIN planned p ON d.source IS NOT DISTINCT FROM p.source
"""
