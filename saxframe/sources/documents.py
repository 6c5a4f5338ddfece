"""Where documents come from and where events go: (doc_id, content) relations, chunk streams, sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNKS = "doc_id string, chunk_no int, bytes binary, is_final boolean"


def from_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """A document per file, named by its path."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.select(F.col("path").alias("doc_id"), "content")


def from_text(spark: SparkSession, path: str) -> DataFrame:
    """A document per text file, read whole."""
    files = spark.read.option("wholetext", "true").text(path)
    return files.select(F.input_file_name().alias("doc_id"), F.encode("value", "UTF-8").alias("content"))


def from_table(df: DataFrame, doc_id: str | Column, content: str | Column) -> DataFrame:
    """A document per row; strings become UTF-8 bytes, nulls no bytes."""
    doc_id, content = (F.col(c) if isinstance(c, str) else c for c in (doc_id, content))
    out = df.select(doc_id.cast("string").alias("doc_id"), content.alias("content"))
    if out.schema["content"].dataType.simpleString() == "string":
        out = out.withColumn("content", F.encode("content", "UTF-8"))
    return out.withColumn("content", F.coalesce("content", F.lit(b"").cast("binary")))


def split_chunks(docs: DataFrame, size: int) -> DataFrame:
    """The chunks, of so many bytes, that a sender would push for each document."""
    n = F.greatest(F.lit(1), F.ceil(F.octet_length("content") / size)).cast("int")
    each = docs.select("doc_id", "content", n.alias("n"), F.explode(F.sequence(F.lit(0), n - 1)).alias("chunk_no"))
    return each.select("doc_id", F.col("chunk_no").cast("int").alias("chunk_no"), F.substring("content", F.col("chunk_no") * size + 1, F.lit(size)).alias("bytes"), (F.col("chunk_no") == F.col("n") - 1).alias("is_final"))


def stream_chunks(spark: SparkSession, path: str, per_trigger: int | None = None) -> DataFrame:
    """Chunks as they arrive in a folder of Parquet files."""
    reader = spark.readStream.schema(CHUNKS)
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    return reader.parquet(path)


def write_events(events: DataFrame, path: str) -> None:
    """Events as Parquet, one folder per event type, so that a handler's projection reads its folder only."""
    events.write.partitionBy("event_type").mode("overwrite").parquet(path)
