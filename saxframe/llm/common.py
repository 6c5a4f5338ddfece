"""What the operators of this subpackage share: words, staged tables, batches of bytes."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from saxframe.deploy import ship

#: A word is a run of anything but space, TAB, LF, VT, FF, CR.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def fold_of(doc_id: str, folds: int) -> Column:
    """crc32 of the id written as text, modulo folds; a null id is in fold -1, which no rule names."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % folds, F.lit(-1))


def row_key(*columns: str) -> list[Column]:
    """Two 64-bit hashes that name a row by its content: rows that agree in the columns agree in the key."""
    cols = [F.col(c).cast("string") for c in columns]
    null = [F.col(c).isNull() for c in columns]
    return [F.xxhash64(*cols, *null).alias("k1"), F.xxhash64(F.lit(0x9E37), *null, *reversed(cols)).alias("k2")]


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; on a local master without one, a new temporary folder."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="saxframe-")
        spark.conf.set("spark.checkpoint.dir", named)
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def stage(df: DataFrame, name: str) -> DataFrame:
    """df, written once to the shared folder and read back: it cuts lineage and survives a lost executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged = path
    return out


def release(df: DataFrame) -> None:
    """Deletes what stage() wrote, once nothing reads it any more."""
    path = getattr(df, "_staged", None)
    if path:
        jvm, sc = df.sparkSession._jvm, df.sparkSession.sparkContext
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)


def settle(spark: SparkSession) -> None:
    """Lets the files go that shuffles of ended steps have left: Spark deletes them once the driver has collected its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def texts(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """UTF-8 bytes of each value; null is empty."""
    return [b or b"" for b in column.cast(pa.large_binary()).to_pylist()]


def sample_texts(df: DataFrame, column: str, most: int) -> list[str]:
    """So many different values of a text column, those of the least hashes; equal values count once.

    First the bound is found among the hashes alone, then the values below it come to the driver.
    """
    hashed = df.where(F.col(column).isNotNull()).select(F.col(column).alias("value"), F.xxhash64(column).alias("h"))
    bound = hashed.select("h").distinct().orderBy("h").limit(most).agg(F.max("h")).first()[0]
    if bound is None:
        return []
    return [r[0] for r in hashed.where(F.col("h") <= bound).groupBy("h").agg(F.first("value").alias("value")).orderBy("h").select("value").collect()]


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The rows of batches in parts of about so many bytes of a column, so that what is made of a part stays small.

    A batch without rows is passed on, so that a step gives its columns for an empty table too.
    """
    for batch in batches:
        size = np.cumsum(pa.compute.fill_null(pa.compute.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while True:
            before = size[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(size, before + most, side="right")))
            yield batch.slice(at, end - at)
            at = end
            if at >= batch.num_rows:
                break


def runs(items: list[bytes], most: int) -> Iterator[tuple[int, int]]:
    """[from, to) of consecutive items of most bytes in all at most, or of one larger item."""
    at, size = 0, 0
    for k, b in enumerate(items):
        if k > at and size + len(b) > most:
            yield at, k
            at, size = k, 0
        size += len(b)
    if at < len(items):
        yield at, len(items)


MULTIPLIER = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(MULTIPLIER, -1, 1 << 64)


class Powers:
    """Powers of an odd multiplier and of its inverse modulo 2**64, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up))
            with np.errstate(over="ignore"):
                self.up = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n - 1, MULTIPLIER, np.uint64), dtype=np.uint64)])
                self.down = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n - 1, INVERSE, np.uint64), dtype=np.uint64)])
        return self.up[:n], self.down[:n]


POWERS = Powers()


def mixed(h: np.ndarray) -> np.ndarray:
    """A finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(32)
    return h


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """S with S[i] = the sum of values[j] * M**j over j < i, modulo 2**64."""
    up, _ = POWERS(len(values) + 1)
    out = np.empty(len(values) + 1, np.uint64)
    out[0] = 0
    np.cumsum(values.astype(np.uint64) * up[: len(values)], dtype=np.uint64, out=out[1:])
    return out


def range_hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the ranges [start, end): equal ranges have equal hashes wherever they stand."""
    _, down = POWERS(len(sums))
    return mixed((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))
