"""Quality classifier: learned vectors of hashed words and character n-grams, averaged, with a softmax output."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from saxframe.llm.common import fold_of, mixed, prefix_sums, range_hashes, runs, slices, table, texts

BUCKET_BITS = 18
DIMENSIONS = 12
CHARACTER_NGRAMS = (3, 5)
#: Labelled rows that the model is fitted on at most, chosen by hash of the id.
TRAINING_ROWS = 3000
EPOCHS = 5
#: Bytes that are hashed at once; longer texts go piece by piece, cut at white space where there is some.
PIECE = 1 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def _pieces(text: bytes) -> Iterator[bytes]:
    at = 0
    while len(text) - at > PIECE:
        cut = max(text.rfind(b" ", at + 1, at + PIECE), text.rfind(b"\n", at + 1, at + PIECE))
        cut = at + PIECE if cut < 0 else cut
        yield text[at:cut]
        at = cut
    yield text[at:] if at else text


def buckets(items: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each kind of feature, the buckets of all items one after another and where each item's begin (one more at the end).

    Kinds: words, pairs of neighbouring words (all pairs of a word and itself are one), and character n-grams over bytes. The letters' case counts.
    """
    size = np.array([len(b) for b in items])
    start = np.concatenate([[0], np.cumsum(size + 1)])
    data = np.frombuffer(b"\n".join([*items, b""]) + b"\n" * 8, np.uint8)
    space = _SPACE[data]
    inside = ~space
    begin = np.flatnonzero(inside[1:] & space[:-1]) + 1
    if inside[0]:
        begin = np.concatenate([[0], begin])
    end = np.flatnonzero(inside[:-1] & space[1:]) + 1
    words = range_hashes(prefix_sums(data + np.uint8(1)), begin, end)
    first = np.searchsorted(begin, start)
    low = np.uint64(64 - BUCKET_BITS)
    yield (words >> low).astype(np.int64), first
    # a word that follows itself is one feature, whatever the word
    pairs = np.where(words[:-1] == words[1:], np.uint64(1) << low, mixed(words[:-1] * np.uint64(3) + words[1:]))
    # the pair of an item's last word and the next item's first belongs to none: it has bucket -1
    owner = np.repeat(np.arange(len(items)), np.diff(first))
    yield np.where(owner[:-1] == owner[1:], (pairs >> low).astype(np.int64), -1), np.minimum(first, len(pairs))
    wide = data.astype(np.uint32)
    for n in CHARACTER_NGRAMS:
        key = wide[: len(wide) - 8].copy()
        for k in range(1, n):
            key = key * np.uint32(0x01000193) + wide[k : len(wide) - 8 + k] if k > 3 else key + (wide[k : len(wide) - 8 + k] << np.uint32(8 * k))
        key = (key ^ np.uint32(n)) * np.uint32(0x9E3779B1)
        key ^= key >> np.uint32(15)
        key *= np.uint32(0x85EBCA77)
        found = (key >> np.uint32(32 - BUCKET_BITS)).astype(np.int64)
        # n-grams that run over an item's end belong to none
        for back in range(1, n):
            found[np.maximum(start[1:] - 1 - back, 0)] = -1
        found[start[1:] - 1] = -1
        yield found, np.minimum(start, len(found))


@dataclass
class Model:
    """Per bucket its share of the logit, which is linear in the average of the vectors; and the output's bias."""

    weight: np.ndarray
    bias: float

    def logits(self, items: list[bytes]) -> np.ndarray:
        total, count = np.zeros(len(items)), np.zeros(len(items))
        table = np.append(self.weight, np.float32(0))
        for found, first in buckets(items):
            sums = np.concatenate([[0.0], np.cumsum(table[found], dtype=np.float64)])
            real = np.concatenate([[0], np.cumsum(found >= 0)])
            total += sums[first[1:]] - sums[first[:-1]]
            count += real[first[1:]] - real[first[:-1]]
        return np.stack([total, count])

    def score(self, items: list[bytes]) -> np.ndarray:
        parts, owner = [], []
        for k, text in enumerate(items):
            for piece in _pieces(text):
                parts.append(piece)
                owner.append(k)
        sums = np.zeros((2, len(items)))
        for a, b in runs(parts, PIECE):
            got = self.logits(parts[a:b])
            np.add.at(sums, (slice(None), np.array(owner[a:b])), got)
        z = sums[0] / np.maximum(sums[1], 1) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def fit(rows: list[tuple[bytes, int]], epochs: int = EPOCHS, rate: float = 0.5, seed: int = 7) -> Model:
    """Stochastic gradient descent, one document at a time, on the cross entropy of a two-way softmax.

    A document's input is the average of its buckets' vectors. Without rows of both labels the
    model gives everything the share of label 1 (one half without rows).
    """
    n = 1 << BUCKET_BITS
    good = sum(y for _, y in rows)
    if not rows or good in (0, len(rows)):
        p = 0.5 if not rows else (good + 0.5) / (len(rows) + 1)
        return Model(np.zeros(n, np.float32), float(np.log(p / (1 - p))))
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (n, DIMENSIONS)).astype(np.float32)
    out, bias = np.zeros((2, DIMENSIONS), np.float32), np.zeros(2, np.float32)
    inputs = []
    for text, y in rows:
        parts = [found[found >= 0] for piece in _pieces(text) for found, _ in buckets([piece])]
        ids, counts = np.unique(np.concatenate(parts), return_counts=True)
        inputs.append((ids, (counts / max(1, counts.sum())).astype(np.float32), y))
    steps, done = epochs * len(inputs), 0
    for _ in range(epochs):
        for k in rng.permutation(len(inputs)):
            ids, share, y = inputs[k]
            mean = share @ vectors[ids]
            z = out @ mean + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            step = np.float32(rate * (1 - done / steps))
            back = out.T @ p
            out -= step * np.outer(p, mean)
            bias -= step * p
            # each vector is moved in full, as if it stood alone in the average
            vectors[ids] -= step * np.minimum(share * 50, 1)[:, None] * back
            done += 1
    return Model(vectors @ (out[1] - out[0]), float(bias[1] - bias[0]))


def training_rows(docs: DataFrame, labels: DataFrame, folds: int, left_out: int, most: int = TRAINING_ROWS) -> list[tuple[bytes, int]]:
    """At most so many (text, label) of labelled documents outside the left-out fold, least hashes of the id first.

    The ids are chosen from the table of labels alone, four times as many as are wanted (a label may
    lack its document), and only their documents are brought together with them.
    """
    fold = fold_of("doc_id", folds)
    usable = labels.where(F.col("quality").isin(0, 1) & fold.between(0, folds - 1) & (fold != left_out)).select("doc_id", F.col("quality").cast("int").alias("quality"))
    chosen = usable.withColumn("h", F.xxhash64("doc_id", F.lit(11))).orderBy("h", "doc_id", "quality").limit(4 * most)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").orderBy("h", "doc_id", "quality", F.xxhash64("text")).limit(most)
    return [((r["text"] or "").encode(), r["quality"]) for r in rows.select("text", "quality").collect()]


def _score(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    learned = model.value
    for batch in slices(batches):
        score = learned.score(texts(batch["text"]))
        yield pa.RecordBatch.from_pydict({name: batch[name] for name in batch.schema.names} | {"score": pa.array(score)})


def score(docs: DataFrame, model: Model, columns: list[str]) -> DataFrame:
    """The named columns of docs (text among them, if wanted) with score, the model's share for label 1."""
    spark = docs.sparkSession
    read = docs.select(*dict.fromkeys([*columns, "text"]))
    kept = [f for f in read.schema.fields]
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", score double"
    return read.mapInArrow(partial(_score, model=spark.sparkContext.broadcast(model)), ddl)


def _slim(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    for batch in _score(batches, model):
        yield batch.drop_columns(["text"])


def classify(docs: DataFrame, labels: DataFrame, folds: int = 3, left_out: int = 1) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score and predicted.

    The model is fitted on labelled rows whose crc32(doc_id as text) modulo folds is not left_out
    and reads nothing but the text. A null or empty text has no features and gets the score of the
    bias; a null id is never held out. An empty table has no rows; without labels scores are 0.5.
    """
    model = fit(training_rows(docs, labels, folds, left_out))
    slim = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()
    scored = slim.mapInArrow(partial(_slim, model=docs.sparkSession.sparkContext.broadcast(model)), f"doc_id {kind}, score double")
    return scored.select("doc_id", (fold_of("doc_id", folds) == left_out).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, folds: int = 3, left_out: int = 1) -> DataFrame:
    """The rows of docs that the classifier doesn't reject, with the columns of docs."""
    model = fit(training_rows(docs, labels, folds, left_out))
    marked = score(docs.withColumnsRenamed({c: f"__{c}" for c in docs.columns if c == "score"}), model, [c if c != "score" else "__score" for c in docs.columns])
    return marked.where("score >= 0.5").drop("score").withColumnsRenamed({"__score": "score"} if "score" in docs.columns else {})


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
