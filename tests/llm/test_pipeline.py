"""The pipeline's stages, one after another, and that each does its part."""

from pyspark.sql import functions as F

import corpus_pipeline
from saxframe.llm import decontaminate, lines
from saxframe.llm.common import stage

DATA = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for name, function in corpus_pipeline.STAGES[:-1]:
        docs = stage(function(spark, docs, DATA), name)
        assert docs.columns == columns
        sizes.append(docs.count())
        if name == "line_dedup":
            assert lines.dedup_lines(docs).agg({"removed_chunks": "sum"}).first()[0] == 0
            assert docs.where("n_chars <> char_length(text)").count() == 0
        if name == "decontaminate":
            assert decontaminate.leaks(docs, spark.read.parquet(f"{DATA}/benchmark.parquet")).count() == 0
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0.5 * sizes[0]
    mixed = corpus_pipeline.STAGES[-1][1](spark, docs, DATA)
    assert set(columns) < set(mixed.columns) and mixed.where("taken > 3 * size OR taken = 0").count() == 0


def test_run_is_the_stages(spark):
    first = sorted(r["doc_id"] for r in corpus_pipeline.run(spark, DATA).select("doc_id").collect())
    assert first and len(set(first)) == len(first)


def test_empty_and_null_documents(spark):
    docs = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "a", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    for frame in (docs, docs.limit(0)):
        for _, function in corpus_pipeline.STAGES:
            frame = stage(function(spark, frame, DATA), "t")
        assert frame.count() == 0


def test_clashing_columns(spark):
    names = ["s", "b", "t", "before", "wanted", "held", "bucket", "size", "k1", "k2", "fp", "row", "ranges", "at", "score", "learn", "sketch", "h", "n", "__k1", "__k2", "__key", "__ranges", "__s", "__b", "given"]
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(40)
    extended = docs.select("*", *[F.lit(k).alias(n) for k, n in enumerate(names)])
    plain, more = docs, extended
    for name, function in corpus_pipeline.STAGES:
        plain, more = stage(function(spark, plain, DATA), name), stage(function(spark, more, DATA), name)
        assert sorted(r["doc_id"] for r in plain.collect()) == sorted(r["doc_id"] for r in more.collect()), name
        kept = [n for n in names if n != "size"]
        assert all(r[n] == names.index(n) for r in more.collect() for n in kept), name
