import zlib

import duckdb
import numpy as np
from pyspark.sql import functions as F

from saxframe.llm import mixing, quality

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, source string, size string, kept int"


def test_mix_same_rows_as_sql(spark):
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    want = sorted(c.sql(mixing.OP8_SQL).fetchall())
    assert sorted(tuple(r) for r in mixing.op8_mixing(spark, DATA).collect()) == want


def test_mix_edges(spark):
    rows = [(1, "a b c", "x", "s", 0), (1, "a b c", "x", "s", 0), (2, None, None, None, 1), (None, "q " * 500, None, "t", 1), (3, "", "y", "u", 2), (4, "w", "z", None, 3)]
    got = [r.asDict() for r in mixing.mix(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert len(got) == len(rows)
    assert sum(r["size"] for r in got) == 507
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in got)
    for source in ("x", None, "y", "z"):
        own = [r for r in got if r["source"] == source]
        assert sum(r["taken"] for r in own) == int(own[0]["target"] + 0.5)
        assert own[0]["target"] <= 3 * own[0]["source_size"]
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).count() == 0


def test_classifier_held_out(spark):
    out = quality.op10_quality_classifier(spark, "/root/testdata/sf0.01").toPandas()
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").toPandas()
    both = out.merge(labels, on="doc_id")
    held = both[both.held_out]
    assert (held.predicted == held.quality).mean() > 0.95
    assert out.held_out.tolist() == [zlib.crc32(str(d).encode()) % 3 == 1 for d in out.doc_id]
    assert ((out.score >= 0.5) == (out.predicted == 1)).all() and out.score.between(0, 1).all()


def test_classifier_edges(spark):
    docs = spark.createDataFrame([(1, None, 0.5), (None, "", None), (2, "a " * 700_000, 1.0), (2, "a", 2.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, 1), (2, None), (None, 0), (9, 5)], "doc_id long, quality int")
    assert quality.classify(docs, labels).count() == 4
    assert {r["score"] for r in quality.classify(docs, labels.limit(0)).collect()} == {0.5}
    kept = quality.keep_good(docs, labels.limit(0))
    assert kept.columns == ["doc_id", "text", "score"] and kept.count() == 4
    assert quality.classify(docs.limit(0), labels).count() == 0


def test_score_reads_the_text_alone():
    rng = np.random.default_rng(0)
    good = [" ".join(rng.choice(["one", "two", "three", "four"], 30)) for _ in range(60)]
    bad = [" ".join(rng.choice(["$$", "%%", "!!"], 30)) for _ in range(60)]
    model = quality.fit([(t.encode(), 1) for t in good] + [(t.encode(), 0) for t in bad])
    alone = [model.score([t.encode()])[0] for t in (good[0], bad[0], "")]
    assert np.allclose(model.score([good[0].encode(), bad[0].encode(), b""]), alone)
    assert alone[0] > 0.9 and alone[1] < 0.1


def test_ties_and_seed(spark):
    docs = spark.range(50).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text"), F.lit("s").alias("source"))
    first, second = (sorted(tuple(r) for r in mixing.mix(docs).collect()) for _ in range(2))
    assert first == second
