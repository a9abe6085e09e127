import zlib

import numpy as np
import pyarrow as pa
import pytest

from threatlens.llm import quality

SCHEMA = "doc_id long, text string, quality string, score int, features int"


def test_held_out_accuracy(spark):
    path = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{path}/{t}.parquet") for t in ("documents", "labels"))
    got = {r.doc_id: r.score for r in quality.classify(docs, labels, keep=["doc_id"]).collect()}
    truth = {r.doc_id: r.quality for r in labels.collect()}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0]
    guess = np.array([got[i] for i in held])
    right = np.array([truth[i] for i in held])
    assert len(got) == docs.count() and ((guess >= 0) & (guess <= 1)).all()
    assert ((guess >= 0.3) == right).mean() > 0.95
    assert (guess[right == 1] >= 0.3).mean() > 0.99
    assert abs(guess.mean() - right.mean()) < 0.05


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "good words here"), (3, "good words here"), (None, "no id"), (4, "word " * 50_000), (5, "%%% ***")]
    docs = spark.createDataFrame([(i, t, "", 1, 1) for i, t in rows], SCHEMA).repartition(3)
    labels = spark.createDataFrame([(3, 1), (3, 0), (5, 0), (6, None), (None, 1), (99, 1)], "doc_id long, quality int")
    got = quality.classify(docs, labels, keep=["doc_id", "text"]).collect()
    assert sorted((str(r.doc_id), str(r.text)) for r in got) == sorted((str(i), str(t)) for i, t in rows)
    assert all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if not r.text}) == 1
    none = quality.classify(docs, labels.limit(0), score_col="_s").collect()
    assert {r._s for r in none} == {0.5} and none[0].asDict().keys() == {*docs.columns, "_s"}
    assert quality.classify(docs.limit(0), labels, keep=["doc_id"]).count() == 0
    with pytest.raises(ValueError):
        quality.classify(docs, labels)


def test_vectors_do_not_depend_on_partitions(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert np.allclose(quality.word_vectors(docs.coalesce(1)), quality.word_vectors(docs.repartition(6)), atol=1e-4)


def test_pooling_is_mean_and_spread():
    vectors = np.random.default_rng(0).normal(size=(quality.BUCKETS, quality.DIM)).astype(np.float32)
    texts = pa.array(["one two two", "", "a," * 200_000])
    got = quality.pooled(texts, vectors)
    words = [["one", "two", "two"], [], ["a", ","] * 200_000]
    for row, ws in zip(got, words, strict=True):
        v = vectors.astype(float)[[quality._bucket(w) for w in ws]] if ws else np.zeros((1, quality.DIM))
        assert np.allclose(row, np.concatenate([v.mean(axis=0), v.std(axis=0)]), atol=1e-3)


def test_temperature_calibrates():
    draw = np.random.default_rng(1)
    x = draw.normal(size=(4000, 2 * quality.DIM)).astype(np.float32)
    y = (draw.random(4000) < 1 / (1 + np.exp(-x[:, 0]))).astype(float)
    check = np.arange(4000) % 4 == 0
    net = quality.fit_network(x, y, check)

    def loss(p):
        return -np.mean(y[check] * np.log(p) + (1 - y[check]) * np.log(1 - p))

    warm = loss(net.probability(x[check]))
    net.temperature = 1.0
    assert warm <= loss(net.probability(x[check]))


def test_one_id_repeated_many_times_is_fitted_on_once(spark, monkeypatch):
    from pyspark.sql import functions as F

    seen = []
    plain = quality.fit_network
    monkeypatch.setattr(quality, "fit_network", lambda x, y, held: (seen.append((len(x), sorted(y))), plain(x, y, held))[1])
    docs = spark.range(3000).select(
        F.when(F.col("id") < 2900, 7).otherwise(F.col("id")).cast("long").alias("doc_id"),
        F.concat(F.lit("word "), F.col("id").cast("string")).alias("text"),
    )
    labels = spark.range(3000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("quality"))
    used = docs.filter(quality.fold("doc_id") != 0).select("doc_id").distinct().count()
    assert quality.classify(docs, labels).count() == 3000
    assert [n for n, _ in seen] == [used] and used <= 101
