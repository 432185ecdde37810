"""Quality network: scores against a plain convolution, held-out accuracy by length of text, odd rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from passagework.llm import quality_cnn
from passagework.llm.labels import remainder
from passagework.llm.quality_cnn import BLOCK, FILTERS, GRAM, LOOK, WIDTH, Network, fit, repeats, sample_chunks, score

SF = "/root/testdata/sf0.1"


def network(seed=1):
    rng = np.random.default_rng(seed)
    return Network(rng.normal(0, 0.1, (WIDTH, 256, FILTERS)).astype(np.float32), rng.normal(0, 0.3, (WIDTH, FILTERS)).astype(np.float32), rng.normal(0, 0.1, FILTERS).astype(np.float32),
                   rng.normal(0, 0.3, 2 * FILTERS).astype(np.float32), 0.1)


def plain(net, text):
    """The score by a loop over places and filters' weights, chunk by chunk."""
    data = text.encode("utf-8", "surrogatepass")
    data += bytes(-(len(data) + WIDTH) % BLOCK + WIDTH)
    own = text.encode("utf-8", "surrogatepass")
    again = np.array([at + GRAM <= len(own) and own[at:at + GRAM] in [own[b:b + GRAM] for b in range(max(0, at - LOOK), at)] for at in range(len(data) + WIDTH)])
    response = np.array([[net.kernel[np.arange(WIDTH), list((data + bytes(WIDTH))[at:at + WIDTH]), f].sum() + net.repeat[again[at:at + WIDTH], f].sum()
                          for f in range(FILTERS)] for at in range(len(data))])
    blocks = len(data) // BLOCK
    chunk = np.array([np.maximum(response[k * BLOCK:(k + 2) * BLOCK].max(axis=0) + net.bias, 0) for k in range(blocks)])
    z = np.concatenate([chunk.mean(axis=0), chunk.max(axis=0)]) @ net.weight + net.offset
    return 1 / (1 + np.exp(-z))


def test_scores_equal_a_plain_convolution(spark):
    texts = [None, "", "short", "é𝄞" * 200, "x" * 248, "x" * 249, "y" * 1500, "a b c " * 300, "short"]
    docs = spark.createDataFrame([(k if k != 4 else None, t, 7.0, "x") for k, t in enumerate(texts)], "doc_id int, text string, score double, `a.b` string")
    got = sorted(((r.doc_id, r.score) for r in score(docs, network()).collect()), key=lambda r: (r[0] is None, r[0]))
    want = [(k if k != 4 else None, plain(network(), t or "")) for k, t in enumerate(texts)]
    assert [g[0] for g in got] == [w[0] for w in sorted(want, key=lambda r: (r[0] is None, r[0]))]
    assert np.allclose([g[1] for g in got], [w[1] for w in sorted(want, key=lambda r: (r[0] is None, r[0]))], atol=1e-5)
    assert got[0][1] == got[1][1] and score(docs.limit(0), network()).count() == 0


def test_repeats_by_slices(monkeypatch):
    data = np.frombuffer(b"abcdeXabcdefg " * 40 + b"z" * 30 + b"unlike all that was", np.uint8)
    whole = repeats(data)
    assert whole[:6].sum() == 0 and whole[6] == 1 and whole.sum() > 500 and whole[-10:].sum() == 0
    monkeypatch.setattr(quality_cnn, "SLICE", 37)
    assert (repeats(data) == whole).all()


def test_sample_holds_all_chunks_of_whole_documents(spark):
    rows = [(k, "z" * (k * 700), k % 2) for k in range(20)]
    sample = spark.createDataFrame(rows, "doc_id long, text string, label int")
    got = {r.doc_id: r.n for r in sample_chunks(sample).groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert got == {k: -(-(k * 700 + WIDTH) // BLOCK) for k, _, _ in rows}
    some = {r.doc_id: r.n for r in sample_chunks(sample, 30_000).groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert 0 < len(some) < 20 and all(got[k] == n for k, n in some.items()) and sum(k * 700 for k in some) <= 30_000


def test_odd_labels(spark):
    docs = spark.createDataFrame([(1, "good " * 20), (2, "### " * 20), (2, "### " * 20), (3, None), (None, "x"), (4, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 0), (3, None), (None, 1), (4, 1), (9, 0), (1, 7)], "doc_id long, quality int")
    net = fit(docs, labels, F.lit(True))
    assert all(0 <= r.score <= 1 for r in score(docs, net).collect())
    assert [r.score for r in score(docs, fit(docs, labels.limit(0), F.lit(True))).collect()] == [0.5] * 6
    assert [r.score for r in score(docs, fit(docs.limit(0), labels, F.lit(True))).collect()] == [0.5] * 6


def test_responses_are_worked_on_in_slices(monkeypatch):
    rng = np.random.default_rng(3)
    data, doc = rng.integers(0, 512, (40, 2 * BLOCK + WIDTH), dtype=np.uint16), np.repeat(np.arange(10), 4)
    whole = quality_cnn.train(data, doc, np.arange(10) % 2, epochs=2)
    monkeypatch.setattr(quality_cnn, "TRAIN_CHUNKS", 3)
    assert np.allclose(whole.kernel, quality_cnn.train(data, doc, np.arange(10) % 2, epochs=2).kernel)


def test_held_out_documents(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", F.length("text").alias("chars"))
    got = entry.queries()["op4_quality_cnn"](spark, SF).join(labels, "doc_id").join(docs, "doc_id").filter("held_out").toPandas()
    assert len(got) > 500 and set(got.predicted) <= {0, 1}
    for low, high in ((0, 500), (500, 8_000), (8_000, 10**9)):
        some = got[(got.chars >= low) & (got.chars < high)]
        good, bad = some[some.quality == 1], some[some.quality == 0]
        assert (good.predicted == 1).mean() > 0.95
        assert (bad.predicted == 1).sum() <= 0.15 * len(bad)
    right = (got.predicted == got.quality).mean()
    assert right > 0.97 and right > got.quality.mean() + 0.1


@pytest.fixture(scope="module")
def folds(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", (remainder(5) == 0).alias("held"))


def test_fold(folds):
    assert 0.15 < folds.filter("held").count() / folds.count() < 0.25
