"""Trees, calibration, features and the query's held-out accuracy."""

import numpy as np

import __spark_entry__ as entry
from passagework.llm import toxicity
from passagework.llm.toxicity import FEATURES, Marker, Trees, fit, isotonic, score
from pyspark.sql import functions as F


def test_trees_learn_an_interaction():
    rng = np.random.default_rng(5)
    x = rng.random((2000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    fitted = Trees().fit(x[:1500], y[:1500])
    assert np.mean((fitted.margin(x[1500:]) > 0) == y[1500:]) > 0.95
    assert np.isfinite(Trees().fit(np.zeros((30, 2)), np.r_[np.ones(15), np.zeros(15)]).margin(np.zeros((3, 2)))).all()


def test_isotonic_rises_and_keeps_the_mean():
    rng = np.random.default_rng(1)
    s = rng.random(3000)
    y = (rng.random(3000) < s**2).astype(float)
    knots, values = isotonic(s, y)
    assert (np.diff(knots) >= 0).all() and (np.diff(values) >= 0).all()
    assert np.abs(np.interp(s, knots, values) - s**2).mean() < 0.05
    knots, values = isotonic(np.zeros(10), np.r_[np.ones(5), np.zeros(5)])
    assert np.allclose(values, 0.5, atol=0.01)


def test_features():
    m = Marker({"vequ-": 3.0})
    f = dict(zip(FEATURES, m.features("You are an id10t and a LOSER, Vequsse!!")))
    assert f["insults"] == f["lexicon"] == 1 / 8 and f["obfuscated_hits"] == 1 / 8 and abs(f["near_person"] - 1 / 3) < 1e-9 and f["exclaim"] > 0
    assert len(m.features("")) == len(FEATURES) and not any(m.features(""))
    assert m.features("x " * 200_000)[0] == 0


def test_a_full_memo_loses_no_weights(monkeypatch):
    rng = np.random.default_rng(4)
    lexicon = {f"w{k}": float(k) for k in range(1, 40)}
    texts = [" ".join(f"w{k}" for k in rng.integers(0, 80, rng.integers(1, 60))) for _ in range(50)]
    m = Marker(lexicon)
    want = [m.features(t) for t in texts]
    assert any(w[FEATURES.index("lexicon_weight")] for w in want)
    for words in (1, 3, 30):
        monkeypatch.setattr(toxicity, "MEMO_WORDS", words)
        m = Marker(lexicon)
        assert [m.features(t) for t in texts] == want
        assert len(m.memo) < words + 60


def test_rows(spark):
    docs = spark.createDataFrame([(1, None, 1), (2, "", 2), (3, "idiot you", 3), (3, "idiot you", 3), (None, "a", 4)],
                                 "doc_id long, text string, score int")
    labels = spark.createDataFrame([(1, 0), (3, 1), (3, 1), (None, 1), (2, None)], "doc_id long, toxic int")
    model = fit(docs, labels, F.lit(True))
    got = score(docs, model).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
    assert {r.score for r in score(docs, fit(docs, labels.limit(0), F.lit(True))).collect()} == {0.0}
    assert score(docs.limit(0), model).count() == 0


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    got = entry.queries()["op7_toxicity_trees"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").toPandas()
    held = got[got.held_out]
    assert held[held.toxic == 1].predicted.mean() >= 0.9 and (held.toxic == 1).sum() > 50
    assert (held.predicted == held.toxic).mean() > 0.97
    assert held[held.toxic == 0].predicted.mean() < 0.05
