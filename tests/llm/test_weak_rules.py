"""Quality by votes: counts against a loop, EM against planted accuracies and a plain version, labels of the test tables."""

import math
import os
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from passagework.llm.weak_rules import (BELIEF, BELIEF_TEXTS, GOOD_SHARE, RULES, assess, ballot_array, estimate, keep_good, learn, signals)

SF = "/root/testdata/sf0.01"
WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(text):
    """The counts of the contract, and whether the base rules fail."""
    words = WORD.findall(text or "")
    windows = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    n = Counter(windows)
    hit = {i + k for i, w in enumerate(windows) if n[w] > 1 for k in range(8)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    marks = re.findall(r"[!-/:-@\[-`{-~]", text or "")
    return {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text or "")),
        "n_dup_lines": sum(x in lines[:i] for i, x in enumerate(lines)), "n_repeat_words": len(hit), "n_distinct_words": len({*words}), "n_lines": len(lines),
        "n_exclaims": (text or "").count("!"), "n_marks": len(marks), "n_capitals": len(re.findall("[A-Z]", text or "")), "n_letters": len(re.findall("[A-Za-z]", text or "")),
        "n_bare_words": sum(not re.search(r"[0-9A-Za-z\x80-\U0010ffff]", w) for w in words), "n_mark_runs": len(re.findall(r"(?=([!-/:-@\[-`{-~])\1)", text or "")),
        "base_failed": len(words) < 20 or 100 * len(hit) > 30 * len(words)}


def texts():
    rng = random.Random(6)
    word = lambda: rng.choice(["the", "Éa", "b##", "|", "𝄞", "x!!", "a b", "of.\n", "\x0b", "CAPS", "\x1c", "é\t"])
    block = " ".join(word() for _ in range(12))
    out = [" ".join(word() for _ in range(rng.randrange(80))) + rng.choice(["", "\n" + block, "\n" + block + "\n" + block]) for _ in range(200)]
    return [None, "", " \n\n", "one", "same line\n" * 50, "a " * 5000, block, block, "\n|\n"] + out


def test_counts(spark):
    rows = [(k if k % 9 else None, t, "x", k) for k, t in enumerate(texts())]
    docs = spark.createDataFrame(rows, "doc_id long, text string, quality string, n_words int").coalesce(1)
    got = assess(docs).collect()
    want = [brute(t) for _, t, _, _ in rows]
    assert Counter(tuple(r[k] for k in want[0]) for r in got) == Counter(tuple(w.values()) for w in want)
    by_id = {r.doc_id: r for r in got if r.doc_id is not None}
    assert all(by_id[k][name] == v for k, w in enumerate(want) if k % 9 for name, v in w.items())
    assert not any(r.kept and r.base_failed for r in got)
    assert assess(docs.limit(0)).count() == 0


def plain_estimate(ballots, times, rounds=400):
    """EM with dictionaries."""
    rules = len(ballots[0])
    believed = {q: [b, 1 - b - g, g] for q, (b, g) in BELIEF.items()}
    chance = {(j, q): list(believed[q]) for j in range(rules) for q in believed}
    share = {"good": GOOD_SHARE, "bad": 1 - GOOD_SHARE}
    for _ in range(rounds):
        post = []
        for b in ballots:
            p = {q: share[q] * math.prod(chance[j, q][v] for j, v in enumerate(b)) for q in share}
            post.append(p["good"] / sum(p.values()))
        for q in share:
            w = [n * (p if q == "good" else 1 - p) for n, p in zip(times, post)]
            for j in range(rules):
                c = [BELIEF_TEXTS * believed[q][v] + sum(x for x, b in zip(w, ballots) if b[j] == v) for v in range(3)]
                chance[j, q] = [x / sum(c) for x in c]
        good = sum(n * p for n, p in zip(times, post)) + BELIEF_TEXTS * GOOD_SHARE
        share = {"good": good / (sum(times) + BELIEF_TEXTS), "bad": 1 - good / (sum(times) + BELIEF_TEXTS)}
    return share["good"], post


def sample(rng, n, good=0.7, right=(0.95, 0.9, 0.8, 0.7, 0.9)):
    truth = rng.random(n) < good
    voted = np.stack([np.where(rng.random(n) < 0.2, 1, np.where((rng.random(n) < a) == truth, 2, 0)) for a in right], axis=1)
    return truth, voted


def test_estimate_equals_plain_version():
    _, voted = sample(np.random.default_rng(1), 500)
    ballots, times = np.unique(voted, axis=0, return_counts=True)
    model = estimate(ballots, times.astype(float))
    good, post = plain_estimate(ballots.tolist(), times.tolist())
    assert abs(model.good - good) < 1e-3 and np.abs(model.posterior(ballots) - post).max() < 5e-3


def test_estimate_finds_planted_accuracies():
    right = (0.95, 0.9, 0.8, 0.7, 0.9)
    truth, voted = sample(np.random.default_rng(2), 20_000, right=right)
    ballots, inverse, times = np.unique(voted, axis=0, return_inverse=True, return_counts=True)
    model = estimate(ballots, times.astype(float))
    assert abs(model.good - 0.7) < 0.03 and np.abs(model.accuracy() - right).max() < 0.04
    assert ((model.posterior(ballots)[inverse.ravel()] >= 0.5) == truth).mean() > 0.95


def test_no_texts():
    model = estimate(ballot_array([], len(RULES)), np.zeros(0))
    assert model.good == pytest.approx(GOOD_SHARE) and len(model.posterior(ballot_array([], len(RULES)))) == 0


def test_labels_and_filter(spark):
    """Good documents stay, bad ones go; the filter keeps the rows that the query keeps, with all columns."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    told = entry.queries()["op11_weak_rules"](spark, SF).drop("quality").join(labels, "doc_id").toPandas()
    able = told[~told.base_failed]
    assert able[able.quality == 1].kept.mean() > 0.97 and (~told[told.quality == 0].kept).mean() > 0.95
    odd = docs.withColumn("a.b", F.lit(1)).withColumn("row", F.lit("x"))
    kept = keep_good(odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in assess(docs).filter("kept").collect())


def test_ballots_are_bounded(spark):
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts())], "doc_id long, text string")
    model, known = learn(signals(docs))
    assert model.chances.shape == (len(RULES), 2, 3) and known.count() <= 3 ** len(RULES)
    assert os.path.isdir(SF)
