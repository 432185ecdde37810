"""Importance resampling against SQL and a loop over whole texts."""

import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter

import duckdb
import pytest
from hypothesis import given
from hypothesis import strategies as st

import __spark_entry__ as entry
from passagework.llm import importance
from passagework.llm.importance import bucket_counts, resample

SF = os.environ.get("PASSAGEWORK_SF_DIR", "/root/testdata/sf0.001")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def features(text, width, buckets):
    ws = words(text)
    return [zlib.crc32(" ".join(ws[i:i + n]).encode()) % buckets for n in range(1, width + 1) for i in range(len(ws) - n + 1)]


def brute(docs, target, percent, width, buckets, least, seed):
    s, t = (Counter(f for _, x in rows for f in features(x, width, buckets)) for rows in (docs, target))
    all_s, all_t = sum(s.values()) + buckets, sum(t.values()) + buckets
    gain = [math.floor(1000 * math.log((t[b] + 1) * all_s / ((s[b] + 1) * all_t))) for b in range(buckets)]
    out = []
    for doc, text in docs:
        f = features(text, width, buckets)
        h = int(hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        out.append([doc, len(words(text)), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None])
    able = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[3], r[2]))
    for k, r in enumerate(able[:percent * len(able) // 100]):
        r[5] = k + 1
    return sorted(map(tuple, out), key=repr)


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(3)
    line = lambda: " ".join(rng.choices("The cat É sat, on-it 12 𝄞x Oh".split(), k=rng.randrange(12)))
    common = "a very common line of words"
    rows = [(k, "\n".join([line() for _ in range(rng.randrange(9))] + [common] * rng.randrange(3))) for k in range(150)]
    return rows + [(200, None), (201, ""), (202, "\n\n"), (203, "long " * 5000), (None, line() * 4), (None, line() * 4), (7, line() * 3), (3, rows[3][1]), (204, "a\r\nb\x00c")]


@pytest.mark.parametrize("width, percent", [(1, 10), (3, 50), (2, 100)])
def test_rows(spark, docs, monkeypatch, width, percent):
    target = [(1, "The cat sat\non it"), (2, "cat"), (3, None), (None, "12 12 É")]
    frame = spark.createDataFrame([(*r, 1, "x") for r in docs], "doc_id long, text string, score int, line string")
    wanted = spark.createDataFrame(target, "item_id long, text string")
    got = [tuple(r) for r in resample(frame, wanted, percent, width, 97, 5, 7).collect()]
    assert sorted(got, key=repr) == brute(docs, target, percent, width, 97, 5, 7)


def test_bucket_counts(spark, docs):
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    for width in (1, 2, 4):
        assert {r.bucket: r.n for r in bucket_counts(frame, width, 50).collect()} == Counter(f for _, x in docs for f in features(x, width, 50))


@given(st.lists(st.text(alphabet="aB é.\n-1", max_size=30), max_size=4), st.integers(1, 4))
def test_slices(parts, width):
    importance_slice, importance.SLICE_BYTES = importance.SLICE_BYTES, 3
    try:
        text = "\n".join(parts)
        hasher = importance.Hasher(width, 1000)
        found = [b for _, some in hasher.all_of(text) for b in some]
        assert sorted(found) == sorted(features(text, width, 1000))
        assert sum(n for n, _ in hasher.all_of(text)) == len(words(text))
    finally:
        importance.SLICE_BYTES = importance_slice


def test_empty_tables(spark, docs):
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    assert resample(frame.limit(0), frame).count() == 0
    assert resample(frame, frame.limit(0), least_words=10**6).filter("rank is not null").count() == 0


def test_query_equals_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    names = ["doc_id", "n_features", "weight", "score", "rank"]
    got = entry.queries()["op12_importance_lines"](spark, SF).select(*names).collect()
    want = con.sql(entry.oracle_sql()["op12_importance_lines"]).select(*names).fetchall()
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr) and any(w[4] for w in want)
