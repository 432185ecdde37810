"""Packing against the tokenizer itself, a naive best fit and the layout of sequences."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

import __spark_entry__ as entry
from passagework.llm import tokens
from passagework.llm.packing import best_fit_decreasing, pack, sequences

PATH = public_tokenizers.path("word_bpe_49k.json")
PLAIN = Tokenizer.from_file(PATH)


def ids(text):
    return PLAIN.encode(text, add_special_tokens=False).ids


def naive(lengths, size):
    room, out = [], {}
    for k in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        fits = [r for r in room if r >= lengths[k]]
        if fits:
            room.remove(min(fits))
            room.append(min(fits) - lengths[k])
        else:
            room.append(size - lengths[k])
    return sorted(room)


@given(st.lists(st.integers(1, 50), max_size=80))
@settings(deadline=None)
def test_best_fit(lengths):
    placed, opened = best_fit_decreasing(lengths, 50)
    used = [0] * opened
    for n, (w, o) in zip(lengths, placed):
        used[w] += n
    assert sorted(50 - u for u in used) == naive(lengths, 50)


@given(st.text(max_size=60) | st.text(alphabet="aB.,é'’s \n\x1c\x85İΣ̈<|endoftext|>0٣", max_size=80))
@settings(max_examples=300, deadline=None)
def test_ids_equal_the_tokenizer(text):
    assert np.frombuffer(tokens.encoder(PATH).encode(text), "<u4").tolist() == ids(text)


def test_small_cache_and_slices(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_WORDS", 20)
    monkeypatch.setattr(tokens, "SLICE_CHARS", 64)
    own, rng = tokens.WordEncoder(PATH), random.Random(3)
    for _ in range(50):
        text = " ".join(rng.choice(["ab", "cd.", "efg,", "x" * 90, "ü"]) + str(rng.randrange(30)) for _ in range(40))
        assert np.frombuffer(own.encode(text), "<u4").tolist() == ids(text)


def check_layout(rows, texts, size):
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert by_doc.keys() == texts.keys()
    for doc, pieces in by_doc.items():
        want, at = ids(texts[doc] or "") + [1], 0
        for p in sorted(pieces, key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(want)
            assert p.ids_crc32 == zlib.crc32(np.array(want[at:at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(want)
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= size
    return by_sequence


def test_rows(spark):
    texts = {1: None, 2: "", 3: "The cat. sat, on <|endoftext|> it's mat! " * 40, 4: "é" * 100, None: "x", 5: "one two", 6: "one two"}
    docs = spark.createDataFrame([(k, t, 7) for k, t in texts.items()], "doc_id long, text string, sequence_id int").coalesce(1)
    got = pack(docs, PATH, size=64, with_ids=True)
    check_layout(got.collect(), texts, 64)
    joined = sequences(got).collect()
    assert sum(len(r.ids) // 4 for r in joined) == sum(len(ids(t or "")) + 1 for t in texts.values())
    assert pack(docs.limit(0), PATH).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = entry.queries()["op6_pack_best_fit"](spark, sf).collect()
    n = len(check_layout(rows, texts, 2048))
    assert sum(r.length for r in rows) / (2048 * n) > 0.9


@pytest.mark.parametrize("n", [3000])
def test_little_padding(n):
    rng = random.Random(1)
    lengths = [rng.choice([rng.randrange(1, 2049), rng.randrange(1, 400)]) for _ in range(n)]
    _, opened = best_fit_decreasing(lengths, 2048)
    assert sum(lengths) / (2048 * opened) > 0.98
