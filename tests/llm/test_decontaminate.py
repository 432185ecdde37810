"""The index against naive search, marks and removal against a loop over words."""

import gc
import hashlib
import random
import re
import weakref

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from passagework.llm.decontaminate import DC, Phrases, mark, remove, report
from passagework.llm.fm_index import FMIndex, WaveletMatrix, suffix_array

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def windows(items):
    out = {}
    for item, text in items:
        w = WORD.findall(lowered(text))
        for k in range(max(len(w) - 9, min(len(w), 1))):
            out.setdefault(tuple(w[k:k + 10]), set()).add(str(item))
    return out


def brute(text, items):
    w, hit, found = WORD.findall(lowered(text)), set(), set()
    for win, owners in windows(items).items():
        for k in range(len(w) - len(win) + 1):
            if tuple(w[k:k + len(win)]) == win:
                hit.update(range(k, k + len(win)))
                found |= owners
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


@given(st.lists(st.integers(0, 3), max_size=60))
@settings(deadline=None)
def test_suffixes_and_ranks(symbols):
    s = np.array(symbols, np.int64)
    assert suffix_array(s).tolist() == sorted(range(len(s)), key=lambda k: symbols[k:])
    tree = WaveletMatrix(s, 3)
    for c in range(4):
        upto = np.arange(len(s) + 1)
        assert tree.rank(np.full(len(upto), c), upto).tolist() == [symbols[:k].count(c) for k in upto]


@given(st.lists(st.lists(st.integers(0, 2), min_size=1, max_size=12), min_size=1, max_size=8), st.lists(st.integers(0, 2), min_size=1, max_size=4))
@settings(deadline=None, max_examples=200)
def test_search_and_locate(stretches, phrase):
    flat, ends = [], []
    for s in stretches:
        flat += [*s, 0]
        ends.append(len(flat) - 1)
    index = FMIndex(np.array(flat), np.array(ends), 3, sample=4)
    low, high = index.search(np.array([[-1] * (4 - len(phrase)) + phrase]), np.array([len(phrase)]))
    starts = [e - len(s) for s, e in zip(stretches, ends)]
    want = [a + k for s, a in zip(stretches, starts) for k in range(len(s) - len(phrase) + 1) if s[k:k + len(phrase)] == phrase]
    assert sorted(index.locate(np.arange(low[0], high[0])).tolist()) == want


def sample(seed, n):
    rng = random.Random(seed)
    vocabulary = ["the", "of", "Éa", "x1", "zz", "QQ", "a-b", "naïve"]
    items = [(k, " ".join(rng.choices(vocabulary, k=rng.choice([0, 1, 2, 3, 9, 10, 11, 14])))) for k in range(12)] + [(3, "twice the"), (99, None)]
    docs = [(k, " ".join(rng.choices(vocabulary + ["junk", "!!", "\n"], k=rng.randrange(60))) + (items[k % 12][1].upper() if k % 3 == 0 else ""))
            for k in range(n)]
    return docs + [(500, None), (501, ""), (502, "... !"), (503, items[9][1]), (503, items[9][1])], items


@pytest.mark.parametrize("block_bytes", [16 << 20, 150])
def test_report_and_remove(spark, block_bytes):
    docs, items = sample(4, 60)
    items = [(k, t) for k, t in items if t is None or len(WORD.findall(t)) not in (1, 2)]
    d = spark.createDataFrame([(*r, 5, "x") for r in docs], "doc_id long, text string, words int, n_words string")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(tuple(r) for r in report(d, b, block_bytes).collect())
    assert got == sorted((k, *brute(t, items)) for k, t in docs)
    cleaned = remove(d, b, block_bytes)
    assert cleaned.columns == d.columns
    left = [(r.doc_id, r.text) for r in cleaned.collect()]
    clean = {k for k, t in docs if not brute(t, items)[4]}
    assert sorted((k, t or "") for k, t in docs if k in clean) == sorted((k, t or "") for k, t in left if k in clean)
    assert not any(brute(t, items)[4] for _, t in left)
    assert 503 not in {k for k, _ in left}


def test_blocks_are_bounded_and_built_in_their_turn(spark, monkeypatch):
    """Items without id or of one id are dealt over the blocks as well, and the driver holds few blocks at a time."""
    rng = random.Random(6)
    items = [(rng.choice([None, 7]), " ".join(f"w{rng.randrange(3000)}" for _ in range(12))) for _ in range(60)] + [(None, "hot " * 11)] * 300
    docs = [(k, f"lead {items[k][1]} tail") for k in range(60)]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    built, alive, most, of = [], weakref.WeakSet(), [0], Phrases.of.__func__

    def watched(cls, some):
        gc.collect()
        most[0] = max(most[0], len(alive))
        built.append(sum(len(t) for _, t in some))
        out = of(cls, some)
        alive.add(out)
        return out

    monkeypatch.setattr(Phrases, "of", classmethod(watched))
    monkeypatch.setattr(Phrases, "__hash__", object.__hash__)
    limit = 1000
    assert {(r.doc_id, r.text) for r in remove(d, b, limit).collect()} == {(k, "lead  tail") for k, _ in docs}
    assert len(built) > 3 and max(built) < 3 * limit and most[0] <= 1
    assert all(r.contaminated and r.n_items >= 1 for r in report(d, b, limit).collect())


def test_short_items_and_empty_tables(spark):
    docs, items = sample(7, 20)
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    assert sorted(tuple(r) for r in report(d, b).collect()) == sorted((k, *brute(t, items)) for k, t in docs)
    assert report(d.limit(0), b).count() == 0
    assert {r.n_hit for r in report(d, b.limit(0)).collect()} == {0}
    assert remove(d, b.limit(0)).count() == len(docs)
    assert mark(d, b, keep_text=False).columns[0] == "doc_id" and DC + "runs" in mark(d, b).columns


def test_long_text_and_same_hash_is_not_same_word():
    phrases = Phrases.of([("1", "a b c d e f g h i j")])
    text = "q a b c d e f g h i j " * 20_000
    n, runs, spans, found = next(phrases.hits(pa.array([text])))
    assert n == 220_000 and len(runs) == 20_000 and found == {"1"}
    phrases.word_data = phrases.word_data.copy()
    phrases.word_data[phrases.word_start[0]] = ord("?")  # as if another word had this hash
    assert not next(phrases.hits(pa.array([text])))[3]
