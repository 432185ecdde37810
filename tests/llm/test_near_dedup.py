"""Sketches against exact similarity, components against a loop, near-duplicates against all pairs."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

import __spark_entry__ as entry
from passagework.llm import near_dedup
from passagework.functions.graph import components
from passagework.llm.id_filter import split_by_filter
from passagework.llm.near_dedup import keep_one, near_duplicates
from passagework.llm.setsketch import band_keys, jaccard_estimate, registers
from passagework.llm.shingles import shingle_sets

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def exact_set(text, width):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[k:k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())


def brute(rows, width, percent=80):
    """component of every id, by all pairs; ids are unique here."""
    sets, root = {k: exact_set(t, width) for k, t in rows}, {k: k for k, _ in rows}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1:]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: (len(sets[k]), find(k), find(k) == k) for k in ids}


def test_shingles():
    texts = ["a b c", None, "", "  ", "one", "One", "x y x y", "é é", "A B C\x0bd"]
    for width in (1, 2, 5):
        sets, at = shingle_sets(pa.array(["drop", *texts]).slice(1), width)
        assert np.diff(at).tolist() == [len(exact_set(t, width)) for t in texts]
        assert sets[at[4]:at[5]].tolist() == sets[at[5]:at[6]].tolist()


@pytest.mark.parametrize("n", [3, 60, 1200])
def test_sketch_estimates_and_merges(n):
    rng = np.random.default_rng(n)
    pool = rng.integers(0, 1 << 63, 40 * n * 2, dtype=np.uint64)
    flat, sizes, want = [], [], []
    for k in range(40):
        own = pool[2 * n * k:2 * n * (k + 1)]
        cut = n * 2 // 3
        flat += [own[:n], own[n - cut:2 * n - cut]]
        sizes += [n, n]
        want.append(cut / (2 * n - cut))
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    got = registers(np.concatenate(flat), offsets)
    guess = jaccard_estimate(got[::2], got[1::2], np.full(40, float(n)), np.full(40, float(n)))
    assert abs(guess.mean() - want[0]) < 0.02 and np.abs(guess - want[0]).max() < 0.15
    union = registers(np.concatenate([flat[0], flat[1]]), np.array([0, 2 * n]))
    assert (union[0] == np.maximum(got[0], got[1])).all()
    assert band_keys(got, 6).shape == (80, 42)


def test_components(spark):
    rng = random.Random(3)
    edges = [(k, k + 1) for k in range(0, 60)] + [(100 + rng.randrange(40), 100 + rng.randrange(40)) for _ in range(30)] + [(500, k) for k in range(501, 540)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {}
    for a, b in edges:
        root.setdefault(a, a), root.setdefault(b, b)
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            low = min(root[a], root[b])
            changed |= root[a] != low or root[b] != low
            root[a] = root[b] = low
    assert got == {k: v for k, v in root.items() if k != v}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_filter(spark):
    rows = spark.createDataFrame([(k, "t") for k in range(200)] + [(None, "t")], "doc_id long, text string")
    ids = rows.filter("doc_id % 7 = 0")
    inside = {r.doc_id for r in split_by_filter(rows, ids, "doc_id", True).collect()}
    outside = {r.doc_id for r in split_by_filter(rows, ids, "doc_id", False).collect()}
    assert set(range(0, 200, 7)) <= inside and inside | outside == {*range(200), None} and not inside & outside and None in outside


def corpus(width):
    rng = random.Random(width)
    words = [f"w{k}" for k in range(3000)]
    base = rng.choices(words, k=120)
    rows = [(0, " ".join(base))]
    for k in range(1, 260):  # one large group of near copies, similar to each other to all degrees
        own = list(base)
        for _ in range(rng.randrange(1, 26 // width)):
            own[rng.randrange(len(own))] = rng.choice(words)
        rows.append((k, " ".join(own)))
    for k in range(300, 340):  # chains, exact copies, letters in other case
        own = rng.choices(words, k=rng.randrange(3, 60))
        rows += [(2 * k, " ".join(own)), (2 * k + 1, "  ".join(own).upper() if k % 2 else " ".join([*own, "tail"]))]
    rows += [(1000, None), (1001, ""), (1002, " \n"), (1003, "one"), (1004, "ONE"), (1005, "two words"), (1006, "Two\twords"), (1007, "x " * 5000)]
    return rows


@pytest.mark.parametrize("width", [2, 5])
def test_rows(spark, width, monkeypatch):
    monkeypatch.setattr(near_dedup, "MINOR_BLOCK", 16)
    monkeypatch.setattr(near_dedup, "BLOCK", 48)
    rows = corpus(width)
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, node string")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(docs, width).collect()}
    want = brute(rows, width)
    assert got == want
    kept = keep_one(docs, width)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(k for k, v in want.items() if v[2])


@pytest.mark.parametrize("percent", [80, 90])
def test_small_linked_sets_share_a_key(percent):
    rng, met = np.random.default_rng(5), 0
    for _ in range(4000):
        both, a, b = rng.integers(1, 13), rng.integers(0, 3), rng.integers(0, 3)
        pool = rng.integers(0, 1 << 63, both + a + b, dtype=np.uint64)
        x, y = np.sort(pool[:both + a]), np.sort(np.concatenate([pool[:both], pool[both + a:]]))
        if 100 * both >= percent * (both + a + b) and max(len(x), len(y)) <= near_dedup.SMALL:
            met += 1
            assert set(near_dedup.small_keys(x, percent)) & set(near_dedup.small_keys(y, percent))
    assert met > 400 and not near_dedup.small_keys(rng.integers(0, 99, 200, dtype=np.uint64), percent)


@pytest.mark.parametrize("kind", ["tinyint", "int", "long", "string", "decimal(20,0)"])
def test_one_stays_whatever_the_type_of_ids(spark, kind):
    """Equal texts 1 to 5, another 9: with ids that are there once, and with repeated rows and a null id."""
    rows = [(k, "a b c d e f g h") for k in (3, 1, 2, 5, 4)] + [(9, "something else that is its own text")]
    for more, want in (([], ["1", "9"]), ([(1, "a b c d e f g h"), (None, "a b c d e f g h")], ["1", "9"])):
        docs = spark.createDataFrame(rows + more, "doc_id int, text string").selectExpr(f"cast(doc_id as {kind}) doc_id", "text")
        kept = keep_one(docs)
        assert kept.schema["doc_id"].dataType == docs.schema["doc_id"].dataType and kept.columns == docs.columns
        assert sorted(str(r.doc_id) for r in kept.collect()) == want
    if kind == "string":
        docs = spark.createDataFrame([("x", "a b c d e f"), ("10", "a b c d e f"), ("9", "a b c d e f")], "doc_id string, text string")
        assert [r.doc_id for r in keep_one(docs).collect()] == ["9"]


def test_odd_rows(spark):
    rows = [(5, "a b c d e f"), (5, "a b c d e f"), (None, "a b c d e f"), (None, None), (4, "a b c d e f"), (5, "other text that is its own")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(tuple(r) for r in near_duplicates(docs, 2).collect() if r.doc_id is not None)
    assert got == [(4, 5, 4, True), (5, 5, 4, False), (5, 5, 4, False), (5, 5, 5, True)]
    assert near_duplicates(docs, 2).filter("doc_id is null and component_id is null and kept").count() == 2
    assert near_duplicates(docs.limit(0)).count() == 0


def test_one_document_of_each_group(spark):
    rng = random.Random(9)
    x, y, z = (" ".join(f"{c}{k}" for k in rng.sample(range(1000), 40)) for c in "xyz")
    x_near, y_near, z_near = (f"{t} tail" for t in (x, y, z))
    rows = [(5, "a b c d e f"), (5, "a b c d e f"), (None, "a b c d e f"), (4, "a b c d e f"), (4, "a b c d e f"), (5, "other text that is its own"),
            (7, x), (7, y), (8, x_near), (9, y_near), (None, z), (None, z_near), (None, z), (None, None), (None, None), (1, ""), (1, ""), (1, None)]
    docs = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "doc_id long, text string, node int")
    got = sorted([(r.doc_id, r.text) for r in keep_one(docs, 2).collect()], key=repr)
    one_z = [r for r in got if r[1] in (z, z_near)]
    assert len(one_z) == 1 and one_z[0][0] is None
    assert sorted([r for r in got if r not in one_z], key=repr) == sorted([
        (4, "a b c d e f"), (5, "other text that is its own"), (7, x), (7, y), (None, None), (1, ""), (1, None)], key=repr)
    assert keep_one(docs, 2).columns == docs.columns
    assert keep_one(docs.limit(0), 2).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in entry.queries()["op8_setsketch_dedup"](spark, sf).collect()}
    assert got == brute(rows, 2)
