"""Alignment of two tokenizers against a loop over whole texts."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

import __spark_entry__ as entry
from passagework.llm import alignment, two_tokenizers
from passagework.llm.alignment import align, container, members, or_merge, pair_counts, popcount, scores

A, B = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
PLAIN_A, PLAIN_B = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
PLAIN_A.encode_special_tokens = True
BYTE = two_tokenizers.byte_decoder()
VOCABULARY = {k: w for w, k in PLAIN_A.get_vocab().items()}


def bytes_a(k):
    return bytes(BYTE[c] for c in VOCABULARY[k])


def bytes_b(k):
    p = PLAIN_B.id_to_piece(k)
    return bytes([int(p[3:5], 16)]) if PLAIN_B.is_byte(k) else p.replace("▁", " ").encode()


def ends(tokens):
    out, at = [], 0
    for t in tokens:
        at += len(t)
        out.append(at)
    return out


def plain(text):
    """Ids of both sides, groups as text, and links."""
    a, b = (PLAIN_A.encode(" " + text, add_special_tokens=False).ids, PLAIN_B.encode(text)) if text else ([], [])
    own = (" " + (text or "")).encode()
    if not text or b"".join(map(bytes_a, a)) != own or b"".join(map(bytes_b, b)) != own:
        return [], [], None, []
    end_a, end_b = ends(map(bytes_a, a)), ends(map(bytes_b, b))
    place_a, place_b = {e: k for k, e in enumerate(end_a)}, {e: k for k, e in enumerate(end_b)}
    groups, links, i, j = [], [], 0, 0
    for end in sorted(place_a.keys() & place_b.keys()):
        x, y = place_a[end] + 1, place_b[end] + 1
        groups.append(",".join(map(str, a[i:x])) + "|" + ",".join(map(str, b[j:y])))
        links.append((a[x - 1], b[y - 1]))
        i, j = x, y
    return a, b, ";".join(groups), links


def brute(texts):
    done = [plain(t) for t in texts]
    count = Counter(link for d in done for link in d[3])
    top = Counter()
    for (_, b), n in count.items():
        top[b] = max(top[b], n)
    return count, top, [
        (len(a), len(b), len(groups.split(";")) if groups else 0, len(links), sum(count[x] == top[x[1]] for x in links), sum(count[x] for x in links),
         hashlib.sha256(groups.encode()).hexdigest() if groups is not None else "") for a, b, groups, links in done]


ODD = ["", None, " ", "  two  blanks ", "a\tb\r\nc;\r\n", "<|endoftext|> <s></s> <0x41>", "a▁b", "▁", "x" * 300, "ends in blank ", "\n\n\n", "it's  he'll", "𝄞é 漢字　仮名", "\x00\x1c\x85",
       "one two", "one two"]


@given(st.text(max_size=40) | st.text(alphabet="aB.é's ▁\n\t\r\x85\xa0　;)<|endoftext|>0٣", max_size=60))
@settings(max_examples=200, deadline=None)
def test_parts_are_tokenized_like_the_whole(text):
    tool = two_tokenizers.aligner(A, B)
    segments = [s for parts in tool.parts(text) for s in tool.segments(parts)]
    a, b, groups, links = plain(text)
    if groups is not None:
        assert ";".join(s.groups for s in segments) == groups and sum(s.n_a for s in segments) == len(a)
    elif text:
        assert any(s.joined for s in segments)


@given(st.lists(st.sets(st.integers(0, 299)), max_size=5), st.sampled_from([300, 1000, 65536]))
def test_containers(sets, size):
    stored = [container(np.array(sorted(s), np.int64), size) for s in sets]
    assert [set(members(c, size).tolist()) for c in stored] == sets and [popcount(c, size) for c in stored] == [len(s) for s in sets]
    assert popcount(or_merge(stored, size), size) == len(set().union(*sets))


@pytest.fixture
def small(monkeypatch):
    """Limits so small that blocks, runs, slices and the memo all turn over."""
    for name, value in (("BLOCK_DOCS", 7), ("BLOCK_LINKS", 400), ("RUN_LINKS", 50)):
        monkeypatch.setattr(alignment, name, value)
    monkeypatch.setattr(alignment, "LOOK_UP_CHARS", 60)


def test_blocks(small):
    block = alignment.Block(5)
    rng = random.Random(1)
    want = [Counter(rng.choices(range(1, 9), k=rng.randrange(60))) for _ in range(6)]
    for own in want:
        codes = [c for c, n in own.items() for _ in range(n)]
        block.add(np.array(codes[::2], np.int64).tobytes())
        block.add(np.array(codes[1::2], np.int64).tobytes())
        block.docs.append(())
    index = block.index()
    for b, n_docs, n_links, planes in zip(index["b"], index["n_docs"], index["n_links"], index["planes"]):
        held = [w[int(b)] for w in want]
        assert [sum((d in members(p, 6)) << k for k, p in enumerate(planes)) for d in range(6)] == held
        assert n_links == sum(held) and n_docs == popcount(or_merge(planes, 6), 6) == sum(h > 0 for h in held)


def test_long_text_by_slices(monkeypatch):
    monkeypatch.setattr(two_tokenizers, "SLICE_CHARS", 50)
    tool = two_tokenizers.Aligner(A, B)
    text = "word, " * 40 + "y" * 120 + " tail\nof it" * 20
    assert ";".join(s.groups for parts in tool.parts(text) for s in tool.segments(parts)) == plain(text)[2]


def rows_of(spark, texts):
    return spark.createDataFrame([(k if k % 5 else None, t, k, "x") for k, t in enumerate(texts)], "doc_id long, text string, a int, block string")


def test_rows(spark):
    rng = random.Random(4)
    texts = ODD + [" ".join(rng.choices(["the", "house,", "é", "\n", "it's", "Ünder", "  "], k=rng.randrange(200))) for _ in range(60)] + ["the the " * 4_000]
    count, _, want = brute(texts)
    aligned = align(rows_of(spark, texts), A, B, with_groups=True)
    got = [tuple(r) for r in scores(aligned).select("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()]
    assert sorted(got) == sorted(want)
    pairs = {(r.a, r.b): (r.n_links, r.n_docs) for r in pair_counts(aligned).collect()}
    docs = Counter(x for t in texts for x in set(plain(t)[3]))
    assert pairs == {k: (n, docs[k]) for k, n in count.items()}
    assert {r.groups for r in scores(aligned).collect()} == {plain(t)[2] or "" for t in texts}
    assert scores(align(rows_of(spark, texts).limit(0), A, B)).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    texts = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    _, _, want = brute([r.text for r in texts])
    names = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    got = {r.doc_id: tuple(r[n] for n in names) for r in entry.queries()["op13_pair_bitmaps"](spark, sf).collect()}
    assert got == {r.doc_id: w for r, w in zip(texts, want)}
