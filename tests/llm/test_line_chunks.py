"""Line chunks: anchors that resist shifts, removal against a loop over all documents, recall of planted runs."""

import os
import random
import re

import duckdb
import pytest

import __spark_entry__ as entry
from passagework.llm.line_chunks import LONG_LINE_WORDS, WINDOW, anchors, remove_repeated, runs

SF = os.environ.get("PASSAGEWORK_SF_DIR", "/root/testdata/sf0.001")
WORD = re.compile("[^\x20\x09-\x0d]+")


def units(text):
    """(first line, last line, body) of every pair of filled lines in a row and of every long line."""
    lines = (text or "").split("\n")
    filled = [k for k, x in enumerate(lines) if WORD.search(x)]
    for at, k in enumerate(filled):
        if at + 1 < len(filled):
            yield k, filled[at + 1], lines[k] + "\n" + lines[filled[at + 1]]
        if len(WORD.findall(lines[k])) > LONG_LINE_WORDS:
            yield k, k, lines[k]


def brute(docs):
    """(text, lines, removed) of every row; the earliest place of a body keeps it."""
    rows = sorted(enumerate(docs), key=lambda r: (r[1][0] is not None, r[1][0] or 0))
    first, out = {}, {}
    for _, (doc, text) in rows:
        for low, _, body in units(text):
            first.setdefault(body, (doc, text, low))
    for at, (doc, text) in rows:
        if text is None:
            out[at] = None, 0, 0
            continue
        gone = {k for low, high, body in units(text) if first[body] != (doc, text, low) for k in range(low, high + 1)}
        lines = text.split("\n")
        out[at] = "\n".join(x for k, x in enumerate(lines) if k not in gone), len(lines), len(gone)
    return [out[k] for k in range(len(docs))]


def lines(rng, n):
    return [" ".join(rng.choices("alpha beta gamma delta é 𝄞".split(), k=6)) + str(rng.randrange(10_000)) for _ in range(n)]


def test_anchors_resist_shifts():
    rng = random.Random(2)
    body = lines(rng, 400)
    before, after = ({a[2] for a in anchors(x)} for x in (body, lines(rng, 7) + body[:200] + lines(rng, 1) + body[200:]))
    assert len(before) == 400 - WINDOW + 1 and len(before - after) == 1
    assert not [*anchors([])] and not [*anchors(["one"])] and len([*anchors(["w " * 60])]) == 1


def test_anchors_grow_together():
    seen = [(3, 2, b"x", 10), (4, 2, b"x", 11), (5, 1, b"x", 12), (6, 2, b"x", 13), (9, 2, b"x", 16), (4, 2, b"y", 0), (3, 2, b"x", 20)]
    assert sorted(runs(seen)) == sorted([(3, 5, b"x", 10), (9, 2, b"x", 16), (4, 2, b"y", 0), (3, 2, b"x", 20)])


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(8)
    shared = lines(rng, 40)
    rows = [(k, "\n".join(lines(rng, rng.randrange(5)) + (shared[:20] if k % 3 else shared[20:]) + lines(rng, 3))) for k in range(2, 40)]
    whole = "\n".join(lines(rng, 12))
    long = "word " * 60
    return rows + [(50, whole), (51, whole), (52, whole), (53, None), (54, ""), (55, "one line"), (56, "same\n" * 300), (57, rows[0][1]), (57, rows[0][1]),
                   (58, whole), (58, rows[1][1]), (None, whole), (60, "\n\n \n"), (61, f"own\n{long}\nlast"), (62, f"{long}\nother"), (63, "p\n\nq\n r"), (64, "x\np\n\t\nq"),
                   (65, "own\nlast one"), (66, "\n".join(shared[5:7]))]


def test_rows(spark, docs):
    d = spark.createDataFrame([(*r, k) for k, r in enumerate(docs)], "doc_id long, text string, n_lines int")
    got = {r.at: (r.text, r.n_lines, r.n_removed) for r in remove_repeated(d.withColumnRenamed("n_lines", "at"), report=True).collect()}
    want = brute(docs)
    assert [got[k] for k in range(len(docs))] == want
    assert sum(w[2] for w in want) > 600
    odd = d.withColumnRenamed("n_lines", "a.b")
    kept = remove_repeated(odd)
    assert kept.columns == odd.columns
    left = {r["a.b"]: r.text for r in kept.collect()}
    assert left == {k: w[0] for k, w in enumerate(want) if w[1] == 0 or w[2] < w[1]}
    assert left[docs.index((54, ""))] == "" and docs.index((53, None)) in left
    assert remove_repeated(d.limit(0)).count() == 0


def test_planted_runs_go(spark):
    """Runs of 2 to 8 lines, planted at any place of other documents, each after the first one gone; other lines stay."""
    rng = random.Random(11)
    passages = [lines(rng, 2 + k % 7) for k in range(60)]
    rows, planted, own = [], 0, 0
    for doc in range(240):
        mine = lines(rng, rng.randrange(1, 9))
        passage = passages[rng.randrange(60)]
        at = rng.randrange(len(mine) + 1)
        rows.append((doc, "\n".join(mine[:at] + passage + mine[at:])))
        planted, own = planted + len(passage), own + len(mine)
    got = remove_repeated(spark.createDataFrame(rows, "doc_id long, text string"), report=True).collect()
    first = sum(len(p) for p in passages if any("\n".join(p) in t for _, t in rows))
    assert sum(r.n_removed for r in got) == planted - first
    assert sum(len(r.text.split("\n")) for r in got if r.text) == own + first


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{SF}/documents.parquet')")
    names = ["doc_id", "n_lines", "n_removed", "text", "text_sha256"]
    got = entry.queries()["op1_line_chunks"](spark, SF).select(*names).collect()
    want = con.sql(entry.oracle_sql()["op1_line_chunks"]).select(*names).fetchall()
    assert sorted(map(tuple, got)) == sorted(want) and sum(w[2] for w in want) > 0
