"""The splitter, sections and page provenance against plain Python walks over small texts."""

import random

import pytest
from pyspark.sql import functions as F

from passagework.operators import chunks as C
from passagework.operators import pages as P


def pack(pieces, size, overlap):
    """Greedy packing of (start, text) pieces, written as a direct walk."""
    out, win = [], []
    for start, t in pieces:
        if win and start + len(t) - win[0][0] > size:
            out.append(win)
            end = win[-1][0] + len(win[-1][1])
            win = [w for w in win if end - w[0] <= overlap and start + len(t) - w[0] <= size]
        win = win + [(start, t)]
    return out + ([win] if win else [])


def split(text, start, seps, size, overlap):
    if not seps:
        pieces = [(start + i, ch) for i, ch in enumerate(text)]
        return pack(pieces, size, overlap)
    parts, at = [], start
    for i, part in enumerate(text.split(seps[0])):
        piece = part if i == 0 else seps[0] + part
        if piece:
            parts.append((at, piece))
        at += len(piece)
    out, run = [], []
    for s, piece in parts:
        if len(piece) < size:
            run.append((s, piece))
        else:
            out += pack(run, size, overlap) + split(piece, s, seps[1:], size, overlap)
            run = []
    return out + pack(run, size, overlap)


def brute(text, size, overlap):
    out = []
    for win in split(text, 0, ["\n\n", "\n", ". ", " "], size, overlap):
        joined = "".join(t for _, t in win)
        if joined.strip():
            out.append((win[0][0] + len(joined) - len(joined.lstrip()), joined.strip()))
    return out


def random_text(rng):
    units = ["word", "a", "", "long" * rng.randint(1, 12), "x" * rng.randint(1, 150), "é" * 5]
    seps = [" ", " ", " ", ". ", "\n", "\n\n", "\n\n\n", "  "]
    return "".join(rng.choice(units) + rng.choice(seps) for _ in range(rng.randint(0, 80)))


@pytest.mark.parametrize("size,overlap", [(60, 15), (100, 30)])
def test_splitter_matches_a_plain_walk(spark, size, overlap):
    rng = random.Random(size)
    texts = [random_text(rng) for _ in range(60)] + ["", "x" * 500, "a b", "\n\n\n\n"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r.i: [(p.start, p.text) for p in r.p]
           for r in df.select("i", C.split_overlapping("t", size, overlap).alias("p")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == brute(t, size, overlap), repr(t)
        assert all(t[s:s + len(x)] == x and len(x) <= size for s, x in got[i])


def test_splitting_is_linear():
    """A section of 10 MB takes about eight times as long as one of 1.25 MB."""
    import time
    rng = random.Random(2)
    unit = "".join(random_text(rng) for _ in range(40))
    took = []
    for n in (1_250_000, 10_000_000):
        text = (unit * (n // len(unit) + 1))[:n]
        start = time.process_time()
        chunks = list(C.split_text(text, 1000, 150, ("\n\n", "\n", ". ", " ")))
        took.append(time.process_time() - start)
        assert len(chunks) > n // 1000 and all(text.startswith(t, s) for s, t in chunks[-20:])
    assert took[1] < 20 * took[0] and took[1] < 30


def pages(spark, rows, doc="d"):
    return spark.createDataFrame([(doc, n, t) for n, t in rows], "document_id string, page_number int, text string")


def test_offsets_and_page_lookup(spark):
    p = P.page_offsets(pages(spark, [(1, "abc"), (3, "de"), (4, "")]))
    assert [(r.page_number, r.start_offset) for r in p.orderBy("page_number").collect()] == [(1, 0), (3, 4), (4, 7)]
    points = spark.createDataFrame([("d", o) for o in (0, 3, 4, 6, 7, 99)], "document_id string, offset bigint")
    got = {r.offset: r.page_number for r in P.offset_to_page(points, p).collect()}
    assert got == {0: 1, 3: 1, 4: 3, 6: 3, 7: 4, 99: 4}


def test_annex_titles_swallow_wrapped_lines(spark):
    text = "Annex 1: Protocol for\nAnnex 2: inner\nAnnex 3: inner\nAnnex 4: Next one\n" + "x" * 50 + "\nfiller text here"
    h = C.heading_candidates(C.document_lines(pages(spark, [(1, text)])))
    got = [(r.line_no, r.heading) for r in h.filter("kind = 'annex'").orderBy("line_no").collect()]
    assert got == [(1, "Annex 1: Protocol for\nAnnex 2: inner\nAnnex 3: inner"), (4, "Annex 4: Next one")]


def test_heading_followed_by_blank_line_on_next_page(spark):
    p = pages(spark, [(1, "Some plain start of text that is long enough\nDiagnosis"), (2, ""), (3, "body " * 20)])
    heads = C.kept_headings(C.heading_candidates(C.document_lines(p))).filter("is_heading").collect()
    assert [r.heading for r in heads] == ["Diagnosis"]


def test_sections_preamble_general_and_short_spans(spark):
    body = "lower case words that go on for a while, and then some more of them."
    p = pages(spark, [(1, f"{body}\n1.1 Managing care\n{body}\n1.2 Short"), (2, f"2.1 Next part\n{body}")])
    got = [(r.heading, r.start) for r in C.split_sections(p).orderBy("section_no").collect()]
    n = len(body)
    assert got == [("Preamble", 0), ("1.1 Managing care", n + 1), ("2.1 Next part", 2 * n + 30)]
    alone = C.split_sections(pages(spark, [(1, body)])).collect()
    assert [(r.heading, r.text) for r in alone] == [("General", body + "\n")]


def test_chunk_ids_pages_and_citations(spark):
    rng = random.Random(5)
    text = lambda: ". ".join("word" * rng.randint(1, 9) + " small talk" for _ in range(60))
    p = pages(spark, [(n, f"1.{n} Managing care\n{text()}") for n in range(1, 5)], "guide").withColumn(
        "page_type", F.when(F.col("page_number") == 2, "copyright").otherwise("content"))
    rows = C.build_chunks(p).orderBy("chunk_index").collect()
    assert [r.chunk_index for r in rows] == list(range(len(rows)))
    assert all(r.chunk_id == f"guide:p{r.page_number}:c{r.chunk_index}" for r in rows)
    assert {r.page_number for r in rows} == {1, 3, 4}
    assert all(60 <= len(r.text) <= 1000 for r in rows)
    by_page = {r.page_number: r.text for r in p.collect()}
    assert all(" ".join(r.text.split())[:60] in " ".join(by_page[r.page_number].split()) for r in rows)


def test_lines_do_not_carry_their_neighbours(spark):
    """Only what may be a wrapped title or a blank line comes along; pages without text keep their line."""
    p = pages(spark, [(1, "Annex 1: Dose\n" + "x" * 41 + "\n\n" + "y" * 40), (2, None), (3, "z")])
    got = [(r.line_no, r.next1, r.next2) for r in C.document_lines(p).orderBy("line_no").collect()]
    assert got == [(1, None, ""), (2, "", "y" * 40), (3, "y" * 40, None), (4, None, "z"), (5, "z", None), (6, None, None)]


def test_chunks_know_their_page(spark):
    """A chunk's place is that of the last page which starts at or before it, as a filter of all starts finds it."""
    rng = random.Random(8)
    rows = [(i, random_text(rng), 7 * i, sorted(rng.sample(range(7 * i, 7 * i + 900), rng.randint(1, 20)))) for i in range(40)] + [(40, None, 0, [0])]
    df = spark.createDataFrame(rows, "i int, t string, at bigint, starts array<bigint>")
    got = {r.i: r.p for r in df.select("i", C.split_on_pages("t", "at", "starts", 60, 15).alias("p")).collect()}
    assert got.pop(40) is None
    for i, t, at, starts in rows[:-1]:
        assert [(p.start, p.text) for p in got[i]] == brute(t, 60, 15)
        assert [p.place for p in got[i]] == [sum(s <= at + p.start for s in starts) or None for p in got[i]]


def test_pages_that_are_not_cut_into_lines(spark):
    """Page numbers of every form go, also where no furniture is; other pages stay as they are and have no removed lines."""
    numbers = ["7", " 12\u00a0", "page 3 of", "PAGE  4 of 9", "3 of 7\x0b", "page 12"]
    plain = "Prose of one line\n\n\n\nin 2004 it ended so"
    p = pages(spark, [(n, f"{x}\nbody") for n, x in enumerate(numbers)] + [(90, plain), (91, ""), (92, None), (93, "1.2.3\nof")])
    got = {r.page_number: (r.text, r.removed) for r in P.clean_furniture(p.withColumn("document_id", F.col("page_number").cast("string"))).collect()}
    assert [got[n] for n in range(len(numbers))] == [("body", [x.strip()]) for x in numbers]
    assert got[90] == ("Prose of one line\n\nin 2004 it ended so", []) and got[91] == ("", []) and got[92] == (None, None) and got[93] == ("1.2.3\nof", [])


def test_page_types_of_texts_with_and_without_phrases(spark):
    from passagework.functions import text as T
    entries = "\n".join(f"Topic {n} \u00a0" for n in range(9))
    rows = [("plain prose", "content"), ("Copyright. Creative Commons", "copyright"), ("copyright only", "content"), ("Figures and TABLES", "table_of_contents"),
            (entries, "table_of_contents"), ("contents\n" + entries, "table_of_contents"), (entries[:30], "content"), (None, "content")]
    df = spark.createDataFrame(rows, "t string, want string")
    assert [r.got for r in df.select(T.page_type("t").alias("got")).collect()] == [w for _, w in rows]


def test_locate_chunk(spark):
    cases = [("abcabc", "abc", 0, 0), ("abcabc", "abc", 1, 3), ("abc", "x", 0, -1), ("q" * 5 + "r" * 45, "r" * 41 + "z", 0, 5)]
    df = spark.createDataFrame(cases, "s string, p string, c int, want int")
    assert all(r.got == r.want for r in df.select("want", C.locate_chunk("s", "p", "c").alias("got")).collect())


def test_furniture_threshold_and_protection(spark):
    rows = [(n, f"Running title {n}\n1.1.{n}\nbody {n}\nPage {n} of 4") for n in range(1, 5)]
    p = pages(spark, rows)
    furniture = P.detect_furniture(p)
    assert {r.key for r in furniture.collect()} == {"runningtitle", "body", "pageof"}
    out = {r.page_number: (r.text, r.removed) for r in P.strip_furniture(p, furniture).collect()}
    assert out[2] == ("1.1.2", ["Running title 2", "body 2", "Page 2 of 4"])
    three = pages(spark, rows[:3])
    assert P.detect_furniture(three).count() == 0
    stripped = P.strip_furniture(three, P.detect_furniture(three)).filter("page_number = 1").first()
    assert stripped.text == "Running title 1\n1.1.1\nbody 1"


def test_one_pass_equals_detection_and_stripping(spark):
    """Documents of other sizes, pages without text, without edge keys and without a document."""
    rows = [(f"d{d}" if d else None, n, None if n == 5 else f"Title of {d}\nown {n * d}\nsome line {chr(97 + n * d % 26)}\n" * (n % 3) + f"Page {n}", n * 10)
            for d in range(6) for n in range(1, 3 * d + 2)]
    p = spark.createDataFrame(rows, "document_id string, page_number int, text string, `key` int")
    want = P.strip_furniture(p, P.detect_furniture(p))
    got = P.clean_furniture(p)
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    assert sorted(map(tuple, got.select(*columns).collect()), key=repr) == sorted(map(tuple, want.select(*columns).collect()), key=repr)
    assert P.detect_furniture(p).count() > 3 and P.clean_furniture(p.limit(0)).count() == 0


def test_middle_lines_stay(spark):
    text = "\n".join(["top"] * 8 + ["41"] + ["end"] * 8)
    p = pages(spark, [(1, text)])
    assert "\n41\n" in P.strip_furniture(p, P.detect_furniture(p)).first().text


def quality(spark, rows):
    df = spark.createDataFrame([("d", n, t, i) for n, t, i in rows], "document_id string, page_number int, text string, image_count int")
    return P.gate_documents(P.extraction_report(P.page_quality(df))).first()


def test_extraction_reports(spark):
    good = quality(spark, [(1, "x" * 120, 0)])
    assert good.accepted and good.text_pages == 1 and good.usable
    blank = quality(spark, [(1, "", 0)])
    assert not blank.accepted and blank.code == "insufficient_text" and blank.empty_pages == [1]
    scan = quality(spark, [(1, "", 1)])
    assert not scan.accepted and "scanned" in scan.message and scan.suspected_scanned_pages == [1]
