"""Prefix hashes against slices, fingerprints against a plain loop over all documents."""

import hashlib
import os

from hypothesis import given, settings
from hypothesis import strategies as st

import __spark_entry__ as entry
from passagework.llm.prefix_hash import Entry, PrefixHashes, compare_with_next, fingerprint, fingerprints, likeness


@given(st.text(alphabet="abé𝄞", max_size=40), st.text(alphabet="abé𝄞", max_size=40), st.integers(0, 40), st.integers(0, 40), st.integers(0, 40))
@settings(max_examples=300, deadline=None)
def test_spans_and_extensions(a, b, i, j, n):
    i, j = min(i, len(a)), min(j, len(b))
    n = min(n, len(a) - i, len(b) - j)
    ha, hb = PrefixHashes(a), PrefixHashes(b)
    assert ha.equal(i, hb, j, n) == (a[i:i + n] == b[j:j + n])
    assert ha.common_extension(i, hb, j) == len(os.path.commonprefix([a[i:], b[j:]]))
    assert (fingerprint(ha) == fingerprint(hb)) == (a == b)


def test_likeness_follows_the_share_of_common_spans():
    words = [hashlib.md5(str(k).encode()).hexdigest() for k in range(400)]
    a = Entry(1, " ".join(words))
    b = Entry(2, " ".join(words[:200] + [w[::-1] for w in words[200:]]))
    c = Entry(3, " ".join(w[::-1] for w in words))
    assert likeness(a.print, a.print) == 1 and 0.15 < likeness(a.print, b.print) < 0.55 and likeness(a.print, c.print) < 0.1
    assert likeness(Entry(1, "").print, c.print) == 0


def brute(rows):
    rows = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    out = []
    for k, (doc, text) in enumerate(rows):
        text, after = text or "", rows[(k + 1) % len(rows)][1] or ""
        half = len(text) // 2
        edited = text[:len(text) - half] + after[:half]
        a, e, n = (fingerprint(PrefixHashes(t)) for t in (text, edited, after))
        out.append((doc, len(text), hashlib.sha256(edited.encode()).hexdigest(), a, e, likeness(a, e), likeness(a, n),
                    len(os.path.commonprefix([text, edited]))))
    return sorted(out, key=repr)


def test_rows(spark):
    rows = [(5, "a long text with 𝄞 signs"), (3, None), (2, ""), (9, "x" * 3000), (9, "x" * 3000), (9, "same id"), (None, "no id"), (1, "é")]
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, part int")
    assert sorted(map(tuple, compare_with_next(docs).collect()), key=repr) == brute(rows)
    assert compare_with_next(docs.limit(0)).count() == 0
    one = compare_with_next(docs.filter("doc_id = 5")).collect()
    assert [tuple(r) for r in one] == brute(rows[:1])
    assert fingerprints(docs).count() == len(rows)


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, entry.queries()["op3_prefix_fingerprint"](spark, sf).collect()), key=repr) == brute(rows)
