"""Language evidence: threes against a loop, fusion on small cases, held-out agreement on the given tables."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

import __spark_entry__ as entry
from passagework.llm import language as lid
from passagework.llm import text_bytes


def brute(text):
    """Counted threes of one text, by a loop over its bytes."""
    data = [b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in text.encode()]
    return sum(sum(v == 32 for v in data[k:k + 3]) < 2 for k in range(len(data) - 2))


@pytest.mark.parametrize("size", [7, 64, 1 << 20])
def test_threes(size, monkeypatch):
    monkeypatch.setattr(text_bytes.windows, "__defaults__", (size,))
    import pyarrow as pa

    texts = ["Hello there", None, "", "a", "ab", "é", "  12 34 ", "Où est l'été ? " * 20, "x" * 100]
    column = pa.array(["skipped", *texts]).slice(1)
    data, offsets = lid.column_bytes(column)
    counted = np.zeros(len(texts), int)
    places = []
    for found, starts, h in lid.threes(data, offsets):
        counted[found] += np.add.reduceat((h < lid.PLACES).astype(int), starts)
        places.append(h)
    assert counted.tolist() == [brute(t or "") for t in texts]
    assert sum(map(len, places)) == len(data)


@pytest.fixture(scope="module")
def rows(spark):
    words = {"en": "the of and to in that", "fr": "le la de et que les", "de": "der die und das nicht", "es": "el los que y una con"}
    docs = [(k, " ".join(words[lang].split() * 12), lang, f"host{k % 3}") for k, lang in enumerate(list(words) * 12)]
    docs += [(100, "the", None, "host0"), (101, "the of and to in that " * 9, "fr", "host0"), (102, None, "en", "host0"), (103, "", None, None),
             (104, "жзийклмн опрст уфхцч " * 20, "ru", "host1"), (105, "12 34 !!", "en", "host1"), (106, "the of and", "EN-us", "host9"),
             (106, "the of and", "EN-us", "host9")]
    return spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")


def test_fusion(rows):
    got = {r.doc_id: r for r in lid.identify(lid.evidence_of_documents(rows)).collect()}
    for k in range(48):
        assert got[k].accepted and got[k].language == got[k].lang
    assert got[100].language == got[101].language == got[106].language == "en" and got[101].accepted
    assert not any(got[k].accepted for k in (102, 103, 104, 105))
    assert got[104].language == lid.OTHER


def places(text):
    """Hashed threes of one text, by a loop."""
    data = [b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in (text or "").encode()]
    out = []
    for a, b, c in zip(data, data[1:], data[2:]):
        if (a, b, c).count(32) < 2:
            out.append(((((a * 0x9E5 + b) % 2**32 * 0x85F1 + c) % 2**32 * 0x9E3779B1) % 2**32) >> 16)
    return out


def plain_identify(rows, languages):
    """(language, probability, accepted) of rows (text, declared, host, domain, suffix), table by table with dictionaries."""
    n = len(languages)

    def primary(tag):
        return re.split("[-_]", tag)[0].strip().lower() if tag is not None else None

    def code(row):
        return languages.index(primary(row[1])) if primary(row[1]) in languages else None

    found = [places(r[0]) for r in rows]
    counts, totals = Counter(), [0] * n
    for r, own in zip(rows, found):
        if code(r) is not None:
            counts.update((k, code(r)) for k in own)
            totals[code(r)] += len(own)
    text = [[lid.TEMPER * sum(math.log((counts[k, c] + 0.05) / (totals[c] + 0.05 * lid.PLACES)) for k in own) for c in range(n)]
            + [lid.TEMPER * -math.log(lid.PLACES) * len(own)] for own in found]
    best = [t.index(max(t)) for t in text]

    def given(values):
        per, total = Counter(), Counter()
        for v, b, own in zip(values, best, found):
            if own and v is not None:
                per[v, b] += 1
                total[b] += 1
        every = max(sum(total.values()), 1)
        return {v: [math.log((per[v, k] + lid.TABLE_PULL * sum(per[v, j] for j in range(n + 1)) / every + 1e-9) / (total[k] + lid.TABLE_PULL))
                    for k in range(n + 1)] for v, _ in per}

    declared, suffix = given([primary(r[1]) for r in rows]), given([r[4] for r in rows])

    def counted(key):
        out = defaultdict(lambda: [0.0] * n)
        for r in rows:
            if code(r) is not None:
                out[key(r)][code(r)] += 1
        return out

    def pulled(own, above, pull):
        return [(c + pull * p) / (sum(own) + pull) for c, p in zip(own, above)]

    everywhere, by_suffix, by_domain, by_host = counted(lambda r: 0)[0], counted(lambda r: r[4]), counted(lambda r: (r[3], r[4])), counted(lambda r: r[2])
    overall = [(c + 1 / n) / (sum(everywhere) + 1) for c in everywhere]
    out = []
    for r, own, scores in zip(rows, found, text):
        parent = pulled(by_domain[r[3], r[4]], pulled(by_suffix[r[4]], overall, lid.SUFFIX_PULL), lid.DOMAIN_PULL)
        left = [c - (k == code(r)) for k, c in enumerate(by_host[r[2]])]
        prior = [(1 - lid.OTHER_PRIOR) * p for p in pulled(left, parent, lid.HOST_PULL)] + [lid.OTHER_PRIOR]
        nothing = [0.0] * (n + 1)
        joint = [a + math.log(b) + c + d for a, b, c, d in zip(scores, prior, declared.get(primary(r[1]), nothing), suffix.get(r[4], nothing))]
        top = joint.index(max(joint))
        sure = 1 / sum(math.exp(v - joint[top]) for v in joint)
        out.append(([*languages, lid.OTHER][top], sure, top < n and sure >= lid.SURE and len(own) > 0))
    return out


def test_fusion_equals_a_plain_version(spark):
    """Texts so short that every kind of evidence matters; hosts under domains under suffixes, odd tags, nulls, repeated rows."""
    rng = random.Random(12)
    words = {"en": "the of and to in".split(), "fr": "le la de et que".split(), "de": "der die und das".split(), "es": "el los que y".split()}
    rows = []
    for k in range(160):
        lang = rng.choice([*words])
        text = " ".join(rng.choices(words[rng.choice([lang, lang, *words])], k=rng.randrange(4)))
        host = rng.choice(["a", "b", "c", "d"])
        rows.append((rng.choice([text, text, None, "12 !"]), rng.choice([lang, lang.upper() + "-x", None, "xx", " en_us"]), rng.choice([f"{host}.site.{lang}", None]),
                     rng.choice([f"site.{lang}", None]), rng.choice([lang[:2], "com", None])))
    rows += rows[:3]
    names = [lid.EV + c for c in ("declared", "host", "domain", "suffix")]
    docs = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], ", ".join(["at int", "text string", *(f"{c} string" for c in names)]))
    got = sorted(tuple(r) for r in lid.identify(docs).select("at", "language", "probability", "accepted").collect())
    want = plain_identify(rows, list(lid.LANGUAGES))
    for (at, language, probability, accepted), (name, sure, fine) in zip(got, want):
        assert abs(probability - sure) < 1e-3 and (language == name or sure < 0.51) and (accepted == fine or abs(sure - lid.SURE) < 1e-3), rows[at]
    assert len(got) == len(want) and len({w[0] for w in want}) > 3 and 20 < sum(w[2] for w in want) < 150


def test_accept_keeps_columns_and_clean_rows(rows):
    assert lid.accept(rows.withColumnRenamed("doc_id", "a.b")).columns == ["a.b", "text", "lang", "source"]
    kept = lid.accept(rows.withColumnRenamed("doc_id", "accepted"))
    assert kept.columns == ["accepted", "text", "lang", "source"]
    assert sorted(r.accepted for r in kept.collect()) == [*range(48), *([100] if kept.filter("accepted = 100").count() else []), 101, 106, 106]
    assert lid.accept(rows.limit(0)).count() == 0


def test_pages(spark):
    pages = spark.createDataFrame(
        [(1, "https://www.a.example.fr:80/x?y", '<html lang="fr-CA"><script>var x="the";</script><p>le &amp; la</p>'), (2, None, None),
         (3, "nonsense", "the <b>of</b>")], "page_id long, url string, html string")
    got = {r.page_id: r for r in lid.evidence_of_pages(pages).collect()}
    assert (got[1].declared, got[1].host, got[1].domain, got[1].suffix) == ("fr-CA", "www.a.example.fr", "a.example.fr", "fr")
    assert "var" not in got[1].text and got[3].host is None and got[2].text == ""


def test_queries(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    got = entry.queries()["op10_language_fusion"](spark, sf).join(docs, "doc_id").toPandas()
    assert (got.language == got.lang).mean() > 0.98 and got.accepted.mean() > 0.98
    assert entry.queries()["op_pages_language"](spark, sf).filter("accepted").count() > 0
