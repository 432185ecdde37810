import math
import random
import statistics

from pyspark.sql import functions as F

from passagework.functions import stats as ST
from passagework.functions.windows import row_numbers, running_total
from passagework.operators import evaluation as E

PAGE_RANKS = [1] * 19 + [2] * 7 + [3] * 6 + [4] * 2 + [5] * 2 + [7] * 2


def test_recall_table_counts_from_ranks(spark):
    rows = [(i, "c", "in_scope", r, r if i % 9 else None) for i, r in enumerate(PAGE_RANKS)]
    df = spark.createDataFrame(rows, "query_id bigint, category string, scope string, page_rank int, answer_rank int")
    got = {r.k: (r.recall, r.answer, r.total) for r in E.recall_at(df).collect()}
    for k in (1, 3, 5, 10):
        assert got[k] == (sum(r <= k for r in PAGE_RANKS), sum(a is not None and a <= k for *_, a in rows), 38)
    assert got[1][0] == 19 and got[3][0] == 32 and got[5][0] == 36 and got[10][0] == 38
    assert E.mrr(df).first().mrr == round(sum(1 / r for r in PAGE_RANKS) / 38, 3)
    kinds = {r.kind for r in E.miss_lists(df).collect()}
    assert kinds == {"weak", "mismatched"}


def labelled(spark):
    hits = spark.createDataFrame(
        [(1, 1, "a.pdf", 3, "nothing"), (1, 2, "a.pdf", 7, "Offer METFORMIN")],
        "query_id bigint, rank int, source string, page_number int, text string")
    q = E.checked_patterns(spark.createDataFrame(
        [(1, "a.pdf", [7], ["metformin"])],
        "query_id bigint, expected_source string, expected_pages array<int>, must_contain array<string>"))
    return E.label_hits(hits, q), q


def test_citation_metrics_truth_table(spark):
    lab, q = labelled(spark)
    for source, want in ((2, (True, True, True)), (1, (True, False, False)), (3, (False, False, False))):
        c = spark.createDataFrame([(1, source)], "query_id bigint, source_id bigint")
        r = E.citation_metrics(q, lab, c).first()
        assert (r.valid, r.page_correct, r.answer_support) == want


def test_patterns_fall_back_to_literals(spark):
    df = E.checked_patterns(spark.createDataFrame(
        [("see ([x here", ["([X"]), ("abc", ["([x"]), ("ABC", ["b."]), ("abc", []), (None, ["a"]), ("ABC", ["(?P<n>abc)"])],
        "t string, must_contain array<string>"))
    assert [r.m for r in df.select(E.matches_any("patterns", "t").alias("m")).collect()] == [True, False, True, True, False, True]


def test_required_literals():
    known = {"metformin": "metformin", r"HbA1c\s+target": "target", r"(?P<q>que\s+la)": "que", "TH[aeo]": "th", "a|b": "", "x?yes": "yes", "(abc)+d": "abc",
             "(abc)?d": "d", r"\bdose\b": "dose", "([X": "([x", "(?:first|second) line": " line", "": "", "é+": "", "(?x) a b c": "abc", "[0-9]{3}": ""}
    assert {p: E.required_literal(p) for p in known} == known


def test_literals_decide_without_python(spark):
    """Whatever literals leave out, Python would not find either; what they leave out never reaches it."""
    rng = random.Random(3)
    pats = ["metformin", r"HbA1c\s+target", "TH[aeo]", "a|b", "(ab)+c", "([X", r"\bdose\b", "Insk", None]
    words = ["Metformin", "hba1c target", "THo", "ababc", "([x", "DOSE", "\u0130n\u017f\u212a", "İNSK", "other", "ınsk", ""]
    rows = [(k, " ".join(rng.choices(words, k=rng.randrange(3))), rng.sample(pats, rng.randrange(4))) for k in range(300)]
    df = E.checked_patterns(spark.createDataFrame(rows, "k int, t string, must_contain array<string>"))
    got = {r.k: (r.a, r.b) for r in df.select("k", E.matches_any("patterns", "t").alias("a"), E.matches_any("patterns", "t", "literals").alias("b")).collect()}
    assert all(a == b for a, b in got.values()) and len({a for a, _ in got.values()}) == 2
    plan = df.select(E.matches_any("patterns", "t", "literals"))._jdf.queryExecution().optimizedPlan().toString()
    assert "exists(literals" in plan and "Contains(lower(translate" in plan


def test_backtracking_ends(spark):
    import time
    assert E._nested(E._parsed("(a+)+b")) and E._nested(E._parsed("(a|aa)*b")) and not E._nested(E._parsed(r"a+\s+(b|c)d*"))
    start = time.time()
    df = E.checked_patterns(spark.createDataFrame([("a" * 5000, ["(a+)+b"]), ("aab", ["(a+)+b"]), ("a" * 5000 + "c", ["(a|aa)+$"])], "t string, must_contain array<string>"))
    assert [r.m for r in df.select(E.matches_any("patterns", "t").alias("m")).collect()] == [False, True, False]
    assert time.time() - start < 30


def test_percentiles_against_sorted_lists(spark):
    rng = random.Random(2)
    for n in (1, 2, 3, 10, 101):
        values = [rng.choice([rng.uniform(-5, 5), 1.5, 2.25]) for _ in range(n)]
        df = spark.createDataFrame([(v,) for v in values], "v double")
        near = ST.percentile_nearest(df, "v", {"p50": 0.5, "p95": 0.95}).first()
        s = sorted(values)
        assert near.p50 == round(s[max(math.ceil(0.5 * n), 1) - 1], 2)
        assert near.p95 == round(s[max(math.ceil(0.95 * n), 1) - 1], 2)
        lin = ST.percentile_linear(df, "v", {"p50": 0.5}).first()
        assert abs(lin.p50 - round(statistics.median(values), 2)) <= 0.0100001
    empty = spark.createDataFrame([], "v double")
    assert ST.percentile_nearest(empty, "v", {"p50": 0.5}).first().p50 == 0.0
    assert ST.percentile_linear(empty, "v", {"p50": 0.5}).first().p50 is None
    three = spark.createDataFrame([(100.0,), (200.0,), (300.0,)], "v double")
    r = ST.percentile_nearest(three, "v", {"p50": 0.5, "p95": 0.95}).first()
    assert (r.p50, r.p95) == (200.0, 300.0)


def test_block_numbering(spark):
    rows = [(k, i * 1_000_003, i % 5) for i in range(100) for k in ("a", "b") if (i * 7 + len(k)) % 3]  # sparse ids
    df = spark.createDataFrame(rows, "k string, i bigint, v int")
    got = {(r.k, r.i): r.s for r in running_total(df, ["k"], "i", F.col("v"), "s").collect()}
    pos = {(r.k, r.i): r.n for r in row_numbers(df, ["k"], "i", "n").collect()}
    for k, i, _ in rows:
        assert got[(k, i)] == sum(v for kk, j, v in rows if kk == k and j < i)
        assert pos[(k, i)] == sum(1 for kk, j, _ in rows if kk == k and j <= i)


def test_percentiles_with_outliers(spark):
    rng = random.Random(4)
    values = [rng.random() for _ in range(3000)] + [1e15, 1e30, -1e300, 0.0, -0.0]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    targets = [F.lit(k) for k in (1, 2, 1500, 3003, 3005)]
    got = {r.t: r.v for r in ST.order_statistics(df, "v", targets, slice_rows=3).collect()}
    assert [got[k] for k in range(5)] == [sorted(values)[k - 1] for k in (1, 2, 1500, 3003, 3005)]


def result(**kw):
    base = dict(query_id=1, scope="in_scope", grounded=True, citation_valid=True, citation_exact=True, citation_coverage=1.0,
                verifier_passed=True, citation_page_correct=True, citation_answer_support=True, evidence_match_passed=True,
                safety_passed=True, evidence_strength="high", citations=1, reason=None, error=None)
    return base | kw


def scored(spark, *rows):
    schema = ("query_id bigint, scope string, grounded boolean, citation_valid boolean, citation_exact boolean, citation_coverage double, "
              "verifier_passed boolean, citation_page_correct boolean, citation_answer_support boolean, evidence_match_passed boolean, "
              "safety_passed boolean, evidence_strength string, citations int, reason string, error string")
    names = [x.strip().split(" ")[0] for x in schema.split(",")]
    return E.score_answers(spark.createDataFrame([tuple(r[n] for n in names) for r in rows], schema))


def test_rubric(spark):
    refused = dict(scope="out_of_scope", grounded=False, citation_valid=None, citation_exact=None, citation_page_correct=None,
                   citation_answer_support=None, citation_coverage=0.0, verifier_passed=False, evidence_strength="insufficient", citations=0)
    rows = scored(
        spark, result(), result(query_id=2, citation_page_correct=False), result(query_id=3, reason="no_relevant_sources", **refused),
        result(query_id=4, reason="retrieval_unavailable", **refused), result(query_id=105, reason="no_relevant_sources", **refused))
    got = {r.query_id: (r.score, r.passed) for r in rows.collect()}
    assert got == {1: (100, True), 2: (90, False), 3: (100, True), 4: (90, False), 105: (90, False)}
    asked = spark.createDataFrame([(1, "in_scope"), (9, "in_scope")], "query_id bigint, scope string")
    filled = {r.query_id: (r.score, r.reason) for r in E.fill_errors(asked, rows).collect()}
    assert filled == {1: (100, None), 9: (0, "api_error")}
    gates = {r.gate: r.passed for r in E.quality_gates(
        E.run_counts(rows), spark.createDataFrame([(10,)], "messages bigint")).collect()}
    assert gates["chat_history_persisted"] and not gates["patient_specific_dosage_refused"] and not gates["overall"]
    assert gates["out_of_scope_abstention_100_percent"] and gates["no_api_errors"]


def test_summary_of_nothing_is_zeros(spark):
    schema = ("scope string, grounded boolean, abstained boolean, citation_valid boolean, citation_exact boolean, citation_page_correct boolean, "
              "citation_answer_support boolean, recall_at_5 boolean, context_precision double, reciprocal_rank double, claim_count int, "
              "supported_claims int, citation_coverage double, error string, total_ms double")
    r = E.eval_summary(spark.createDataFrame([], schema)).first()
    assert r.in_total == 0 and r.faithfulness == 0.0 and r.p95_total == 0.0 and r.grounded_percent == 0


def test_tenants_are_disjoint(spark):
    c = spark.createDataFrame([("a", "d1"), ("a", "d2"), ("b", "d3")], "tenant string, document_id string")
    assert E.tenant_disjoint(c).first().disjoint
    assert not E.tenant_disjoint(c.union(spark.createDataFrame([("b", "d1")], c.schema))).first().disjoint


def test_integrity_of_lists_with_missing_ranks(spark):
    """A list that lost its first ranks still reaches to its last one; a question without a label has no row."""
    q = E.checked_patterns(spark.createDataFrame(
        [(1, "d", [3], ["care"])], "query_id long, expected_document_id string, expected_pages array<int>, must_contain array<string>"))
    hits = spark.createDataFrame([(1, 3), (1, 4), (2, 1)], "query_id long, rank int")
    rows = [(1, "C1", 4, 4, "t", "d", 3, "s", "k", "the care plan"), (2, "C1", 1, 1, "t", "d", 3, "s", "k", "the care plan")]
    citations = spark.createDataFrame(
        rows, "query_id long, citation_id string, source_id int, rank int, document string, document_id string, page int, section string, "
        "chunk_id string, excerpt string")
    got = [tuple(r) for r in E.citation_integrity(citations, q, hits).collect()]
    assert got == [(1, True, True, True)]
