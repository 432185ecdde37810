import json

import pytest

from passagework.operators import audit as A

HIT = "query_id bigint, rank int, text string, title string, source string, document_id string, publisher string, " \
      "source_url string, topic string, page_number int, section_title string, chunk_id string, distance double, rerank_score double"


def hit(rank, text, score=1.0, page=None, q=1):
    return (q, rank, text, "Guide", "s.pdf", "doc", "Pub", "https://x", "t", page or rank, "Sec", f"c{rank}", 0.5, score)


def hits(spark, *rows):
    return spark.createDataFrame(list(rows), HIT)


def answers(spark, *payloads):
    rows = [(i, p if isinstance(p, str) else json.dumps(p)) for i, p in enumerate(payloads, 1)]
    return A.parse_answers(spark.createDataFrame(rows, "query_id bigint, raw string"))


def claim(text, *refs):
    return {"text": text, "evidence": [{"source_id": s, "excerpt": x} for s, x in refs]}


SOURCE = "Offer self‑monitoring of blood glucose every day. Review the plan after 1–3 months."


def checked(spark, h, a):
    refs = A.validate_refs(A.answer_claims(a.filter("sufficient")), h)
    numbered = A.number_citations(refs)
    claims = A.surviving_claims(refs, numbered)
    return claims, A.citation_table(numbered, h), A.evidence_package(a, claims, A.validation_errors(refs))


def test_exact_citation(spark):
    a = answers(spark, {"sufficient": True, "recommendation_claims": [claim("Offer it", (1, "self-monitoring of blood glucose"))]})
    claims, cites, package = checked(spark, hits(spark, hit(1, SOURCE)), a)
    p = package.first()
    assert p.recommendation == "Offer it [C1]" and p.evidence_strength == "medium" and p.errors == []
    assert [c.citation_id for c in cites.collect()] == ["C1"] and claims.count() == 1


def test_duplicate_evidence_is_one_citation(spark):
    ref = (1, "self-monitoring of blood glucose")
    a = answers(spark, {"sufficient": True, "recommendation_claims": [claim("Offer it", ref, ref)]})
    _, cites, package = checked(spark, hits(spark, hit(1, SOURCE)), a)
    assert cites.count() == 1 and package.first().recommendation == "Offer it [C1]"


def test_invented_excerpt_leaves_no_package(spark):
    a = answers(spark, {"sufficient": True, "recommendation_claims": [claim("Offer it", (1, "entirely invented words"))]})
    p = checked(spark, hits(spark, hit(1, SOURCE)), a)[2].first()
    assert p.recommendation is None
    assert p.errors == ["recommendation-1:invented_or_invalid_excerpt:1", "recommendation-1:no_valid_citations",
                        "missing_recommendation"]


def test_bad_optional_claim_is_dropped(spark):
    a = answers(spark, {
        "sufficient": True, "recommendation_claims": [claim("Offer it", (1, "self-monitoring of blood glucose"))],
        "supporting_claims": [claim("More", (1, "words that are not there")), claim("Out", (5, "Review the plan"))]})
    claims, _, package = checked(spark, hits(spark, hit(1, SOURCE)), a)
    p = package.first()
    assert [c.claim_id for c in claims.collect()] == ["recommendation-1"] and p.evidence_strength == "low"
    assert "supporting-2:invalid_source_id:5" in p.errors and p.missing_evidence.startswith("Some generated")


def test_malformed_answers(spark):
    bad = answers(
        spark, "plain text", {"sufficient": True}, {"sufficient": "true", "recommendation_claims": [claim("x", (1, "yyyyyyyyy"))]},
        "{broken", {"sufficient": True, "recommendation_claims": [{"text": "t", "evidence": [
            {"source_id": True, "excerpt": "abcdefgh"}, {"source_id": "1", "excerpt": "abcdefgh"}, {"source_id": 1, "excerpt": " "}]}]})
    rows = {r.query_id: r for r in bad.collect()}
    assert [rows[i].sufficient for i in range(1, 6)] == [False, False, False, False, True]
    assert rows[5].recommendation_claims[0].evidence == []


def verdicts(spark, *rows):
    raw = json.dumps({"results": [
        {"claim_id": c, "supported": ok, "relevant": True, "safe": True, "overconfident": False, "reason": "r"} for c, ok in rows]})
    return A.parse_verdicts(spark.createDataFrame([(1, raw)], "query_id bigint, raw string"))


def two_claims(spark):
    a = answers(spark, {
        "sufficient": True, "recommendation_claims": [claim("Offer it", (1, "self-monitoring of blood glucose"))],
        "supporting_claims": [claim("Review", (1, "Review the plan after 1-3 months"))]})
    return checked(spark, hits(spark, hit(1, SOURCE)), a)


def test_optional_verdict_missing_keeps_answer(spark):
    claims, cites, _ = two_claims(spark)
    outcome, kept = A.apply_verdicts(claims, verdicts(spark, ("recommendation-1", True)))
    o = outcome.first()
    assert not o.malformed and o.dropped == ["supporting-1"] and o.has_recommendation
    assert [r.claim_id for r in kept.collect()] == ["recommendation-1"]
    assert [r.citation_id for r in A.used_citations(cites, kept).collect()] == ["C1"]


def test_required_verdict_missing_is_malformed(spark):
    claims, _, _ = two_claims(spark)
    outcome, kept = A.apply_verdicts(claims, verdicts(spark, ("supporting-1", True)))
    assert outcome.first().malformed and kept.count() == 0


@pytest.mark.parametrize("rows", [[("recommendation-1", True)] * 2, [("recommendation-1", True), ("other", True)]])
def test_doubled_or_unknown_verdicts_are_malformed(spark, rows):
    claims, _, _ = two_claims(spark)
    assert A.apply_verdicts(claims, verdicts(spark, *rows))[0].first().malformed


def test_strength(spark):
    h = hits(spark, hit(1, SOURCE), hit(2, "Another place says: offer it to every adult."))
    a = answers(spark, {"sufficient": True, "recommendation_claims": [
        claim("Offer it", (1, "self-monitoring of blood glucose"), (2, "offer it to every adult"))]})
    claims, cites, _ = checked(spark, h, a)
    flags = lambda weak: spark.createDataFrame([(1, weak)], "query_id bigint, weak boolean")
    assert A.evidence_strength(claims, cites, flags(False)).first().evidence_strength == "high"
    assert A.evidence_strength(claims, cites, flags(True)).first().evidence_strength == "low"


def rescue(spark, question, *rows):
    q = spark.createDataFrame([(1, question)], "query_id bigint, question string")
    return A.extractive_rescue(hits(spark, *rows), q).first()


def test_rescue_prefers_initial_choice(spark):
    r = rescue(spark, "Which treatment comes for adults?",
               hit(1, "Offer further medicines if control is poor in adults.", 5.9), hit(2, "Offer metformin to most adults at first.", 5.6))
    assert r.source_id == 2
    r = rescue(spark, "Which further treatment comes for adults?",
               hit(1, "Offer further medicines if control is poor in adults.", 5.9), hit(2, "Offer metformin to most adults at first.", 5.6))
    assert r.source_id == 1


def test_rescue_offers_a_window_for_tables(spark):
    table = "dose range " * 80
    r = rescue(spark, "What is the range?", hit(1, "This is one full sentence about something else.", 4.0), hit(2, table, 7.0))
    assert r.source_id == 2 and r.excerpt == " ".join(table.split())[:600].rsplit(" ", 1)[0]


def disposition(spark, role, raw, ver=None, gen_fail=None, ver_fail=None, question="What is the plan for adults?", score=1.0, **kw):
    q = spark.createDataFrame([(1, question, role, gen_fail, ver_fail)],
                              "query_id bigint, question string, role string, generation_failure string, verification_failure string")
    v = ver if ver is not None else verdicts(spark, ("recommendation-1", True))
    h = kw.pop("hits", None) or hits(spark, hit(1, SOURCE, score))
    r = A.answer_disposition(q, h, answers(spark, raw), v, **kw).first()
    return r.grounded, r.reason, r.evidence_strength


GOOD = {"sufficient": True, "recommendation_claims": [claim("Offer it", (1, "self-monitoring of blood glucose"))]}
BAD = {"sufficient": True, "recommendation_claims": [claim("Offer it", (1, "invented words only"))]}


def test_dispositions(spark):
    no = "insufficient"
    assert disposition(spark, "patient", GOOD) == (True, None, "medium")
    assert disposition(spark, "patient", BAD) == (False, "evidence_validation_failed", no)
    assert disposition(spark, "doctor", BAD) == (True, None, "medium")
    assert disposition(spark, "patient", "nothing") == (False, "model_reported_insufficient_context", no)
    assert disposition(spark, "patient", GOOD, gen_fail="rate_limited") == (False, "generation_rate_limited", no)
    assert disposition(spark, "patient", GOOD, ver_fail="unavailable") == (False, "evidence_verification_unavailable", no)
    assert disposition(spark, "doctor", GOOD, gen_fail="unavailable", ver_fail="unavailable") == (True, None, "medium")
    assert disposition(spark, "doctor", GOOD, gen_fail="unavailable", ver_fail="unavailable", score=-1.0) == (
        False, "evidence_verification_failed", no)
    assert disposition(spark, "patient", GOOD, verdicts(spark, ("recommendation-1", False))) == (
        False, "evidence_verification_failed", no)
    assert disposition(spark, "doctor", GOOD, verdicts(spark, ("recommendation-1", False))) == (True, None, "medium")
    assert disposition(spark, "doctor", GOOD, question="best pizza")[1] == "non_medical_question"
    assert disposition(spark, "patient", GOOD, question="do I have asthma")[1] == "patient_specific_diagnosis"
    assert disposition(spark, "patient", GOOD, verifier_enabled=False)[1] == "evidence_verifier_disabled"
    assert disposition(spark, "patient", GOOD, hits=hits(spark, hit(1, SOURCE, q=2)))[1] == "no_relevant_sources"


def test_prompt_has_delimiters(spark):
    q = spark.createDataFrame([(1, "Why?", ""), (2, "How?", "age 50")], "query_id bigint, question string, context string")
    rows = {r.query_id: r.prompt for r in A.assemble_prompt(hits(spark, hit(1, SOURCE)), q).collect()}
    assert rows[1].startswith("SOURCES:\nBEGIN_UNTRUSTED_SOURCE_1\n[1] Guide — page 1, Sec\n")
    assert rows[1].endswith("\n\nValid source_id integers: 1 to 1.\n\nBEGIN_PATIENT_QUESTION\nWhy?\nEND_PATIENT_QUESTION")
    assert rows[2].startswith("SOURCES:\n(none)\n\nBEGIN_UNTRUSTED_PATIENT_CONTEXT\nage 50\n")


def test_full_package(spark):
    """All parts of a package that survives, and nothing but flags of its failure where no recommendation does."""
    h = hits(spark, hit(1, SOURCE), hit(2, SOURCE), hit(1, SOURCE, q=2), hit(3, "other text altogether", page=1))
    a = answers(spark, {"sufficient": True, "partial": True, "missing_evidence": "doses", "recommendation_claims": [
        claim("Offer it", (1, "self-monitoring of blood glucose"), (2, "Review the plan after 1-3 months")), claim("Invent it", (1, "no such words at all"))],
        "supporting_claims": [claim("Because", (1, "self-monitoring of blood glucose"))]},
        {"sufficient": True, "recommendation_claims": [claim("Invent it", (1, "no such words at all"))]})
    claims, _, package = checked(spark, h, a)
    got = {r.query_id: r for r in A.full_package(package, claims, h).collect()}
    r = got[1]
    assert [(c.claim_id, c.claim, c.citation_ids) for c in r.recommendation_claims] == [("recommendation-1", "Offer it", ["C1", "C2"])]
    assert [(c.claim_id, c.citation_ids) for c in r.supporting_evidence] == [("supporting-1", ["C1"])]
    assert r.evidence_checked == ["Guide (p. 1)", "Guide (p. 2)"] and r.evidence_strength == "low" and r.missing_evidence.startswith("doses Some generated")
    assert r.safety_notice.startswith("This answer summarizes")
    assert r.checks.asDict() == {"retrieval_passed": True, "exact_excerpts_passed": True, "citation_coverage": 1.0, "evidence_match_passed": False,
                                 "safety_passed": False, "verifier_passed": False}
    assert got[2].recommendation is None and got[2].checks is None and got[2].evidence_checked is None and got[2].recommendation_claims is None
    outcome = spark.createDataFrame([(1, False, True)], "query_id bigint, malformed boolean, has_recommendation boolean")
    assert A.full_package(package, claims, h, outcome).filter("query_id = 1").first().checks.verifier_passed
    assert A.full_package(package.limit(0), claims, h).count() == 0
