"""Answer and citation audit over tables of model outputs.

Everything is keyed by ``query_id``: hits ``(query_id, rank, text, …)``, raw answers ``(query_id, raw)``, raw verdicts
``(query_id, raw)``.  A question has a handful of hits and claims, so per-question groups are small by nature and hash
partitioning by question spreads any volume evenly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passagework import constants as K
from passagework.functions import text as T
from passagework.sources.lineage import cut

_REF = "struct<source_id:bigint,excerpt:string>"
_CLAIM = f"struct<text:string,evidence:array<{_REF}>>"
ANSWER_SCHEMA = (
    f"sufficient boolean, partial boolean, missing_evidence string, recommendation_claims array<{_CLAIM}>, "
    f"supporting_claims array<{_CLAIM}>")
VERDICT_SCHEMA = (
    "results array<struct<claim_id:string,supported:boolean,relevant:boolean,safe:boolean,overconfident:boolean,"
    "reason:string>>")


# --- sources, prompts, quotes -------------------------------------------------------------------------
def checked_sources(hits: DataFrame) -> DataFrame:
    """Distinct source labels per question in rank order: ``(query_id, sources)``."""
    ranked = F.array_sort(F.collect_list(F.struct("rank", T.source_label("title", "page_number").alias("label"))))
    return hits.groupBy("query_id").agg(
        F.array_distinct(F.transform(ranked, lambda x: x.label)).alias("sources"))


def assemble_prompt(hits: DataFrame, queries: DataFrame, system: DataFrame | None = None) -> DataFrame:
    """``(query_id, prompt[, system_prompt])``: numbered, delimited source blocks, optional context, question.

    ``queries(query_id, question, context[, role, mode])``; ``system(role, mode, system_prompt)`` holds the prompt
    texts in use.
    """
    n = F.col("rank").cast("string")
    section = F.when(F.coalesce("section_title", F.lit("")) != "", F.concat(F.lit(", "), F.col("section_title"))).otherwise("")
    block = F.concat(
        F.lit("BEGIN_UNTRUSTED_SOURCE_"), n, F.lit("\n["), n, F.lit("] "), F.col("title"), F.lit(" — page "),
        F.coalesce(F.col("page_number").cast("string"), F.lit("None")), section, F.lit("\n"), F.col("text"),
        F.lit("\nEND_UNTRUSTED_SOURCE_"), n)
    blocks = hits.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", block.alias("b")))).alias("bs"))
    j = queries.join(blocks, "query_id", "left")
    some = F.col("bs").isNotNull()
    context = F.coalesce("context", F.lit(""))
    prompt = F.concat_ws(
        "\n", F.lit("SOURCES:"),
        F.when(some, F.array_join(F.transform("bs", lambda x: x.b), "\n\n")).otherwise(F.lit("(none)")),
        F.when(context != "", F.concat(F.lit("\nBEGIN_UNTRUSTED_PATIENT_CONTEXT\n"), context,
                                       F.lit("\nEND_UNTRUSTED_PATIENT_CONTEXT"))),
        F.when(some, F.concat(F.lit("\nValid source_id integers: 1 to "), F.size("bs").cast("string"), F.lit("."))),
        F.lit("\nBEGIN_PATIENT_QUESTION"), F.col("question"), F.lit("END_PATIENT_QUESTION"))
    out = j.withColumn("prompt", prompt)
    if system is None:
        return out.select("query_id", "prompt")
    return out.join(system, ["role", "mode"], "left").select("query_id", "prompt", "system_prompt")


def extractive_answer(hits: DataFrame) -> DataFrame:
    """Quote of the first hit, cut at 420 characters on a word boundary: ``(query_id, claim_text, source_id, excerpt)``."""
    q = hits.filter(F.col("rank") == 1).select("query_id", T.quote_head("text").alias("excerpt"))
    return q.select("query_id", F.concat(F.lit(K.QUOTE_PREFIX), F.col("excerpt")).alias("claim_text"),
                    F.lit(1).cast("bigint").alias("source_id"), "excerpt")


def extractive_rescue(hits: DataFrame, queries: DataFrame) -> DataFrame:
    """The best quotable sentence per question: ``(query_id, source_id, excerpt, claim_text, rerank_score)``.

    Order: rerank score (less a penalty when a question about a first choice meets "further medicines"; 0 and missing
    count as unscored), words shared with the question, lower rank, earlier position, text.  A passage without a
    sentence of 24-600 characters offers its first 600 folded characters, less the last word.
    """
    q = queries.select("query_id", T.content_words("question").alias("words"),
                       (~F.col("question").rlike(K.ESCALATION)).alias("initial"))
    eligible = F.filter(
        F.transform(T.sentences("text"), lambda s, i: F.struct(i.alias("pos"), T.strip(s).alias("s"))),
        lambda x: F.length(x.s).between(K.RESCUE_MIN, K.RESCUE_MAX))
    head = F.substring(T.fold_punctuation("text"), 1, K.RESCUE_MAX)
    window = F.regexp_replace(head, " [^ ]*$", "")
    fallback = F.when(F.length(window) >= K.RESCUE_MIN, F.array(F.struct(F.lit(0).alias("pos"), window.alias("s")))).otherwise(
        F.array().cast("array<struct<pos:int,s:string>>"))
    with_sentences = hits.select("query_id", "rank", "rerank_score", "text", eligible.alias("e"))
    cand = with_sentences.select(
        "query_id", "rank", "rerank_score",
        F.explode_outer(F.when(F.size("e") > 0, F.col("e")).otherwise(fallback)).alias("c")).filter(F.col("c").isNotNull())
    scored = cand.join(q, "query_id")
    overlap = F.size(F.array_intersect("words", F.array_distinct(T.long_words(F.lower(F.col("c.s"))))))
    base = F.coalesce(F.nullif(F.col("rerank_score"), F.lit(0.0)), F.lit(K.UNSCORED))
    penalty = F.when(F.col("initial") & F.col("c.s").rlike(K.FURTHER_MEDICINES), K.FURTHER_PENALTY).otherwise(0.0)
    best = scored.groupBy("query_id").agg(F.max(F.struct(
        (base - penalty).alias("score"), overlap.alias("overlap"), (-F.col("rank")).alias("neg_rank"),
        (-F.col("c.pos")).alias("neg_pos"), F.col("c.s").alias("excerpt"), F.col("rerank_score"))).alias("b"))
    return best.select(
        "query_id", (-F.col("b.neg_rank")).cast("bigint").alias("source_id"), F.col("b.excerpt").alias("excerpt"),
        F.concat(F.lit(K.RESCUE_PREFIX), T.fold_punctuation(F.col("b.excerpt"))).alias("claim_text"),
        F.col("b.rerank_score").alias("rerank_score"))


# --- parsing ------------------------------------------------------------------------------------------
def _object(raw: Column, schema: str) -> Column:
    """JSON object from the first ``{`` to the last ``}``."""
    return F.from_json(F.regexp_extract(raw, r"(?s)\{.*\}", 0), schema)


def parse_answers(raw: DataFrame) -> DataFrame:
    """Typed answers; anything malformed reads as insufficient.

    Only a JSON true is true; references need an integer id and a non-blank excerpt, claims a non-blank text; a
    sufficient answer without a recommendation is not sufficient.
    """
    p = raw.withColumn("__a", _object(F.col("raw"), ANSWER_SCHEMA))

    def claims(c: Column) -> Column:
        refs = lambda x: F.transform(
            F.filter(F.coalesce(x.evidence, F.array().cast(f"array<{_REF}>")),
                     lambda r: r.source_id.isNotNull() & (T.strip(r.excerpt) != "")),
            lambda r: F.struct(r.source_id.alias("source_id"), T.strip(r.excerpt).alias("excerpt")))
        good = F.filter(F.coalesce(c, F.array().cast(f"array<{_CLAIM}>")), lambda x: T.strip(x.text) != "")
        return F.transform(good, lambda x: F.struct(T.strip(x.text).alias("text"), refs(x).alias("evidence")))

    keep = [c for c in raw.columns if c != "raw"]
    out = p.select(*keep, F.coalesce(F.col("__a.sufficient"), F.lit(False)).alias("__s"),
                   F.coalesce(F.col("__a.partial"), F.lit(False)).alias("partial"),
                   F.coalesce(T.strip("__a.missing_evidence"), F.lit("")).alias("missing_evidence"),
                   claims(F.col("__a.recommendation_claims")).alias("recommendation_claims"),
                   claims(F.col("__a.supporting_claims")).alias("supporting_claims"))
    return out.withColumn("sufficient", F.col("__s") & (F.size("recommendation_claims") > 0)).drop("__s")


def answer_claims(answers: DataFrame) -> DataFrame:
    """Claims in order: ``(query_id, kind, kind_no, claim_no, claim_id, claim_text, evidence)``."""
    tagged = F.concat(
        F.transform("recommendation_claims", lambda c, i: F.struct(
            F.lit("recommendation").alias("kind"), F.lit(0).alias("kind_no"), (i + 1).alias("claim_no"), c.alias("c"))),
        F.transform("supporting_claims", lambda c, i: F.struct(
            F.lit("supporting").alias("kind"), F.lit(1).alias("kind_no"), (i + 1).alias("claim_no"), c.alias("c"))))
    # The outer explode keeps Spark from parsing every answer a second time to test for emptiness.
    rows = answers.select("query_id", F.explode_outer(tagged).alias("x")).filter(F.col("x").isNotNull())
    return rows.select(
        "query_id", "x.kind", "x.kind_no", "x.claim_no",
        F.concat("x.kind", F.lit("-"), F.col("x.claim_no").cast("string")).alias("claim_id"),
        T.fold_punctuation(F.col("x.c.text")).alias("claim_text"), F.col("x.c.evidence").alias("evidence"))


def parse_verdicts(raw: DataFrame) -> DataFrame:
    """Verifier rows ``(query_id, row_no, claim_id, supported, relevant, safe, overconfident, passed, reason)``."""
    p = raw.select("query_id", _object(F.col("raw"), VERDICT_SCHEMA).alias("v")).select(
        "query_id", F.posexplode_outer("v.results").alias("row_no", "r")).filter(F.col("r.claim_id").isNotNull())

    def flag(name: str) -> Column:
        return F.coalesce(F.col(f"r.{name}"), F.lit(False)).alias(name)

    rows = p.select("query_id", "row_no", T.strip("r.claim_id").alias("claim_id"), flag("supported"), flag("relevant"),
                    flag("safe"), flag("overconfident"), F.coalesce(T.strip("r.reason"), F.lit("")).alias("reason"))
    return rows.withColumn(
        "passed", F.col("supported") & F.col("relevant") & F.col("safe") & ~F.col("overconfident"))


# --- validation ---------------------------------------------------------------------------------------
def validate_refs(claims: DataFrame, hits: DataFrame) -> DataFrame:
    """One row per claim and reference with ``claim_status`` and ``ref_status`` (``ok`` or an error code).

    An excerpt counts when its folded form of 8-600 characters stands in the folded source it names.
    """
    n = F.length("claim_text")
    status = (
        F.when((n == 0) | (n > K.CLAIM_MAX), "invalid_claim_text").when(F.size("evidence") == 0, "missing_evidence")
        .otherwise("ok"))
    refs = claims.withColumn("claim_status", status).select(
        "query_id", "kind", "kind_no", "claim_no", "claim_id", "claim_text", "claim_status",
        F.posexplode_outer("evidence").alias("ref_no", "r"))
    refs = refs.select(
        *[c for c in refs.columns if c != "r"], F.col("r.source_id").alias("source_id"),
        T.fold_punctuation(F.col("r.excerpt")).alias("excerpt"))
    src = hits.select("query_id", F.col("rank").cast("bigint").alias("source_id"),
                      T.fold_punctuation("text").alias("__source"))
    size = F.length("excerpt")
    ref_status = (
        F.when(F.col("claim_status") != "ok", F.lit(None))
        .when(F.col("__source").isNull(), "invalid_source_id")
        .when((size < K.EXCERPT_MIN) | (size > K.EXCERPT_MAX) | ~F.contains("__source", "excerpt"),
              "invented_or_invalid_excerpt")
        .otherwise("ok"))
    return refs.join(src, ["query_id", "source_id"], "left").withColumn("ref_status", ref_status).drop("__source")


def number_citations(refs: DataFrame) -> DataFrame:
    """Distinct valid references as ``C1``, ``C2``… in first-use order: ``(query_id, source_id, excerpt, citation_no, citation_id)``."""
    first = refs.filter(F.col("ref_status") == "ok").groupBy("query_id", "source_id", "excerpt").agg(
        F.min(F.struct("kind_no", "claim_no", "ref_no")).alias("first"))
    w = Window.partitionBy("query_id").orderBy("first")
    return first.withColumn("citation_no", F.row_number().over(w)).select(
        "query_id", "source_id", "excerpt", "citation_no",
        F.concat(F.lit("C"), F.col("citation_no").cast("string")).alias("citation_id"))


def citation_table(numbered: DataFrame, hits: DataFrame) -> DataFrame:
    """Citations with the metadata of the hit they quote."""
    meta = hits.select(
        "query_id", F.col("rank").cast("bigint").alias("source_id"), "rank", "document_id",
        F.coalesce(F.nullif(F.col("title"), F.lit("")), F.lit(K.UNKNOWN_DOCUMENT)).alias("document"), "publisher",
        F.col("page_number").alias("page"), F.col("section_title").alias("section"), "chunk_id",
        T.safe_url("source_url").alias("source_url"), F.col("distance").alias("vector_distance"), "rerank_score")
    return numbered.join(meta, ["query_id", "source_id"])


def surviving_claims(refs: DataFrame, numbered: DataFrame) -> DataFrame:
    """Claims with at least one valid reference and their distinct citation ids in use order."""
    ok = refs.filter(F.col("ref_status") == "ok").join(numbered, ["query_id", "source_id", "excerpt"])
    ids = F.array_distinct(F.transform(
        F.array_sort(F.collect_list(F.struct("ref_no", "citation_id"))), lambda x: x.citation_id))
    return ok.groupBy("query_id", "kind", "kind_no", "claim_no", "claim_id", "claim_text").agg(ids.alias("citation_ids"))


def validation_errors(refs: DataFrame) -> DataFrame:
    """``(query_id, errors)``: codes in claim and reference order, ``missing_recommendation`` last; none gives no row.

    Groups are single claims first, then single questions.
    """
    sid = F.col("source_id").cast("string")
    code = (
        F.when(F.col("claim_status") != "ok", F.concat_ws(":", "claim_id", "claim_status"))
        .when(F.col("ref_status") != "ok", F.concat(F.col("claim_id"), F.lit(":"), F.col("ref_status"), F.lit(":"), sid)))
    per_claim = refs.groupBy("query_id", "kind_no", "claim_no", "claim_id", "claim_status").agg(
        F.transform(F.array_sort(F.collect_list(F.when(code.isNotNull(), F.struct(
            F.coalesce("ref_no", F.lit(0)).alias("n"), code.alias("code"))))), lambda x: x.code).alias("codes"),
        F.coalesce(F.bool_or(F.col("ref_status") == "ok"), F.lit(False)).alias("alive"))
    codes = F.when((F.col("claim_status") == "ok") & ~F.col("alive"), F.concat(
        "codes", F.array(F.concat("claim_id", F.lit(":no_valid_citations"))))).otherwise(F.col("codes"))
    per_query = per_claim.groupBy("query_id").agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("kind_no", "claim_no", codes.alias("codes")))),
                              lambda x: x.codes)).alias("codes"),
        F.bool_or(F.col("alive") & (F.col("kind_no") == 0)).alias("has"))
    out = F.when(F.col("has"), F.col("codes")).otherwise(F.concat("codes", F.array(F.lit("missing_recommendation"))))
    return per_query.select("query_id", out.alias("errors")).filter(F.size("errors") > 0)


def rendered(claims: DataFrame) -> DataFrame:
    """``(query_id, recommendation)``: recommendation claims with ``[C1]`` markers, joined by blank lines."""
    marks = F.array_join(F.transform("citation_ids", lambda c: F.concat(F.lit("["), c, F.lit("]"))), " ")
    one = F.concat(F.col("claim_text"), F.lit(" "), marks)
    recs = claims.filter(F.col("kind") == "recommendation")
    return recs.groupBy("query_id").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("claim_no", one.alias("t")))), lambda x: x.t), "\n\n").alias("recommendation"))


def evidence_package(answers: DataFrame, claims: DataFrame, errors: DataFrame) -> DataFrame:
    """Per sufficient answer: rendered recommendation (null when none survived), strength, missing evidence, errors."""
    none = F.array().cast("array<string>")
    j = (
        answers.filter("sufficient").select("query_id", "partial", "missing_evidence")
        .join(rendered(claims), "query_id", "left").join(errors, "query_id", "left")
        .withColumn("errors", F.coalesce("errors", none)))
    bad = F.size("errors") > 0
    missing = F.when(F.col("partial"), F.col("missing_evidence")).otherwise(F.lit(""))
    noted = T.strip(F.concat(missing, F.when(bad, F.lit(" " + K.DROPPED_TEXT_NOTE)).otherwise(F.lit(""))))
    alive = F.col("recommendation").isNotNull()
    return j.select(
        "query_id", "recommendation", "partial", "errors",
        F.when(alive, F.when(F.col("partial") | bad, "low").otherwise("medium")).alias("evidence_strength"),
        F.when(alive, noted).alias("missing_evidence"))


def full_package(package: DataFrame, claims: DataFrame, hits: DataFrame, outcome: DataFrame | None = None) -> DataFrame:
    """:func:`evidence_package` with what a reader is shown beside it, null where no recommendation survived:
    ``recommendation_claims``, ``supporting_evidence`` (claim id, text, citation ids, in claim order), ``safety_notice``,
    ``evidence_checked`` (labels of all sources) and ``checks``.

    Of the six checks those of retrieval, excerpts and citation coverage hold of every package, as only claims with an exact
    excerpt are left in it.  The other three are false until an audit passed: ``verdicts`` is the outcome of
    :func:`apply_verdicts`, whose failure is null where the package was verified.  All sides are keyed by the
    question and bounded by it, so the package is one exchange of each.
    """
    def of(kind: str) -> Column:
        rows = F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct(
            "claim_no", F.struct("claim_id", F.col("claim_text").alias("claim"), "citation_ids").alias("c")))))
        return F.transform(rows, lambda x: x.c)

    per_query = claims.groupBy("query_id").agg(of("recommendation").alias("recommendation_claims"), of("supporting").alias("supporting_evidence"))
    j = package.join(per_query, "query_id", "left").join(
        checked_sources(hits).withColumnRenamed("sources", "evidence_checked"), "query_id", "left")
    verified = F.lit(False)
    if outcome is not None:
        j = j.join(outcome.select("query_id", (F.col("has_recommendation") & ~F.col("malformed")).alias("__verified")), "query_id", "left")
        verified = F.coalesce("__verified", F.lit(False))
    alive = F.col("recommendation").isNotNull()
    checks = F.struct(
        F.lit(True).alias("retrieval_passed"), F.lit(True).alias("exact_excerpts_passed"), F.lit(1.0).alias("citation_coverage"),
        *[verified.alias(n) for n in ("evidence_match_passed", "safety_passed", "verifier_passed")])
    added = {"recommendation_claims": F.col("recommendation_claims"), "supporting_evidence": F.col("supporting_evidence"),
             "safety_notice": F.lit(K.SAFETY_NOTICE), "evidence_checked": F.col("evidence_checked"), "checks": checks}
    return j.select(*package.columns, *[F.when(alive, c).alias(n) for n, c in added.items()])


# --- verification -------------------------------------------------------------------------------------
def verification_complete(verdicts: DataFrame, claims: DataFrame) -> DataFrame:
    """``(query_id, complete, passed)``: every claim judged exactly once and nothing else; all rows pass."""
    v = verdicts.groupBy("query_id", "claim_id").agg(F.count(F.lit(1)).alias("n"), F.min("passed").alias("ok"))
    both = v.join(claims.select("query_id", "claim_id", F.lit(True).alias("expected")), ["query_id", "claim_id"], "full")
    agg = both.groupBy("query_id").agg(
        F.bool_and(F.col("expected").isNotNull() & (F.coalesce("n", F.lit(0)) == 1)).alias("complete"),
        F.bool_and(F.coalesce("ok", F.lit(True))).alias("all_ok"))
    return agg.select("query_id", "complete", (F.col("complete") & F.col("all_ok")).alias("passed"))


def apply_verdicts(claims: DataFrame, verdicts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(outcome, kept)`` of verified claims.

    ``outcome(query_id, malformed, dropped, has_recommendation, rejected_recommendation)``: malformed when an id is
    doubled or unknown or a recommendation has no row.  ``kept`` are the passing claims of well-formed questions
    that keep a recommendation; the others show nothing.
    """
    v = verdicts.groupBy("query_id", "claim_id").agg(F.count(F.lit(1)).alias("n"), F.min("passed").alias("ok"))
    c = claims.withColumn("__known", F.lit(True))
    both = c.join(v, ["query_id", "claim_id"], "full")
    known, judged = F.col("__known").isNotNull(), F.col("n").isNotNull()
    is_rec = F.col("kind") == "recommendation"
    ok = F.coalesce("ok", F.lit(False))
    outcome = both.groupBy("query_id").agg(
        F.bool_or(~known | (F.coalesce("n", F.lit(0)) > 1) | (is_rec & ~judged)).alias("malformed"),
        F.sort_array(F.collect_list(F.when(known & ~ok, F.col("claim_id")))).alias("dropped"),
        F.coalesce(F.bool_or(known & is_rec & ok), F.lit(False)).alias("has_recommendation"),
        F.coalesce(F.bool_or(F.startswith("claim_id", F.lit("recommendation-")) & judged & ~ok), F.lit(False)).alias(
            "rejected_recommendation"))
    outcome = outcome.withColumn("malformed", F.coalesce("malformed", F.lit(False)))
    alive = outcome.filter(~F.col("malformed") & F.col("has_recommendation")).select("query_id")
    kept = both.filter(known & ok).select(*claims.columns).join(alive, "query_id", "left_semi")
    return outcome, kept


def verified_answer(package: DataFrame, outcome: DataFrame, kept: DataFrame) -> DataFrame:
    """The answer that may be shown: ``(query_id, recommendation, supporting_evidence, missing_evidence, safety_notice)``.

    Only questions that keep a recommendation are there.  It is rendered again from the claims that passed; supporting
    claims that passed stay, in order, as (claim_id, claim, citation_ids); a dropped claim adds a note to what is missing.
    """
    supporting = kept.filter(F.col("kind") == "supporting").groupBy("query_id").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("claim_no", "claim_id", F.col("claim_text").alias("claim"), "citation_ids"))),
        lambda c: F.struct(c.claim_id.alias("claim_id"), c.claim.alias("claim"), c.citation_ids.alias("citation_ids"))).alias("supporting_evidence"))
    empty = F.array().cast("array<struct<claim_id:string,claim:string,citation_ids:array<string>>>")
    note = F.when(F.size("dropped") > 0, F.lit(" " + K.DROPPED_VERDICT_NOTE)).otherwise(F.lit(""))
    return (
        rendered(kept).join(package.select("query_id", "missing_evidence"), "query_id").join(outcome.select("query_id", "dropped"), "query_id")
        .join(supporting, "query_id", "left").select(
            "query_id", "recommendation", F.coalesce("supporting_evidence", empty).alias("supporting_evidence"),
            T.strip(F.concat(F.coalesce("missing_evidence", F.lit("")), note)).alias("missing_evidence"),
            F.lit(K.SAFETY_NOTICE).alias("safety_notice")))


def used_citations(citations: DataFrame, kept: DataFrame) -> DataFrame:
    """Citations some kept claim still uses."""
    used = kept.select("query_id", F.explode("citation_ids").alias("citation_id"))
    return citations.join(used, ["query_id", "citation_id"], "left_semi")


def evidence_strength(kept: DataFrame, citations: DataFrame, flags: DataFrame) -> DataFrame:
    """``(query_id, evidence_strength)``.

    ``flags(query_id, weak)`` marks partial answers, validation errors and dropped claims: those are low.  Otherwise high
    when every recommendation cites at least two distinct (chunk, page) places, else medium.
    """
    recs = kept.filter(F.col("kind") == "recommendation").select(
        "query_id", "claim_id", F.explode("citation_ids").alias("citation_id"))
    places = recs.join(citations.select("query_id", "citation_id", "chunk_id", "page"), ["query_id", "citation_id"]).groupBy(
        "query_id", "claim_id").agg(F.size(F.collect_set(F.struct("chunk_id", "page"))).alias("places"))
    per = places.groupBy("query_id").agg(F.min("places").alias("least"))
    return per.join(flags, "query_id", "left").select(
        "query_id", F.when(F.coalesce("weak", F.lit(False)), "low").when(F.col("least") >= 2, "high").otherwise(
            "medium").alias("evidence_strength"))


def local_quote_verdicts(claims: DataFrame, citations: DataFrame) -> DataFrame:
    """Verdicts without a verifier: only a recommendation quoting its one excerpt word for word, with a positive
    rerank score, passes."""
    one = claims.withColumn("citation_id", F.element_at("citation_ids", 1))
    j = one.join(citations.select("query_id", "citation_id", F.col("excerpt").alias("__x"), F.col("rerank_score").alias("__s")),
                 ["query_id", "citation_id"], "left")
    n = len(K.RESCUE_PREFIX)
    quote = T.fold_punctuation(F.expr(f"substring(claim_text, {n + 1})"))
    passed = (
        (F.col("kind") == "recommendation") & (F.size("citation_ids") == 1)
        & F.startswith("claim_text", F.lit(K.RESCUE_PREFIX)) & (quote == T.fold_punctuation("__x")) & (F.col("__s") > 0))
    passed = F.coalesce(passed, F.lit(False))
    return j.select("query_id", F.lit(0).alias("row_no"), "claim_id", passed.alias("supported"), passed.alias("relevant"),
                    passed.alias("safe"), F.lit(False).alias("overconfident"), passed.alias("passed"))


# --- refusals and disposition -------------------------------------------------------------------------
def failure_class(error_type, status_code) -> Column:
    """``rate_limited`` or ``unavailable`` for a failed call, null without a failure."""
    limited = F.coalesce(T.col(error_type).isin(*K.RATE_LIMIT_TYPES), F.lit(False)) | F.coalesce(
        T.col(status_code) == 429, F.lit(False))
    return F.when(T.col(error_type).isNotNull() | T.col(status_code).isNotNull(),
                  F.when(limited, "rate_limited").otherwise("unavailable"))


def refusal_reply(reason, role, mode) -> Column:
    """What a refused question is told: by reason, for a clinician or a patient, and for a patient by mode."""
    reply = {(audience, kind): F.lit(text) for audience, kind, text in K.REPLIES}
    doctor, triage = T.col(role) == "doctor", T.col(mode) == "triage"
    reason = T.col(reason)
    patient = F.when(triage, reply["patient", "personal_triage"]).otherwise(reply["patient", "personal_general"])
    gap = F.when(triage, reply["patient", "insufficient_triage"]).otherwise(reply["patient", "insufficient_general"])
    return (
        F.when(reason == "non_medical_question", reply["doctor", "non_medical_question"])
        .when(reason.isin(*K.PERSONAL_REASONS), F.when(doctor, reply["doctor", "personal"]).otherwise(patient))
        .when(F.endswith(reason, F.lit("_rate_limited")), reply["any", "rate_limited"])
        .when(reason.isin(*K.DEPENDENCY_FAILURES), reply["any", "unavailable"])
        .otherwise(F.when(doctor, reply["doctor", "insufficient"]).otherwise(gap)))


def refusals(refused: DataFrame, hits: DataFrame) -> DataFrame:
    """Ungrounded answer rows for ``refused(query_id, reason, missing_evidence)`` with checks, checked sources and the safety
    notice; with ``role`` and ``mode`` in ``refused`` also the ``recommendation``, the text that the question is told."""
    src = checked_sources(hits)
    told = [refusal_reply("reason", "role", "mode").alias("recommendation")] if {"role", "mode"} <= set(refused.columns) else []
    no = F.lit(False)
    missing = F.coalesce(F.nullif(F.col("missing_evidence"), F.lit("")), F.lit(K.DEFAULT_MISSING))
    return refused.join(src, "query_id", "left").select(
        "query_id", *told, F.lit(K.SAFETY_NOTICE).alias("safety_notice"), no.alias("grounded"), "reason", F.lit("insufficient").alias("evidence_strength"),
        missing.alias("missing_evidence"), F.coalesce("sources", F.array().cast("array<string>")).alias("evidence_checked"),
        F.struct(
            F.col("sources").isNotNull().alias("retrieval_passed"), no.alias("exact_excerpts_passed"),
            F.lit(0.0).alias("citation_coverage"), no.alias("evidence_match_passed"),
            (~F.col("reason").isin(*K.PERSONAL_REASONS)).alias("safety_passed"), no.alias("verifier_passed")).alias("checks"))


def rescue_answers(rescue: DataFrame) -> DataFrame:
    """Rescue quotes in the shape of parsed answers."""
    ref = F.array(F.struct("source_id", "excerpt"))
    claim = F.array(F.struct(F.col("claim_text").alias("text"), ref.alias("evidence")))
    return rescue.select(
        "query_id", F.lit(True).alias("sufficient"), F.lit(False).alias("partial"), F.lit("").alias("missing_evidence"),
        claim.cast(f"array<{_CLAIM}>").alias("recommendation_claims"),
        F.array().cast(f"array<{_CLAIM}>").alias("supporting_claims"))


def answer_disposition(queries: DataFrame, hits: DataFrame, answers: DataFrame, verdicts: DataFrame,
                       verifier_enabled: bool = True) -> DataFrame:
    """Final ``(query_id, grounded, reason, evidence_strength, rescued)`` of every question.

    ``queries(query_id, question, role, generation_failure, verification_failure)`` with failure classes (null when the
    call worked) and an optional boolean ``retrieval_failed``, parsed ``answers`` and parsed ``verdicts``.  Stages are left-joined tables; one ordered ``when``
    decides: off-topic, personal, retrieval down, no sources, generation failure, insufficient, validation (a clinician gets the
    quoted rescue), verifier off or failed, verdicts, grounded.
    """
    doctor = F.col("role") == "doctor"
    # Each stage table is written once and read by the later stages.
    answers, verdicts = cut(answers), cut(verdicts)
    refs = cut(validate_refs(answer_claims(answers.filter("sufficient")), hits))
    claims = cut(surviving_claims(refs, cut(number_citations(refs))))
    errors = validation_errors(refs)
    own = rendered(claims).select("query_id", F.lit(True).alias("own"))
    rescue = cut(extractive_rescue(hits, queries))
    state = (
        queries.select("query_id", "question", "role", "generation_failure", "verification_failure", (
            F.coalesce("retrieval_failed", F.lit(False)) if "retrieval_failed" in queries.columns else F.lit(False)).alias("retrieval_failed"))
        .join(hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_hits")), "query_id", "left")
        .join(answers.select("query_id", "sufficient", "partial"), "query_id", "left")
        .join(own, "query_id", "left")
        .join(rescue.select("query_id", F.lit(True).alias("quotable"),
                            F.coalesce(F.col("rerank_score") > 0, F.lit(False)).alias("local_ok")), "query_id", "left"))
    no_own = F.col("own").isNull() | F.col("generation_failure").isNotNull()
    uses_rescue = doctor & no_own & F.col("quotable").isNotNull()
    state = cut(state.withColumn("uses_rescue", F.coalesce(uses_rescue, F.lit(False))))
    # The claims put before the verifier: the answer's own, or the quote where a clinician's answer had none.
    quoted = rescue.join(state.filter("uses_rescue").select("query_id"), "query_id", "left_semi")
    refs_q = cut(validate_refs(answer_claims(rescue_answers(quoted)), hits))
    numbered_q = cut(number_citations(refs_q))
    before = cut(claims.join(state.filter("uses_rescue").select("query_id"), "query_id", "left_anti").unionByName(
        surviving_claims(refs_q, numbered_q)))
    used_refs = refs.join(state.filter("uses_rescue").select("query_id"), "query_id", "left_anti").unionByName(refs_q)
    cites = citation_table(number_citations(used_refs), hits)
    outcome, kept = apply_verdicts(before, verdicts.join(before.select("query_id").distinct(), "query_id", "left_semi"))
    outcome, kept = cut(outcome), cut(kept)
    flags = (
        state.select("query_id", "partial", "uses_rescue").join(errors, "query_id", "left")
        .join(outcome.select("query_id", "dropped"), "query_id", "left")
        .select("query_id", (
            (F.coalesce("partial", F.lit(False)) & ~F.col("uses_rescue"))
            | (F.col("errors").isNotNull() & ~F.col("uses_rescue"))
            | (F.coalesce(F.size("dropped"), F.lit(0)) > 0)).alias("weak")))
    strength = evidence_strength(kept, cites, flags).withColumnRenamed("evidence_strength", "checked_strength")
    s = state.join(outcome, "query_id", "left").join(strength, "query_id", "left")
    malformed = F.coalesce("malformed", F.lit(True))
    rejected = F.coalesce("rejected_recommendation", F.lit(False))
    local = F.coalesce("local_ok", F.lit(False))
    off, personal = T.clearly_off_topic("question"), T.personal_request("question")
    gen, ver = F.col("generation_failure"), F.col("verification_failure")
    sufficient = F.coalesce("sufficient", F.lit(False))
    has_package = F.col("uses_rescue") | (F.col("own").isNotNull() & gen.isNull())
    reason = (
        F.when(doctor & off, "non_medical_question")
        .when(personal.isNotNull(), personal)
        .when(F.col("retrieval_failed"), "retrieval_unavailable")
        .when(F.col("n_hits").isNull(), "no_relevant_sources")
        .when(gen.isNotNull() & ~doctor, F.concat(F.lit("generation_"), gen))
        .when(gen.isNull() & ~sufficient, "model_reported_insufficient_context")
        .when(~has_package, "evidence_validation_failed"))
    if not verifier_enabled:
        reason = reason.otherwise(F.lit("evidence_verifier_disabled"))
    else:
        reason = (
            reason.when(ver.isNotNull() & ~F.col("uses_rescue"), F.concat(F.lit("evidence_verification_"), ver))
            .when(ver.isNotNull() & ~local, "evidence_verification_failed")
            .when(ver.isNotNull(), F.lit(None))
            .when(doctor & rejected & ~local, "evidence_verification_failed")
            .when(doctor & rejected, F.lit(None))
            .when(malformed | ~F.coalesce("has_recommendation", F.lit(False)), "evidence_verification_failed"))
    out = s.withColumn("reason", reason)
    grounded = F.col("reason").isNull()
    by_quote = ver.isNotNull() | (doctor & rejected)
    quote_strength = F.when(F.coalesce("partial", F.lit(False)) & ~F.col("uses_rescue"), "low").otherwise("medium")
    return out.select(
        "query_id", grounded.alias("grounded"), "reason",
        F.when(~grounded, "insufficient").when(by_quote, quote_strength).otherwise(F.col("checked_strength")).alias(
            "evidence_strength"),
        (grounded & (F.col("uses_rescue") | by_quote)).alias("rescued"))
