"""Family G: answer and citation audit.  Four consecutive documents are one question's hits; answers and verdicts are
JSON texts that Spark writes from them, with every kind of defect at fixed question numbers."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import functions as F

from passagework import constants as K
from passagework.functions import text as T
from passagework.operators import audit as O
from passagework.plans import sqltext as Q
from passagework.plans.hits import HITS, hits
from passagework.plans.registry import query
from passagework.sources.lineage import cut
from passagework.sources.tables import table

# --- the same answers as SQL relations ----------------------------------------------------------------
_QUESTIONS = """qs as (select query_id, case when query_id % 2 = 0 then 'doctor' else 'patient' end as role,
  case when query_id % 19 = 3 then 'best pizza place' when query_id % 23 = 5 then 'do I have asthma'
    when query_id % 3 = 0 then 'which further care is next: ' || text
    else 'which care: ' || text end as question,
  case when query_id % 31 = 2 then 'rate_limited' when query_id % 31 = 3 then 'unavailable' end as generation_failure,
  case when query_id % 37 = 2 then 'rate_limited' when query_id % 37 in (3, 4) then 'unavailable' end as verification_failure
  from hits where rank = 4)"""

_ANSWERS = f"""pv as (select query_id, max(case when rank = 1 then {Q.squeeze('text')} end) as s1,
    max(case when rank = 2 then {Q.squeeze('text')} end) as s2, max(case when rank = 3 then {Q.squeeze('text')} end) as s3,
    max(case when rank = 4 then {Q.squeeze('text')} end) as s4
  from hits group by 1),
va as (select *, query_id % 11 <> 0 as valid, query_id % 7 <> 0 and query_id % 11 <> 0 as sufficient,
    query_id % 6 = 0 and query_id % 11 <> 0 as partial from pv),
cl as (select query_id, 'recommendation' as kind, 0 as kind_no, 1 as claim_no, 'Offer the care plan ' || query_id as claim_text
    from va where valid
  union all select query_id, 'recommendation', 0, 2, 'Also consider' from va where valid and query_id % 4 = 0
  union all select query_id, 'supporting', 1, 1, 'Background' from va where valid),
r0 as (select query_id, 0 as kind_no, 1 as claim_no, 0 as o, 1 as source_id,
      case when query_id % 12 = 5 then 'made up words' else substr(s1, length(s1) // 2 + 1, 80) end as excerpt from va where valid
  union all select query_id, 0, 1, 1, 2, substr(s2, greatest(length(s2) - 59, 1), 60) from va where valid and query_id % 3 = 0
  union all select query_id, 0, 2, 0, 1, 'no such words in any source' from va where valid and query_id % 4 = 0
  union all select query_id, 0, 2, 1, 4, substr(s4, length(s4) // 2 + 1, 50) from va where valid and query_id % 8 = 0
  union all select query_id, 1, 1, 0, 9, 'whatever here' from va where valid and query_id % 5 = 0
  union all select query_id, 1, 1, 0, 3, substr(s3, length(s3) // 3 + 1, 40) from va where valid and query_id % 5 > 1
  union all select query_id, 1, 1, 1, 1, substr(s1, 1, 80) from va where valid and query_id % 5 > 1),
rf as (select query_id, kind_no, claim_no, source_id, {Q.fold('excerpt')} as excerpt,
    row_number() over (partition by query_id, kind_no, claim_no order by o) - 1 as ref_no
  from r0 where {Q.strip('excerpt')} <> '')"""

_REFS = f"""vc as (select cl.*, cl.kind || '-' || cl.claim_no as claim_id, case when exists (select 1 from rf where
      rf.query_id = cl.query_id and rf.kind_no = cl.kind_no and rf.claim_no = cl.claim_no) then 'ok' else 'missing_evidence' end
    as claim_status from cl join va using (query_id) where sufficient),
vr as (select c.*, r.ref_no, r.source_id, r.excerpt, case when c.claim_status <> 'ok' then null
    when h.text is null then 'invalid_source_id'
    when length(r.excerpt) < 8 or length(r.excerpt) > 600 or not contains({Q.fold('h.text')}, r.excerpt)
      then 'invented_or_invalid_excerpt' else 'ok' end as ref_status
  from vc c left join rf r on r.query_id = c.query_id and r.kind_no = c.kind_no and r.claim_no = c.claim_no
    left join hits h on h.query_id = c.query_id and h.rank = r.source_id)"""

_CITES = """nc as (select query_id, source_id, excerpt, row_number() over (partition by query_id
      order by min(kind_no * 1000000 + claim_no * 1000 + ref_no)) as citation_no from vr where ref_status = 'ok'
  group by query_id, source_id, excerpt),
cu as (select v.query_id, v.kind, v.kind_no, v.claim_no, v.claim_id, v.claim_text, n.citation_no, min(v.ref_no) as m
  from vr v join nc n on n.query_id = v.query_id and n.source_id = v.source_id and n.excerpt = v.excerpt
  where v.ref_status = 'ok' group by all),
sc as (select query_id, kind, kind_no, claim_no, claim_id, claim_text, string_agg('C' || citation_no, ',' order by m) as citation_ids,
    string_agg('[C' || citation_no || ']', ' ' order by m) as marks from cu group by all)"""

_ERRORS = """pc as (select query_id, kind_no, claim_no, claim_id, claim_status, coalesce(bool_or(ref_status = 'ok'), false) as alive,
    string_agg(case when claim_status <> 'ok' then claim_id || ':' || claim_status
      when ref_status <> 'ok' then claim_id || ':' || ref_status || ':' || source_id end, '; ' order by ref_no) as codes
  from vr group by all),
pe as (select *, concat_ws('; ', codes, case when claim_status = 'ok' and not alive then claim_id || ':no_valid_citations' end)
    as line from pc),
pq as (select query_id, bool_or(alive and kind_no = 0) as has,
    string_agg(nullif(line, ''), '; ' order by kind_no, claim_no) as lines from pe group by 1),
er as (select query_id, concat_ws('; ', lines, case when not has then 'missing_recommendation' end) as errors from pq),
ee as (select * from er where errors <> '')"""

_PACKAGE = f"""rd as (select query_id, string_agg(claim_text || ' ' || marks, chr(10) || chr(10) order by claim_no) as recommendation
  from sc where kind = 'recommendation' group by 1),
pk as (select v.query_id, r.recommendation, v.partial, coalesce(e.errors, '') as errors,
    case when r.recommendation is not null then case when v.partial or e.errors is not null then 'low' else 'medium' end end
      as evidence_strength,
    case when r.recommendation is not null then trim(case when v.partial then 'gap' else '' end
      || case when e.errors is not null then ' {K.DROPPED_TEXT_NOTE}' else '' end) end as missing_evidence
  from va v left join rd r using (query_id) left join ee e using (query_id) where v.sufficient)"""

_ALL = f"{HITS}, {_ANSWERS}, {_REFS}, {_CITES}"

_VERDICTS = """vd as (
  select query_id, 'recommendation-1' as claim_id, query_id % 10 <> 3 as passed from va
  union all select query_id, 'recommendation-1', query_id % 10 <> 3 from va where query_id % 17 = 4
  union all select query_id, claim_id, not (kind = 'supporting' and query_id % 9 = 2) from sc
    where claim_id <> 'recommendation-1' and not (kind = 'supporting' and query_id % 13 = 5)
  union all select query_id, 'extra-1', true from va where query_id % 29 = 7)"""


def _outcome(claims: str) -> str:
    return f"""vg as (select query_id, claim_id, count(*) as n, bool_and(passed) as ok from vd group by 1, 2),
bo as (select coalesce(c.query_id, v.query_id) as query_id, coalesce(c.claim_id, v.claim_id) as claim_id, c.kind,
    c.claim_no, c.claim_text, c.marks, c.citation_ids, c.query_id is not null as known, v.n, v.ok
  from {claims} c full join vg v on v.query_id = c.query_id and v.claim_id = c.claim_id),
oc as (select query_id, bool_or(not known or coalesce(n, 0) > 1 or (coalesce(kind = 'recommendation', false) and n is null))
      as malformed,
    coalesce(string_agg(case when known and not coalesce(ok, false) then claim_id end, ',' order by claim_id), '') as dropped,
    bool_or(known and kind = 'recommendation' and coalesce(ok, false)) as has_rec,
    bool_or(starts_with(claim_id, 'recommendation-') and n is not null and not coalesce(ok, false)) as rejected
  from bo group by 1),
kp as (select bo.* from bo join oc using (query_id) where known and coalesce(ok, false) and not malformed and has_rec)"""


_RESCUE = f"""sn as (select query_id, rank, rerank_score, text,
    string_split(regexp_replace({Q.strip('text')}, '([.!?]){Q.WS}+', '\\1' || chr(1), 'g'), chr(1)) as l from hits),
se as (select query_id, rank, rerank_score, {Q.strip('s')} as s, pos from (
    select query_id, rank, rerank_score, unnest(l) as s, generate_subscripts(l, 1) - 1 as pos from sn)),
el as (select * from se where length(s) between 24 and 600),
wn as (select query_id, rank, rerank_score, regexp_replace(substr({Q.fold('text')}, 1, 600), ' [^ ]*$', '') as s, 0 as pos
  from hits h where not exists (select 1 from el where el.query_id = h.query_id and el.rank = h.rank)),
cd as (select * from el union all select * from wn where length(s) >= 24),
qw as (select distinct query_id, lower(u.w) as w from qs, unnest(regexp_extract_all(question, '[A-Za-z0-9]{{3,}}')) u(w)
  where lower(u.w) not in ({', '.join(Q.lit(w) for w in K.STOP_WORDS)})),
ql as (select query_id, list(w) as words from qw group by 1),
sr as (select cd.*, coalesce(nullif(rerank_score, 0), -1000)
      - case when not regexp_matches(question, {Q.lit(K.ESCALATION)}) and regexp_matches(s, {Q.lit(K.FURTHER_MEDICINES)}) then 2 else 0 end as score,
    len(list_intersect(coalesce(words, []), list_distinct(regexp_extract_all(lower(s), '[A-Za-z0-9]{{3,}}')))) as overlap
  from cd join qs using (query_id) left join ql using (query_id)),
rs as (select query_id, rank as source_id, s as excerpt, 'The verified guideline states: ' || {Q.fold('s')} as claim_text, rerank_score
  from (select *, row_number() over (partition by query_id order by score desc, overlap desc, rank, pos) as k from sr) where k = 1)"""


# --- the same tables in Spark -------------------------------------------------------------------------
def questions(spark, sf):
    n = F.col("query_id")
    h = hits(spark, sf).filter(F.col("rank") == 4)
    return h.select(
        "query_id", F.when(n % 2 == 0, "doctor").otherwise("patient").alias("role"), F.lit("general").alias("mode"),
        F.when(n % 19 == 3, F.lit("best pizza place")).when(n % 23 == 5, F.lit("do I have asthma"))
        .when(n % 3 == 0, F.concat(F.lit("which further care is next: "), F.col("text")))
        .otherwise(F.concat(F.lit("which care: "), F.col("text"))).alias("question"),
        F.when(n % 31 == 2, "rate_limited").when(n % 31 == 3, "unavailable").alias("generation_failure"),
        F.when(n % 37 == 2, "rate_limited").when((n % 37).isin(3, 4), "unavailable").alias("verification_failure"))


def raw_answers(spark, sf):
    h = hits(spark, sf)
    n = F.col("query_id")

    def squeezed(r):
        return F.max(F.when(F.col("rank") == r, T.squeeze("text"))).alias(f"s{r}")

    def deep(c, part, n):
        """``n`` characters from the given part of the passage on; without a part its last ones."""
        start = F.floor(F.length(c) / part) + 1 if part else F.greatest(F.length(c) - (n - 1), F.lit(1))
        return F.substring(F.col(c), start.cast("int"), F.lit(n))

    p = h.groupBy("query_id").agg(squeezed(1), squeezed(2), squeezed(3), squeezed(4))

    def ref(cond, source, text):
        return F.when(cond, F.struct(F.lit(source).alias("source_id"), text.alias("excerpt")))

    def claim(cond, text, *refs):
        return F.when(cond, F.struct(text.alias("text"), F.array_compact(F.array(*refs)).alias("evidence")))

    yes = F.lit(True)
    first = F.when(n % 12 == 5, F.lit("made up words")).otherwise(deep("s1", 2, 80))
    recs = F.array_compact(F.array(
        claim(yes, F.concat(F.lit(" Offer  the care plan "), n.cast("string")), ref(yes, 1, first),
              ref(n % 3 == 0, 2, deep("s2", None, 60))),
        claim(n % 4 == 0, F.lit("Also\nconsider"), ref(yes, 1, F.lit("no such words in any source")),
              ref(n % 8 == 0, 4, deep("s4", 2, 50)))))
    sups = F.array(claim(
        yes, F.lit("Background"), ref(n % 5 == 0, 9, F.lit("whatever here")), ref(n % 5 > 1, 3, deep("s3", 3, 40)),
        ref(n % 5 > 1, 1, F.substring("s1", 1, 80))))
    body = F.to_json(F.struct(
        (n % 7 != 0).alias("sufficient"), (n % 6 == 0).alias("partial"), F.lit(" gap ").alias("missing_evidence"),
        recs.alias("recommendation_claims"), sups.alias("supporting_claims")))
    return p.select("query_id", F.when(n % 11 == 0, F.lit("not json at all")).otherwise(
        F.concat(F.lit("Here it is: "), body, F.lit(" done"))).alias("raw"))


def answers(spark, sf):
    return O.parse_answers(raw_answers(spark, sf))


class Stages:
    """Stage tables of one run, each written once when first asked for."""

    def __init__(self, spark, sf):
        self.spark, self.sf = spark, sf

    @cached_property
    def answers(self):
        return cut(answers(self.spark, self.sf))

    @cached_property
    def hits(self):
        return hits(self.spark, self.sf)

    @cached_property
    def refs(self):
        return cut(O.validate_refs(O.answer_claims(self.answers.filter("sufficient")), self.hits))

    @cached_property
    def numbered(self):
        return cut(O.number_citations(self.refs))

    @cached_property
    def claims(self):
        return cut(O.surviving_claims(self.refs, self.numbered))

    @property
    def citations(self):
        return O.citation_table(self.numbered, self.hits)

    @property
    def raw_verdicts(self):
        return raw_verdicts(self.spark, self.sf, self.claims)

    @cached_property
    def verdicts(self):
        return cut(O.parse_verdicts(self.raw_verdicts))

    @cached_property
    def verified(self):
        outcome, kept = O.apply_verdicts(self.claims, self.verdicts)
        return cut(outcome), cut(kept)


def raw_verdicts(spark, sf, claims):
    n = F.col("query_id")
    base = hits(spark, sf).filter(F.col("rank") == 1).select("query_id")
    yes = F.lit(True)

    def rows(df, claim_id, supported, safe):
        return df.select("query_id", F.struct(claim_id.alias("claim_id"), supported.alias("supported"), yes.alias("relevant"),
                                              safe.alias("safe"), F.lit(False).alias("overconfident"),
                                              F.lit(" why ").alias("reason")).alias("r"))

    first = F.lit("recommendation-1")
    others = claims.filter((F.col("claim_id") != first) & ~((F.col("kind") == "supporting") & (n % 13 == 5)))
    both = (
        rows(base, first, n % 10 != 3, yes)
        .unionAll(rows(base.filter(n % 17 == 4), first, n % 10 != 3, yes))
        .unionAll(rows(others, F.col("claim_id"), yes, ~((F.col("kind") == "supporting") & (n % 9 == 2))))
        .unionAll(rows(base.filter(n % 29 == 7), F.lit("extra-1"), yes, yes)))
    return both.groupBy("query_id").agg(F.to_json(F.struct(F.collect_list("r").alias("results"))).alias("raw"))


@query("g1_assemble_prompt", f"""{HITS}, {_QUESTIONS},
b as (select query_id, string_agg('BEGIN_UNTRUSTED_SOURCE_' || rank || chr(10) || '[' || rank || '] ' || title || ' — page '
    || page_number || ', ' || section_title || chr(10) || text || chr(10) || 'END_UNTRUSTED_SOURCE_' || rank,
    chr(10) || chr(10) order by rank) as t, count(*) as n from hits group by 1)
select query_id, md5('SOURCES:' || chr(10) || t || chr(10) || case when query_id % 3 = 0 then chr(10)
    || 'BEGIN_UNTRUSTED_PATIENT_CONTEXT' || chr(10) || 'age 50' || chr(10) || 'END_UNTRUSTED_PATIENT_CONTEXT' || chr(10) else '' end
  || chr(10) || 'Valid source_id integers: 1 to ' || n || '.' || chr(10) || chr(10) || 'BEGIN_PATIENT_QUESTION' || chr(10)
  || question || chr(10) || 'END_PATIENT_QUESTION') as prompt_md5 from b join qs using (query_id)""")
def assemble_prompt(spark, sf):
    q = questions(spark, sf).withColumn("context", F.when(F.col("query_id") % 3 == 0, F.lit("age 50")))
    return O.assemble_prompt(hits(spark, sf), q).select("query_id", F.md5("prompt").alias("prompt_md5"))


@query("g2_parse_answers", f"""{HITS}, {_ANSWERS}
select v.query_id, v.sufficient, v.partial, case when valid then 'gap' else '' end as missing_evidence,
  (select count(*) from cl where cl.query_id = v.query_id and kind_no = 0) as recommendations,
  (select count(*) from cl where cl.query_id = v.query_id and kind_no = 1) as supporting,
  (select count(*) from rf where rf.query_id = v.query_id) as refs from va v""")
def parse_answers(spark, sf):
    a = answers(spark, sf)
    every = F.concat("recommendation_claims", "supporting_claims")
    return a.select(
        "query_id", "sufficient", "partial", "missing_evidence", F.size("recommendation_claims").alias("recommendations"),
        F.size("supporting_claims").alias("supporting"),
        F.aggregate(every, F.lit(0), lambda acc, c: acc + F.size(c.evidence)).alias("refs"))


@query("g3_extractive_answer", f"""{HITS}, t as (select query_id, {Q.squeeze('text')} as t from hits where rank = 1)
select query_id, 'The clinic''s uploaded guidance states: ' || e as claim_text, 1 as source_id, e as excerpt from (
  select query_id, case when length(t) > 420 then regexp_replace(substr(t, 1, 420), ' [^ ]*$', '') else t end as e from t)""")
def extractive_answer(spark, sf):
    return O.extractive_answer(hits(spark, sf))


@query("g4_extractive_rescue", f"""{HITS}, {_QUESTIONS}, {_RESCUE} select query_id, source_id, excerpt, claim_text from rs""")
def extractive_rescue(spark, sf):
    return O.extractive_rescue(hits(spark, sf), questions(spark, sf)).select(
        "query_id", "source_id", "excerpt", "claim_text")


@query("g5_validate_refs", f"""{HITS}, {_ANSWERS}, {_REFS}
select query_id, claim_id, claim_text, claim_status, ref_no, source_id, excerpt, ref_status from vr""")
def validate_refs(spark, sf):
    return Stages(spark, sf).refs.select(
        "query_id", "claim_id", "claim_text", "claim_status", "ref_no", "source_id", "excerpt", "ref_status")


@query("g6_number_citations", f"""{_ALL}
select n.query_id, 'C' || citation_no as citation_id, n.source_id, n.excerpt, case when h.title = '' then 'Unknown document' else
  h.title end as document, h.page_number as page, h.chunk_id,
  case when starts_with(h.source_url, 'http') then h.source_url end as source_url
from nc n join hits h on h.query_id = n.query_id and h.rank = n.source_id""")
def number_citations(spark, sf):
    return Stages(spark, sf).citations.select("query_id", "citation_id", "source_id", "excerpt", "document", "page", "chunk_id",
                                       "source_url")


@query("g6_claim_citations", f"{_ALL} select query_id, claim_id, citation_ids from sc")
def claim_citations(spark, sf):
    return Stages(spark, sf).claims.select("query_id", "claim_id", F.array_join("citation_ids", ",").alias("citation_ids"))


@query("g7_validation_errors", f"{_ALL}, {_ERRORS} select query_id, errors from ee")
def validation_errors(spark, sf):
    return O.validation_errors(Stages(spark, sf).refs).select("query_id", F.array_join("errors", "; ").alias("errors"))


@query("g8_evidence_package", f"""{_ALL}, {_ERRORS}, {_PACKAGE}
select query_id, recommendation, partial, errors, evidence_strength, missing_evidence from pk""")
def evidence_package(spark, sf):
    s = Stages(spark, sf)
    package = O.evidence_package(s.answers, s.claims, O.validation_errors(s.refs))
    return package.withColumn("errors", F.array_join("errors", "; "))


@query("g8_full_package", f"""{_ALL}, {_ERRORS}, {_PACKAGE}, {_VERDICTS}, {_outcome('sc')},
lb as (select query_id, case when title = '' then 'Verified clinic document' else title end
    || case when page_number <> 0 then ' (p. ' || page_number || ')' else '' end as label, min(rank) as r from hits group by 1, 2),
ck as (select query_id, string_agg(label, '; ' order by r) as evidence_checked from lb group by 1),
cs as (select query_id, string_agg(claim_id || '=' || claim_text || '=' || citation_ids, '; ' order by claim_no) filter (kind = 'recommendation') as recs,
    coalesce(string_agg(claim_id || '=' || claim_text || '=' || citation_ids, '; ' order by claim_no) filter (kind = 'supporting'), '') as sups
  from sc group by 1)
select pk.query_id, pk.recommendation, cs.recs as recommendation_claims, cs.sups as supporting_evidence, pk.evidence_strength,
  {Q.lit(K.SAFETY_NOTICE)} as safety_notice, ck.evidence_checked, pk.missing_evidence, true as retrieval_passed, true as exact_excerpts_passed,
  1.0::double as citation_coverage, has_rec and not malformed as evidence_match_passed, has_rec and not malformed as safety_passed,
  has_rec and not malformed as verifier_passed
from pk join cs using (query_id) join ck using (query_id) join oc using (query_id) where pk.recommendation is not null""")
def full_package(spark, sf):
    """Packages with a recommendation, as they stand after the audit of their claims."""
    s = Stages(spark, sf)
    package = O.evidence_package(s.answers, s.claims, O.validation_errors(s.refs))
    one = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws("=", x.claim_id, x.claim, F.array_join(x.citation_ids, ","))), "; ")
    return O.full_package(package, s.claims, s.hits, s.verified[0]).filter("recommendation is not null").select(
        "query_id", "recommendation", one("recommendation_claims").alias("recommendation_claims"), one("supporting_evidence").alias(
            "supporting_evidence"), "evidence_strength", "safety_notice", F.array_join("evidence_checked", "; ").alias("evidence_checked"),
        "missing_evidence", "checks.*")


@query("g9_parse_verdicts", f"""{_ALL}, {_VERDICTS}
select query_id, claim_id, passed, 'why' as reason, count(*) as n from vd group by all""")
def parse_verdicts(spark, sf):
    return Stages(spark, sf).verdicts.groupBy("query_id", "claim_id", "passed", "reason").agg(F.count(F.lit(1)).alias("n"))


@query("g10_verification_complete", f"""{_ALL}, {_VERDICTS}, {_outcome('sc')}
select query_id, bool_and(known and coalesce(n, 0) = 1) as complete,
  bool_and(known and coalesce(n, 0) = 1) and bool_and(coalesce(ok, true)) as passed from bo group by 1""")
def verification_complete(spark, sf):
    s = Stages(spark, sf)
    return O.verification_complete(s.verdicts, s.claims)


@query("g11_apply_verdicts", f"""{_ALL}, {_VERDICTS}, {_outcome('sc')}
select query_id, malformed, dropped, coalesce(has_rec, false) as has_recommendation from oc""")
def apply_verdicts(spark, sf):
    outcome, _ = Stages(spark, sf).verified
    return outcome.select("query_id", "malformed", F.array_join("dropped", ",").alias("dropped"), "has_recommendation")


@query("g11_kept_claims", f"""{_ALL}, {_VERDICTS}, {_outcome('sc')}
select query_id, string_agg(claim_text || ' ' || marks, chr(10) || chr(10) order by claim_no)
  filter (kind = 'recommendation') as recommendation from kp group by 1""")
def kept_claims(spark, sf):
    return O.rendered(Stages(spark, sf).verified[1])


@query("g11_verified_answer", f"""{_ALL}, {_ERRORS}, {_PACKAGE}, {_VERDICTS}, {_outcome('sc')}
select k.query_id, string_agg(claim_text || ' ' || marks, chr(10) || chr(10) order by claim_no) filter (kind = 'recommendation') as recommendation,
  coalesce(string_agg(claim_id || '=' || claim_text || '=' || citation_ids, '; ' order by claim_no) filter (kind = 'supporting'), '') as supporting,
  trim(coalesce(any_value(pk.missing_evidence), '') || case when any_value(oc.dropped) <> '' then {Q.lit(' ' + K.DROPPED_VERDICT_NOTE)} else '' end)
    as missing_evidence
from kp k join pk using (query_id) join oc using (query_id) group by 1""")
def verified_answer(spark, sf):
    s = Stages(spark, sf)
    package = O.evidence_package(s.answers, s.claims, O.validation_errors(s.refs))
    shown = O.verified_answer(package, *s.verified)
    one = F.transform("supporting_evidence", lambda c: F.concat_ws("=", c.claim_id, c.claim, F.array_join(c.citation_ids, ",")))
    return shown.select("query_id", "recommendation", F.array_join(one, "; ").alias("supporting"), "missing_evidence")


@query("g11_used_citations", f"""{_ALL}, {_VERDICTS}, {_outcome('sc')}
select distinct query_id, unnest(string_split(citation_ids, ',')) as citation_id from kp""")
def used_citations(spark, sf):
    s = Stages(spark, sf)
    return O.used_citations(s.citations, s.verified[1]).select("query_id", "citation_id")


_STRENGTH = """pl as (select k.query_id, k.claim_id, count(distinct h.chunk_id || ':' || h.page_number) as places
  from kp k join cu on cu.query_id = k.query_id and cu.claim_id = k.claim_id
    join nc n on n.query_id = cu.query_id and n.citation_no = cu.citation_no
    join hits h on h.query_id = n.query_id and h.rank = n.source_id where k.kind = 'recommendation' group by 1, 2),
st as (select p.query_id, case when bool_or(v.partial or e.errors is not null or o.dropped <> '') then 'low'
    when min(places) >= 2 then 'high' else 'medium' end as evidence_strength
  from pl p join va v on v.query_id = p.query_id join oc o on o.query_id = p.query_id
    left join ee e on e.query_id = p.query_id group by 1)"""


@query("g12_evidence_strength", f"""{_ALL}, {_ERRORS}, {_VERDICTS}, {_outcome('sc')}, {_STRENGTH}
select query_id, evidence_strength from st""")
def evidence_strength(spark, sf):
    s = Stages(spark, sf)
    outcome, kept = s.verified
    errors = O.validation_errors(s.refs)
    flags = (
        s.answers.select("query_id", "partial").join(errors, "query_id", "left")
        .join(outcome.select("query_id", "dropped"), "query_id", "left")
        .select("query_id", (F.col("partial") | F.col("errors").isNotNull()
                             | (F.coalesce(F.size("dropped"), F.lit(0)) > 0)).alias("weak")))
    return O.evidence_strength(kept, s.citations, flags)


@query("g13_local_quote_verdicts", f"""{HITS}, {_QUESTIONS}, {_RESCUE}
select query_id, 'recommendation-1' as claim_id, coalesce(rerank_score > 0, false) as passed from rs""")
def local_quote_verdicts(spark, sf):
    h = hits(spark, sf)
    # Quotes are checked against the texts once; numbers, claims and verdicts read what came of it.
    r = cut(O.validate_refs(O.answer_claims(O.rescue_answers(O.extractive_rescue(h, questions(spark, sf)))), h))
    numbered = cut(O.number_citations(r))
    return O.local_quote_verdicts(O.surviving_claims(r, numbered), O.citation_table(numbered, h)).select(
        "query_id", "claim_id", "passed")


@query("g14_refusals", f"""{HITS}, {_QUESTIONS},
l as (select query_id, rank, case when title = '' then 'Verified clinic document' else title end
    || case when page_number <> 0 then ' (p. ' || page_number || ')' else '' end as label from hits where query_id % 4 <> 1),
f as (select query_id, label, min(rank) as r from l group by 1, 2),
s as (select query_id, string_agg(label, '; ' order by r) as sources from f group by 1),
r as (select query_id, case when query_id % 3 = 0 then 'patient_specific_diagnosis' else
    'generation_' || coalesce(generation_failure, 'unavailable') end as reason from qs)
select r.query_id, false as grounded, reason, 'insufficient' as evidence_strength,
  case when r.query_id % 2 = 0 then 'gap' else {Q.lit(K.DEFAULT_MISSING)} end as missing_evidence,
  coalesce(sources, '') as evidence_checked, sources is not null as retrieval_passed,
  reason <> 'patient_specific_diagnosis' as safety_passed from r left join s using (query_id)""")
def refusals(spark, sf):
    n = F.col("query_id")
    # Failure classes come from raw error types and status codes.
    q = questions(spark, sf)
    kind = O.failure_class(F.when(n % 31 == 2, F.lit("RateLimitError")).when(n % 31 != 2, F.lit("Timeout")),
                           F.when(n % 31 == 2, F.lit(429)))
    r = q.select("query_id", F.when(n % 3 == 0, K.PERSONAL_REASONS[0]).otherwise(
        F.concat(F.lit("generation_"), kind)).alias("reason"), F.when(n % 2 == 0, "gap").otherwise("").alias("missing_evidence"))
    out = O.refusals(r, hits(spark, sf).filter(n % 4 != 1))
    return out.select("query_id", "grounded", "reason", "evidence_strength", "missing_evidence",
                      F.array_join("evidence_checked", "; ").alias("evidence_checked"),
                      F.col("checks.retrieval_passed").alias("retrieval_passed"),
                      F.col("checks.safety_passed").alias("safety_passed"))


_DISPOSITION = f"""{_ALL}, {_ERRORS}, {_QUESTIONS}, {_RESCUE}, {_VERDICTS},
s0 as (select q.*, v.sufficient, v.partial, exists (select 1 from sc where sc.query_id = q.query_id
      and kind = 'recommendation') as own, rs.query_id is not null as quotable, coalesce(rs.rerank_score > 0, false) as local_ok
  from qs q join va v using (query_id) left join rs using (query_id)),
s1 as (select *, role = 'doctor' and (not own or generation_failure is not null) and quotable as uses_rescue from s0),
bf as (select sc.* from sc where query_id not in (select query_id from s1 where uses_rescue)
  union all select query_id, 'recommendation', 0, 1, 'recommendation-1', claim_text, 'C1', '[C1]' from rs
    where query_id in (select query_id from s1 where uses_rescue)), {_outcome('bf')}, {_STRENGTH.replace('st as', 'st0 as')},
s2 as (select s1.*, coalesce(oc.malformed, true) as malformed, coalesce(oc.has_rec, false) as has_rec,
    coalesce(oc.rejected, false) as rejected, oc.dropped, st0.evidence_strength as own_strength
  from s1 left join oc using (query_id) left join st0 using (query_id)),
s3 as (select *, case when role = 'doctor' and regexp_matches(question, {Q.lit(K.OFF_TOPIC)}) then 'non_medical_question'
    when regexp_matches(question, {Q.lit(K.PERSONAL_DIAGNOSIS)}) then 'patient_specific_diagnosis'
    when regexp_matches({Q.squeeze('question')}, {Q.lit(K.PERSONAL_DOSAGE)}) then 'patient_specific_dosage_or_treatment'
    when query_id % 37 = 6 then 'retrieval_unavailable'
    when generation_failure is not null and role <> 'doctor' then 'generation_' || generation_failure
    when generation_failure is null and not sufficient then 'model_reported_insufficient_context'
    when not (uses_rescue or (own and generation_failure is null)) then 'evidence_validation_failed'
    when verification_failure is not null and not uses_rescue then 'evidence_verification_' || verification_failure
    when verification_failure is not null and not local_ok then 'evidence_verification_failed'
    when verification_failure is not null then null
    when role = 'doctor' and rejected and not local_ok then 'evidence_verification_failed'
    when role = 'doctor' and rejected then null
    when malformed or not has_rec then 'evidence_verification_failed' end as reason from s2)
select query_id, reason is null as grounded, reason, case when reason is not null then 'insufficient'
  when verification_failure is not null or (role = 'doctor' and rejected) then
    case when partial and not uses_rescue then 'low' else 'medium' end
  when uses_rescue then case when dropped <> '' then 'low' else 'medium' end else own_strength end as evidence_strength,
  reason is null and (uses_rescue or verification_failure is not null or (role = 'doctor' and rejected)) as rescued from s3"""


@query("g15_answer_disposition", _DISPOSITION)
def answer_disposition(spark, sf):
    s = Stages(spark, sf)
    q = questions(spark, sf).withColumn("retrieval_failed", F.col("query_id") % 37 == 6)
    return O.answer_disposition(q, s.hits, s.answers, s.verdicts)


@query("g14_refusal_replies", f"""with q as (select doc_id, case doc_id % 7 when 0 then 'patient_specific_diagnosis' when 1 then 'non_medical_question'
    when 2 then 'generation_rate_limited' when 3 then 'retrieval_unavailable' when 4 then 'no_relevant_sources'
    when 5 then 'patient_specific_dosage_or_treatment' else 'evidence_validation_failed' end as reason,
    case when doc_id % 2 = 0 then 'doctor' else 'patient' end as role, case when doc_id % 3 = 0 then 'triage' else 'general' end as mode from documents),
r(audience, kind, reply) as (values {', '.join('(' + ', '.join(Q.lit(x) for x in row) + ')' for row in K.REPLIES)}),
k as (select *, case when reason = 'non_medical_question' then 'non_medical_question'
    when reason like 'patient_specific%' then case when role = 'doctor' then 'personal' else 'personal_' || mode end
    when reason = 'generation_rate_limited' then 'rate_limited' when reason = 'retrieval_unavailable' then 'unavailable'
    else case when role = 'doctor' then 'insufficient' else 'insufficient_' || mode end end as kind,
  case when reason = 'non_medical_question' then 'doctor' when reason in ('generation_rate_limited', 'retrieval_unavailable') then 'any'
    else role end as audience from q)
select doc_id, reason, reply from k join r using (audience, kind)""")
def refusal_replies(spark, sf):
    n = F.col("doc_id")
    reasons = ("patient_specific_diagnosis", "non_medical_question", "generation_rate_limited", "retrieval_unavailable", "no_relevant_sources",
               "patient_specific_dosage_or_treatment", "evidence_validation_failed")
    q = table(spark, sf, "documents").select(
        "doc_id", F.element_at(F.array(*map(F.lit, reasons)), (n % 7 + 1).cast("int")).alias("reason"),
        F.when(n % 2 == 0, "doctor").otherwise("patient").alias("role"), F.when(n % 3 == 0, "triage").otherwise("general").alias("mode"))
    return q.select("doc_id", "reason", O.refusal_reply("reason", "role", "mode").alias("reply"))
