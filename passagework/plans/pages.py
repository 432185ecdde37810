"""Family C: page quality, furniture removal, page types."""

from __future__ import annotations

from pyspark.sql import functions as F

from passagework import constants as K
from passagework.functions import text as T
from passagework.operators import pages as O
from passagework.plans import sqltext as Q
from passagework.plans.registry import query
from passagework.plans.views import guide_pages

_QUALITY = Q.GUIDE + """, q as (select document_id, page_number, text, length(text) as char_count, image_count,
  image_count > 0 and length(text) < 40 as suspected_scanned from gp)"""
# Documents of even numbers declare two hundred pages more than were read.
_REPORT = _QUALITY + """, r as (
  select document_id, count(*) + 200 * any_value(regexp_matches(document_id, '[02468]$'))::int as total_pages, count(*) filter (char_count >= 40) as text_pages,
    coalesce(string_agg(page_number::varchar, ',' order by page_number) filter (char_count = 0), '') as empty_pages,
    coalesce(string_agg(page_number::varchar, ',' order by page_number) filter (suspected_scanned), '')
      as suspected_scanned_pages,
    count(*) filter (suspected_scanned) as n_scanned,
    sum(char_count)::bigint as total_characters,
    round(count(*) filter (char_count >= 40)::double / (count(*) + 200 * any_value(regexp_matches(document_id, '[02468]$'))::int), 4)
      as text_page_ratio,
    sum(char_count) >= 100 and count(*) filter (char_count >= 40)
      >= greatest(1, ceil((count(*) + 200 * any_value(regexp_matches(document_id, '[02468]$'))::int) * 0.05)) as usable
  from q group by document_id)"""


def _declared(pages):
    read = pages.groupBy("document_id").agg(F.count(F.lit(1)).alias("n"))
    total = F.when(F.col("document_id").rlike("[02468]$"), F.col("n") + 200)
    return pages.join(read, "document_id").withColumn("total_pages", total).drop("n")


def _report(spark, sf):
    return O.extraction_report(_declared(O.page_quality(guide_pages(spark, sf))))


@query("c1_page_quality",
       f"with {_QUALITY} select document_id, page_number, char_count, suspected_scanned from q")
def page_quality(spark, sf):
    return O.page_quality(guide_pages(spark, sf)).select(
        "document_id", "page_number", "char_count", "suspected_scanned")


@query("c2_extraction_report", f"""with {_REPORT}
select document_id, total_pages, text_pages, empty_pages, suspected_scanned_pages, total_characters, text_page_ratio,
  usable, concat_ws(' | ', case when n_scanned > 0 then n_scanned || ' page(s) appear image-only with no extractable text'
    end, case when usable and text_page_ratio < 0.5 then {Q.lit(K.LOW_TEXT_WARNING)} end) as warnings from r""")
def extraction_report(spark, sf):
    r = _report(spark, sf)
    return r.select(
        "document_id", "total_pages", "text_pages", F.array_join("empty_pages", ",").alias("empty_pages"),
        F.array_join("suspected_scanned_pages", ",").alias("suspected_scanned_pages"), "total_characters",
        "text_page_ratio", "usable", F.array_join("warnings", " | ").alias("warnings"))


# Half of the documents lose their texts so that both verdicts occur.
_BLANKED = _QUALITY.replace(", q as", ", gb as (select document_id, page_number, image_count, case when "
                            "regexp_matches(document_id, '[02468]-') then substr(text, 1, 2) else text end as text "
                            "from gp), q as").replace("from gp)\"", "from gp)\"")
_BLANKED = _BLANKED[:_BLANKED.rindex("from gp)")] + "from gb)"


@query("c3_gate_documents", "with " + _BLANKED + _REPORT[len(_QUALITY):] + f"""
select document_id, usable as accepted, case when not usable then 'insufficient_text' end as code,
  case when usable then null when n_scanned > 0 then {Q.lit(K.SCANNED_MESSAGE)} else {Q.lit(K.SHORT_MESSAGE)} end
  as message from r""")
def gate_documents(spark, sf):
    g = guide_pages(spark, sf)
    g = g.withColumn("text", F.when(F.col("document_id").rlike("[02468]-"), F.substring("text", 1, 2)).otherwise(
        F.col("text")))
    return O.gate_documents(O.extraction_report(_declared(O.page_quality(g)))).select(
        "document_id", "accepted", "code", "message")


@query("c4_sample_pages", f"""with {Q.GUIDE},
s as (select *, row_number() over (partition by document_id order by page_number) as sample from gp
      where length(text) > 100)
select document_id, page_number, sample, length(text) as char_count,
  replace(substr(text, 1, 400), chr(10), ' ') || case when length(text) > 400 then '...' else '' end as preview
from s where sample <= 3""")
def sample_pages(spark, sf):
    return O.sample_pages(guide_pages(spark, sf))


@query("c5_line_shape", f"""with {Q.GUIDE}, {Q.LINES}
select case when protected then 'protected' when numbered then 'page_number' else 'text' end as shape,
  count(*) as lines from sl group by 1""")
def line_shape(spark, sf):
    return O.page_lines(guide_pages(spark, sf)).groupBy(T.line_shape(T.strip("line")).alias("shape")).agg(
        F.count(F.lit(1)).alias("lines"))


@query("c6_furniture_key", f"""with {Q.GUIDE}, {Q.LINES} select key, count(*) as lines from sl group by 1""")
def furniture_key(spark, sf):
    return O.page_lines(guide_pages(spark, sf)).groupBy(T.furniture_key(T.strip("line")).alias("key")).agg(
        F.count(F.lit(1)).alias("lines"))


@query("c7_page_lines", f"with {Q.GUIDE}, {Q.LINES} select document_id, page_number, pos, line, is_edge from sl")
def page_lines(spark, sf):
    return O.page_lines(guide_pages(spark, sf)).select("document_id", "page_number", "pos", "line", "is_edge")


@query("c8_detect_furniture", f"with {Q.FURNITURE} select document_id, key, pages from furniture")
def detect_furniture(spark, sf):
    return O.detect_furniture(guide_pages(spark, sf))


def _stripped(spark, sf):
    return O.clean_furniture(guide_pages(spark, sf))


@query("c9_strip_furniture", f"with {Q.STRIPPED} select document_id, page_number, text from st")
def strip_furniture(spark, sf):
    return _stripped(spark, sf).select("document_id", "page_number", "text")


@query("c10_removed_line_report", f"""with {Q.STRIPPED},
c as (select document_id, s, count(*) as removed from judged where gone group by 1, 2),
r as (select *, row_number() over (partition by document_id order by removed desc, s) as rank from c)
select document_id, rank, substr(s, 1, 80) as line, removed from r where rank <= 10""")
def removed_line_report(spark, sf):
    return O.removed_line_report(_stripped(spark, sf))


@query("c11_drop_empty_pages", f"""with {Q.STRIPPED}
select document_id, page_number, 'empty' as reason from st where {Q.strip('text')} = ''""")
def drop_empty_pages(spark, sf):
    return O.drop_empty_pages(_stripped(spark, sf))[1]


@query("c12_copyright_pages", f"with {Q.GUIDE} select document_id, page_number, {Q.COPYRIGHT} as flag from gp")
def copyright_pages(spark, sf):
    return guide_pages(spark, sf).select("document_id", "page_number", T.is_copyright_page("text").alias("flag"))


@query("c13_toc_line_ratio",
       f"with {Q.GUIDE} select document_id, page_number, round({Q.toc_ratio('text')}, 6) as ratio from gp")
def toc_line_ratio(spark, sf):
    return guide_pages(spark, sf).select(
        "document_id", "page_number", F.round(T.toc_line_ratio("text"), 6).alias("ratio"))


@query("c14_toc_pages", f"with {Q.GUIDE} select document_id, page_number, {Q.TOC} as flag from gp")
def toc_pages(spark, sf):
    return guide_pages(spark, sf).select("document_id", "page_number", T.is_toc_page("text").alias("flag"))


@query("c15_classify_pages",
       f"with {Q.CLASSIFIED} select document_id, page_number, page_type, char_count, md5(text) as text_md5 from cp")
def classify_pages(spark, sf):
    return O.classify_pages(guide_pages(spark, sf)).select(
        "document_id", "page_number", "page_type", "char_count", F.md5("text").alias("text_md5"))


@query("c15_flagged_pages", f"""with {Q.CLASSIFIED}
select document_id, page_number, 'empty' as reason from lc where text = ''
union all select document_id, page_number, page_type from cp where page_type <> 'content'""")
def flagged_pages(spark, sf):
    return O.flagged_pages(guide_pages(spark, sf))


@query("c16_cleanup_summary", f"""with {Q.CLASSIFIED},
a as (select document_id, sum(length(text)) as i, count(*) as pi from gp group by 1),
b as (select document_id, sum(char_count) as o, count(*) as po from cp group by 1),
j as (select a.document_id, i, pi, coalesce(o, 0) as o, coalesce(po, 0) as po from a left join b using (document_id))
select document_id, sum(i)::bigint as chars_in, sum(o)::bigint as chars_out, (sum(i) - sum(o))::bigint as removed,
  round(100.0::double * (sum(i) - sum(o))::double / greatest(sum(i), 1)::double, 1) as removed_percent,
  sum(po)::bigint as pages_kept, sum(pi)::bigint as pages_total
from j group by rollup (document_id)""")
def cleanup_summary(spark, sf):
    g = guide_pages(spark, sf)
    return O.cleanup_summary(g, O.classify_pages(g))


@query("c17_content_pages",
       f"with {Q.CLASSIFIED} select document_id, page_number from cp where page_type = 'content'")
def content_pages(spark, sf):
    return O.content_pages(O.classify_pages(guide_pages(spark, sf))).select("document_id", "page_number")


@query("c17_skipped_pages", f"""with {Q.CLASSIFIED} select document_id,
  count(*) filter (page_type <> 'content') as skipped, count(*) filter (page_type = 'content') as kept
from cp group by 1""")
def skipped_pages(spark, sf):
    return O.skipped_page_counts(O.classify_pages(guide_pages(spark, sf)))
