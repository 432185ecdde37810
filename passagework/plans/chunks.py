"""Family D: whole documents, sections, chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from passagework.functions import text as T
from passagework.operators import chunks as O
from passagework.operators import pages as P
from passagework.plans import sqltext as Q
from passagework.plans.registry import query
from passagework.plans.views import guide_pages, text_pages
from passagework.sources.lineage import spread
from passagework.sources.tables import table

_CONTENT = Q.CLASSIFIED + """, co as (
  select document_id, page_number, text,
    coalesce(sum(length(text) + 1) over (partition by document_id order by page_number
      rows between unbounded preceding and 1 preceding), 0)::bigint as start_offset
  from cp where page_type = 'content')"""


def content(spark, sf):
    return P.content_pages(P.classify_pages(guide_pages(spark, sf))).select("document_id", "page_number", "text")


@query("d1_page_offsets", f"with {_CONTENT} select document_id, page_number, start_offset from co")
def page_offsets(spark, sf):
    return P.page_offsets(content(spark, sf)).select("document_id", "page_number", "start_offset")


@query("d1_concat_pages", f"""with {_CONTENT}
select document_id, length(t) as chars, md5(t) as text_md5, pages from (
  select document_id, string_agg(text, chr(10) order by page_number) || chr(10) as t, count(*) as pages
  from co group by 1)""")
def concat_pages(spark, sf):
    return P.concat_pages(content(spark, sf)).select(
        "document_id", F.length("text").alias("chars"), F.md5("text").alias("text_md5"),
        F.size("page_map").alias("pages"))


@query("d2_offset_to_page", f"""with {_CONTENT},
pt as (select document_id, page_number as asked, start_offset + (page_number * 37) % 400 as "offset" from co)
select pt.document_id, pt.asked, pt."offset", max(co.page_number) as page_number
from pt join co on co.document_id = pt.document_id and co.start_offset <= pt."offset" group by 1, 2, 3""")
def offset_to_page(spark, sf):
    o = P.page_offsets(content(spark, sf))
    points = o.select("document_id", F.col("page_number").alias("asked"),
                      (F.col("start_offset") + F.col("page_number") * 37 % 400).alias("offset"))
    return P.offset_to_page(points, o)


_W = "over (partition by document_id order by page_number, pos)"
_HEADS = _CONTENT + f""", dl as (
  select document_id, page_number, unnest(l) as line, generate_subscripts(l, 1) - 1 as pos
  from (select document_id, page_number, string_split(text, chr(10)) as l from co)),
d2 as (select *, row_number() {_W} as line_no, lead(line, 1) {_W} as next1, lead(line, 2) {_W} as next2,
    coalesce(sum(length(line) + 1) over (partition by document_id order by page_number, pos
      rows between unbounded preceding and 1 preceding), 0)::bigint as start,
    regexp_matches(line, '^Annex\\s+[0-9]+\\s*:[^\\n]{{0,40}}$') as annex,
    case when length(lead(line, 1) {_W}) between 2 and 40 and length(lead(line, 2) {_W}) between 2 and 40 then 2
         when length(lead(line, 1) {_W}) between 2 and 40 then 1 else 0 end as extra from dl),
d3 as (select *, coalesce(lag(annex, 1) {_W} and lag(extra, 1) {_W} >= 1, false)
    or coalesce(lag(annex, 2) {_W} and lag(extra, 2) {_W} >= 2, false) as swallowed from d2),
d4 as (select *, case when swallowed then null
    when regexp_matches(line, '^[0-9]+(\\.[0-9]+)*[ \\t]+[A-Z][^\\n]{{2,80}}$') then 'numbered'
    when annex then 'annex' when regexp_matches(line, '^[A-Z][A-Za-z ,\\-]{{3,70}}$') then 'plain' end as kind from d3),
d5 as (select *, case when kind = 'annex' and extra = 2 then line || chr(10) || next1 || chr(10) || next2
    when kind = 'annex' and extra = 1 then line || chr(10) || next1 when kind is not null then line end as heading,
    coalesce(next1 = '', false) as blank_follows,
    list_filter(string_split_regex({Q.strip('line')}, '{Q.WS}+'), lambda w: regexp_matches(w, '^\\p{{L}}+$')) as words
  from d4),
hd as (select *, coalesce(kind is not null
    and not regexp_matches(replace({Q.strip('heading')}, chr(10), ' '),
      '(^[0-9]+\\s*(of)?\\s*[0-9]*$)|(^(?i:page)\\s+[0-9]+)|©|(?i:all rights reserved)|(?i:notice of rights)')
    and (kind in ('numbered', 'annex') or blank_follows
      or regexp_matches(regexp_replace(heading, '\\P{{L}}', '', 'g'), '^\\p{{Lu}}+$')
      or (len(words) >= 2 and len(list_filter(words, lambda w: regexp_matches(w, '^\\p{{Lu}}'))) >= 0.6 * len(words))),
    false) as is_heading from d5)"""


def _headings(spark, sf):
    return O.kept_headings(O.heading_candidates(O.document_lines(content(spark, sf))))


@query("d3_heading_candidates", f"""with {_HEADS}
select document_id, line_no, start, kind, heading, blank_follows from hd where kind is not null""")
def heading_candidates(spark, sf):
    h = O.heading_candidates(O.document_lines(content(spark, sf)))
    return h.filter(F.col("kind").isNotNull()).select(
        "document_id", "line_no", "start", "kind", "heading", "blank_follows")


@query("d4_boilerplate_headings", """with l as (select doc_id, unnest(string_split(
    text || chr(10) || 'page 12 and on' || chr(10) || '131' || chr(10) || '12 of 131', chr(10))) as line from documents)
select doc_id, count(*) filter (regexp_matches(trim(line),
  '(^[0-9]+\\s*(of)?\\s*[0-9]*$)|(^(?i:page)\\s+[0-9]+)|©|(?i:all rights reserved)|(?i:notice of rights)')) as boilerplate
from l group by 1""")
def boilerplate_headings(spark, sf):
    d = table(spark, sf, "documents")
    lines = F.split(F.concat("text", F.lit("\npage 12 and on\n131\n12 of 131")), "\n")
    return d.select("doc_id", F.size(F.filter(lines, T.is_boilerplate_heading)).cast("bigint").alias("boilerplate"))


@query("d5_kept_headings", f"with {_HEADS} select document_id, line_no, heading from hd where is_heading")
def kept_headings(spark, sf):
    return _headings(spark, sf).filter("is_heading").select("document_id", "line_no", "heading")


_SECTIONS = _HEADS + f""", nm as (select *, sum(is_heading::int) {_W} as section_no from hd),
bd as (select document_id, section_no::bigint as section_no, min(start) as start,
    string_agg(line, chr(10) order by line_no) || chr(10) as raw,
    max(case when is_heading then {Q.squeeze('heading')} end) as title from nm group by 1, 2),
ge as (select *, max(section_no) over (partition by document_id) = 0 as general from bd),
se as (select document_id, section_no,
    case when general then 'General' else coalesce(title, 'Preamble') end as heading,
    case when general then start else start + length(raw) - length(ltrim(raw, {Q.WS_LIT})) end as start,
    (select b.start from ge b where b.document_id = ge.document_id and b.section_no = ge.section_no)
      + length(raw) as "end",
    case when general then raw else {Q.strip('raw')} end as text
  from ge where general or length({Q.strip('raw')}) >= 30)"""


@query("d6_split_sections", f"""with {_SECTIONS}
select document_id, section_no, heading, start, "end", length(text) as chars, md5(text) as text_md5 from se""")
def split_sections(spark, sf):
    return O.split_sections(content(spark, sf)).select(
        "document_id", "section_no", "heading", "start", "end", F.length("text").alias("chars"),
        F.md5("text").alias("text_md5"))


_FIXED = """with w as (select doc_id, unnest(range(0, 1 + greatest(ceil((length(text) - 1000) / 850.0)::bigint, 0))) as k,
    text as body from documents),
f as (select doc_id, k as piece_no, k * 850 as start, substr(body, k * 850 + 1, 1000) as text from w)"""


def _fixed(spark, sf):
    d = spread(table(spark, sf, "documents"), "doc_id")
    return d.select("doc_id", F.posexplode_outer(O.fixed_windows("text")).alias("piece_no", "p")).select(
        "doc_id", "piece_no", F.col("p.start").alias("start"), F.col("p.text").alias("text"))


@query("d7_fixed_windows", f"{_FIXED} select * from f")
def fixed_windows(spark, sf):
    return _fixed(spark, sf)


@query("d7_split_overlapping", f"""with recursive {Q.split_sql('documents', 'doc_id')}
select doc_id, row_number() over (partition by doc_id order by start) - 1 as piece_no, start, chunk as text from ck""")
def split_overlapping(spark, sf):
    d = spread(table(spark, sf, "documents"), "doc_id")
    return d.select("doc_id", F.posexplode_outer(O.split_overlapping("text")).alias("piece_no", "p")).select(
        "doc_id", "piece_no", F.col("p.start").alias("start"), F.col("p.text").alias("text")).filter(F.col("text").isNotNull())


@query("d8_drop_tiny_chunks",
       f"{_FIXED} select doc_id, piece_no, start from f where length({Q.strip('text')}) >= 60")
def drop_tiny_chunks(spark, sf):
    return O.drop_tiny_chunks(_fixed(spark, sf)).select("doc_id", "piece_no", "start")


@query("d9_locate_chunk", """with c as (select doc_id, text as section, doc_id % 50 as cur,
    case when doc_id % 2 = 0 then substr(text, 101, 200) else substr(text, 101, 60) || '#changed' end as piece
  from documents),
l as (select doc_id, cur, strpos(substr(section, cur + 1), piece) as a, length(substr(piece, 1, 40)) as n,
    strpos(substr(section, cur + 1), substr(piece, 1, 40)) as b from c)
select doc_id, case when a > 0 then a - 1 + cur when n >= 20 and b > 0 then b - 1 + cur else -1 end as place from l""")
def locate_chunk(spark, sf):
    n = F.col("doc_id")
    piece = F.when(n % 2 == 0, F.substring("text", 101, 200)).otherwise(
        F.concat(F.substring("text", 101, 60), F.lit("#changed")))
    return table(spark, sf, "documents").select(
        "doc_id", O.locate_chunk(F.col("text"), piece, n % 50).alias("place"))


_BY_PAGE = f"""with {Q.PAGES},
w as (select document_id, page_number, unnest(range(0, 1 + greatest(ceil((length(text) - 1000) / 850.0)::bigint, 0))) as k
  from pg),
i as (select *, row_number() over (partition by document_id order by page_number, k) - 1 as chunk_index from w)"""


@query("d10_chunk_ids", f"""{_BY_PAGE}
select document_id, k as piece_no, chunk_index, document_id || ':p' || page_number || ':c' || chunk_index as chunk_id from i""")
def chunk_ids(spark, sf):
    p = text_pages(spark, sf)
    c = p.select("document_id", "page_number", F.posexplode_outer(O.fixed_windows("text")).alias("piece_no", "p"))
    return O.chunk_ids(c, ["page_number", "piece_no"]).select("document_id", "piece_no", "chunk_index", "chunk_id")


_CHUNKS = f"""{_SECTIONS},
sx as (select document_id || '|' || section_no as sid, text from se), {Q.split_sql('sx', 'sid')},
cz as (select s.document_id, s.section_no, s.heading, s.start + c.start as "offset", c.chunk, c.start as piece from ck c
  join se s on s.document_id || '|' || s.section_no = c.sid where length({Q.strip('c.chunk')}) >= 60),
cy as (select z.document_id, section_no, heading, piece, chunk, max(co.page_number) as page_number from cz z join co
  on co.document_id = z.document_id and co.start_offset <= z."offset" group by 1, 2, 3, 4, 5),
bc as (select *, row_number() over (partition by document_id order by section_no, piece) - 1 as chunk_index from cy)"""


@query("d11_build_chunks", f"""with recursive {_CHUNKS}
select document_id || ':p' || page_number || ':c' || chunk_index as chunk_id, document_id, chunk_index, chunk as text,
  heading as section_title, page_number from bc""")
def build_chunks(spark, sf):
    pages = P.classify_pages(guide_pages(spark, sf))
    return O.build_chunks(pages)


_ANNEX = """with c as (select doc_id, text, case when doc_id % 3 = 0 then 'Annex ' || doc_id || ': Table'
  when doc_id % 3 = 1 then 'Annexes' else '1.1 Care' end as section_title, doc_id % 4 as m from documents)"""


@query("d12_embed_text", f"""{_ANNEX} select doc_id, case when starts_with(section_title, 'Annex ')
  then section_title || chr(10) || text else text end as page_content from c""")
def embed_text(spark, sf):
    n = F.col("doc_id")
    title = F.when(n % 3 == 0, F.concat(F.lit("Annex "), n.cast("string"), F.lit(": Table"))).when(
        n % 3 == 1, F.lit("Annexes")).otherwise(F.lit("1.1 Care"))
    return table(spark, sf, "documents").select("doc_id", O.embed_text(title, F.col("text")).alias("page_content"))


@query("d13_index_metadata", """select 'd' || doc_id as chunk_id, case when doc_id % 4 = 0 then '' else source end
  as document_id, 'Section' as section_title, doc_id % 97 + 1 as page_number, source, source as title,
  'p' as publisher, '' as url, lang as topic, text as page_content from documents""")
def index_metadata(spark, sf):
    d = table(spark, sf, "documents")
    n = F.col("doc_id")
    return O.index_metadata(d.select(
        F.concat(F.lit("d"), n.cast("string")).alias("chunk_id"),
        F.when(n % 4 != 0, F.col("source")).alias("document_id"), F.lit("Section").alias("section_title"),
        (n % 97 + 1).alias("page_number"), "source", F.col("source").alias("title"), F.lit("p").alias("publisher"),
        F.lit("").alias("url"), F.col("lang").alias("topic"), "text"))
