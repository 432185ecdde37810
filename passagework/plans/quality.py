"""Family I: chunk quality report over whole documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from passagework.operators import chunks as C
from passagework.operators import quality as O
from passagework.plans import sqltext as Q
from passagework.plans.chunks import _CHUNKS
from passagework.plans.registry import query
from passagework.plans.views import guide_pages, text_chunks
from passagework.sources.lineage import cut

_BODY = Q.strip("text")


@query("i1_char_stats", """select min(length(text)) as min_size, max(length(text)) as max_size,
round(avg(length(text)), 2) as mean_size, round(median(length(text)), 2) as median_size from documents""")
def char_stats(spark, sf):
    return O.char_stats(text_chunks(spark, sf))


@query("i2_word_stats", f"""with w as (select case when {Q.squeeze('text')} = '' then 0
  else length({Q.squeeze('text')}) - length(replace({Q.squeeze('text')}, ' ', '')) + 1 end as v from documents)
select min(v) as min_size, max(v) as max_size, round(avg(v), 2) as mean_size, round(median(v), 2) as median_size from w""")
def word_stats(spark, sf):
    return O.word_stats(text_chunks(spark, sf))


@query("i3_small_chunks", f"""select count(*) filter (length({_BODY}) < 100) as small,
count(*) filter (length({_BODY}) < 50) as very_small from documents""")
def small_chunks(spark, sf):
    return O.small_chunks(text_chunks(spark, sf))


@query("i3_small_chunk_examples", f"""select 'd' || doc_id as chunk_id, source, length(text) as chars,
substr(text, 1, 300) as text from documents where length({_BODY}) < 100 order by doc_id limit 10""")
def small_chunk_examples(spark, sf):
    return O.small_chunk_examples(text_chunks(spark, sf), "doc_id")


@query("i4_large_chunks", f"select count(*) filter (length({_BODY}) >= 1200) as large from documents")
def large_chunks(spark, sf):
    return O.large_chunks(text_chunks(spark, sf))


@query("i4_large_chunk_examples", f"""select 'd' || doc_id as chunk_id, source, length(text) as chars,
substr(text, 1, 300) as text from documents where length({_BODY}) >= 1200 order by doc_id limit 5""")
def large_chunk_examples(spark, sf):
    return O.large_chunk_examples(text_chunks(spark, sf), "doc_id")


@query("i5_duplicate_texts", f"""select min(doc_id) as doc_id, {_BODY} as text, count(*) as copies
from documents where {_BODY} <> '' group by {_BODY} having count(*) > 1""")
def duplicate_texts(spark, sf):
    return O.duplicate_texts(text_chunks(spark, sf), "doc_id")


@query("i6_missing_metadata", """with c as (select doc_id,
  case when doc_id % 7 = 0 then null else source end as source,
  case when doc_id % 11 = 0 then null else doc_id % 97 + 1 end as page_number from documents)
select 'd' || doc_id as chunk_id,
  concat_ws(',', case when source is null then 'source' end, case when page_number is null then 'page_number' end,
            'section_title', 'title', 'publisher', 'url', 'topic') as missing from c""")
def missing_metadata(spark, sf):
    c = text_chunks(spark, sf)
    c = c.withColumn("source", F.when(F.col("doc_id") % 7 != 0, F.col("source"))).withColumn(
        "page_number", F.when(F.col("doc_id") % 11 != 0, F.col("page_number")))
    return O.missing_metadata(c).select("chunk_id", F.array_join("missing", ",").alias("missing"))


@query("i7_char_count_mismatch", """with c as (select doc_id, text,
  case when doc_id % 9 = 0 then null when doc_id % 4 = 0 then n_chars + 1 else n_chars end as stored from documents)
select 'd' || doc_id as chunk_id, stored, length(text) as actual from c
where stored is not null and stored <> length(text)""")
def char_count_mismatch(spark, sf):
    n = F.col("doc_id")
    stored = F.when(n % 9 == 0, F.lit(None)).when(n % 4 == 0, F.col("char_count") + 1).otherwise(F.col("char_count"))
    return O.char_count_mismatch(text_chunks(spark, sf).withColumn("char_count", stored))


# Passages written onto the page they came from, the page before it, or a page that is not theirs.
_CITED = Q.PAGES + f""", c as (select 'd' || doc_id as chunk_id, document_id, text,
    case doc_id % 3 when 0 then page_number when 1 then page_number - 1 else page_number + 1 end as cited from pg),
p as (select document_id, page_number, {Q.squeeze('text')} as t from pg),
j as (select c.chunk_id, c.document_id, c.cited as page_number, substr({Q.squeeze('c.text')}, 1, 60) as probe,
    coalesce(a.t, '') as here, {Q.squeeze("coalesce(a.t, '') || ' ' || coalesce(b.t, '')")} as both_pages
  from c left join p a on a.document_id = c.document_id and a.page_number = c.cited
         left join p b on b.document_id = c.document_id and b.page_number = c.cited + 1),
v as (select *, case when length(probe) < 20 then 'skipped' when contains(here, probe) then 'exact'
    when contains(both_pages, probe) then 'spanning' else 'wrong' end as verdict from j)"""


def _cited(spark, sf):
    from passagework.plans.views import text_pages
    p = text_pages(spark, sf)
    n = F.col("doc_id") % 3
    cited = F.when(n == 0, F.col("page_number")).when(n == 1, F.col("page_number") - 1).otherwise(
        F.col("page_number") + 1)
    chunks = p.select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("chunk_id"), "document_id",
                      cited.alias("page_number"), "text")
    return chunks, p


@query("i8_page_citation_rows",
       f"with {_CITED} select chunk_id, document_id, page_number, probe, verdict from v")
def page_citation_rows(spark, sf):
    return O.page_citation_rows(*_cited(spark, sf))


@query("i8_page_citation_check",
       f"with {_CITED} select verdict, count(*) as chunks from v group by verdict")
def page_citation_check(spark, sf):
    return O.page_citation_check(*_cited(spark, sf))


_BUILT = f"""{_CHUNKS}, nx as (select document_id, page_number, {Q.squeeze('text')} as t from co),
pr as (select b.*, substr({Q.squeeze('chunk')}, 1, 60) as probe, coalesce(a.t, '') as here,
    {Q.squeeze("coalesce(a.t, '') || ' ' || coalesce(c.t, '')")} as both_pages
  from bc b left join nx a on a.document_id = b.document_id and a.page_number = b.page_number
    left join nx c on c.document_id = b.document_id and c.page_number = b.page_number + 1)"""


@query("i8_built_chunk_citations", f"""with recursive {_BUILT}
select case when length(probe) < 20 then 'skipped' when contains(here, probe) then 'exact'
    when contains(both_pages, probe) then 'spanning' else 'wrong' end as verdict, count(*) as chunks from pr group by 1""")
def built_chunk_citations(spark, sf):
    """The same check on chunks built from classified pages, against those pages."""
    from passagework.operators.pages import classify_pages, content_pages
    pages = cut(content_pages(classify_pages(guide_pages(spark, sf))))  # both sides of the check read the same pages
    return O.page_citation_check(C.build_chunks(pages), pages)


@query("i9_sentence_boundaries", f"""with b as (select {_BODY} as t from documents),
f as (select regexp_matches(t, '^\\p{{Ll}}') as s, t <> '' and not regexp_matches(t, '[.:?!;\\]]$') as e from b)
select count(*) as total, count(*) filter (s) as starts_mid, count(*) filter (e) as ends_mid,
  round(100.0::double * count(*) filter (s) / count(*), 1) as starts_percent,
  round(100.0::double * count(*) filter (e) / count(*), 1) as ends_percent from f""")
def sentence_boundaries(spark, sf):
    return O.sentence_boundaries(text_chunks(spark, sf))


@query("i10_boilerplate_rate", """with f as (select regexp_matches(text,
  '(?i)©|all rights reserved|notice of rights|\\.{4,}|page [0-9]+ of [0-9]+') as h from documents)
select count(*) as total, count(*) filter (h) as contaminated,
  round(100.0::double * count(*) filter (h) / count(*), 1) as percent from f""")
def boilerplate_rate(spark, sf):
    return O.boilerplate_rate(text_chunks(spark, sf))


@query("i11_page_distribution",
       "select source, doc_id % 97 + 1 as page_number, count(*) as chunks from documents group by 1, 2")
def page_distribution(spark, sf):
    return O.page_distribution(text_chunks(spark, sf))


@query("i11_pages_represented", "select count(distinct doc_id % 97 + 1) as pages from documents")
def pages_represented(spark, sf):
    return O.pages_represented(text_chunks(spark, sf))


@query("i12_source_distribution", "select source, count(*) as chunks from documents group by 1")
def source_distribution(spark, sf):
    return O.source_distribution(text_chunks(spark, sf))


@query("i13_size_consistency", f"""select round(avg(length(text)), 2) as mean_size,
count(*) filter (length(text) < 100) as very_small, count(*) filter (length(text) > 1200) as very_large
from documents where {_BODY} <> ''""")
def size_consistency(spark, sf):
    return O.size_consistency(text_chunks(spark, sf))


@query("i14_example_chunks", """with r as (select *, row_number() over (order by doc_id) as k, count(*) over () as n
  from documents)
select 'd' || doc_id as chunk_id, source, text from r where k in (1, n // 2 + 1, n)""")
def example_chunks(spark, sf):
    return O.example_chunks(text_chunks(spark, sf), "doc_id").select("chunk_id", "source", "text")
