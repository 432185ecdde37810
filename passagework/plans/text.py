"""Family B: text normalisation, over whole documents with line noise written around them."""

from __future__ import annotations

from pyspark.sql import functions as F

from passagework import constants as K
from passagework.functions import text as T
from passagework.operators.operations import unique_slugs
from passagework.plans import sqltext as Q
from passagework.plans.hits import HITS, hits
from passagework.plans.registry import query
from passagework.sources.lineage import spread
from passagework.sources.tables import table

_NOISY = (
    "'  ' || source || chr(13) || chr(10) || text || ' manage-' || chr(10) || 'ment ' || chr(64257) || 'ne ....... 12  '"
    " || chr(9) || chr(10) || chr(10) || chr(10) || chr(10) || chr(160) || ' say ' || chr(8220) || 'a' || chr(8209)"
    " || 'b' || chr(8217) || chr(8221) || ' v1.2.3 x' || doc_id || chr(10)")
_BASE = f"with n as (select doc_id, {_NOISY} as t from documents)"


def _noisy(spark, sf):
    d = spread(table(spark, sf, "documents"), "doc_id")
    t = F.concat(F.lit("  "), F.col("source"), F.lit("\r\n"), F.col("text"), F.lit(
        " manage-\nment ﬁne ....... 12  \t\n\n\n\n\xa0 say “a‑b’” v1.2.3 x"),
        F.col("doc_id").cast("string"), F.lit("\n"))
    return d.select("doc_id", t.alias("t"))


def _simple(name: str, fn, sql_expr: str):
    @query(name, f"{_BASE} select doc_id, {sql_expr} as out from n")
    def run(spark, sf):
        return _noisy(spark, sf).select("doc_id", fn("t").alias("out"))
    return run


_CLEAN = "regexp_replace(t, '\\r\\n?', chr(10), 'g')"
_CLEAN = f"replace(replace({_CLEAN}, chr(64257), 'fi'), chr(64258), 'fl')"
_CLEAN = f"regexp_replace({_CLEAN}, '-\\n([a-z])', '\\1', 'g')"
_CLEAN = f"regexp_replace({_CLEAN}, '(?m)[ \\t]+$', '', 'g')"
_CLEAN = f"regexp_replace({_CLEAN}, '[ \\t]{{2,}}', ' ', 'g')"
_CLEAN = Q.strip(f"regexp_replace({_CLEAN}, '\\n{{3,}}', chr(10) || chr(10), 'g')")
_DOTS = "regexp_replace({}, '\\.{{4,}}', ' ', 'g')"
_LIGHT = _DOTS.format("replace(t, chr(160), ' ')")
_LIGHT = f"regexp_replace({_LIGHT}, '[ \\t]{{2,}}', ' ', 'g')"
_LIGHT = Q.strip(f"regexp_replace({_LIGHT}, '\\n{{3,}}', chr(10) || chr(10), 'g')")

_simple("b1_clean_extracted_text", T.clean_extracted_text, _CLEAN)
_simple("b2_remove_dot_leaders", T.remove_dot_leaders, _DOTS.format("t"))
_simple("b3_light_clean", T.light_clean, _LIGHT)
_simple("b4_fold_punctuation", T.fold_punctuation, Q.fold("t"))
_simple("b5_normalize_for_match", T.normalize_for_match, Q.squeeze("t"))
_simple("b7_tokenize", lambda c: F.array_join(T.tokenize(c), " "), f"array_to_string({Q.tokens('t')}, ' ')")


@query("b6_normalize_message",
       "select conv_id, turn, lower(" + Q.strip(
           f"regexp_replace(text || '! Really?', '[^\\p{{L}}\\p{{N}}\\p{{M}}_{Q.WS[1:-1]}]', '', 'g')")
       + ") as out from conversations")
def normalize_message(spark, sf):
    c = table(spark, sf, "conversations")
    return c.select("conv_id", "turn", T.normalize_message(F.concat("text", F.lit("! Really?"))).alias("out"))


@query("b8_content_words", f"""
select item_id, string_agg(w, ' ' order by w) as words from (
  select distinct item_id, lower(u.w) as w
  from benchmark, unnest(regexp_extract_all(text || ' What should THIS do?', '[A-Za-z0-9]{{3,}}')) u(w))
where w not in ({', '.join(Q.lit(w) for w in K.STOP_WORDS)}) group by item_id""")
def content_words(spark, sf):
    b = table(spark, sf, "benchmark")
    words = T.content_words(F.concat("text", F.lit(" What should THIS do?")))
    return b.select("item_id", F.array_join(F.sort_array(words), " ").alias("words"))


@query("b9_unique_slugs", """
with s as (select c_custkey, trim(regexp_replace(lower(trim(' ' || c_mktsegment || ' & Co. ' ||
             case when c_custkey % 7 = 0 then (c_custkey % 29 + 1)::varchar else '' end)), '[^a-z0-9]+', '-', 'g'), '-') as b
           from customer),
r as (select c_custkey, b, row_number() over (partition by b order by c_custkey) as k from s),
f as (select b, m, row_number() over (partition by b order by m) + 1 as k
  from (select b, unnest(range(2, n + 40)) as m from (select b, count(*) as n from s group by b))
  where b || '-' || m not in (select b from s))
select c_custkey, case when r.k = 1 then b else b || '-' || f.m end as slug from r left join f using (b, k)""")
def slugs(spark, sf):
    c = table(spark, sf, "customer").select(
        "c_custkey", F.concat(F.lit(" "), F.col("c_mktsegment"), F.lit(" & Co. "), F.when(
            F.col("c_custkey") % 7 == 0, (F.col("c_custkey") % 29 + 1).cast("string")).otherwise("")).alias("name"))
    return unique_slugs(c, "name", "c_custkey").select("c_custkey", "slug")


@query("b10_safe_url", """
select page_id, case when regexp_matches(u, '(?i)^https?://') then u end as safe from (
  select page_id, case when page_id % 3 = 0 then 'ftp:' || url when page_id % 3 = 1 then upper(url) else url end as u
  from pages)""")
def safe_urls(spark, sf):
    p = table(spark, sf, "pages")
    u = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("ftp:"), F.col("url"))).when(
        F.col("page_id") % 3 == 1, F.upper("url")).otherwise(F.col("url"))
    return p.select("page_id", T.safe_url(u).alias("safe"))


@query("b11_checked_sources", HITS + """,
l as (select query_id, rank, case when title = '' then 'Verified clinic document' else title end
        || case when page_number <> 0 then ' (p. ' || page_number || ')' else '' end as label from hits),
f as (select query_id, label, min(rank) as r from l group by query_id, label)
select query_id, string_agg(label, '; ' order by r) as sources from f group by query_id""")
def checked_sources(spark, sf):
    from passagework.operators.audit import checked_sources as op
    return op(hits(spark, sf)).select("query_id", F.array_join("sources", "; ").alias("sources"))
