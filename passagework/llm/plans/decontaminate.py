"""Query of benchmark decontamination."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from passagework.llm.decontaminate import report
from passagework.plans.registry import query
from passagework.sources.tables import table

SQL = r"""
with w as (
  select 0 as item, doc_id as id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from documents
  union all
  select 1, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') from benchmark),
bench as (
  select distinct id as item_id, least(len(ws), 10) as n, array_to_string(ws[i:i + least(len(ws), 10) - 1], ' ') as win
  from (select id, ws, unnest(range(1, len(ws) - least(len(ws), 10) + 2)) as i from w where item = 1 and len(ws) > 0)),
docs as (
  select id as doc_id, n, i, array_to_string(ws[i:i + n - 1], ' ') as win
  from (select id, ws, n, unnest(range(1, len(ws) - n + 2)) as i from w, (select distinct n from bench) where item = 0 and len(ws) >= n)),
found as (select d.doc_id, d.n, d.i, b.item_id from docs d join bench b on d.n = b.n and d.win = b.win),
hit as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from found) group by doc_id),
items as (
  select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as ids
  from (select distinct doc_id, cast(item_id as varchar) as item from found) group by doc_id)
select w.id as doc_id, len(ws) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
  sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from w left join hit on w.id = hit.doc_id left join items on w.id = items.doc_id where item = 0"""


@query("op2_decontaminate_fm", SQL)
def op2_decontaminate_fm(spark: SparkSession, sf: str) -> DataFrame:
    """Every whole text of ``documents`` against every item of ``benchmark``."""
    return report(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
