"""Query of line dedup."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from passagework.llm.line_chunks import remove_repeated
from passagework.plans.registry import query
from passagework.sources.tables import table

SQL = r"""
with lines as (
  select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as i from documents
  where text is not null),
filled as (select *, row_number() over (partition by doc_id order by i) as k from lines where regexp_matches(line, '[^\x20\x09-\x0D]')),
pairs as (
  select doc_id, k, i as low, lead(i) over (partition by doc_id order by k) as high,
    line || chr(10) || lead(line) over (partition by doc_id order by k) as body from filled),
anchors as (
  select * from pairs where high is not null
  union all select doc_id, k, i, i, line from filled where len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) > 50),
judged as (select *, row_number() over (partition by body order by doc_id, k) > 1 as again from anchors),
gone as (select distinct doc_id, unnest(range(low, high + 1)) as i from judged where again),
kept as (
  select l.doc_id, count(*) as n_lines, count(g.i) as n_removed, coalesce(string_agg(line, chr(10) order by l.i) filter (g.i is null), '') as text
  from lines l left join gone g on l.doc_id = g.doc_id and l.i = g.i group by l.doc_id)
select d.doc_id, cast(coalesce(n_lines, 0) as bigint) as n_lines, cast(coalesce(n_removed, 0) as bigint) as n_removed,
  case when d.text is not null then k.text end as text, sha256(coalesce(k.text, '')) as text_sha256
from documents d left join kept k on d.doc_id = k.doc_id"""


@query("op1_line_chunks", SQL)
def op1_line_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Every whole text of ``documents`` without the chunks that stand earlier in the table."""
    return remove_repeated(table(spark, sf, "documents").select("doc_id", "text"), report=True)
