"""Query of importance resampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from passagework.llm.importance import resample
from passagework.plans.registry import query
from passagework.sources.tables import table

SQL = r"""
with recursive bits as (select i::bigint as i, 0 as k, i::bigint as c from range(256) t(i)
  union all select i, k + 1, case when c & 1 = 1 then xor(c >> 1, 3988292384::bigint) else c >> 1 end from bits where k < 8),
tab as (select list(c order by i) as tab from bits where k = 8),
texts as (
  select 0 as side, doc_id as id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from documents
  union all
  select 1, null, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') from benchmark),
words as (select side, id, unnest(ws) as w from texts),
sums as (select side, id, w, count(*) as n from words group by all),
hexes as (select w, hex(encode(w)) as x from (select distinct w from sums)),
crc as (
  select w, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(1, length(x) + 1, 2), lambda p: ('0x' || substr(x, p, 2))::bigint)),
    lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295::bigint) % 10000 as bucket from hexes, tab),
counts as (select bucket, coalesce(sum(n) filter (side = 0), 0)::double as s, coalesce(sum(n) filter (side = 1), 0)::double as t from sums join crc using (w) group by bucket),
gains as (
  select bucket, floor(1000 * ln(((t + 1) * ((select sum(s) from counts) + 10000)) / ((s + 1) * ((select sum(t) from counts) + 10000))))::bigint as gain from counts),
weights as (select id as doc_id, sum(n)::bigint as n_features, sum(n * gain)::hugeint as total from sums join crc using (w) join gains using (bucket) where side = 0 group by id),
scored as (
  select d.doc_id, coalesce(n_features, 0) as n_features,
    case when n_features is null then 0 else (total - ((total % n_features) + n_features) % n_features) // n_features end::bigint as weight,
    ('0x' || substr(sha256('2024:' || d.doc_id), 1, 8))::bigint as h
  from documents d left join weights w on d.doc_id = w.doc_id),
summed as (select doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5::double) / 4294967296)))::bigint as score from scored),
drawn as (
  select doc_id, row_number() over (order by score desc, doc_id) as rank from summed where n_features >= 20
  qualify rank <= (select 10 * count(*) // 100 from summed where n_features >= 20))
select s.doc_id, n_features, weight, score, rank from summed s left join drawn r on s.doc_id = r.doc_id"""


@query("op12_importance_lines", SQL)
def op12_importance_lines(spark: SparkSession, sf: str) -> DataFrame:
    """A tenth of ``documents``, drawn towards ``benchmark``."""
    drawn = resample(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")
