"""``documents`` seen as retrieved passages: four consecutive ids are the ranked hits of one question."""

from __future__ import annotations

from pyspark.sql import functions as F

from passagework.sources.lineage import spread
from passagework.sources.tables import table

HITS = """with hits as (
  select doc_id // 4 as query_id, doc_id % 4 + 1 as rank, text,
    case when doc_id % 5 = 0 then '' else 'Guide ' || ((doc_id // 2) % 7) end as title, source,
    source || '-' || (doc_id // 1000) as document_id, 'Publisher ' || source as publisher,
    case when doc_id % 6 = 0 then 'ftp://x' else 'https://example.org/' || source end as source_url,
    lang as topic, (doc_id // 2) % 13 as page_number, 'Section ' || (doc_id % 9) as section_title,
    'd' || doc_id as chunk_id, ((doc_id * 37) % 200) / 100::double as distance,
    case when doc_id % 17 <> 0 then (((doc_id * 53) % 200) - 100) / 10::double end as rerank_score
  from documents)"""


def hits(spark, sf):
    d = spread(table(spark, sf, "documents"), "doc_id")
    n = F.col("doc_id")

    def div(a, b):
        return F.floor(a / b).cast("bigint")

    return d.select(
        div(n, 4).alias("query_id"), (n % 4 + 1).cast("int").alias("rank"), "text",
        F.when(n % 5 == 0, F.lit("")).otherwise(F.concat(F.lit("Guide "), (div(n, 2) % 7).cast("string"))).alias("title"),
        "source", F.concat("source", F.lit("-"), div(n, 1000).cast("string")).alias("document_id"),
        F.concat(F.lit("Publisher "), F.col("source")).alias("publisher"),
        F.when(n % 6 == 0, F.lit("ftp://x")).otherwise(F.concat(F.lit("https://example.org/"), F.col("source"))).alias(
            "source_url"),
        F.col("lang").alias("topic"), (div(n, 2) % 13).cast("int").alias("page_number"),
        F.concat(F.lit("Section "), (n % 9).cast("string")).alias("section_title"),
        F.concat(F.lit("d"), n.cast("string")).alias("chunk_id"),
        ((n * 37 % 200) / 100.0).alias("distance"),
        F.when(n % 17 != 0, ((n * 53 % 200) - 100) / 10.0).alias("rerank_score"))
