"""Family K: streams over files that Spark writes from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from passagework.plans import sqltext as Q
from passagework.plans.lifecycle import write_documents
from passagework.plans.registry import query
from passagework.sources.documents import fingerprint, read_documents
from passagework.sources.lineage import new_folder
from passagework.sources.tables import table
from passagework.streaming import ingest as S


_PLAIN = Q.CLASSIFIED.replace(Q.GUIDE, Q.PAGES + ", gp as (select document_id, source, doc_id, page_number, image_count, text from pg)")


def _ingested_sql() -> str:
    from passagework.plans import chunks as C
    return "with recursive " + C._CHUNKS.replace(Q.CLASSIFIED, _PLAIN) + """
select document_id || ':p' || page_number || ':c' || chunk_index as chunk_id, md5(chunk) as text_md5, heading as section_title from bc"""


@query("k1_stream_chunk_ingest", _ingested_sql())
def stream_chunk_ingest(spark, sf):
    base = new_folder(spark, "passagework-stream")
    source = write_documents(spark, sf)
    # However many files Spark writes they come in two micro-batches: a batch is planned anew, and meanwhile no task runs.
    files = len(read_documents(spark, source, multi_line=False).inputFiles())
    # Everything is ingested twice, the second time in another generation: the result must not change.
    for generation in (0, 1):
        S.stream_chunk_ingest(spark, source, f"{base}/store", f"{base}/checkpoint-{generation}", generation,
                              files_per_batch=max(1, -(-files // 2))).awaitTermination()
    return S.current_chunks(spark, f"{base}/store").select("chunk_id", F.md5("text").alias("text_md5"), "section_title")


def _write_uploads(d, after, folder) -> int:
    """Append documents as uploads to a folder, in as many files as there are splits to read (two at least), and say how many."""
    rows = d.select(F.col("lang").alias("tenant"), F.encode("text", "utf-8").alias("content"),
                    F.timestamp_seconds(F.lit(1_704_067_200) + after + F.col("doc_id") % 60).alias("ts"))
    files = max(2, rows.rdd.getNumPartitions())
    (rows if rows.rdd.getNumPartitions() >= 2 else rows.repartition(2)).write.mode("append").parquet(folder)
    return files


@query("k2_stream_dedupe_uploads", "select distinct lang as tenant, sha256(text) as sha from documents")
def stream_dedupe_uploads(spark, sf):
    base = new_folder(spark, "passagework-stream")
    files = _write_uploads(table(spark, sf, "documents"), F.lit(0), f"{base}/in")
    uploads = spark.readStream.schema("tenant string, content binary, ts timestamp").option(
        "maxFilesPerTrigger", -(-files // 2)).parquet(f"{base}/in")
    hashed = uploads.select("tenant", "ts", fingerprint("content").alias("sha"))
    S.stream_dedupe_uploads(hashed, "1 hour").select("tenant", "sha").writeStream.format("parquet").option(
        "checkpointLocation", f"{base}/checkpoint").option("path", f"{base}/out").trigger(
        availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{base}/out")


@query("k2_stream_new_uploads", """select lang as tenant, sha256(text) as sha, count(*) as published
from (select distinct lang, text from documents) group by all""")
def stream_new_uploads(spark, sf):
    """Files come ten hours apart, under a watermark of one hour: state is long gone when most copies come."""
    base = new_folder(spark, "passagework-stream")
    d = table(spark, sf, "documents")
    for part in range(4):
        files = _write_uploads(d.filter(F.col("doc_id") % 4 == part), F.lit(part * 36_000), f"{base}/in")
    uploads = spark.readStream.schema("tenant string, content binary, ts timestamp").option("maxFilesPerTrigger", files).parquet(f"{base}/in")
    S.stream_new_uploads(uploads, f"{base}/store", f"{base}/checkpoint").awaitTermination()
    return S.stored_uploads(spark, f"{base}/store").groupBy("tenant", "sha").agg(F.count(F.lit(1)).alias("published"))
