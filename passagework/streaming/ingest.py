"""Structured Streaming: idempotent chunk ingest and duplicate-upload detection."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from passagework.operators.chunks import build_chunks
from passagework.operators.pages import classify_pages
from passagework.sources.documents import DOCUMENT_SCHEMA, fingerprint
from passagework.sources.lineage import cut, dealt

#: Hexadecimal digits of a hash that name its folder.
HASH_HEAD = 2
#: Room for the micro-batches of one generation of a stream.
GENERATION = 1_000_000_000


def _newest(batch: DataFrame) -> DataFrame:
    """One row per document: of copies in the same micro-batch the newest file wins."""
    return batch.groupBy(F.col("source").alias("document_id")).agg(
        F.max_by("pages", F.struct("modified_at", "file")).alias("pages"))


def _attempt() -> str:
    """A name that sorts by time."""
    return f"t{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"


def ingest_batch(batch: DataFrame, store: str, version: int) -> None:
    """Chunk every document of a micro-batch and publish them as ``version``.

    Every attempt writes a path of its own and the manifest that makes it visible last, so a replayed batch takes nothing
    from a reader of its first attempt.  A document's newest version, and of one version the newest attempt, replaces
    all its older chunks, also when it now has fewer, and nothing already stored is rewritten.
    """
    attempt = f"version={version}/attempt={_attempt()}"
    # Half a split is what a task holds, however much a batch brings: the plan is long, and more tasks than that cost more than they even out.
    docs = _newest(dealt(batch, "source", shares=2, least=2))
    page = docs.select("document_id", F.explode("pages").alias("p")).select(
        "document_id", "p.page_number", F.coalesce("p.text", F.lit("")).alias("text"))
    chunks = build_chunks(classify_pages(page))
    chunks.write.parquet(f"{store}/chunks/{attempt}")
    batch.select(F.col("source").alias("document_id")).distinct().write.parquet(f"{store}/manifest/{attempt}")


def stream_chunk_ingest(spark: SparkSession, source: str, store: str, checkpoint: str, generation: int = 0,
                        files_per_batch: int = 1000, multi_line: bool = False) -> StreamingQuery:
    """Ingest document JSON files as they arrive; a whole document lies in one file.

    A stream restarted with a fresh checkpoint must take a higher ``generation``, so that its versions are newer.
    """
    docs = (
        spark.readStream.schema(DOCUMENT_SCHEMA).option("maxFilesPerTrigger", files_per_batch)
        .option("multiLine", multi_line).json(source)
        .select("source", "pages", F.col("_metadata.file_modification_time").alias("modified_at"),
                F.col("_metadata.file_path").alias("file")))
    return (
        docs.writeStream.foreachBatch(lambda df, batch_id: ingest_batch(df, store, generation * GENERATION + batch_id))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def current_chunks(spark: SparkSession, store: str) -> DataFrame:
    """Chunks of each document's newest published version."""
    manifest = spark.read.option("basePath", f"{store}/manifest").parquet(f"{store}/manifest")
    newest = manifest.groupBy("document_id").agg(F.max(F.struct("version", "attempt")).alias("v")).select("document_id", "v.*")
    chunks = spark.read.option("basePath", f"{store}/chunks").parquet(f"{store}/chunks")
    return chunks.join(newest, ["document_id", "version", "attempt"], "left_semi")


def compact(spark: SparkSession, store: str, target: str) -> None:
    """Write the current chunks as the only version of a new store; readers then switch to ``target``."""
    attempt = f"version=0/attempt={_attempt()}"
    current_chunks(spark, store).drop("version", "attempt").write.parquet(f"{target}/chunks/{attempt}")
    spark.read.parquet(f"{store}/manifest").select("document_id").distinct().write.parquet(f"{target}/manifest/{attempt}")


def stream_dedupe_uploads(uploads: DataFrame, delay: str = "1 hour") -> DataFrame:
    """First upload of each (tenant, content) within the watermark ``delay`` of a stream with event time ``ts``.

    State is dropped behind the watermark, so a copy that comes later passes; :func:`stream_new_uploads` catches those too.
    A stream that carries ``sha`` already needs no ``content``, which is then not shuffled.
    """
    hashed = uploads if "sha" in uploads.columns else uploads.withColumn("sha", fingerprint("content"))
    return hashed.withWatermark("ts", delay).dropDuplicatesWithinWatermark(
        ["tenant", "sha"])


def stream_new_uploads(uploads: DataFrame, store: str, checkpoint: str, delay: str = "1 hour") -> StreamingQuery:
    """Publish every (tenant, content) of a stream once, however long after the first a copy comes.

    Two steps.  Keyed state with timers takes copies that are near in time: it is bounded by what arrives within ``delay``.
    What it lets pass meets the stored hashes, which lie in folders by the hash's beginning: a batch reads those of its own
    hashes only.  Uploads that are late by more than ``delay`` are dropped by the watermark, as in any such stream; they are no
    duplicates of what was published, so their sender must send them again.
    """
    # What is published needs no content: only hashes are shuffled and kept as state.
    near = stream_dedupe_uploads(uploads.select("tenant", "ts", fingerprint("content").alias("sha")), delay)
    return (
        near.writeStream.foreachBatch(lambda df, batch_id: publish_new(df, store, batch_id))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def publish_new(batch: DataFrame, store: str, batch_id: int) -> None:
    """Append the uploads of a micro-batch whose (tenant, hash) no other batch has published.

    A batch writes folders of its own number, so a replay writes the same rows again in their place.
    """
    spark = batch.sparkSession
    rows = cut(batch.groupBy("tenant", "sha").agg(F.min("ts").alias("ts")).withColumn("head", F.substring("sha", 1, HASH_HEAD)))
    heads = [r[0] for r in rows.select("head").distinct().collect()]  # at most 16 ** HASH_HEAD
    known = stored_uploads(spark, store).filter(F.col("head").isin(heads) & (F.col("batch") != batch_id)).select("tenant", "sha")
    same = rows["tenant"].eqNullSafe(known["tenant"]) & (rows["sha"] == known["sha"])
    new = rows.join(known, same, "left_anti")
    new.repartition("head").write.mode("overwrite").partitionBy("head").parquet(f"{store}/batch={batch_id}")


def stored_uploads(spark: SparkSession, store: str) -> DataFrame:
    """``tenant``, ``sha``, ``ts`` of all published uploads, with their ``batch`` and the ``head`` of the hash (folders)."""
    schema = "tenant string, sha string, ts timestamp, batch bigint, head string"
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(store)
    if not folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(store)
