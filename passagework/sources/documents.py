"""Reading and writing document stages, upload admission, document life cycle and chunk store upkeep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from passagework import constants as K
from passagework.functions.once import once

PAGE = "struct<page_number:int,text:string,char_count:int,image_count:int,page_type:string>"
DOCUMENT_SCHEMA = (
    f"source string, title string, publisher string, url string, topic string, total_pages int, pages array<{PAGE}>")
CHUNK_FIELDS = (
    "chunk_id string, document_id string, text string, section_title string, page_number int, source string, "
    "title string, publisher string, url string, topic string, char_count int")
QUERY_FIELDS = (
    "id bigint, query string, category string, scope string, expected_source string, expected_pages array<int>, "
    "expected_recommendation string, must_contain array<string>, abstain_above double, why string")


def _struct(fields: str) -> str:
    return "struct<" + ", ".join(f"{a}:{b}" for a, b in (f.strip().split(" ", 1) for f in fields.split(", "))) + ">"


# --- reading ------------------------------------------------------------------------------------------
def read_documents(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Nested document JSON, one object per file (``multi_line``) or per line."""
    return spark.read.schema(DOCUMENT_SCHEMA).option("multiLine", multi_line).json(path)


def read_page_documents(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """One row per page with the document's provenance."""
    d = read_documents(spark, path, multi_line)
    return d.select("source", "title", "publisher", "url", "topic", "total_pages", F.explode("pages").alias("p")).select(
        "source", "title", "publisher", "url", "topic", "total_pages", "p.*")


def require_fields(df: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """``(good, rejects)``: rejects lack a required field and say which in ``missing``."""
    missing = F.array_compact(F.array(*[
        F.when(F.col(c).isNull(), F.lit(c)) if c in df.columns else F.lit(c) for c in columns]))
    marked = once(df, missing=missing)
    return marked.filter(F.size("missing") == 0).drop("missing"), marked.filter(F.size("missing") > 0)


def attach_source_metadata(documents: DataFrame, registry: DataFrame) -> DataFrame:
    """Provenance by file name with defaults for what the registry lacks; ``registered`` flags known files."""
    reg = registry.select(
        "source", F.col("title").alias("__title"), F.col("publisher").alias("__publisher"), F.col("url").alias("__url"),
        F.col("topic").alias("__topic"), F.lit(True).alias("registered"))

    def value(c: str, default: str) -> Column:
        return F.coalesce(F.nullif(F.col(f"__{c}"), F.lit("")), F.lit(default)).alias(c)

    keep = [c for c in documents.columns if c not in ("title", "publisher", "url", "topic", "source")]
    return documents.join(reg, "source", "left").select(
        "source", *keep, value("title", K.UNKNOWN_TITLE), value("publisher", K.UNKNOWN_PUBLISHER), value("url", ""),
        value("topic", ""), F.coalesce("registered", F.lit(False)).alias("registered"))


def write_stage(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] | None = None) -> None:
    """Persist a stage's output for the next one."""
    writer = df.write.mode("overwrite").format(fmt)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


def write_tenant_stage(df: DataFrame, path: str, tenant: str, document: str, files: int = 8) -> None:
    """Persist a stage in a folder for each tenant, so that reading, searching or dropping one touches no other.

    Rows are dealt by tenant and one of ``files`` parts of its documents: a document lies whole in one file, a large
    tenant is written by many tasks, and a small one is no more than ``files`` files.
    """
    part = F.pmod(F.xxhash64(document), F.lit(files))
    df.repartition(F.col(tenant), part).write.mode("overwrite").partitionBy(tenant).parquet(path)


def load_chunks(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Chunks from a flat list of chunk objects or from objects wrapping a ``chunks`` list."""
    one = _struct(CHUNK_FIELDS)
    raw = spark.read.schema(f"{CHUNK_FIELDS}, chunks array<{one}>").option("multiLine", multi_line).json(path)
    flat = F.struct(*[F.col(f.strip().split(" ", 1)[0]) for f in CHUNK_FIELDS.split(", ")])
    return raw.select(F.explode(F.coalesce("chunks", F.array(flat))).alias("c")).select("c.*")


def load_queries(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """The labelled questions of a ``{"queries": [...]}`` file."""
    raw = spark.read.schema(f"queries array<{_struct(QUERY_FIELDS)}>").option("multiLine", multi_line).json(path)
    return raw.select(F.explode("queries").alias("q")).select("q.*")


def pick_queries(queries: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(picked, missing)`` for wanted ``ids(id, position)``: picked rows carry ``position``, missing ids are listed."""
    return queries.join(ids, "id"), ids.join(queries.select("id"), "id", "left_anti")


# --- uploads ------------------------------------------------------------------------------------------
def fingerprint(content) -> Column:
    return F.sha2(F.col(content) if isinstance(content, str) else content, 256)


def duplicate_uploads(uploads: DataFrame) -> DataFrame:
    """``(tenant, sha, copies)`` of byte-identical uploads within a tenant; only fingerprints are shuffled."""
    return uploads.groupBy("tenant", fingerprint("content").alias("sha")).agg(
        F.count(F.lit(1)).alias("copies")).filter(F.col("copies") > 1)


def read_uploads(spark: SparkSession, path: str, announced: DataFrame | None = None) -> DataFrame:
    """Raw files as ``(name, length, content)``.

    Spark's file source passes over empty files; with ``announced(name)``, the uploads that were registered, those
    come back with length 0.
    """
    files = spark.read.format("binaryFile").load(path).select(
        F.element_at(F.split("path", "/"), -1).alias("name"), "length", "content")
    return files if announced is None else announced.select("name").join(files, "name", "left")


def admit_blobs(files: DataFrame) -> DataFrame:
    """Add ``reason`` (null when admitted): extension, emptiness, size, signature near the start, in this order."""
    signature = F.to_binary(F.lit(K.PDF_SIGNATURE), F.lit("utf-8"))
    head = F.substring("content", 1, K.PDF_SIGNATURE_WINDOW)
    reason = (
        F.when(~F.coalesce(F.endswith(F.lower("name"), F.lit(".pdf")), F.lit(False)), "not_pdf_extension")
        .when(F.coalesce(F.col("length"), F.lit(0)) == 0, "empty_file")
        .when(F.col("length") > K.MAX_UPLOAD_BYTES, "file_too_large")
        .when(~F.contains(head, signature), "not_a_pdf"))
    return files.withColumn("reason", reason)


# --- document rows ------------------------------------------------------------------------------------
def apply_verification(documents: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(documents, conflicts)`` after ``decisions(document_id, verified, decided_by, decided_at)``.

    Only a ready document can be verified; withdrawing works in any state.  Of several decisions on one document the
    latest counts (of equal times the withdrawal, then the greatest decider).  Every decision on an unknown document, or
    that verifies one that is not ready, comes back as a conflict.
    """
    last = F.max_by(F.struct("verified", "decided_by", "decided_at"), F.struct("decided_at", ~F.col("verified"), F.col("decided_by")))
    d = decisions.groupBy("document_id").agg(last.alias("l")).select(
        "document_id", F.col("l.verified").alias("__v"), "l.decided_by", "l.decided_at")
    joined = documents.join(d, "document_id", "left")
    applies = F.col("__v").isNotNull() & (~F.col("__v") | (F.col("status") == "ready"))

    def new(column: str, value: Column) -> Column:
        return F.when(applies, F.when(F.col("__v"), value)).otherwise(F.col(column)).alias(column)

    changed = ("verified", "verified_by", "verified_at")
    out = joined.select(
        *[c for c in documents.columns if c not in changed],
        F.when(applies, F.col("__v")).otherwise(F.col("verified")).alias("verified"),
        new("verified_by", F.col("decided_by")), new("verified_at", F.col("decided_at")))
    state = documents.select("document_id", F.col("status").alias("__status"))
    conflicts = decisions.join(state, "document_id", "left").filter(
        F.col("__status").isNull() | (F.col("verified") & (F.col("__status") != "ready"))).select(
        "document_id", "verified",
        F.when(F.col("__status").isNull(), "document_not_found").otherwise("not_ready").alias("reason"))
    return out, conflicts


def finalize_ingestion(documents: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Publish ``outcomes(document_id, page_count, chunk_count, error)``: ready with counts, or failed without chunks.

    Of several outcomes of one document the latest by an optional ``finished_at`` counts; without times, or at the same
    time, a success before a failure, then the greater counts.  Errors are kept up to 2000 characters, as published.
    """
    time = [F.col("finished_at")] if "finished_at" in outcomes.columns else []
    order = F.struct(*time, F.col("error").isNull().alias("ok"), F.col("page_count"), F.col("chunk_count"), F.col("error"))
    last = F.max_by(F.struct("page_count", "chunk_count", "error"), order)
    outcomes = outcomes.groupBy("document_id").agg(last.alias("l")).select("document_id", "l.*")
    o = outcomes.select("document_id", F.col("page_count").alias("__pages"), F.col("chunk_count").alias("__chunks"),
                        F.substring("error", 1, 2000).alias("__error"), F.lit(True).alias("__done"))
    j = documents.join(o, "document_id", "left")
    done, bad = F.col("__done").isNotNull(), F.col("__error").isNotNull()

    def pick(ready: Column, failed: Column, old: Column) -> Column:
        return F.when(done & bad, failed).when(done, ready).otherwise(old)

    changed = ("status", "verified", "processing_error", "page_count", "chunk_count")
    return j.select(
        *[c for c in documents.columns if c not in changed],
        pick(F.lit("ready"), F.lit("failed"), F.col("status")).alias("status"),
        pick(F.col("verified"), F.lit(False), F.col("verified")).alias("verified"),
        pick(F.lit(None).cast("string"), F.col("__error"), F.col("processing_error")).alias("processing_error"),
        pick(F.col("__pages"), F.col("page_count"), F.col("page_count")).alias("page_count"),
        pick(F.col("__chunks"), F.lit(0).cast("bigint"), F.col("chunk_count")).alias("chunk_count"))


# --- chunk rows ---------------------------------------------------------------------------------------
def upsert_chunks(current: DataFrame, incoming: DataFrame, order: str | None = None) -> DataFrame:
    """Incoming rows replace current ones of the same id; applying the same batch twice changes nothing.

    Of incoming rows with one id the greatest by ``order`` stays, among equals (or without ``order``) the greatest row.
    """
    rest = [c for c in incoming.columns if c != "chunk_id"]
    ranked = F.struct(*([order] if order else []), *[c for c in rest if c != order])
    incoming = incoming.groupBy("chunk_id").agg(F.max_by(F.struct(*rest), ranked).alias("l")).select("chunk_id", "l.*").select(*incoming.columns)
    return incoming.unionByName(current.join(incoming.select("chunk_id"), "chunk_id", "left_anti"))


def delete_document_chunks(chunks: DataFrame, ids: DataFrame) -> DataFrame:
    """Chunks without those of the listed documents."""
    return chunks.join(ids.select("document_id").distinct(), "document_id", "left_anti")


def replace_documents(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Re-ingest: every chunk of an incoming document goes before the new ones come, so none is left behind."""
    return delete_document_chunks(current, incoming).unionByName(incoming)


def drop_tenant(chunks: DataFrame, tenant: str) -> DataFrame:
    """All tenants' chunks but one's; on a table partitioned by tenant only partition names are read."""
    return chunks.filter(F.col("tenant") != tenant)


def latest_run(reports: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Newest evaluation run per group: by ``created_at``, else by the file's modification time."""
    when = F.coalesce("created_at", "modified_at") if "modified_at" in reports.columns else F.col("created_at")
    rest = [c for c in reports.columns if c not in (by or [])]
    best = reports.groupBy(*(by or [])).agg(F.max_by(F.struct(*rest), F.struct(when, "run_id")).alias("r"))
    return best.select(*(by or []), "r.*")


def read_runs(spark: SparkSession, path: str, fields: str) -> DataFrame:
    """Run reports from a directory of JSON files with the file's modification time as ``modified_at``."""
    return spark.read.schema(fields).json(path).withColumn("modified_at", F.col("_metadata.file_modification_time"))


def chunks_to_rows(chunks: DataFrame, tenant: Column) -> DataFrame:
    return chunks.select(
        "document_id", tenant.alias("clinic_id"), F.col("text").alias("content"), "section_title", "page_number",
        F.col("chunk_id").alias("vector_ref"))
