"""Family A: sources, sinks and table upkeep.  Stage files are written by Spark from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from passagework import constants as K
from passagework.plans import sqltext as Q
from passagework.plans.registry import query
from passagework.plans.views import text_pages
from passagework.sources import documents as D
from passagework.sources.lineage import new_folder
from passagework.sources.tables import table


def _folder(spark) -> str:
    return new_folder(spark, "passagework-stage")


def write_documents(spark, sf) -> str:
    """``documents`` as nested document JSON, one object per line."""
    path = _folder(spark)
    pages = text_pages(spark, sf)
    page = F.struct(F.col("page_number").cast("int").alias("page_number"), F.col("text"),
                    F.length("text").alias("char_count"), F.col("image_count").cast("int").alias("image_count"))
    docs = pages.groupBy("document_id", "source").agg(F.array_sort(F.collect_list(page)).alias("pages"))
    D.write_stage(docs.select(
        F.col("document_id").alias("source"), F.concat(F.lit("Guide "), F.col("source")).alias("title"),
        F.lit("p").alias("publisher"), F.lit("").alias("url"), F.lit("t").alias("topic"),
        F.size("pages").alias("total_pages"), "pages"), path, "json")
    return path


@query("a1_read_page_documents", f"""with {Q.PAGES}
select document_id as source, 'Guide ' || source as title, page_number, length(text) as char_count, md5(text) as text_md5 from pg""")
def read_page_documents(spark, sf):
    return D.read_page_documents(spark, write_documents(spark, sf), multi_line=False).select(
        "source", "title", "page_number", "char_count", F.md5("text").alias("text_md5"))


@query("a2_require_fields", """select doc_id, concat_ws(',', case when doc_id % 7 = 0 then 'source' end,
  case when doc_id % 11 = 0 then 'lang' end) as missing from documents where doc_id % 7 = 0 or doc_id % 11 = 0
union all select count(*), 'good' from documents where doc_id % 7 <> 0 and doc_id % 11 <> 0""")
def require_fields(spark, sf):
    d = table(spark, sf, "documents")
    n = F.col("doc_id")
    d = d.withColumn("source", F.when(n % 7 != 0, F.col("source"))).withColumn("lang", F.when(n % 11 != 0, F.col("lang")))
    good, rejects = D.require_fields(d, ["source", "text", "lang"])
    return rejects.select("doc_id", F.array_join("missing", ",").alias("missing")).unionByName(
        good.agg(F.count(F.lit(1)).alias("doc_id")).select("doc_id", F.lit("good").alias("missing")))


@query("a3_attach_source_metadata", f"""with r as (select 'src' || n_nationkey as source, n_name as title,
  case when n_regionkey = 1 then '' else 'Region ' || n_regionkey end as publisher, '' as url, null as topic
  from nation where n_regionkey <> 0)
select doc_id, d.source, coalesce(nullif(title, ''), {Q.lit(K.UNKNOWN_TITLE)}) as title,
  coalesce(nullif(publisher, ''), 'UNKNOWN') as publisher, coalesce(url, '') as url, coalesce(topic, '') as topic,
  r.source is not null as registered from documents d left join r on r.source = d.source""")
def attach_source_metadata(spark, sf):
    n = table(spark, sf, "nation").filter(F.col("n_regionkey") != 0)
    registry = n.select(
        F.concat(F.lit("src"), F.col("n_nationkey").cast("string")).alias("source"), F.col("n_name").alias("title"),
        F.when(F.col("n_regionkey") == 1, "").otherwise(
            F.concat(F.lit("Region "), F.col("n_regionkey").cast("string"))).alias("publisher"),
        F.lit("").alias("url"), F.lit(None).cast("string").alias("topic"))
    return D.attach_source_metadata(table(spark, sf, "documents").select("doc_id", "source"), registry)


@query("a4_write_stage", """select source, count(*) as n, sum(length(text))::bigint as chars from documents group by 1""")
def write_stage(spark, sf):
    path = _folder(spark)
    D.write_stage(table(spark, sf, "documents").select("doc_id", "text", "source"), path, partition_by=["source"])
    return spark.read.parquet(path).groupBy("source").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))


@query("a5_load_chunks", """select 'd' || doc_id as chunk_id, source, length(text) as chars from documents""")
def load_chunks(spark, sf):
    path = _folder(spark)
    c = table(spark, sf, "documents").select(
        "doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("chunk_id"), "text", "source")
    one = F.struct("chunk_id", "text", "source")
    # Odd ids go into wrapper objects of at most eight chunks, even ids stay flat.
    wrapped = c.filter("doc_id % 2 = 1").groupBy(F.floor(F.col("doc_id") / 16)).agg(F.collect_list(one).alias("chunks"))
    D.write_stage(wrapped.select("chunks"), path + "/wrapped", "json")
    D.write_stage(c.filter("doc_id % 2 = 0").drop("doc_id"), path + "/flat", "json")
    return D.load_chunks(spark, path + "/*", multi_line=False).select("chunk_id", "source", F.length("text").alias("chars"))


@query("a6_load_queries", """select item_id as id, text as query, 'picked' as kind from benchmark
  where item_id in (select distinct user_id from events)
union all select distinct user_id, null, 'missing' from events where user_id not in (select item_id from benchmark)""")
def load_queries(spark, sf):
    path = _folder(spark)
    b = table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("query"))
    D.write_stage(b.groupBy(F.floor(F.col("id") / 50)).agg(F.collect_list(F.struct("id", "query")).alias("queries")).select(
        "queries"), path, "json")
    ids = table(spark, sf, "events").select(F.col("user_id").alias("id")).distinct()
    picked, missing = D.pick_queries(D.load_queries(spark, path, multi_line=False), ids)
    return picked.select("id", "query", F.lit("picked").alias("kind")).unionByName(
        missing.select("id", F.lit(None).cast("string").alias("query"), F.lit("missing").alias("kind")))


@query("a7_duplicate_uploads", """select lang as tenant, sha256(text) as sha, count(*) as copies from documents
group by 1, 2 having count(*) > 1""")
def duplicate_uploads(spark, sf):
    return D.duplicate_uploads(table(spark, sf, "documents").select(
        F.col("lang").alias("tenant"), F.encode("text", "utf-8").alias("content")))


@query("a8_admit_blobs", """with f as (select doc_id, case when doc_id % 4 = 0 then 'f.txt' else 'F' || doc_id || '.PDF' end as name,
  case when doc_id % 5 = 0 then '' when doc_id % 3 = 0 then text else substr(text, 1, doc_id % 700) || '%PDF-1.7' || text end
  as t, strlen(substr(text, 1, doc_id % 700)) as before, doc_id % 6 = 1 as huge from documents)
select doc_id, case when not name like '%.PDF' then 'not_pdf_extension' when huge then 'file_too_large'
  when t = '' then 'empty_file' when doc_id % 3 = 0 or before + 5 > 1024 then 'not_a_pdf' end as reason from f""")
def admit_blobs(spark, sf):
    n = F.col("doc_id")
    t = F.when(n % 5 == 0, F.lit("")).when(n % 3 == 0, F.col("text")).otherwise(F.concat(
        F.substring(F.col("text"), F.lit(1), (n % 700).cast("int")), F.lit("%PDF-1.7"), F.col("text")))
    files = table(spark, sf, "documents").select(
        "doc_id", F.when(n % 4 == 0, F.lit("f.txt")).otherwise(F.concat(F.lit("F"), n.cast("string"), F.lit(".PDF"))).alias(
            "name"), F.encode(t, "utf-8").alias("content"))
    size = F.when(n % 6 == 1, F.lit(K.MAX_UPLOAD_BYTES + 1)).otherwise(F.octet_length("content"))
    return D.admit_blobs(files.withColumn("length", size)).select("doc_id", "reason")


_DOCS = """dc as (select doc_id as document_id, case when doc_id % 3 = 0 then 'processing' else 'ready' end as status,
  doc_id % 2 = 0 and doc_id % 3 <> 0 as verified, case when doc_id % 2 = 0 and doc_id % 3 <> 0 then 'old' end as verified_by
  from documents), ds as (select doc_id as document_id, quality = 1 as v from labels
  union all select 1000000 + doc_id, true from labels
  union all select doc_id, quality <> 1 from labels where doc_id % 5 = 0), dl as (select doc_id as document_id, quality = 1 as v from labels)"""


def _documents(spark, sf):
    n = F.col("doc_id")
    ok = (n % 2 == 0) & (n % 3 != 0)
    d = table(spark, sf, "documents").select(
        n.alias("document_id"), F.when(n % 3 == 0, "processing").otherwise("ready").alias("status"), ok.alias("verified"),
        F.when(ok, F.lit("old")).alias("verified_by"), F.lit(None).cast("timestamp").alias("verified_at"))
    lab = table(spark, sf, "labels")
    at, before = (F.lit(f"2024-0{m}-01 00:00:00").cast("timestamp") for m in (2, 1))
    dec = lab.select(F.col("doc_id").alias("document_id"), (F.col("quality") == 1).alias("verified"), at.alias("decided_at")).unionAll(
        lab.select(F.col("doc_id") + 1_000_000, F.lit(True), at)).unionAll(
        lab.filter("doc_id % 5 = 0").select("doc_id", F.col("quality") != 1, before)).withColumn("decided_by", F.lit("new"))
    return d, dec


@query("a9_apply_verification", f"""with {_DOCS}
select document_id, status, case when v is null then verified when not v then false when status = 'ready' then true
    else verified end as verified,
  case when v is null then verified_by when not v then null when status = 'ready' then 'new' else verified_by end as verified_by
from dc left join dl using (document_id)""")
def apply_verification(spark, sf):
    return D.apply_verification(*_documents(spark, sf))[0].select("document_id", "status", "verified", "verified_by")


@query("a9_verification_conflicts", f"""with {_DOCS}
select document_id, v as verified, case when status is null then 'document_not_found' else 'not_ready' end as reason
from ds left join dc using (document_id) where status is null or (v and status <> 'ready')""")
def verification_conflicts(spark, sf):
    return D.apply_verification(*_documents(spark, sf))[1]


@query("a10_finalize_ingestion", """select doc_id as document_id,
  case when doc_id % 4 = 0 then 'processing' when doc_id % 5 = 0 then 'failed' else 'ready' end as status,
  case when doc_id % 4 = 0 or doc_id % 5 <> 0 then doc_id % 2 = 0 else false end as verified,
  case when doc_id % 4 <> 0 and doc_id % 5 = 0 then substr(text, 1, 2000) end as processing_error,
  case when doc_id % 4 = 0 or doc_id % 5 = 0 then null else 1 + doc_id % 9 end as page_count,
  case when doc_id % 4 = 0 then null when doc_id % 5 = 0 then 0 else length(text) // 850 end as chunk_count from documents""")
def finalize_ingestion(spark, sf):
    d, n = table(spark, sf, "documents"), F.col("doc_id")
    none = F.lit(None)
    docs = d.select(n.alias("document_id"), F.lit("processing").alias("status"), (n % 2 == 0).alias("verified"),
                    none.cast("string").alias("processing_error"), none.cast("bigint").alias("page_count"),
                    none.cast("bigint").alias("chunk_count"))
    out = d.filter(n % 4 != 0).select(
        n.alias("document_id"), (n % 9 + 1).alias("page_count"), F.floor(F.length("text") / 850).alias("chunk_count"),
        F.when(n % 5 == 0, F.col("text")).alias("error"), F.lit(2).alias("finished_at"))
    again = out.filter(F.col("document_id") % 3 == 0).withColumns(
        {"error": F.when(F.col("error").isNull(), F.lit("first try")), "finished_at": F.lit(1)})
    return D.finalize_ingestion(docs, out.unionByName(again))


def _chunks(spark, sf):
    n = F.col("doc_id")
    return table(spark, sf, "documents").select(
        "doc_id", F.concat(F.lit("d"), n.cast("string")).alias("chunk_id"), F.col("source").alias("tenant"),
        F.concat(F.lit("doc"), F.floor(n / 10).cast("string")).alias("document_id"), "text")


def tenant_chunks(spark, sf):
    """Chunks in a folder for each tenant, each split by document."""
    path = _folder(spark)
    D.write_tenant_stage(_chunks(spark, sf), path, "tenant", "document_id")
    return spark.read.parquet(path)


@query("a11_upsert_chunks", """select 'd' || doc_id as chunk_id, case when doc_id % 3 = 0 then 'new' else 'old' end as version,
  length(text) as chars from documents where doc_id % 2 = 0 or doc_id % 3 = 0""")
def upsert_chunks(spark, sf):
    c = _chunks(spark, sf)
    cols = ("chunk_id", F.length("text").alias("chars"))
    old = c.filter("doc_id % 2 = 0").select(*cols, F.lit("old").alias("version"))
    new = c.filter("doc_id % 3 = 0").select(*cols, F.lit("new").alias("version"))
    new = new.unionByName(c.filter("doc_id % 6 = 0").select(*cols, F.lit("late").alias("version")))
    return D.upsert_chunks(D.upsert_chunks(old, new, "version"), new, "version")


@query("a11_replace_documents", """select 'd' || doc_id as chunk_id, case when (doc_id // 10) % 3 = 0 then 'new' else 'old' end
  as version from documents where (doc_id // 10) % 3 <> 0 or doc_id % 2 = 0""")
def replace_documents(spark, sf):
    c = _chunks(spark, sf)
    new = c.filter("floor(doc_id / 10) % 3 = 0 and doc_id % 2 = 0").withColumn("version", F.lit("new"))
    return D.replace_documents(c.withColumn("version", F.lit("old")), new).select("chunk_id", "version")


@query("a12_delete_document_chunks", """select tenant, count(*) as remaining from (select source as tenant, doc_id // 10 as b
  from documents) where b not in (select doc_id from labels where toxic = 1) group by 1""")
def delete_document_chunks(spark, sf):
    ids = table(spark, sf, "labels").filter("toxic = 1").select(
        F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("document_id"))
    return D.delete_document_chunks(_chunks(spark, sf), ids).groupBy("tenant").agg(F.count(F.lit(1)).alias("remaining"))


@query("a13_drop_tenant", "select source as tenant, count(*) as n from documents where source <> 'src3' group by 1")
def drop_tenant(spark, sf):
    """Chunks stored by tenant: the folder of the one that goes is not read."""
    return D.drop_tenant(tenant_chunks(spark, sf), "src3").groupBy("tenant").agg(F.count(F.lit(1)).alias("n"))


@query("a14_latest_run", """with r as (select *, row_number() over (partition by event_type order by ts desc, event_id desc) as k
  from events) select event_type as provider, event_id as run_id, round(value, 4) as score from r where k = 1""")
def latest_run(spark, sf):
    path = _folder(spark)
    D.write_stage(table(spark, sf, "events").select(
        F.col("event_type").alias("provider"), F.col("event_id").alias("run_id"), F.col("ts").alias("created_at"),
        F.col("value").alias("score")), path, "json")
    runs = D.read_runs(spark, path, "provider string, run_id bigint, created_at timestamp, score double")
    return D.latest_run(runs, ["provider"]).select("provider", "run_id", F.round("score", 4).alias("score"))


@query("a15_chunks_to_rows", """select 'doc' || (doc_id // 10) as document_id, source as clinic_id, md5(text) as content_md5,
  'S' as section_title, doc_id % 97 + 1 as page_number, 'd' || doc_id as vector_ref from documents""")
def chunks_to_rows(spark, sf):
    c = _chunks(spark, sf).withColumn("section_title", F.lit("S")).withColumn("page_number", F.col("doc_id") % 97 + 1)
    return D.chunks_to_rows(c, F.col("tenant")).withColumn("content_md5", F.md5("content")).drop("content")
