import json

from pyspark.sql import functions as F

from passagework.operators.chunks import build_chunks
from passagework.operators.pages import classify_pages
from passagework.sources import documents as D
from passagework.streaming import ingest as S


def test_read_one_document_per_file(spark, tmp_path):
    doc = {"source": "a.pdf", "title": "A", "pages": [{"page_number": 1, "text": "x"}, {"page_number": 2, "text": "y"}]}
    (tmp_path / "a.json").write_text(json.dumps(doc, indent=2))
    assert [(r.source, r.page_number) for r in D.read_page_documents(spark, str(tmp_path)).orderBy("page_number").collect()] == [
        ("a.pdf", 1), ("a.pdf", 2)]
    good, bad = D.require_fields(D.read_documents(spark, str(tmp_path)), ["source", "publisher", "pages"])
    assert good.count() == 0 and bad.first().missing == ["publisher"]


def test_load_chunks_takes_both_shapes(spark, tmp_path):
    (tmp_path / "flat.json").write_text(json.dumps([{"chunk_id": "a", "text": "x"}, {"chunk_id": "b", "text": "y"}]))
    (tmp_path / "wrapped.json").write_text(json.dumps({"total_chunks": 1, "chunks": [{"chunk_id": "c", "text": "z"}]}))
    assert sorted(r.chunk_id for r in D.load_chunks(spark, str(tmp_path)).collect()) == ["a", "b", "c"]


def test_admission(spark, tmp_path):
    (tmp_path / "ok.PDF").write_bytes(b"junk %PDF-1.7 body")
    (tmp_path / "late.pdf").write_bytes(b"x" * 1020 + b"%PDF-1.7")
    (tmp_path / "none.pdf").write_bytes(b"")
    (tmp_path / "note.txt").write_bytes(b"%PDF-1.7")
    names = spark.createDataFrame([("ok.PDF",), ("late.pdf",), ("none.pdf",), ("note.txt",)], "name string")
    got = {r.name: r.reason for r in D.admit_blobs(D.read_uploads(spark, str(tmp_path), names)).collect()}
    assert got == {"ok.PDF": None, "late.pdf": "not_a_pdf", "none.pdf": "empty_file", "note.txt": "not_pdf_extension"}


def test_publish_outcomes(spark):
    docs = spark.createDataFrame(
        [("good", "processing", False, None, None, None), ("bad", "processing", True, None, None, 9)],
        "document_id string, status string, verified boolean, processing_error string, page_count bigint, chunk_count bigint")
    out = spark.createDataFrame([("good", 3, 12, None), ("good", None, None, "first try"), ("bad", None, None, "e" * 3000)],
                                "document_id string, page_count bigint, chunk_count bigint, error string")
    r = {x.document_id: x for x in D.finalize_ingestion(docs, out).collect()}
    assert D.finalize_ingestion(docs, out).count() == 2
    assert (r["good"].status, r["good"].verified, r["good"].chunk_count) == ("ready", False, 12)
    assert (r["bad"].status, r["bad"].verified, r["bad"].chunk_count, len(r["bad"].processing_error)) == ("failed", False, 0, 2000)


def test_upsert_and_delete(spark):
    c = spark.createDataFrame([("1", "a", "old"), ("2", "a", "old"), ("3", "b", "old")], "chunk_id string, document_id string, v string")
    new = spark.createDataFrame([("1", "a", "new")], c.schema)
    once = D.upsert_chunks(c, new)
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, D.upsert_chunks(once, new).collect()))
    ids = spark.createDataFrame([("a",)], "document_id string")
    assert D.delete_document_chunks(c, ids).count() == 1
    assert sorted(r.chunk_id for r in D.replace_documents(c, new).collect()) == ["1", "3"]


def test_repeated_updates_keep_one_row(spark):
    docs = spark.createDataFrame([("a", "ready", False, None, None), ("b", "ready", True, "x", None)],
                                 "document_id string, status string, verified boolean, verified_by string, verified_at string")
    dec = spark.createDataFrame([("a", True, "p", "1"), ("a", False, "q", "2"), ("b", False, "p", "1"), ("b", True, "q", "3")],
                                "document_id string, verified boolean, decided_by string, decided_at string")
    got = {r.document_id: (r.verified, r.verified_by) for r in D.apply_verification(docs, dec)[0].collect()}
    assert got == {"a": (False, None), "b": (True, "q")} and D.apply_verification(docs, dec)[0].count() == 2
    new = spark.createDataFrame([("1", "b", 1), ("1", "a", 2), ("2", "c", 0)], "chunk_id string, v string, n int")
    assert sorted(map(tuple, D.upsert_chunks(new.limit(0), new, "n").collect())) == [("1", "a", 2), ("2", "c", 0)]
    assert sorted(r.v for r in D.upsert_chunks(new.limit(0), new).collect()) == ["b", "c"]


def document(name, pages):
    text = "Offer the plan to adults and review it after some months. " * 12
    return json.dumps({"source": name, "pages": [{"page_number": n, "text": f"{n}.1 Managing part {n}\n{text}"} for n in range(1, pages + 1)]})


def test_stream_ingest_replaces_whole_documents(spark, tmp_path):
    src, store = tmp_path / "in", str(tmp_path / "store")
    src.mkdir()
    (src / "a.json").write_text(document("a", 3))
    (src / "b.json").write_text(document("b", 2))

    def run():
        S.stream_chunk_ingest(spark, str(src), store, str(tmp_path / "cp"), files_per_batch=1).awaitTermination()
        return {(r.document_id, r.chunk_id) for r in S.current_chunks(spark, store).collect()}

    def batch(*docs):
        rows = [(d, n, f"{n}.1 Managing part {n}\n" + "Offer the plan to adults and review it after some months. " * 12)
                for d, k in docs for n in range(1, k + 1)]
        pages = spark.createDataFrame(rows, "document_id string, page_number int, text string")
        return {(r.document_id, r.chunk_id) for r in build_chunks(classify_pages(pages)).collect()}

    assert run() == batch(("a", 3), ("b", 2))
    assert run() == batch(("a", 3), ("b", 2))
    (src / "a-again.json").write_text(document("a", 1))
    assert run() == batch(("a", 1), ("b", 2))
    S.compact(spark, store, str(tmp_path / "compacted"))
    assert {(r.document_id, r.chunk_id) for r in S.current_chunks(spark, str(tmp_path / "compacted")).collect()} == batch(("a", 1), ("b", 2))


def test_number_of_micro_batches_does_not_grow_with_the_files(spark, tmp_path, monkeypatch):
    """Documents in many files come in two micro-batches a generation, and every one of them in both generations."""
    from passagework.plans import streams
    monkeypatch.setattr(streams, "new_folder", lambda spark, kind: str(tmp_path / "stream"))
    settings = {"spark.sql.shuffle.partitions": "24", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        streams.stream_chunk_ingest(spark, "/root/testdata/sf0.001")
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    manifest = spark.read.parquet(f"{tmp_path}/stream/store/manifest")
    versions = {r.version: r.n for r in manifest.groupBy("version").agg(F.countDistinct("document_id").alias("n")).collect()}
    documents = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("source", F.floor(F.col("doc_id") / 1000)).distinct().count()
    assert sorted(versions) == [0, 1, S.GENERATION, S.GENERATION + 1]
    assert versions[0] + versions[1] == versions[S.GENERATION] + versions[S.GENERATION + 1] == documents


def test_replayed_batch_changes_nothing(spark, tmp_path):
    page = "struct<page_number:int,text:string,char_count:int,image_count:int,page_type:string>"
    rows = spark.read.schema(f"source string, pages array<{page}>").json(
        spark.sparkContext.parallelize([document("a", 2)])).withColumn("modified_at", F.current_timestamp()).withColumn("file", F.lit("f"))
    store = str(tmp_path / "s")
    S.ingest_batch(rows, store, 0)
    n = S.current_chunks(spark, store).count()
    S.ingest_batch(rows, store, 0)
    assert n > 0 and S.current_chunks(spark, store).count() == n


def test_duplicate_uploads_are_dropped_once_per_tenant(spark, tmp_path):
    rows = [("a", b"x", 0), ("a", b"x", 5), ("b", b"x", 6), ("a", b"y", 7)]
    df = spark.createDataFrame(rows, "tenant string, content binary, s bigint")
    df.select("tenant", "content", F.timestamp_seconds("s").alias("ts")).write.parquet(str(tmp_path / "in"))
    up = spark.readStream.schema("tenant string, content binary, ts timestamp").parquet(str(tmp_path / "in"))
    S.stream_dedupe_uploads(up).select("tenant", "sha").writeStream.format("parquet").option("path", str(tmp_path / "out")).option(
        "checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3


def test_copies_long_after_the_first(spark, tmp_path):
    """A copy two hours later, under a watermark of one, is not published again; nor is a replayed batch; late files are dropped."""
    from passagework.streaming import ingest
    day = "2024-01-01 "
    parts = [[("a", "x", "10:00:00"), ("a", "x", "10:10:00"), ("a", "y", "10:00:00"), ("b", "x", "10:00:00")],
             [("a", "x", "12:30:00"), ("a", "z", "12:30:00"), (None, "x", "12:30:00")],
             [("a", "late", "09:00:00"), ("a", "x", "20:00:00"), ("b", "w", "20:00:00"), (None, "x", "23:00:00")]]
    for k, rows in enumerate(parts):
        df = spark.createDataFrame([(t, c.encode(), day + at) for t, c, at in rows], "tenant string, content binary, at string")
        df.selectExpr("tenant", "content", "cast(at as timestamp) ts").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    uploads = spark.readStream.schema("tenant string, content binary, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    store = str(tmp_path / "store")
    query = ingest.stream_new_uploads(uploads, store, str(tmp_path / "checkpoint"))
    query.awaitTermination()
    from pyspark.sql import functions as F
    published = ingest.stored_uploads(spark, store)
    sha = {c: spark.range(1).select(F.sha2(F.lit(c), 256)).first()[0] for c in ("x", "y", "z", "w", "late")}
    want = sorted([("a", sha["x"]), ("a", sha["y"]), ("b", sha["x"]), ("a", sha["z"]), ("None", sha["x"]), ("b", sha["w"])])
    assert sorted((str(r.tenant), r.sha) for r in published.collect()) == want
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]) <= 6
    assert query.recentProgress[-1]["stateOperators"][0]["numRowsTotal"] <= 3  # what lies behind the watermark is dropped
    again = spark.createDataFrame([("a", sha["z"], day + "12:30:00")], "tenant string, sha string, at string").selectExpr("tenant", "sha", "cast(at as timestamp) ts")
    ingest.publish_new(again, store, 77)
    ingest.publish_new(again, store, 1)  # a replay of the batch that published z
    assert ingest.stored_uploads(spark, store).filter(F.col("sha") == sha["z"]).count() == 1


def test_uploads_are_written_split_by_split(spark, tmp_path):
    """No task of the k2 queries writes or reads a fixed share of all uploads, and hashed uploads need no content."""
    from passagework.plans import streams
    d = spark.range(60).selectExpr("id as doc_id", "'en' as lang", "concat('text ', id % 20) as text").repartition(6)
    files = streams._write_uploads(d, F.lit(0), str(tmp_path / "in"))
    assert files == len(list((tmp_path / "in").glob("part-*.parquet"))) == 6
    up = spark.readStream.schema("tenant string, content binary, ts timestamp").parquet(str(tmp_path / "in"))
    hashed = up.select("tenant", "ts", F.sha2("content", 256).alias("sha"))
    assert S.stream_dedupe_uploads(hashed).columns == ["tenant", "ts", "sha"]
