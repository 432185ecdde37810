"""Every stage of the pipeline, on what its predecessor kept, against a plain version."""

import os

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from passagework.llm.language import OTHER, SURE, evidence_of_documents, identify
from tests.llm.test_decontaminate import brute as hits
from tests.llm.test_line_chunks import brute as without_repeats
from tests.llm.test_near_dedup import brute as groups
from tests.llm.test_packing import check_layout

SF = os.environ.get("PASSAGEWORK_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """Input and results of all stages, each written and read again."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    folder = tmp_path_factory.mktemp("stages")
    out.append(docs)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(folder / str(k)))
        docs = spark.read.parquet(str(folder / str(k)))
        out.append(docs)
    return out


def texts(df):
    return {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}


def test_language(steps):
    kept = texts(steps[1])
    judged = identify(evidence_of_documents(steps[0]).drop("lang", "source", "n_chars")).collect()
    assert kept == {k: v for k, v in texts(steps[0]).items() if k in {r.doc_id for r in judged if r.language != OTHER and r.probability >= SURE}}
    assert len(kept) > 0.98 * steps[0].count()


def test_line_dedup(steps):
    rows = sorted(texts(steps[1]).items())
    want = {k: t for (k, _), (t, n, gone) in zip(rows, without_repeats(rows)) if n == 0 or gone < n}
    assert texts(steps[2]) == want != dict(rows)


def test_near_dedup(steps):
    before = texts(steps[2])
    assert texts(steps[3]) == {k: before[k] for k, v in groups(list(before.items()), 5).items() if v[2]} != before


def test_decontaminate(steps, spark):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    before, after = texts(steps[3]), texts(steps[4])
    clean = {k: t for k, t in before.items() if not hits(t, items)[4]}
    assert {k: after.get(k) for k in clean} == clean
    assert not any(hits(t, items)[4] for t in after.values())
    assert after != before


def test_pack(steps):
    check_layout(steps[5].collect(), texts(steps[4]), 2048)


def test_columns_and_query(steps, spark):
    assert all(s.columns == steps[0].columns for s in steps[:5])
    got = entry.queries()["pipeline"](spark, SF)
    rest = ("doc_id", "start", "length", "ids_crc32", "doc_tokens")
    assert sorted(got.select(*rest).collect()) == sorted(steps[5].select(*rest).collect())


def test_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert out.count() == 0


def test_odd_columns(spark):
    """Columns of the operators' own names, nulls and repeated rows pass through all stages but the last."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60).selectExpr("*", "doc_id as node", "text as spans", "source as key", "1 as n")
    docs = docs.unionByName(docs.limit(3)).unionByName(docs.limit(2).selectExpr(
        "cast(null as bigint) doc_id", "text", "cast(null as string) lang", "cast(null as string) source", "n_chars", "node", "spans", "key", "n"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and 0 < out.count() <= 65
