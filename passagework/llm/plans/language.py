"""Queries of language identification."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from passagework.llm.language import EV, evidence_of_documents, evidence_of_pages, identify
from passagework.plans.registry import query
from passagework.sources.tables import table


@query("op10_language_fusion")
def op10_language_fusion(spark: SparkSession, sf: str) -> DataFrame:
    """Every document by its whole text, its declared language and its source."""
    docs = evidence_of_documents(table(spark, sf, "documents").select("doc_id", "text", "lang", "source"))
    return identify(docs.drop("lang", "source"))


@query("op_pages_language")
def op_pages_language(spark: SparkSession, sf: str) -> DataFrame:
    """Every page by its visible text, its markup's language, its address suffix, host and domain."""
    pages = evidence_of_pages(table(spark, sf, "pages"))
    return identify(pages.withColumnsRenamed({c: EV + c for c in ("declared", "host", "domain", "suffix")}))
