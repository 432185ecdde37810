"""Query of personal data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from passagework.llm.pii import digests, personal_data
from passagework.plans.registry import query
from passagework.sources.tables import table


@query("op5_pii_anchors")
def op5_pii_anchors(spark: SparkSession, sf: str) -> DataFrame:
    """Every whole text of ``documents``."""
    return digests(personal_data(table(spark, sf, "documents")))
