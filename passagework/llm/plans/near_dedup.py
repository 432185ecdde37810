"""Query of near-duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from passagework.llm.near_dedup import near_duplicates
from passagework.plans.registry import query
from passagework.sources.tables import table


@query("op8_setsketch_dedup")
def op8_setsketch_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Every whole text of ``documents`` on two-word shingles at 0.8."""
    return near_duplicates(table(spark, sf, "documents"), width=2)
