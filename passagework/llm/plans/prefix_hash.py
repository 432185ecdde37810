"""Query of document fingerprints."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from passagework.llm.prefix_hash import compare_with_next
from passagework.plans.registry import query
from passagework.sources.tables import table


@query("op3_prefix_fingerprint")
def op3_prefix_fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    """Every whole text of ``documents`` with its edited text and the next document."""
    return compare_with_next(table(spark, sf, "documents"))
