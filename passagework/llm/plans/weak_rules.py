"""Query of quality rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from passagework.llm.weak_rules import assess
from passagework.plans.registry import query
from passagework.sources.tables import table


@query("op11_weak_rules")
def op11_weak_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Counts, posterior and verdict of every document."""
    return assess(table(spark, sf, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality", "ballot")
