"""Query of packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from passagework.llm.packing import pack
from passagework.plans.registry import query
from passagework.sources.tables import table


@query("op6_pack_best_fit")
def op6_pack_best_fit(spark: SparkSession, sf: str) -> DataFrame:
    """All documents in sequences of 2048."""
    return pack(table(spark, sf, "documents"), public_tokenizers.path("word_bpe_49k.json"))
