"""Query of cross-tokenizer alignment."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from passagework.llm.alignment import align, scores
from passagework.plans.registry import query
from passagework.sources.tables import table

BYTE_LEVEL, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"


@query("op13_pair_bitmaps")
def op13_pair_bitmaps(spark: SparkSession, sf: str) -> DataFrame:
    """All documents under both tokenizers, with the scores of their links."""
    aligned = align(table(spark, sf, "documents"), public_tokenizers.path(BYTE_LEVEL), public_tokenizers.path(PIECES))
    return scores(aligned).drop("groups")
