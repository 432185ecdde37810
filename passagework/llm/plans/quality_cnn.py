"""Query of the quality classifier."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagework.llm.labels import remainder
from passagework.llm.quality_cnn import fit, score
from passagework.plans.registry import query
from passagework.sources.tables import table


@query("op4_quality_cnn")
def op4_quality_cnn(spark: SparkSession, sf: str) -> DataFrame:
    """Every whole text of ``documents``, learned from the rows whose remainder is not 0."""
    docs = table(spark, sf, "documents")
    network = fit(docs, table(spark, sf, "labels"), remainder(5) != 0)
    return score(docs, network).select(
        "doc_id", (remainder(5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
