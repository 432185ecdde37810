"""Query of toxicity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagework.llm.labels import remainder
from passagework.llm.toxicity import fit, score
from passagework.plans.registry import query
from passagework.sources.tables import table


@query("op7_toxicity_trees")
def op7_toxicity_trees(spark: SparkSession, sf: str) -> DataFrame:
    """Every whole text of ``documents``, learned from the rows whose remainder is not 2."""
    docs = table(spark, sf, "documents")
    model = fit(docs, table(spark, sf, "labels"), remainder(4) != 2)
    return score(docs, model).select(
        "doc_id", (remainder(4) == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
