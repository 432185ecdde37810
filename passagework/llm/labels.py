"""Bounded samples of labelled documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``: the fold of a document."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, learn: Column, rows: int) -> DataFrame:
    """At most ``rows`` labelled documents that ``learn`` allows: ``doc_id``, ``text``, ``label`` (0 or 1), ``fold`` (0 or 1).

    Ids are taken in the order of a hash, so the sample is the same on every run; the ids are bounded by ``rows`` and
    travel to the documents, whose texts do not move.  Of documents with the same text one is kept, so that copies do
    not vote.  Null labels and null ids are left out, an id labelled twice counts with its larger label.
    """
    ids = (labels.filter(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & learn)
           .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col(label).cast("int")).alias("label"))
           .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    found = texts.join(F.broadcast(ids), "doc_id").withColumn("same", F.xxhash64("text"))
    one = found.groupBy("same").agg(F.min_by(F.struct("doc_id", "text", "label"), "doc_id").alias("d")).select("d.*")
    return one.withColumn("fold", F.pmod(F.xxhash64(F.col("doc_id"), F.lit(7)), F.lit(2)).cast("int"))
