"""Five stages from raw documents to packed training sequences.

Each stage takes the documents that its predecessor kept, with all their columns, and its decisions take effect: it drops
rows or cuts text.  The last stage gives the pieces of the packed sequences.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from passagework.llm.decontaminate import remove
from passagework.llm.language import accept
from passagework.llm.line_chunks import remove_repeated
from passagework.llm.near_dedup import keep_one
from passagework.llm.packing import pack
from passagework.sources.lineage import cut
from passagework.sources.tables import table

TOKENIZER = "word_bpe_49k.json"


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages; those whose language the evidence does not settle go."""
    return accept(docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the multi-line chunks that stand earlier in the corpus; documents left without a line go."""
    return remove_repeated(docs)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates on five-word shingles at 0.8."""
    return keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without benchmark passages; documents left without a word go."""
    return remove(docs, table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens."""
    return pack(docs, public_tokenizers.path(TOKENIZER))


STAGES = [("language", identify_language), ("line_dedup", dedup_lines), ("near_dedup", dedup_near), ("decontaminate", decontaminate),
          ("pack", pack_sequences)]

#: Likelihoods of byte hashes, sketches and a tokenizer are beyond SQL; tests hold every stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply every stage to ``documents``; each result but the last is written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
