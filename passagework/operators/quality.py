"""Chunk quality report.  ``chunks`` carry at least ``chunk_id, source, text``.

Counts and percentages are single aggregates with map-side combine; example lists are top-n per report, not per key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagework import constants as K
from passagework.functions import text as T
from passagework.functions.stats import count_if
from passagework.functions.windows import row_numbers, top_per_key


def _size_stats(chunks: DataFrame, size: Column) -> DataFrame:
    """min, max, mean and median of a small-domain integer: one row per distinct size, then weighted figures."""
    counts = chunks.select(size.alias("v")).groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(
        F.min("v").alias("min_size"), F.max("v").alias("max_size"),
        F.round(F.sum(F.col("v") * F.col("n")) / F.sum("n"), 2).alias("mean_size"),
        F.round(F.expr("percentile(v, 0.5, n)"), 2).alias("median_size"))


def char_stats(chunks: DataFrame) -> DataFrame:
    return _size_stats(chunks, F.length("text"))


def word_stats(chunks: DataFrame) -> DataFrame:
    return _size_stats(chunks, T.word_count("text"))


def _examples(chunks: DataFrame, keep: Column, n: int, order: str) -> DataFrame:
    return chunks.filter(keep).orderBy(order).limit(n).select(
        "chunk_id", "source", F.length("text").alias("chars"), F.substring("text", 1, 300).alias("text"))


def small_chunks(chunks: DataFrame) -> DataFrame:
    n = F.length(T.strip("text"))
    return chunks.agg(count_if(n < K.SMALL_CHUNK).alias("small"), count_if(n < K.VERY_SMALL_CHUNK).alias("very_small"))


def small_chunk_examples(chunks: DataFrame, order: str, n: int = 10) -> DataFrame:
    return _examples(chunks, F.length(T.strip("text")) < K.SMALL_CHUNK, n, order)


def large_chunks(chunks: DataFrame) -> DataFrame:
    return chunks.agg(count_if(F.length(T.strip("text")) >= K.LARGE_CHUNK).alias("large"))


def large_chunk_examples(chunks: DataFrame, order: str, n: int = 5) -> DataFrame:
    return _examples(chunks, F.length(T.strip("text")) >= K.LARGE_CHUNK, n, order)


def duplicate_texts(chunks: DataFrame, order: str) -> DataFrame:
    """``(order column, text, copies)`` of trimmed non-blank texts seen more than once.

    Texts are counted by SHA-256 fingerprint, so the shuffle moves 32 bytes per distinct text and a group of copies
    shrinks to one row per partition; only the first copy's text is fetched again.
    """
    body = T.strip("text")
    counts = chunks.filter(body != "").groupBy(F.sha2(body, 256).alias("sha")).agg(
        F.count(F.lit(1)).alias("copies"), F.min(order).alias(order)).filter(F.col("copies") > 1)
    return chunks.select(order, body.alias("text")).join(counts.select(order, "copies"), order)


def missing_metadata(chunks: DataFrame, fields: tuple[str, ...] = K.REQUIRED_CHUNK_FIELDS) -> DataFrame:
    """Chunks lacking required fields and which; an absent column counts as missing everywhere."""
    absent = F.array_compact(F.array(*[
        F.when(F.col(f).isNull(), F.lit(f)) if f in chunks.columns else F.lit(f) for f in fields]))
    return chunks.select("chunk_id", absent.alias("missing")).filter(F.size("missing") > 0)


def char_count_mismatch(chunks: DataFrame, stored: str = "char_count") -> DataFrame:
    actual = F.length("text")
    return chunks.filter(F.col(stored).isNotNull() & (F.col(stored) != actual)).select(
        "chunk_id", F.col(stored).alias("stored"), actual.alias("actual"))


def page_citation_rows(chunks: DataFrame, pages: DataFrame) -> DataFrame:
    """Each chunk's verdict: exact, spanning, wrong or skipped.

    The opening 60 squeezed characters must stand on the cited page, or on it and the next page number together.
    Pages are squeezed and moved once, without each other: the probe visits both pages and brings back whether it stands
    there and the 60 characters next to the page break.
    """
    size = 60
    text = pages.select("document_id", F.col("page_number").alias("__at"), T.squeeze("text").alias("page_text"))
    known = pages.select("document_id").distinct().withColumn("known", F.lit(True))
    asked = chunks.select("chunk_id", "document_id", "page_number", F.substring(T.squeeze("text"), 1, size).alias("probe"),
                          F.monotonically_increasing_id().alias("__row"))
    asked = asked.withColumn("__next", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("__at", F.col("page_number") + F.col("__next"))
    here = F.col("__next") == 0
    found = F.coalesce(F.contains(F.col("page_text"), F.col("probe")), F.lit(False))
    edge = F.when(here, F.right(F.col("page_text"), F.lit(size))).otherwise(F.left(F.col("page_text"), F.lit(size)))
    met = (
        asked.join(text, ["document_id", "__at"], "left")
        .select("__row", "chunk_id", "document_id", "page_number", "probe", here.alias("here"), found.alias("found"), edge.alias("edge"))
        .groupBy("__row", "chunk_id", "document_id", "page_number", "probe")
        .agg(F.bool_or(F.col("here") & F.col("found")).alias("on_page"), F.bool_or(~F.col("here") & F.col("found")).alias("on_next"),
             F.max(F.when(F.col("here"), F.col("edge"))).alias("tail"), F.max(F.when(~F.col("here"), F.col("edge"))).alias("head"))
        .join(known, "document_id", "left"))
    across = T.squeeze(F.concat(F.coalesce("tail", F.lit("")), F.lit(" "), F.coalesce("head", F.lit(""))))
    verdict = (
        F.when(F.col("known").isNull() | F.col("page_number").isNull() | (F.length("probe") < 20), "skipped")
        .when(F.col("on_page"), "exact")
        .when(F.col("on_next") | F.contains(across, F.col("probe")), "spanning")
        .otherwise("wrong"))
    return met.select("chunk_id", "document_id", "page_number", "probe", verdict.alias("verdict"))


def page_citation_check(chunks: DataFrame, pages: DataFrame) -> DataFrame:
    return page_citation_rows(chunks, pages).groupBy("verdict").agg(F.count(F.lit(1)).alias("chunks"))


def sentence_boundaries(chunks: DataFrame) -> DataFrame:
    body = T.strip("text")
    starts = body.rlike(r"^\p{Ll}")
    ends = (body != "") & ~body.rlike(r"[.:?!;\]]$")
    total = F.count(F.lit(1))
    return chunks.agg(
        total.alias("total"), count_if(starts).alias("starts_mid"), count_if(ends).alias("ends_mid"),
        F.round(F.try_divide(100.0 * count_if(starts), total), 1).alias("starts_percent"),
        F.round(F.try_divide(100.0 * count_if(ends), total), 1).alias("ends_percent"))


def boilerplate_rate(chunks: DataFrame) -> DataFrame:
    hit, total = F.col("text").rlike(K.CHUNK_BOILERPLATE), F.count(F.lit(1))
    return chunks.agg(
        total.alias("total"), count_if(hit).alias("contaminated"),
        F.round(F.try_divide(100.0 * count_if(hit), total), 1).alias("percent"))


def page_distribution(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy(
        F.coalesce("source", F.lit("unknown")).alias("source"), "page_number").agg(F.count(F.lit(1)).alias("chunks"))


def pages_represented(chunks: DataFrame) -> DataFrame:
    return chunks.agg(F.countDistinct("page_number").alias("pages"))


def source_distribution(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy(F.coalesce("source", F.lit("unknown")).alias("source")).agg(
        F.count(F.lit(1)).alias("chunks"))


def size_consistency(chunks: DataFrame) -> DataFrame:
    n = F.length("text")
    return chunks.filter(T.strip("text") != "").agg(
        F.round(F.avg(n), 2).alias("mean_size"), count_if(n < K.SMALL_CHUNK).alias("very_small"),
        count_if(n > K.LARGE_CHUNK).alias("very_large"))


def example_chunks(chunks: DataFrame, order: str) -> DataFrame:
    """First, middle (``n // 2``) and last chunk in ``order``; a chunk id appears once.

    Positions come from block numbering, so no single task ever orders the whole table.
    """
    one = chunks.withColumn("__all", F.lit(0))
    placed = row_numbers(one.select("__all", order), ["__all"], order, "__n")
    total = placed.agg(F.max("__n").alias("total")).withColumn("__all", F.lit(0))
    n, total_col = F.col("__n"), F.col("total")
    role = (F.when(n == 1, 1).when(n == F.floor(total_col / 2) + 1, 2).when(n == total_col, 3))
    picks = placed.join(F.broadcast(total), "__all").withColumn("role", role).filter(F.col("role").isNotNull())
    rows = one.drop("__all").join(F.broadcast(picks.select(order, "role")), order)
    return top_per_key(rows, ["chunk_id"], ["role"], 1, "__r").drop("__r", "role")
