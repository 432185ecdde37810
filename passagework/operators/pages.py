"""Page quality, removal of repeated page furniture, page classification.

A page table has ``document_id, page_number, text`` plus whatever else travels along.  A document is one uploaded
file, bounded by the upload limit (``K.MAX_UPLOAD_BYTES``), so windows over one document hold a bounded group;
nothing here groups by tenant or source.  The first window hash-partitions the pages once by ``document_id``, unless they lie
so already, and every later step of the family reuses that partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passagework import constants as K
from passagework.functions import text as T
from passagework.functions.once import once
from passagework.functions.windows import top_per_key

DOC = "document_id"
DOC_PAGE = [DOC, "page_number"]


def page_quality(pages: DataFrame) -> DataFrame:
    """Add ``char_count`` and ``suspected_scanned`` (an image but hardly any text)."""
    n = F.length("text")
    return pages.withColumn("char_count", n).withColumn(
        "suspected_scanned", (F.col("image_count") > 0) & (n < K.TEXT_PAGE_MIN_CHARS)
    )


def extraction_report(pages: DataFrame) -> DataFrame:
    """One quality row per document; ``pages`` must carry :func:`page_quality` columns.

    Where pages carry the document's declared ``total_pages``, that number counts, so a document read in part has the
    ratio of the whole; otherwise, or where it is null, the page rows are counted.
    """
    chars = F.coalesce(F.col("char_count"), F.lit(0))
    total, text_pages = F.col("total_pages"), F.col("text_pages")
    scanned = F.size("suspected_scanned_pages")
    agg = pages.groupBy(DOC).agg(
        (F.coalesce(F.max("total_pages").cast("bigint"), F.count(F.lit(1))) if "total_pages" in pages.columns else F.count(F.lit(1))).alias(
            "total_pages"),
        F.count_if(chars >= K.TEXT_PAGE_MIN_CHARS).alias("text_pages"),
        F.sort_array(F.collect_list(F.when(chars == 0, F.col("page_number")))).alias("empty_pages"),
        F.sort_array(F.collect_list(F.when(F.col("suspected_scanned"), F.col("page_number")))).alias(
            "suspected_scanned_pages"),
        F.sum(chars).alias("total_characters"),
    )
    ratio = F.when(total > 0, text_pages / total).otherwise(F.lit(0.0))
    needed = F.greatest(F.lit(1), F.ceil(total * F.lit(K.MIN_TEXT_PAGE_RATIO)))
    usable = (total > 0) & (F.col("total_characters") >= K.DOCUMENT_MIN_CHARS) & (text_pages >= needed)
    return (
        agg.withColumn("text_page_ratio", F.round(ratio, 4))
        .withColumn("usable", usable)
        .withColumn(
            "warnings",
            F.array_compact(F.array(
                F.when(scanned > 0, F.concat(scanned.cast("string"),
                                             F.lit(" page(s) appear image-only with no extractable text"))),
                F.when(F.col("usable") & (ratio < 0.5), F.lit(K.LOW_TEXT_WARNING)),
            )),
        )
    )


def gate_documents(report: DataFrame) -> DataFrame:
    """Add ``accepted``, ``code`` and ``message``.

    Failures found before the text was read (``encrypted_pdf``, ``empty_pdf``, ``invalid_pdf``) or after chunking
    (``no_chunks``) arrive in an optional ``stage_code`` column and win over the text check.
    """
    scanned = F.size("suspected_scanned_pages") > 0
    stage = F.col("stage_code") if "stage_code" in report.columns else F.lit(None).cast("string")
    code = F.coalesce(stage, F.when(~F.col("usable"), F.lit(K.INSUFFICIENT_TEXT)))
    return (
        report.withColumn("code", code)
        .withColumn("accepted", F.col("code").isNull())
        .withColumn(
            "message",
            F.when(F.col("code") == K.INSUFFICIENT_TEXT,
                   F.when(scanned, F.lit(K.SCANNED_MESSAGE)).otherwise(F.lit(K.SHORT_MESSAGE))),
        )
    )


def sample_pages(pages: DataFrame, n: int = 3) -> DataFrame:
    """First ``n`` pages with more than 100 characters per document, with a 400-character preview."""
    full = pages.filter(F.length("text") > 100)
    head = F.translate(F.substring("text", 1, 400), "\n", " ")
    preview = F.when(F.length("text") > 400, F.concat(head, F.lit("..."))).otherwise(head)
    return top_per_key(
        full.select(DOC, "page_number", F.length("text").alias("char_count"), preview.alias("preview")),
        [DOC], ["page_number"], n, "sample")


# --- lines and furniture ------------------------------------------------------------------------------
def page_lines(pages: DataFrame) -> DataFrame:
    """One row per line with its position and whether it lies within the page edge."""
    n = F.size("__lines")
    lines = pages.withColumn("__lines", F.split("text", "\n")).select(
        *[c for c in pages.columns if c != "text"], n.alias("line_count"), F.posexplode_outer("__lines").alias("pos", "line"))
    return lines.withColumn(
        "is_edge", (F.col("pos") < K.EDGE_LINES) | (F.col("pos") >= F.col("line_count") - K.EDGE_LINES))


def _edge_keys():
    """Distinct furniture keys on the edge of a page, worked out inside the row."""
    lines = F.split("text", "\n")
    # Most pages are edge throughout: their lines are looked at once.
    edge = F.transform(F.element_at(F.transform(F.array(lines), lambda x: F.when(F.size(x) <= 2 * K.EDGE_LINES, x).otherwise(
        F.concat(F.slice(x, 1, K.EDGE_LINES), F.slice(F.reverse(x), 1, K.EDGE_LINES)))), 1), T.strip)
    usable = F.filter(edge, lambda x: (x != "") & (F.length(x) <= K.FURNITURE_MAX_LINE) & ~T.is_protected(x))
    return F.array_distinct(F.array_remove(F.transform(usable, T.furniture_key), ""))


def detect_furniture(pages: DataFrame) -> DataFrame:
    """``(document_id, key, pages)`` of edge lines repeated on enough pages of their document.

    Keys are made distinct inside each page row, so the one aggregate counts pages, and it combines map-side; its rows
    without a key count all pages of a document.
    """
    marks = F.concat(F.array(F.lit(None).cast("string")), F.coalesce(_edge_keys(), F.array().cast("array<string>")))
    counts = pages.filter(F.col(DOC).isNotNull()).select(DOC, F.explode(marks).alias("key")).groupBy(DOC, "key").agg(F.count(F.lit(1)).alias("pages"))
    total = F.max(F.when(F.col("key").isNull(), F.col("pages"))).over(Window.partitionBy(DOC))
    return counts.withColumn("__total", total).filter(
        F.col("key").isNotNull() & is_furniture(F.col("__total"), F.col("pages"))).select(DOC, "key", "pages")


def is_furniture(page_count: Column, pages: Column) -> Column:
    """Whether an edge key on ``pages`` of a document's ``page_count`` pages is repeated on enough of them."""
    limit = F.greatest(F.lit(K.FURNITURE_MIN_PAGES), F.floor(page_count * F.lit(K.FURNITURE_PAGE_RATIO)))
    return (page_count >= K.FURNITURE_MIN_PAGES) & (pages >= limit)


def strip_furniture(pages: DataFrame, furniture: DataFrame) -> DataFrame:
    """Drop furniture and page-number lines from page edges; ``removed`` lists the dropped lines.

    The keys of one document travel as one small array to its pages (keyed join, no broadcast).  Where the furniture is that
    of these very pages, :func:`clean_furniture` needs no such join.
    """
    keys = furniture.groupBy(DOC).agg(F.collect_set("key").alias("__keys"))
    return _without_edges(pages.join(keys, DOC, "left").withColumn(
        "__keys", F.coalesce("__keys", F.array().cast("array<string>"))))


def clean_furniture(pages: DataFrame) -> DataFrame:
    """:func:`detect_furniture` and :func:`strip_furniture` on one scan and one exchange of the text.

    Edge keys are worked out in the row.  A page's keys stand beside it as slim rows, which meet in the partition of
    their document: windows there count the pages of each key, and what is repeated often enough comes back to the page rows
    as one small array.  Where the pages lie by document already, nothing is shuffled.
    """
    cols = [c for c in pages.columns if c != DOC]
    keyed = once(pages, __edge=_edge_keys())
    page = F.struct(F.lit(True).alias("__page"), F.lit(None).cast("string").alias("__key"))
    slim = F.transform(F.coalesce("__edge", F.array().cast("array<string>")), lambda k: F.struct(F.lit(False).alias("__page"), k.alias("__key")))
    rows = keyed.select(DOC, *cols, F.inline(F.concat(F.array(page), slim))).select(
        DOC, *[F.when(F.col("__page"), F.col(c)).alias(c) for c in cols], "__page", "__key")
    # One sort serves the three windows; the first one's partitioning by document holds for the second as well.
    whole = Window.partitionBy(DOC).orderBy("__key").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    same = Window.partitionBy(DOC, "__key")
    total = F.count_if("__page").over(whole)
    counted = rows.withColumn("__total", total).withColumn("__pages", F.count(F.lit(1)).over(same))
    told = counted.withColumn("__keys", F.collect_set(F.when(
        F.col("__key").isNotNull() & F.col(DOC).isNotNull() & is_furniture(F.col("__total"), F.col("__pages")), F.col("__key"))).over(whole))
    return _without_edges(told.filter("__page").drop("__page", "__key", "__total", "__pages"))


def _without_edges(joined: DataFrame) -> DataFrame:
    """Lines are judged inside the page row by its ``__keys``, so the text is neither exploded nor collected again.

    A page of a document without furniture on which no line ends like a page number is not cut into lines.
    """
    def drop(t):
        return (t != "") & ~T.is_protected(t) & (
            (F.size("__keys") > 0) & F.array_contains(F.col("__keys"), T.furniture_key(t)) | t.rlike(K.PAGE_NUMBER_LINE))

    lines, e = F.col("__lines"), K.EDGE_LINES
    n = F.size(lines)
    head = F.slice(lines, 1, e)
    middle = F.slice(lines, e + 1, F.greatest(n - 2 * e, F.lit(0)))
    tail = F.when(n > e, F.slice(lines, F.greatest(n - e + 1, F.lit(e + 1)), e)).otherwise(F.slice(lines, 1, 0))
    # A page number ends its line with a digit, or with "of" after one.
    touched = F.coalesce((F.size("__keys") > 0) | F.col("text").rlike(rf"(?md)[0-9](?:\s+(?i:of))?{T.IN_LINE}*$"), F.lit(True))
    split = once(joined, __lines=F.when(touched, F.split("text", "\n")), __whole=F.when(~touched, F.col("text"))).drop("text")
    split = once(split, __head=head, __middle=middle, __tail=tail).drop("__lines")
    split = once(split, __drop=F.transform(F.transform("__head", T.strip), drop), __last=F.transform(F.transform("__tail", T.strip), drop))

    def pick(lines, flags, want: bool):
        return F.filter(lines, lambda x, i: F.element_at(flags, i + 1) == want)

    kept = F.array_join(F.concat(
        pick("__head", F.col("__drop"), False), F.col("__middle"), pick("__tail", F.col("__last"), False)), "\n")
    gone = F.transform(
        F.concat(pick("__head", F.col("__drop"), True), pick("__tail", F.col("__last"), True)), T.strip)
    none = F.when(F.col("__whole").isNotNull(), F.array().cast("array<string>"))
    return once(split, text=T.strip_long(T.two_newlines(F.coalesce("__whole", kept))), removed=F.coalesce(none, gone)).drop(
        "__keys", "__whole", "__head", "__middle", "__tail", "__drop", "__last")


def removed_line_report(stripped: DataFrame, n: int = 10) -> DataFrame:
    """Most common removed lines per document, previewed at 80 characters; ties in text order."""
    counts = stripped.select(DOC, F.explode("removed").alias("line")).groupBy(DOC, "line").agg(
        F.count(F.lit(1)).alias("removed"))
    top = top_per_key(counts, [DOC], [F.desc("removed"), F.asc("line")], n)
    return top.select(DOC, "rank", F.substring("line", 1, 80).alias("line"), "removed")


def drop_empty_pages(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(kept, rejects)``; rejects carry reason ``empty``."""
    blank = T.strip("text") == ""
    return pages.filter(~blank), pages.filter(blank).select(*DOC_PAGE, F.lit("empty").alias("reason"))


def _cleaned(pages: DataFrame) -> DataFrame:
    return once(clean_furniture(pages), text=T.light_clean("text"))


def classify_pages(pages: DataFrame) -> DataFrame:
    """Furniture off, light clean-up, blank pages out, ``page_type`` and ``char_count`` added."""
    kept = _cleaned(pages).filter(F.col("text") != "")  # stripped and never null
    return once(kept, page_type=T.page_type("text")).withColumn("char_count", F.length("text"))


def flagged_pages(pages: DataFrame) -> DataFrame:
    """Pages left out of the content with the reason: empty, copyright or table_of_contents."""
    clean = _cleaned(pages)
    reason = F.when(F.col("text") == "", F.lit("empty")).otherwise(T.page_type("text"))
    return once(clean, reason=reason).select(*DOC_PAGE, "reason").filter(F.col("reason") != "content")


def cleanup_summary(before: DataFrame, after: DataFrame) -> DataFrame:
    """Characters in, out, removed and pages kept, per document and for the whole corpus (null document)."""
    tagged = before.select(DOC, F.length("text").alias("i"), F.lit(0).alias("o"), F.lit(1).alias("pi"),
                           F.lit(0).alias("po")).unionByName(
        after.select(DOC, F.lit(0).alias("i"), F.length("text").alias("o"), F.lit(0).alias("pi"),
                     F.lit(1).alias("po")))
    cin, cout = F.sum("i"), F.sum("o")
    return tagged.rollup(DOC).agg(
        cin.alias("chars_in"), cout.alias("chars_out"), (cin - cout).alias("removed"),
        F.round(F.lit(100.0) * (cin - cout) / F.greatest(cin, F.lit(1)), 1).alias("removed_percent"),
        F.sum("po").alias("pages_kept"), F.sum("pi").alias("pages_total"))


def content_pages(pages: DataFrame) -> DataFrame:
    """Pages whose type is not skipped; a missing type counts as content."""
    return pages.filter(~F.coalesce(F.col("page_type"), F.lit("content")).isin(*K.SKIPPED_PAGE_TYPES))


def skipped_page_counts(pages: DataFrame) -> DataFrame:
    skipped = F.coalesce(F.col("page_type"), F.lit("content")).isin(*K.SKIPPED_PAGE_TYPES)
    return pages.groupBy(DOC).agg(F.count_if(skipped).alias("skipped"), F.count_if(~skipped).alias("kept"))


# --- whole documents ----------------------------------------------------------------------------------
def page_offsets(pages: DataFrame) -> DataFrame:
    """Start offset of each page in its document's text (pages joined with one newline after each)."""
    w = Window.partitionBy(DOC).orderBy("page_number").rowsBetween(Window.unboundedPreceding, -1)
    return pages.withColumn("start_offset", F.coalesce(F.sum(F.length("text") + 1).over(w), F.lit(0)))


def concat_pages(pages: DataFrame) -> DataFrame:
    """One row per document: its whole text and the map of page starts.  One document is one bounded upload."""
    return (
        page_offsets(pages).groupBy(DOC)
        .agg(F.array_sort(F.collect_list(F.struct("page_number", "start_offset", "text"))).alias("p"))
        .select(
            DOC,
            F.concat(F.array_join(F.transform("p", lambda x: x.text), "\n"), F.lit("\n")).alias("text"),
            F.transform("p", lambda x: F.struct(x.start_offset.alias("start"), x.page_number.alias("page"))).alias(
                "page_map"),
        )
    )


def offset_to_page(points: DataFrame, offsets: DataFrame) -> DataFrame:
    """As-of join: last page starting at or before ``offset`` (the first page before any start).

    ``points(document_id, offset, …)`` meet ``offsets(document_id, page_number, start_offset)`` in one ordered
    pass per document.
    """
    extra = [c for c in points.columns if c not in (DOC, "offset")]
    starts = offsets.select(DOC, F.col("start_offset").alias("offset"), "page_number", F.lit(0).alias("__kind"))
    both = points.withColumn("__kind", F.lit(1)).unionByName(starts, allowMissingColumns=True)
    w = Window.partitionBy(DOC).orderBy("offset", "__kind", F.col("page_number"))
    first = Window.partitionBy(DOC)
    page = F.coalesce(
        F.last_value("page_number", ignoreNulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)),
        F.min("page_number").over(first))
    return both.withColumn("__page", page).filter(F.col("__kind") == 1).select(
        DOC, "offset", *extra, F.col("__page").alias("page_number"))
