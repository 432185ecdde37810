"""Sections and overlapping chunks with page provenance.

Everything per document runs on one hash partitioning by ``document_id``: pages are spread over lines, headings
become running section numbers, a section's lines come together again and are cut into chunks inside the row.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passagework import constants as K
from passagework.functions import text as T
from passagework.functions.once import once
from passagework.operators.pages import DOC, content_pages, page_offsets


def document_lines(pages: DataFrame) -> DataFrame:
    """Lines of each document in reading order with their character offset.

    Lines are numbered page by page before they are spread, so that every later window has the order of ``line_no`` and
    Spark sorts the lines once.  ``next1`` and ``next2`` are the next two lines where these are short enough to be wrapped
    titles, else null: rows do not carry their neighbours' text.
    """
    ahead = Window.partitionBy(DOC).orderBy("page_number").rowsBetween(Window.unboundedPreceding, -1)
    n = F.greatest(F.size(F.split("text", "\n")), F.lit(1))  # a page without text is one line without text
    placed = page_offsets(pages).withColumn("__ahead", F.coalesce(F.sum(n).over(ahead), F.lit(0)))
    lines = placed.select(
        DOC, "page_number", "start_offset", "__ahead", F.posexplode_outer(F.split("text", "\n")).alias("pos", "line")).withColumn(
        "line_no", (F.col("__ahead") + F.coalesce("pos", F.lit(0)) + 1).cast("int")).drop("__ahead")
    w = Window.partitionBy(DOC).orderBy("line_no")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    short = F.when(F.length("line") <= K.WRAPPED_LINE[1], F.col("line"))
    return (
        lines.withColumn("start", F.coalesce(F.sum(F.length("line") + 1).over(before), F.lit(0)))
        .withColumn("next1", F.lead(short, 1).over(w))
        .withColumn("next2", F.lead(short, 2).over(w))
    )


def _annex_extra() -> Column:
    """How many wrapped lines (2-40 characters each, at most two) belong to an annex title."""
    def fits(c):
        return F.coalesce(F.length(c).between(*K.WRAPPED_LINE), F.lit(False))
    return F.when(fits("next1") & fits("next2"), 2).when(fits("next1"), 1).otherwise(0)


def _swallowed(titles: Column, line_no: Column) -> Column:
    """Walk nearby annex titles in order: a title covers the lines it wraps onto, and a covered one starts nothing."""
    covered = F.aggregate(
        titles, F.lit(0),
        lambda upto, t: F.when((t.n > upto) & (t.n < line_no), t.n + t.x).otherwise(upto))
    return covered >= line_no


def heading_candidates(lines: DataFrame) -> DataFrame:
    """Add ``kind`` (numbered, annex, plain or null), ``heading`` text and whether a blank line follows it.

    An annex title may wrap onto two more lines, which then start no heading of their own.  The title word and
    its number stand on one line.  Whether a line is wrapped text depends only on the unbroken run of titles at
    most two lines apart before it, so the window that gathers titles is cut at every gap.  ``run`` numbers these
    stretches in the order of lines: later windows over (``run``, ``line_no``) find the rows sorted.
    """
    w = Window.partitionBy(DOC).orderBy("line_no")
    title = T.is_annex_heading("line")
    marked = (
        lines.withColumn("annex", title).withColumn("extra", _annex_extra())
        .withColumn("near", F.max(F.col("annex").cast("int")).over(w.rowsBetween(-2, 0)))
        .withColumn("run", F.sum(1 - F.col("near")).over(w.rowsBetween(Window.unboundedPreceding, 0))))
    run = Window.partitionBy(DOC, "run").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    marked = marked.withColumn("titles", F.collect_list(
        F.when(F.col("annex"), F.struct(F.col("line_no").alias("n"), F.col("extra").alias("x")))).over(run))
    kind = (
        F.when((F.size("titles") > 0) & _swallowed(F.col("titles"), F.col("line_no")), F.lit(None))
        .when(T.is_numbered_heading("line"), "numbered")
        .when(F.col("annex"), "annex")
        .when(T.is_plain_heading("line"), "plain"))
    wrapped = (
        F.when(F.col("extra") == 2, F.concat_ws("\n", "line", "next1", "next2"))
        .when(F.col("extra") == 1, F.concat_ws("\n", "line", "next1"))
        .otherwise(F.col("line")))
    return (
        marked.withColumn("kind", kind)
        .withColumn("heading", F.when(F.col("kind") == "annex", wrapped).when(F.col("kind").isNotNull(), F.col("line")))
        .withColumn("blank_follows", F.coalesce(F.col("next1") == "", F.lit(False)))
        .drop("annex", "extra", "near", "titles")
    )


def kept_headings(candidates: DataFrame) -> DataFrame:
    """Add ``is_heading``: a candidate that is no boilerplate and looks like a real heading."""
    return once(candidates, is_heading=_is_heading())


def _is_heading() -> Column:
    keep = (
        F.col("kind").isNotNull()
        & ~T.is_boilerplate_heading("heading")
        & (F.col("kind").isin("numbered", "annex") | F.col("blank_follows") | T.looks_titled("heading"))
    )
    return F.coalesce(keep, F.lit(False))


def split_sections(pages: DataFrame) -> DataFrame:
    """``(document_id, section_no, heading, start, end, text, page_map)`` cut at the kept headings.

    Text before the first heading is ``Preamble``; a document without headings is one ``General`` section; spans
    under 30 characters go.  The heading stays in the text; ``page_map`` lists the section's pages and their starts.
    """
    # No generator comes between the windows (as in kept_headings): it would hide the order of the rows, and their text be sorted again.
    lines = heading_candidates(document_lines(pages)).withColumn("is_heading", _is_heading())
    w = Window.partitionBy(DOC).orderBy("run", "line_no")
    headings = F.sum(F.col("is_heading").cast("int"))
    numbered = lines.withColumn("section_no", headings.over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn(
        "headings", headings.over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    body = numbered.groupBy(DOC, "section_no").agg(
        F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("l"),
        F.min("start").alias("start"),
        F.array_sort(F.collect_set(
            F.struct(F.col("start_offset").alias("start"), F.col("page_number").alias("page")))).alias("page_map"),
        F.max(F.when(F.col("is_heading"), T.squeeze("heading"))).alias("title"),
        (F.max("headings") == 0).alias("general"),
    )
    shaped = once(
        once(body, joined=F.array_join(F.col("l.line"), "\n")).drop("l")
        .withColumn("end", F.col("start") + F.length("joined") + 1),
        stripped=T.strip_long("joined"))
    lead = F.length("joined") - F.length(T.lstrip("joined"))
    return (
        shaped.filter(F.col("general") | (F.length("stripped") >= K.MIN_SECTION_CHARS))
        .select(
            DOC, "section_no",
            F.when(F.col("general"), K.GENERAL).otherwise(F.coalesce("title", F.lit(K.PREAMBLE))).alias("heading"),
            F.when(F.col("general"), F.col("start")).otherwise(F.col("start") + lead).alias("start"),
            "end",
            F.when(F.col("general"), F.concat("joined", F.lit("\n"))).otherwise(F.col("stripped")).alias("text"),
            "page_map",
        )
    )


# --- splitting ----------------------------------------------------------------------------------------
def _atoms(text: str, seps: tuple[str, ...], run: tuple, size: int, overlap: int) -> Iterator[tuple[str, tuple]]:
    """Pieces shorter than ``size`` with the run they may be packed in; longer ones go to the next separator, at last to
    fixed windows, each a run of its own.  Separators stay with the piece after them."""
    if not seps:
        for k, at in enumerate(range(0, max(len(text) - overlap, 1), size - overlap)):
            yield text[at:at + size], (*run, "fixed", k)
        return
    parts = text.split(seps[0])
    pieces = [p for p in (parts[0], *(seps[0] + p for p in parts[1:])) if p]
    for i, piece in enumerate(pieces):
        if len(piece) < size:
            yield piece, run
        else:
            yield from _atoms(piece, seps[1:], (*run, i), size, overlap)


def split_text(text: str, size: int, overlap: int, seps: tuple[str, ...]) -> Iterator[tuple[int, str]]:
    """(start, chunk) of one text, in one walk that holds no more than a chunk's pieces."""
    held: list[tuple[str, int]] = []  # pieces of the open chunk and where they start
    at, open_run = 0, None

    def chunk() -> Iterator[tuple[int, str]]:
        joined = "".join([t for t, _ in held])
        if stripped := joined.strip(T.WHITESPACE):
            yield held[0][1] + len(joined) - len(joined.lstrip(T.WHITESPACE)), stripped

    for piece, run in _atoms(text, seps, (), size, overlap):
        if run[-2:-1] == ("fixed",) and run[-1]:
            at -= overlap  # a window begins inside the one before it
        end = at + len(piece)
        if run != open_run:
            yield from chunk()
            held = []
        elif held and end - held[0][1] > size:
            yield from chunk()
            held = [(t, s) for t, s in held if at - s <= overlap and end - s <= size]
        held.append((piece, at))
        at, open_run = end, run
    yield from chunk()


def split_overlapping(c, size: int = K.CHUNK_SIZE, overlap: int = K.CHUNK_OVERLAP,
                      seps: tuple[str, ...] = K.CHUNK_SEPARATORS) -> Column:
    """Array of ``struct<start,text>``: pieces of at most ``size`` characters overlapping by at most ``overlap``; null for null.

    Text is cut at the coarsest separator (blank line, line, sentence, word, character) that gives pieces below
    ``size``; pieces are packed greedily, separators stay with the piece after them, and each new chunk takes
    over trailing pieces totalling at most ``overlap``.  A piece too long for its separator is cut by the next one
    and packed on its own.  ``start`` is the true offset of the trimmed chunk, so no search is needed to place it.

    Each text is walked once with a cursor, Arrow batch by batch: a fold in SQL copies the growing array of chunks.
    """
    seps = tuple(seps)

    @F.arrow_udf("array<struct<start:int,text:string>>")
    def chunks(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            starts, found, offsets = [], [], [0]
            for text in texts.to_pylist():
                for start, chunk in split_text(text, size, overlap, seps) if text is not None else ():
                    starts.append(start)
                    found.append(chunk)
                offsets.append(len(starts))
            rows = pa.StructArray.from_arrays([pa.array(starts, pa.int32()), pa.array(found, pa.string())], names=["start", "text"])
            yield pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), rows, mask=texts.is_null())

    return chunks(T.col(c))


def split_on_pages(text, start, page_starts, size: int = K.CHUNK_SIZE, overlap: int = K.CHUNK_OVERLAP,
                   seps: tuple[str, ...] = K.CHUNK_SEPARATORS) -> Column:
    """Like :func:`split_overlapping`, with the chunks' ``place`` besides: which of the ascending ``page_starts`` is the last
    at or before it, counted from 1 (null before all).  ``start`` is the text's offset in the document."""
    seps = tuple(seps)

    @F.arrow_udf("array<struct<start:int,text:string,place:int>>")
    def chunks(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, at, pages in batches:
            starts, found, places, offsets = [], [], [], [0]
            for text, base, firsts in zip(texts.to_pylist(), at.to_pylist(), pages.to_pylist(), strict=True):
                for start, chunk in split_text(text, size, overlap, seps) if text is not None else ():
                    starts.append(start)
                    found.append(chunk)
                    places.append(bisect_right(firsts, base + start) or None)
                offsets.append(len(starts))
            rows = pa.StructArray.from_arrays(
                [pa.array(starts, pa.int32()), pa.array(found, pa.string()), pa.array(places, pa.int32())], names=["start", "text", "place"])
            yield pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), rows, mask=texts.is_null())

    return chunks(T.col(text), T.col(start), T.col(page_starts))


def fixed_windows(c, size: int = K.CHUNK_SIZE, overlap: int = K.CHUNK_OVERLAP) -> Column:
    """Array of ``struct<start,text>`` cut every ``size - overlap`` characters, whatever the text says."""
    text, step = T.col(c), size - overlap
    last = F.greatest(F.ceil((F.length(text) - size) / F.lit(step)), F.lit(0)).cast("int")
    return F.transform(F.sequence(F.lit(0), last),
                       lambda k: F.struct((k * step).alias("start"),
                                          F.substring(text, k * step + 1, F.lit(size)).alias("text")))


def drop_tiny_chunks(chunks: DataFrame, minimum: int = K.MIN_CHUNK_CHARS) -> DataFrame:
    return chunks.filter(F.length(T.strip("text")) >= minimum)


def locate_chunk(section, piece, cursor) -> Column:
    """0-based place of ``piece`` at or after ``cursor``: whole, else by its first 40 characters, else -1."""
    s, p, at = T.col(section), T.col(piece), T.col(cursor).cast("int") + 1
    probe = F.substring(p, 1, K.LOCATE_PROBE)
    whole = F.call_function("locate", p, s, at)
    head = F.when(F.length(probe) >= K.LOCATE_PROBE_MIN, F.call_function("locate", probe, s, at)).otherwise(F.lit(0))
    return F.when(p == "", at - 1).when(whole > 0, whole - 1).when(head > 0, head - 1).otherwise(F.lit(-1))


def chunk_ids(chunks: DataFrame, order: list[str]) -> DataFrame:
    """Add ``chunk_index`` (0-based over the document) and ``chunk_id`` ``{document}:p{page}:c{index}``."""
    w = Window.partitionBy(DOC).orderBy(*order)
    return chunks.withColumn("chunk_index", F.row_number().over(w) - 1).withColumn(
        "chunk_id",
        F.concat(F.col(DOC), F.lit(":p"), F.col("page_number").cast("string"), F.lit(":c"),
                 F.col("chunk_index").cast("string")))


def section_chunks(sections: DataFrame) -> DataFrame:
    """Chunks of each section with their document offset and the page they start on; tiny ones are gone.

    The outer explode keeps Spark from splitting every text twice to test for emptiness; a section without chunks
    gives a null text, which the size filter drops.
    """
    cut = sections.select(
        DOC, "section_no", F.col("heading").alias("section_title"), F.col("start").alias("section_start"), "page_map",
        F.posexplode_outer(split_on_pages("text", "start", "page_map.start")).alias("piece_no", "p"))
    # Chunks come stripped.
    return cut.select(
        DOC, "section_no", "section_title", "piece_no", (F.col("section_start") + F.col("p.start")).alias("offset"),
        F.element_at("page_map", F.col("p.place")).page.alias("page_number"),
        F.col("p.text").alias("text")).filter(F.length("text") >= K.MIN_CHUNK_CHARS)


def build_chunks(pages: DataFrame, provenance: DataFrame | None = None) -> DataFrame:
    """Classified pages → chunks carrying page, section and provenance columns.

    One hash partitioning by document serves offsets, headings, sections and chunk numbers: the text is shuffled
    once.  ``provenance`` has one row per document (``document_id, source, title, publisher, url, topic``).
    """
    content = content_pages(pages) if "page_type" in pages.columns else pages
    content = content.select(DOC, "page_number", "text")
    chunks = section_chunks(split_sections(content))
    out = chunk_ids(chunks, ["section_no", "piece_no"]).select(
        "chunk_id", DOC, "chunk_index", "text", "section_title", "page_number")
    return out if provenance is None else out.join(provenance, DOC, "left")


def embed_text(section_title, text) -> Column:
    """Text to embed: an annex title is put in front, other headings are not."""
    h, t = T.col(section_title), T.col(text)
    return F.when(F.startswith(h, F.lit("Annex ")), F.concat(h, F.lit("\n"), t)).otherwise(t)


def index_metadata(chunks: DataFrame) -> DataFrame:
    """Scalar metadata for the index.  A missing document id becomes '' and so matches no id filter."""
    return chunks.select(
        "chunk_id", F.coalesce(DOC, F.lit("")).alias(DOC), "section_title", "page_number", "source", "title",
        "publisher", "url", "topic", embed_text("section_title", "text").alias("page_content"))
