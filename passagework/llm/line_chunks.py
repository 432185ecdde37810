"""Line dedup: runs of lines that stand earlier in the corpus, found by rolling hashes and removed after byte comparison."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagework.llm.arrow import arrow_map, map_rows, pieces
from passagework.llm.id_filter import split_by_filter
from passagework.sources.lineage import cut

#: Lines under a rolling hash.
WINDOW = 2
#: The rolling hash is a polynomial of this base over 128-bit line hashes.
BASE = 0x9E3779B97F4A7C15F39CC0605CEDC835
#: A line of more words is a chunk of its own.
LONG_LINE_WORDS = 50
BLANKS = " \t\n\v\f\r"
WORD = re.compile(f"[^{BLANKS}]+")

LC = "_lc_"


def line_hash(line: str) -> int:
    """The line's MD5 as an integer."""
    return int.from_bytes(hashlib.md5(line.encode("utf-8", "surrogatepass")).digest(), "big")


def filled_lines(text: str) -> tuple[list[str], list[int]]:
    """All lines of ``text``, and the places of those that hold more than blanks."""
    lines = text.split("\n")
    return lines, [k for k, line in enumerate(lines) if line.strip(BLANKS)]


def anchors(lines: list[str]) -> Iterator[tuple[int, int, bytes]]:
    """(place, number of lines, hash) of every ``WINDOW`` lines in a row, and of every long line by itself.

    A run of lines is found in another text wherever it stands there, because a hash depends on the lines under it alone:
    text put in or taken out before or behind a run changes none of its anchors.  To find runs of no more than ``WINDOW``
    lines wherever they stand, no rule may pass over an anchor.
    """
    hashes = [line_hash(line) for line in lines]
    for k, line in enumerate(lines):
        if k + WINDOW <= len(lines):
            rolled = 0
            for h in hashes[k:k + WINDOW]:
                rolled = (rolled * BASE + h) % (1 << 128)
            yield k, WINDOW, rolled.to_bytes(16, "big")
        if len(line) > 2 * LONG_LINE_WORDS and len(WORD.findall(line)) > LONG_LINE_WORDS:
            yield k, 1, (hashes[k] ^ 1).to_bytes(16, "big")


def joined(lines: list[str], start: int, n: int) -> str:
    return "\n".join(lines[start:start + n])


def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with a key of id and text: rows that share both are one document, an id with two texts is two."""
    return docs.withColumn(LC + "row", F.unhex(F.md5(F.concat_ws("\x01", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce(
        F.col("text").cast("string"), F.lit(""))).cast("binary"))))


def runs(seen: list[tuple[int, int, bytes, int]]) -> list[tuple[int, int, bytes, int]]:
    """(start, lines, first row, start there) of the chunks that ``seen`` anchors (the same four) make together: anchors that
    overlap or touch and lead to the same place of the same row are one chunk."""
    out: list[list] = []
    for start, n, row, there in sorted(seen, key=lambda s: (s[2], s[3] - s[0], s[0], s[1])):
        last = out[-1] if out else None
        if last and last[2] == row and last[3] - last[0] == there - start and start <= last[0] + last[1]:
            last[1] = max(last[1], start + n - last[0])
        else:
            out.append([start, n, row, there])
    return [tuple(r) for r in out]


def repeated_chunks(docs: DataFrame) -> DataFrame:
    """Per key of :func:`keyed` rows the chunks that stand earlier, with the earlier bytes: ``_lc_row``, ``_lc_seen`` (array of
    start among the filled lines, and body).  Earlier is by ``doc_id`` (null first), key and place.

    Hashes of anchors are grouped, at most some forty bytes a line.  A filter of repeated hashes sorts out most of them before
    they meet the first place of their hash; those of one row that lead to one place grow together to a chunk.  Bytes of a
    chunk move once from the first row and once to each row that repeats it.  An anchor or chunk of any number of rows is
    grouped with map-side minima or joined, so adaptive execution can split it.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), LC + "row", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def found(records: Iterator[dict]) -> Iterator[tuple]:
        for r in records:
            lines, filled = filled_lines(r["text"])
            for start, n, digest in anchors([lines[k] for k in filled]):
                yield digest, r["doc_id"], r[LC + "row"], start, n

    places = cut(map_rows(texts, found, f"digest binary, doc_id long, {LC}row binary, start int, n int"))
    first = places.groupBy("digest").agg(F.count("*").alias("times"), F.min(F.struct("doc_id", LC + "row", "start")).alias("first")).filter("times > 1")
    first = cut(first.select("digest", F.col(f"first.{LC}row").alias("first_row"), F.col("first.start").alias("first_start")))
    again = split_by_filter(places, first.select("digest"), "digest", True).join(first, "digest")
    again = again.filter((F.col(LC + "row") != F.col("first_row")) | (F.col("start") != F.col("first_start")))
    by_row = again.groupBy(LC + "row").agg(F.collect_set(F.struct("start", "n", "first_row", "first_start")).alias("seen"))

    def grown(records: Iterator[dict]) -> Iterator[tuple]:
        for r in records:
            for start, n, row, there in runs([(s["start"], s["n"], s["first_row"], s["first_start"]) for s in r["seen"]]):
                yield r[LC + "row"], start, n, row, there

    chunks = cut(map_rows(by_row, grown, f"{LC}row binary, start int, n int, first_row binary, first_start int"))
    wanted = chunks.select("first_row", "first_start", "n").distinct().groupBy("first_row").agg(
        F.collect_list(F.struct("first_start", "n")).alias("wanted"))

    def bodies(records: Iterator[dict]) -> Iterator[tuple]:
        for r in records:
            lines, filled = filled_lines(r["text"])
            own = [lines[k] for k in filled]
            for w in r["wanted"]:
                yield r["first_row"], w["first_start"], w["n"], joined(own, w["first_start"], w["n"])

    asked = cut(wanted)
    holders = split_by_filter(texts.withColumnRenamed(LC + "row", "first_row"), asked.select("first_row"), "first_row", True)
    holders = holders.join(asked, "first_row").dropDuplicates(["first_row"]).select("first_row", "text", "wanted")
    known = map_rows(holders, bodies, "first_row binary, first_start int, n int, body string")
    told = chunks.join(known, ["first_row", "first_start", "n"])
    return cut(told.groupBy(LC + "row").agg(F.collect_list(F.struct("start", "n", "body")).alias(LC + "seen")))


def cut_out(text: str | None, seen: list[dict] | None) -> tuple[str | None, int, int]:
    """``text`` without the chunks whose bytes are those of ``seen``, its number of lines and how many of them go."""
    if text is None:
        return None, 0, 0
    if not seen:
        return text, text.count("\n") + 1, 0
    lines, filled = filled_lines(text)
    own = [lines[k] for k in filled]
    gone = [False] * len(lines)
    for s in seen:
        if joined(own, s["start"], s["n"]) == s["body"]:
            low, high = filled[s["start"]], filled[s["start"] + s["n"] - 1]
            gone[low:high + 1] = [True] * (high + 1 - low)
    return "\n".join(line for line, g in zip(lines, gone) if not g), len(lines), sum(gone)


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def remove_repeated(docs: DataFrame, report: bool = False) -> DataFrame:
    """``docs`` with the same columns, every chunk that stands earlier in the corpus cut out of ``text``.

    A chunk is two or more lines in a row, or one line of more than ``LONG_LINE_WORDS`` words.  Lines of blanks alone count as
    no lines in it, and go if they stand within one.  A chunk is cut only where its bytes equal the earlier ones.
    Documents left without a line go, null and empty texts stay as they are, and so does every text without such a chunk.
    Rows that share id and text are one document and keep or lose the same lines.  With ``report`` every row stays and has
    ``n_lines``, ``n_removed`` (lines) and ``text_sha256`` beside its columns.

    Only texts that hold the first place of a repeated chunk or repeat one are shuffled; a filter lets the others stay in
    their tasks.  Jobs run while the frame is built.
    """
    names = docs.columns
    types = dict(docs.dtypes)
    told = keyed(docs)
    chunks = repeated_chunks(told)
    rows = chunks.select(LC + "row")
    none = F.lit(None).cast(dict(chunks.dtypes)[LC + "seen"]).alias(LC + "seen")
    plain = [quoted(c) for c in names]
    met = split_by_filter(told, rows, LC + "row", True).join(chunks, LC + "row", "left").select(*plain, LC + "seen")
    both = split_by_filter(told, rows, LC + "row", False).select(*plain, none).unionByName(met)

    if report:
        def reported(records: Iterator[dict]) -> Iterator[tuple]:
            for r in records:
                text, total, gone = cut_out(r["text"], r[LC + "seen"])
                digest = hashlib.sha256((text or "").encode("utf-8", "surrogatepass")).hexdigest()
                yield *[text if c == "text" else r[c] for c in names], total, gone, digest

        ddl = ", ".join([*(f"`{c}` {types[c]}" for c in names), "n_lines long, n_removed long, text_sha256 string"])
        return map_rows(both, reported, ddl)

    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole):
                texts, seen = batch.column(at).to_pylist(), batch.column(len(names)).to_pylist()
                done = [cut_out(t, s) for t, s in zip(texts, seen)]
                columns = batch.columns[:len(names)]
                columns[at] = pa.array([d[0] for d in done], columns[at].type)
                out = pa.RecordBatch.from_arrays(columns, names=names)
                yield out.filter(pa.array([total == 0 or gone < total for _, total, gone in done]))

    return arrow_map(both, run, docs.schema)
