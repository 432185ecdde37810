"""Document fingerprints by prefix polynomial hashes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cached_property

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagework.llm.arrow import map_rows
from passagework.sources.lineage import cut

PRIME = np.uint64((1 << 31) - 1)
BASES = (948_701_839, 1_313_260_517)
#: Code points of the spans that a fingerprint samples, and of its bins.
SPAN = 8
BINS = 64


def reduced(x: np.ndarray) -> np.ndarray:
    """``x`` modulo the prime 2^31 - 1, for any unsigned 64-bit ``x``."""
    x = (x & PRIME) + (x >> np.uint64(31))
    x = (x & PRIME) + (x >> np.uint64(31))
    return np.where(x >= PRIME, x - PRIME, x)


class Powers:
    """Powers of a base modulo the prime, grown by doubling to the longest text so far."""

    def __init__(self, base: int):
        self.base = base
        self.table = np.ones(1, np.uint64)

    def upto(self, n: int) -> np.ndarray:
        while len(self.table) < n:
            k = len(self.table)
            self.table = np.concatenate([self.table, reduced(self.table * np.uint64(pow(self.base, k, int(PRIME))))])
        return self.table[:n]


POWERS = [Powers(b) for b in BASES]
INVERSES = [Powers(pow(b, -1, int(PRIME))) for b in BASES]


class PrefixHashes:
    """Hashes of all prefixes of a text, two bases modulo 2^31 - 1.  Any span's hash is two look-ups and a product."""

    def __init__(self, text: str):
        self.codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        self.prefix = [self._prefixes(p) for p in POWERS]

    def __len__(self) -> int:
        return len(self.codes)

    def _prefixes(self, powers: Powers) -> np.ndarray:
        terms = reduced((self.codes + np.uint64(1)) * powers.upto(len(self.codes)))
        return reduced(np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)]))

    def span(self, start: int, end: int) -> tuple[int, int]:
        """The hash of the code points from ``start`` to ``end``, whatever text they stand in."""
        p = int(PRIME)
        return tuple((int(h[end]) - int(h[start])) * int(inv.upto(start + 1)[start]) % p for h, inv in zip(self.prefix, INVERSES))

    def equal(self, start: int, other: PrefixHashes, at: int, length: int) -> bool:
        """Whether two spans hold the same text (up to a chance of about 2^-60)."""
        return self.span(start, start + length) == other.span(at, at + length)

    def common_extension(self, start: int, other: PrefixHashes, at: int) -> int:
        """Length of the longest common text from ``start`` here and ``at`` there, by binary search over span equality."""
        low, high = 0, min(len(self) - start, len(other) - at)
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if self.equal(start, other, at, middle) else (low, middle - 1)
        return low

    @cached_property
    def spans(self) -> np.ndarray:
        """Hashes of every span of ``SPAN`` code points (of the whole text if it is shorter), mixed to 64 bits."""
        width = min(SPAN, len(self))
        if not width:
            return np.zeros(0, np.uint64)
        h, n = self.prefix[0], len(self) - width + 1
        return mixed(reduced((h[width:] + PRIME - h[:n]) * INVERSES[0].upto(n)))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprint(text: PrefixHashes, spans: np.ndarray | None = None) -> str:
    """Length and hash of the whole text, and the least span hash of each of ``BINS`` bins in one byte; a bit map of filled bins.

    Equal texts have equal fingerprints, texts that differ differ in the first part (up to a chance of about 2^-60).
    """
    spans = text.spans if spans is None else spans
    least = np.full(BINS, np.iinfo(np.uint64).max)
    np.minimum.at(least, (spans & np.uint64(BINS - 1)).astype(np.intp), spans >> np.uint64(6))
    filled = least != np.iinfo(np.uint64).max
    marks = np.where(filled, least & np.uint64(255), 0).astype(np.uint8).tobytes().hex()
    whole = "".join(f"{v:08x}" for v in text.span(0, len(text)))
    return f"{len(text):x}.{whole}.{np.packbits(filled).tobytes().hex()}.{marks}"


def likeness(a: str, b: str) -> float:
    """Share of bins, filled in either fingerprint, on which both agree; 1 for equal fingerprints."""
    if a == b:
        return 1.0
    (_, _, fa, ma), (_, _, fb, mb) = a.split("."), b.split(".")
    in_a, in_b = (np.unpackbits(np.frombuffer(bytes.fromhex(f), np.uint8)).astype(bool) for f in (fa, fb))
    same = np.frombuffer(bytes.fromhex(ma), np.uint8) == np.frombuffer(bytes.fromhex(mb), np.uint8)
    return float(np.count_nonzero(same & in_a & in_b) / max(np.count_nonzero(in_a | in_b), 1))


class Entry:
    """A document of the sequence with its hashes and fingerprint, which two neighbours use."""

    def __init__(self, doc_id: int | None, text: str):
        self.doc_id, self.text = doc_id, text
        self.hashes = PrefixHashes(text)
        self.print = fingerprint(self.hashes)

    def with_next(self, after: Entry) -> tuple:
        half = len(self.text) // 2
        edited = self.text[:len(self.text) - half] + after.text[:half]
        hashes = PrefixHashes(edited)
        edited_print = fingerprint(hashes)
        return (self.doc_id, len(self.text), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), self.print, edited_print,
                likeness(self.print, edited_print), likeness(self.print, after.print), self.hashes.common_extension(0, hashes, 0))


RESULT = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, "
          "near_next double, common_prefix long")
DONE, FIRST, LAST = 0, 1, 2


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``n_chars`` and ``fingerprint`` of every row's whole text; null text counts as empty.  Narrow."""
    def rows(records: Iterator[dict]) -> Iterator[tuple]:
        for r in records:
            own = PrefixHashes(r["text"] or "")
            yield r["doc_id"], len(own), fingerprint(own)

    return map_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), rows,
                    "doc_id long, n_chars long, fingerprint string")


def compare_with_next(docs: DataFrame) -> DataFrame:
    """Every document against its text half overwritten by the next document's beginning, and against the next document.

    Next is by descending ``doc_id`` (null last, then by text, so repeated rows follow each other), after the last comes
    the first.  Null text counts as empty; other columns are not read; no rows give none.  ``common_prefix`` is the longest
    common beginning of text and edited text.

    Texts move once, dealt by ranges of ``doc_id`` and sorted there; each task walks its range with two documents in hand.
    Only the first and the last document of a range wait for their neighbours: they are matched range by range.
    """
    spark = docs.sparkSession
    ready = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    order = [F.desc_nulls_last("doc_id"), F.asc("text")]
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = ready.repartitionByRange(ranges, F.desc_nulls_last("doc_id")).sortWithinPartitions(*order)

    def walk(records: Iterator[dict]) -> Iterator[tuple]:
        part, before = TaskContext.get().partitionId(), None
        nothing = (None,) * 7
        for r in records:
            now = Entry(r["doc_id"], r["text"])
            if before is None:
                yield FIRST, part, now.doc_id, *nothing, now.text
            else:
                yield DONE, part, *before.with_next(now), None
            before = now
        if before is not None:
            yield LAST, part, before.doc_id, *nothing, before.text

    walked = cut(map_rows(dealt, walk, f"kind int, part int, {RESULT}, text string"))
    firsts = walked.filter(F.col("kind") == FIRST)
    parts = sorted(r["part"] for r in firsts.select("part").collect())  # one number per range
    if not parts:
        return walked.drop("kind", "part", "text")
    follows = spark.createDataFrame(list(zip(parts, [*parts[1:], parts[0]])), "part int, after int")
    ends = (walked.filter(F.col("kind") == LAST).select("part", "doc_id", "text").join(F.broadcast(follows), "part")
            .join(firsts.select(F.col("part").alias("after"), F.col("doc_id").alias("next_id"), F.col("text").alias("next_text")), "after")
            .select("doc_id", "text", "next_id", "next_text"))

    def match(records: Iterator[dict]) -> Iterator[tuple]:
        for r in records:
            yield Entry(r["doc_id"], r["text"]).with_next(Entry(r["next_id"], r["next_text"]))

    return walked.filter(F.col("kind") == DONE).drop("kind", "part", "text").unionByName(map_rows(ends, match, RESULT))
