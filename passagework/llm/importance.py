"""Importance resampling to a target distribution: hashed n-gram features, counted line by distinct line."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagework.functions.windows import row_numbers
from passagework.llm.arrow import map_rows
from passagework.sources.lineage import cut

#: Greatest number of words of a feature, buckets that features are hashed into.
WIDTH, BUCKETS = 1, 10_000
#: Share of the documents with enough words that is drawn, and how many words are enough.
PERCENT, LEAST_WORDS = 10, 20
SEED = 2024

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
#: Words whose buckets a task remembers; beyond it the memo begins anew.
MEMO_WORDS = 200_000
#: Bytes of a text whose words are held at once.
SLICE_BYTES = 1 << 20


def words_of(text: str) -> Iterator[list[bytes]]:
    """Lower-cased words (ASCII letters, digits, all beyond ASCII) of ``text``, slice by slice."""
    data = text.encode("utf-8", "surrogatepass").lower()
    at = 0
    while at < len(data):
        end = min(len(data), at + SLICE_BYTES)
        if cut_word := WORD.match(data, end - 1):
            end = cut_word.end()
        yield WORD.findall(data, at, end)
        at = end


class Hasher:
    """Buckets of features: the CRC-32 of words joined by one space, modulo the number of buckets."""

    def __init__(self, width: int, buckets: int):
        self.width, self.buckets = width, buckets
        self.memo: dict[bytes, int] = {}

    def words(self, words: list[bytes]) -> list[int]:
        memo = self.memo
        if len(memo) > MEMO_WORDS:
            memo.clear()
        for w in set(words).difference(memo):
            memo[w] = zlib.crc32(w) % self.buckets
        return [memo[w] for w in words]

    def runs(self, before: list[bytes], words: list[bytes]) -> Iterator[int]:
        """Buckets of runs of two or more words that end in ``words`` and may begin in ``before``."""
        both = before + words
        for n in range(2, self.width + 1):
            for end in range(max(len(before) + 1, n), len(both) + 1):
                yield zlib.crc32(b" ".join(both[end - n:end])) % self.buckets

    def across(self, before: list[bytes], words: list[bytes]) -> Iterator[int]:
        """Buckets of runs that begin in ``before`` (earlier lines) and end in ``words`` (a line)."""
        for n in range(2, self.width + 1):
            for inside in range(1, min(n - 1, len(words)) + 1):
                if n - inside <= len(before):
                    yield zlib.crc32(b" ".join(before[len(before) - (n - inside):] + words[:inside])) % self.buckets

    def all_of(self, text: str) -> Iterator[tuple[int, list[int]]]:
        """(number of words, buckets of all features) of ``text``, slice by slice."""
        before: list[bytes] = []
        for words in words_of(text):
            yield len(words), self.words(words) + [*self.runs(before, words)]
            before = (before + words)[-(self.width - 1):] if self.width > 1 else []


def text_column() -> Column:
    return F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")


def added(counts: Iterable[tuple[int, list[int]]], buckets: int) -> np.ndarray:
    """Sums of (times, buckets)."""
    total = np.zeros(buckets, np.int64)
    for times, found in counts:
        if found:
            total += times * np.bincount(found, minlength=buckets)
    return total


def bucket_counts(docs: DataFrame, width: int = WIDTH, buckets: int = BUCKETS) -> DataFrame:
    """``bucket`` and ``n``: how often features of all texts of ``docs`` fall into each bucket that has one.

    Texts are cut at newlines, which no word holds.  Equal lines of the corpus are one row with their number (combined
    where they are read, so a very common line is one row of a task), and a distinct line's features are counted once and
    multiplied.  Runs of words that cross lines are counted document by document, in a scan of their own if ``width`` > 1.
    """
    texts = docs.select(text_column())
    lines = texts.select(F.explode(F.split("text", "\n", -1)).alias("line")).filter("line != ''").groupBy("line").agg(F.count("*").alias("n"))

    def of_lines(records: Iterator[dict]) -> Iterator[tuple]:
        hasher, total, size = Hasher(width, buckets), np.zeros(buckets, np.int64), 0
        held: dict[int, list[str]] = defaultdict(list)

        def counted() -> np.ndarray:
            by_times: dict[int, list[int]] = defaultdict(list)
            for n, own in held.items():  # lines of the same number are read as one text where no run of words can cross them
                for text in ["\n".join(own)] if width == 1 else own:
                    for _, found in hasher.all_of(text):
                        by_times[n] += found
            return added(by_times.items(), buckets)

        for r in records:
            held[r["n"]].append(r["line"])
            size += len(r["line"])
            if size >= SLICE_BYTES:
                total += counted()
                held.clear()
                size = 0
        total += counted()
        yield from ((k, int(total[k])) for k in np.flatnonzero(total).tolist())

    def of_crossings(records: Iterator[dict]) -> Iterator[tuple]:
        hasher, total = Hasher(width, buckets), np.zeros(buckets, np.int64)
        most = width - 1
        for r in records:
            before: list[bytes] = []
            found: list[int] = []
            for line in r["text"].split("\n"):
                head, tail = [], before
                for words in words_of(line):
                    head += words[:most - len(head)]
                    tail = (tail + words[-most:])[-most:]
                found += hasher.across(before, head)
                before = tail
            total += added([(1, found)], buckets)
        yield from ((k, int(total[k])) for k in np.flatnonzero(total).tolist())

    ddl = "bucket int, n long"
    parts = map_rows(lines, of_lines, ddl)
    if width > 1:
        parts = parts.unionByName(map_rows(texts, of_crossings, ddl))
    return parts.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, width: int = WIDTH, buckets: int = BUCKETS) -> np.ndarray:
    """For every bucket floor(1000 * ln of the ratio of its smoothed shares) in ``target`` and in ``docs``.

    Two tables of at most ``buckets`` rows reach the driver.
    """
    def counted(texts: DataFrame) -> list[int]:
        out = [0] * buckets
        for r in bucket_counts(texts, width, buckets).collect():
            out[r.bucket] = r.n
        return out

    source, wanted = counted(docs), counted(target)
    all_source, all_wanted = float(sum(source) + buckets), float(sum(wanted) + buckets)
    return np.array([math.floor(1000 * math.log((t + 1.0) * all_source / ((s + 1.0) * all_wanted))) for s, t in zip(source, wanted)], np.int64)


def gumbel(seed: int, doc_id: int | None) -> int:
    """Noise of a document, floor(1000 * Gumbel): the same on every run.  A null id counts as an empty one."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weigh(docs: DataFrame, gain: np.ndarray, width: int = WIDTH, seed: int = SEED) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_features``, ``weight`` (floored mean gain of its features, 0 without any) and ``score``
    (with the noise of its id) of every row."""
    def rows(records: Iterator[dict]) -> Iterator[tuple]:
        hasher = Hasher(width, len(gain))
        for r in records:
            n_words = n = total = 0
            for count, found in hasher.all_of(r["text"]):
                n_words, n = n_words + count, n + len(found)
                total += int(gain[found].sum()) if found else 0
            weight = total // n if n else 0
            yield r["doc_id"], n_words, n, weight, weight + gumbel(seed, r["doc_id"])

    return map_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_column()), rows,
                    "doc_id long, n_words long, n_features long, weight long, score long")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, width: int = WIDTH, buckets: int = BUCKETS,
             least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """Per row ``doc_id``, ``n_words``, ``n_features``, ``weight``, ``score``, and ``rank`` of the drawn documents (null for the others).

    Of the N rows with ``least_words`` words or more floor(``percent`` * N / 100) are drawn: those of the highest scores, ties
    to the smaller id, null ids last.  Null texts have no words; every row is a document of its own, repeated rows too;
    other columns are not read.

    The counts of scores (integers in a narrow range) give the least drawn score; rows below it are not numbered.  The others
    are numbered by sampled ranges, so no task holds all of them.  Jobs run while the frame is built.
    """
    scored = cut(weigh(docs, gains(docs, target, width, buckets), width, seed))
    enough = scored.filter(F.col("n_words") >= least_words)
    counts = sorted(((r["score"], r["n"]) for r in enough.groupBy("score").agg(F.count("*").alias("n")).collect()), reverse=True)
    left = drawn = percent * sum(n for _, n in counts) // 100
    least = None
    for value, n in counts:
        if left <= 0:
            break
        least, left = value, left - n
    if least is None:
        return scored.withColumn("rank", F.lit(None).cast("long"))
    near = (F.col("n_words") >= least_words) & (F.col("score") >= least)
    order = F.struct((-F.col("score")).alias("score"), F.col("doc_id").isNull().alias("unknown"), "doc_id", "weight", "n_features")
    ranked = row_numbers(scored.filter(near).withColumn("_order", order), [], "_order", "rank").drop("_order")
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank").cast("long")))
    return ranked.unionByName(scored.filter(~near).withColumn("rank", F.lit(None).cast("long")))
