"""Benchmark decontamination: an FM-index per shard of training texts answers where test phrases stand."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from passagework.llm.arrow import arrow_map, pieces
from passagework.llm.fm_index import FMIndex
from passagework.llm.text_bytes import column_bytes
from passagework.llm.words import ALPHANUMERIC, LOWER, word_bounds, word_hashes
from passagework.sources.lineage import cut

WINDOW = 10
#: Bytes of benchmark texts that are searched for in one pass over the documents.
BLOCK_BYTES = 16 << 20
#: Bytes of documents of one shard, which is one index.
SHARD_BYTES = 4 << 20
#: Occurrences that are located at once.
LOCATE = 1 << 18

DC = "_dc_"


def words_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    data, offsets = column_bytes(pa.array(texts, pa.string()))
    data = LOWER[data]
    return data, offsets, *word_bounds(data, offsets, ALPHANUMERIC)


@dataclass
class Phrases:
    """The windows of a block of items over the vocabulary of their words."""

    hashes: np.ndarray  # of the vocabulary's words, rising
    word_data: np.ndarray
    word_start: np.ndarray
    word_size: np.ndarray
    windows: np.ndarray  # symbols, padded on the left with -1
    lengths: np.ndarray
    owners: list[tuple[str, ...]]  # items of each window

    @classmethod
    def of(cls, items: list[tuple[str, str | None]], size: int = WINDOW) -> Phrases:
        data, offsets, starts, ends = words_of([t for _, t in items])
        hashes, first, symbol = np.unique(word_hashes(data, starts, ends), return_index=True, return_inverse=True)
        bounds = np.searchsorted(starts, offsets)
        owners: dict[tuple[int, ...], set[str]] = defaultdict(set)
        for (item, _), a, b in zip(items, bounds, bounds[1:]):
            own = symbol[a:b].tolist()
            for k in range(max(len(own) - size + 1, min(len(own), 1))):
                owners[tuple(own[k:k + size])].add(item)
        windows = np.full((len(owners), size), -1, np.int64)
        for row, w in zip(windows, owners):
            row[size - len(w):] = w
        return cls(hashes, data, starts[first], (ends - starts)[first], windows, np.array([len(w) for w in owners], np.int64),
                   [tuple(v) for v in owners.values()])

    def symbols(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The vocabulary's symbol of every word, -1 for words of no item; words are compared byte by byte."""
        if not len(self.hashes) or not len(starts):
            return np.full(len(starts), -1, np.int64)
        wanted = word_hashes(data, starts, ends)
        at = np.minimum(np.searchsorted(self.hashes, wanted), len(self.hashes) - 1)
        known = np.flatnonzero((self.hashes[at] == wanted) & (self.word_size[at] == ends - starts))
        out = np.full(len(starts), -1, np.int64)
        if len(known):
            size = self.word_size[at[known]]
            first = np.concatenate([[0], np.cumsum(size)[:-1]])
            within = np.arange(int(size.sum())) - np.repeat(first, size)
            same = data[np.repeat(starts[known], size) + within] == self.word_data[np.repeat(self.word_start[at[known]], size) + within]
            known = known[np.logical_and.reduceat(same, first)]
            out[known] = at[known]
        return out

    def occurrences(self, symbols: np.ndarray, text_of: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(windows, first words) of all occurrences among the shard's words.

        Only stretches of vocabulary words of one text that are as long as the shortest window are indexed: no window can
        stand anywhere else.
        """
        if not len(self.lengths) or not len(symbols):
            return
        known = symbols >= 0
        breaks = np.flatnonzero(np.concatenate([[True], ~known[1:] | ~known[:-1] | (text_of[1:] != text_of[:-1])]))
        sizes = np.diff(np.append(breaks, len(symbols)))
        long = known[breaks] & (sizes >= self.lengths.min())
        starts, sizes = breaks[long], sizes[long]
        if not len(starts):
            return
        places = sizes + 1
        first = np.concatenate([[0], np.cumsum(places)[:-1]])
        word = np.repeat(starts - first, places) + np.arange(int(places.sum()))
        ends = first + sizes
        word[ends] = 0
        index = FMIndex(np.where(symbols[word] < 0, 0, symbols[word]), ends, len(self.hashes))
        low, high = index.search(self.windows, self.lengths)
        found = np.flatnonzero(high > low)
        counts = high[found] - low[found]
        upto = np.cumsum(counts)
        for k in range(0, int(upto[-1]) if len(upto) else 0, LOCATE):
            nth = np.arange(k, min(k + LOCATE, int(upto[-1])))
            which = np.searchsorted(upto, nth, side="right")
            row = low[found[which]] + nth - (upto[which] - counts[which])
            yield found[which], word[index.locate(row)]

    def hits(self, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, set[str]]]:
        """Per text: number of words, merged runs of hit words as first and end words, byte bounds of the runs, items."""
        data, offsets = column_bytes(texts)
        data = LOWER[data]
        starts, ends = word_bounds(data, offsets, ALPHANUMERIC)
        bounds = np.searchsorted(starts, offsets)
        text_of = np.repeat(np.arange(len(texts)), np.diff(bounds))
        covered = np.zeros(len(starts) + 1, np.int64)
        items: dict[int, set[str]] = defaultdict(set)
        for window, word in self.occurrences(self.symbols(data, starts, ends), text_of):
            np.add.at(covered, word, 1)
            np.add.at(covered, word + self.lengths[window], -1)
            for pair in np.unique(text_of[word] * len(self.lengths) + window):
                items[int(pair // len(self.lengths))].update(self.owners[int(pair % len(self.lengths))])
        hit = np.flatnonzero(np.cumsum(covered[:-1]) > 0)
        opens = hit[np.concatenate([[True], (np.diff(hit) > 1) | (text_of[hit[1:]] != text_of[hit[:-1]])])] if len(hit) else hit
        closes = hit[np.concatenate([(np.diff(hit) > 1) | (text_of[hit[1:]] != text_of[hit[:-1]]), [True]])] + 1 if len(hit) else hit
        at = np.searchsorted(opens, bounds)
        for k in range(len(texts)):
            runs = np.stack([opens[at[k]:at[k + 1]], closes[at[k]:at[k + 1]]], axis=1)
            spans = np.stack([starts[runs[:, 0]], ends[runs[:, 1] - 1]], axis=1) - offsets[k] if len(runs) else runs
            yield int(bounds[k + 1] - bounds[k]), runs - bounds[k], spans, items.get(k, set())


def dealt(benchmark: DataFrame, limit: int = BLOCK_BYTES) -> list[DataFrame]:
    """Distinct items in blocks of about ``limit`` bytes; each is small enough for the driver and for every task.

    Items are dealt by id and text together, so an id of any number of texts is spread over the blocks.  A null id counts
    as empty.  Nothing is read here but sizes: :func:`phrases_of` builds a block when its turn comes.
    """
    items = benchmark.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.col("text").cast("string").alias("text")).distinct()
    size = items.agg(F.coalesce(F.sum(F.octet_length("text") + F.octet_length("item")), F.lit(0))).first()[0]
    n = max(1, -(-size // limit))
    if n == 1:
        return [items]
    items = cut(items)
    return [items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k) for k in range(n)]


def phrases_of(block: DataFrame) -> Phrases:
    """The windows of one block, built in the driver."""
    return Phrases.of([(r["item"], r["text"]) for r in block.collect()])


def merged(a: list[int], b: list[int]) -> list[int]:
    """Union of two lists of runs, each first, end, first, end, ... rising."""
    out: list[int] = []
    for first, end in sorted([*zip(a[::2], a[1::2]), *zip(b[::2], b[1::2])]):
        if out and first <= out[-1]:
            out[-1] = max(out[-1], end)
        else:
            out += [first, end]
    return out


def mark(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES, keep_text: bool = True) -> DataFrame:
    """``docs`` with what the benchmark's windows hit in each whole text, in columns that begin with ``_dc_``: ``words`` (its
    words), ``runs`` (hit words, first, end, ...), ``spans`` (their bytes in UTF-8 likewise) and ``items`` (ids as strings, sorted).

    Null text has no words; items without words have no windows; repeated items and rows are as good as any.  Narrow: the
    items travel to the documents in blocks of bounded size.  More than one block means one pass over the documents each,
    with the marks so far written in between.
    """
    at = docs.columns.index("text")
    marks = [StructField(DC + "words", LongType()), StructField(DC + "runs", ArrayType(LongType())),
             StructField(DC + "spans", ArrayType(LongType())), StructField(DC + "items", ArrayType(StringType()))]
    own = docs.schema.fields

    for number, phrases in enumerate(map(phrases_of, dealt(benchmark, block_bytes))):
        def run(batches: Iterator[pa.RecordBatch], phrases=phrases, number=number) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for batch in pieces(whole, SHARD_BYTES):
                    words, runs, spans, items = [], [], [], []
                    before = [batch.column(len(own) + k).to_pylist() for k in (1, 2, 3)] if number else None
                    for k, (n, run_of, span_of, item_of) in enumerate(phrases.hits(batch.column(at))):
                        words.append(n)
                        some = run_of.ravel().tolist(), span_of.ravel().tolist()
                        runs.append(merged(before[0][k], some[0]) if number else some[0])
                        spans.append(merged(before[1][k], some[1]) if number else some[1])
                        items.append(sorted(item_of.union(before[2][k]) if number else item_of))
                    columns = [*batch.columns[:len(own)], pa.array(words, pa.int64()), pa.array(runs, pa.list_(pa.int64())),
                               pa.array(spans, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string()))]
                    yield pa.RecordBatch.from_arrays(columns, names=[*(f.name for f in own), *(f.name for f in marks)])

        docs = arrow_map(cut(docs) if number else docs, run, StructType([*own, *marks]))
    return docs if keep_text else docs.drop("text")


def report(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``n_words``, ``n_hit``, ``n_items``, ``items_sha256`` (of the ids joined by commas) and
    ``contaminated``."""
    marked = mark(docs.select("doc_id", F.col("text").cast("string").alias("text")), benchmark, block_bytes)
    runs = F.col(DC + "runs")
    hit = F.aggregate(F.transform(runs, lambda v, i: F.when(i % 2 == 1, v).otherwise(-v)), F.lit(0).cast("long"), lambda a, v: a + v)
    return marked.select(
        "doc_id", F.col(DC + "words").alias("n_words"), hit.alias("n_hit"), F.size(DC + "items").cast("long").alias("n_items"),
        F.sha2(F.array_join(DC + "items", ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


def remove(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with the same columns, the hit spans cut out of ``text``; a text of which no word is left goes.

    What a cut joins is searched again, until no window stands in the text.  Texts without a hit stay byte for byte,
    also null and empty ones.  Blocks of the benchmark take their turns, with the texts so far written in between; while a
    later block changed a text, all blocks take another turn.  A block's windows are built anew for each of its turns.
    """
    names, at = docs.columns, docs.columns.index("text")
    some = dealt(benchmark, block_bytes)

    def cutter(phrases: Phrases):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for batch in pieces(whole, SHARD_BYTES):
                    texts = batch.column(at)
                    found = {k: spans for k, (_, _, spans, _) in enumerate(phrases.hits(texts)) if len(spans)}
                    if not found:
                        yield pa.RecordBatch.from_arrays(batch.columns, names=names)
                        continue
                    texts, gone = texts.to_pylist(), set()
                    for k, spans in found.items():
                        text, words = texts[k].encode("utf-8", "surrogatepass"), 1
                        while len(spans):
                            edges = spans.ravel().tolist()
                            text = b"".join(text[a:b] for a, b in zip([0, *edges[1::2]], [*edges[::2], len(text)]))
                            words, _, spans, _ = next(phrases.hits(pa.array([text.decode("utf-8", "surrogatepass")])))
                        texts[k] = text.decode("utf-8", "surrogatepass")
                        if not words:
                            gone.add(k)
                    columns = batch.columns
                    columns[at] = pa.array(texts, columns[at].type)
                    kept = pa.array([k not in gone for k in range(len(texts))])
                    yield pa.RecordBatch.from_arrays(columns, names=names).filter(kept)

        return run

    left = arrow_map(docs, cutter(phrases_of(some[0])), docs.schema)
    turn, since = 1, 0
    while len(some) > 1 and since < len(some) - 1:
        before = cut(left)
        left = cut(arrow_map(before, cutter(phrases_of(some[turn % len(some)])), docs.schema))
        size = [F.count("*"), F.sum(F.octet_length("text"))]
        since = since + 1 if before.agg(*size).first() == left.agg(*size).first() else 0
        turn += 1
    return left
