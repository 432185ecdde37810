"""Quality rules by weak supervision: rules vote or abstain, EM estimates how they err, a posterior decides."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from passagework.llm.arrow import lean, map_batches, pieces
from passagework.llm.shingles import PLACE_CODES
from passagework.llm.text_bytes import column_bytes
from passagework.llm.words import ALPHANUMERIC, LOWER, NOT_BLANK, mix, word_bounds, word_hashes
from passagework.sources.lineage import cut

#: Words of a window that may be repeated.
WINDOW = 8
#: Least words, and greatest percentage of words in repeated windows, of a text that the base rules let pass.
LEAST_WORDS, REPEAT_PERCENT = 20, 30
#: Posterior probability of good quality from which a text is kept.
KEEP = 0.5
ROUNDS, TOLERANCE = 200, 1e-9
SYMBOLS = b"#*$%&|<>"
#: Bytes of ASCII that are neither letters, digits, blanks nor control characters.
MARK = np.zeros(256, bool)
MARK[33:127] = True
MARK &= ~ALPHANUMERIC[LOWER]
BLANKS = " \t\n\v\f\r"
LINE_ENDS = tuple(".!?…:;,\"')]»”。！？")

#: Counts of a text that rules read, beside its words.
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_distinct_words", "n_lines", "n_ended_lines", "n_letters",
          "n_capitals", "n_exclaims", "n_marks", "n_mark_runs", "n_bare_words")


@dataclass(frozen=True)
class Rule:
    """A share of two counts.  It votes for bad quality within ``bad``, for good quality within ``good`` (both ends included), else it abstains,
    and so it does where the denominator is below ``least``."""

    name: str
    part: str
    whole: str
    good: tuple[float, float]
    bad: tuple[float, float]
    least: int = 1

    def vote(self) -> Column:
        share = F.col(self.part) / F.col(self.whole)
        inside = [share.between(*limits) for limits in (self.bad, self.good)]
        return F.when(F.col(self.whole) < self.least, 0).when(inside[0], -1).when(inside[1], 1).otherwise(0)


MANY = 1e18
RULES = (
    Rule("symbols", "n_symbols", "n_words", (0, 0.02), (0.1, MANY)),
    Rule("word_length", "word_chars", "n_words", (3, 10), (14, MANY)),
    Rule("dup_lines", "n_dup_lines", "n_lines", (0, 0.1), (0.3, 1), least=3),
    Rule("repeats", "n_repeat_words", "n_words", (0, 0.1), (0.3, 1)),
    Rule("distinct", "n_distinct_words", "n_words", (0.3, 1), (0, 0.15), least=30),
    Rule("line_ends", "n_ended_lines", "n_lines", (0.6, 1), (0, 0.1)),
    Rule("capitals", "n_capitals", "n_letters", (0, 0.2), (0.5, 1), least=20),
    Rule("marks", "n_marks", "word_chars", (0, 0.1), (0.18, 1)),
    Rule("mark_runs", "n_mark_runs", "n_words", (0, 0.05), (0.2, MANY)),
    Rule("bare_words", "n_bare_words", "n_words", (0, 0.05), (0.15, 1)),
    Rule("exclaims", "n_exclaims", "n_words", (0, 0.05), (0.2, MANY)),
)
#: What is believed before any text is read: shares of bad and good votes given bad and good quality, as pseudo-counts of
#: so many texts, and the share of good texts.
BELIEF = {"bad": (0.35, 0.45), "good": (0.01, 0.85)}
BELIEF_TEXTS, GOOD_SHARE = 20.0, 0.8


def counts_of(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
    """``COUNTS`` of the texts in the second column of ``batch``."""
    column = batch.column(1)
    data, offsets = column_bytes(column)
    n = len(column)
    filled = np.flatnonzero(np.diff(offsets))

    def of_bytes(marked: np.ndarray) -> np.ndarray:
        total = np.zeros(n, np.int64)
        if len(filled):
            total[filled] = np.add.reduceat(marked, offsets[filled], dtype=np.int64)
        return total

    starts, ends = word_bounds(data, offsets, NOT_BLANK)
    hashes = word_hashes(data, starts, ends)
    bounds = np.searchsorted(starts, offsets)
    words = np.diff(bounds)
    doc = np.repeat(np.arange(n), words)
    salted = mix(doc.astype(np.uint64) + np.uint64(1))

    def of_words(marked: np.ndarray) -> np.ndarray:
        return np.bincount(doc[marked], minlength=n)

    windows = max(len(hashes) - WINDOW + 1, 0)
    rolled = np.zeros(windows, np.uint64)
    for k in range(WINDOW):
        rolled += hashes[k:k + windows] * PLACE_CODES[k]
    inside = np.flatnonzero(doc[:windows] == doc[len(doc) - windows:])
    key = mix(mix(rolled[inside]) ^ salted[inside])
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    again = np.zeros(len(key), bool)
    again[order[1:]] |= same
    again[order[:-1]] |= same
    step = np.zeros(len(hashes) + 1, np.int32)
    np.add.at(step, inside[again], 1)
    np.add.at(step, inside[again] + WINDOW, -1)
    by_text = np.lexsort((hashes, doc))
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[by_text][1:] != hashes[by_text][:-1]) | (doc[1:] != doc[:-1])  # texts stay in order

    n_lines, n_dup, n_ended = (np.zeros(n, np.int64) for _ in range(3))
    for k, text in enumerate(column.to_pylist()):
        lines = [line for line in (text or "").split("\n") if line.strip(BLANKS)]
        n_lines[k], n_dup[k] = len(lines), len(lines) - len(set(lines))
        n_ended[k] = sum([line.rstrip(BLANKS).endswith(LINE_ENDS) for line in lines])
    marks = MARK[data]
    runs = np.zeros(len(data), bool)
    runs[1:] = marks[1:] & (data[1:] == data[:-1])
    runs[offsets[filled]] = False
    bare = (np.add.reduceat(ALPHANUMERIC[LOWER[data]], starts, dtype=np.int64) == 0) if len(starts) else np.zeros(0, bool)
    low, high = (data >= ord("a")) & (data <= ord("z")), (data >= ord("A")) & (data <= ord("Z"))
    return {
        "n_words": words, "word_chars": of_bytes(NOT_BLANK[data] & ((data & 0xC0) != 0x80)), "n_symbols": of_bytes(np.isin(data, np.frombuffer(SYMBOLS, np.uint8))),
        "n_dup_lines": n_dup, "n_repeat_words": of_words(np.cumsum(step)[:-1] > 0), "n_distinct_words": of_words(new),
        "n_lines": n_lines, "n_ended_lines": n_ended, "n_letters": of_bytes(low | high), "n_capitals": of_bytes(high), "n_exclaims": of_bytes(data == ord("!")),
        "n_marks": of_bytes(marks), "n_mark_runs": of_bytes(runs), "n_bare_words": of_words(bare)}


def signals(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``COUNTS`` of every row's whole text; null text counts as empty, an empty one has all counts 0."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for whole in batches:
            for batch in pieces(whole, 1 << 20):
                counts = counts_of(batch)
                yield from zip(batch.column(0).to_pylist(), *(counts[c].tolist() for c in COUNTS))

    ready = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_batches(ready, rows, "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS))


def votes(rules: tuple[Rule, ...] = RULES) -> Column:
    """Votes of all rules over a row of counts as one string of ``-``, ``0`` and ``+``."""
    return F.concat(*[F.when(r.vote() < 0, "-").when(r.vote() > 0, "+").otherwise("0") for r in rules])


@dataclass
class Model:
    """Share of good texts, and for every rule the probability of each vote (bad, none, good) given bad and given good quality."""

    good: float
    chances: np.ndarray  # rule, quality (bad, good), vote

    def posterior(self, ballots: np.ndarray) -> np.ndarray:
        """Probability of good quality for rows of votes (0 bad, 1 none, 2 good)."""
        log = np.log(self.chances)
        rule = np.arange(ballots.shape[1])
        bad, good = (log[rule, q, ballots].sum(axis=1) for q in (0, 1))
        z = np.log(self.good) - np.log1p(-self.good) + good - bad
        return 1 / (1 + np.exp(-np.clip(z, -700, 700)))

    def accuracy(self) -> np.ndarray:
        """For every rule the probability that its vote, if it votes, is right."""
        share = np.array([1 - self.good, self.good])
        right = share[0] * self.chances[:, 0, 0] + share[1] * self.chances[:, 1, 2]
        return right / (right + share[0] * self.chances[:, 0, 2] + share[1] * self.chances[:, 1, 0])


def believed(rules: int) -> Model:
    """The model before any text is read."""
    one = [[bad, 1 - bad - good, good] for bad, good in (BELIEF["bad"], BELIEF["good"])]
    return Model(GOOD_SHARE, np.array([one] * rules, float))


def estimate(ballots: np.ndarray, times: np.ndarray) -> Model:
    """Expectation-maximisation over distinct ballots and how many texts have each; ``BELIEF`` counts as ``BELIEF_TEXTS`` more texts.

    Quality is not observed: texts are shared out to bad and good by their posterior, chances are estimated anew from the
    shares, until the posteriors rest.
    """
    prior = believed(ballots.shape[1])
    model, before = prior, None
    one_hot = np.eye(3)[ballots]  # ballot, rule, vote
    for _ in range(ROUNDS):
        good = model.posterior(ballots)
        if before is not None and np.abs(good - before).max(initial=0) < TOLERANCE:
            break
        before = good
        weight = np.stack([times * (1 - good), times * good])  # quality, ballot
        counts = np.einsum("qb,brv->rqv", weight, one_hot) + BELIEF_TEXTS * prior.chances
        total = weight.sum(axis=1) + BELIEF_TEXTS * np.array([1 - GOOD_SHARE, GOOD_SHARE])
        model = Model(float(total[1] / total.sum()), counts / counts.sum(axis=2, keepdims=True))
    return model


def ballot_array(ballots: list[str], rules: int) -> np.ndarray:
    return np.array([["-0+".index(v) for v in b] for b in ballots], np.int64).reshape(-1, rules)


def base_failed() -> Column:
    """Too few words, or too many of them in windows that stand twice or more in the text."""
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))


def learn(counted: DataFrame, rules: tuple[Rule, ...] = RULES) -> tuple[Model, DataFrame]:
    """The model of all rows of ``counted`` (:func:`signals`), and ``ballot``, ``quality`` for each ballot that occurs.

    Ballots are counted where they are read; at most 3 ** rules of them, with their numbers, reach the driver.
    """
    got = sorted(counted.groupBy(votes(rules).alias("ballot")).agg(F.count("*").alias("n")).collect())
    ballots = ballot_array([r.ballot for r in got], len(rules))
    model = estimate(ballots, np.array([r.n for r in got], float))
    known = [(r.ballot, float(q)) for r, q in zip(got, model.posterior(ballots))]
    return model, counted.sparkSession.createDataFrame(known, "ballot string, quality double")


def judged(counted: DataFrame, known: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``counted`` with ``ballot``, ``quality`` (posterior), ``base_failed`` and ``kept``.  ``known`` has at most 3 ** rules rows."""
    told = counted.withColumn("ballot", votes(rules)).join(F.broadcast(known), "ballot", "left")
    return told.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("quality") >= KEEP, F.lit(False)))


def assess(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per row of ``docs`` its counts, ``ballot``, ``quality``, ``base_failed`` and ``kept``.

    A text that fails the base rules goes; of the others those stay whose posterior is at least ``KEEP``: no single rule
    decides.  Null and empty texts fail.  Every row is a text of its own, repeated rows vote each time; ids may be
    null; other columns are not read.  Texts are read once and never moved; counts are written as a table.
    """
    counted = cut(signals(docs))
    return judged(counted, learn(counted, rules)[1], rules)


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text :func:`assess` keeps.

    The verdict is found again from the row's own text, so neither texts nor ids are joined.
    """
    _, known = learn(signals(docs), rules)
    good = [r.ballot for r in known.filter(F.col("quality") >= KEEP).collect()]
    whole = F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]).alias("row")
    told = docs.select(whole, F.col("text").cast("string").alias("text"))
    fields = StructType([told.schema["row"], *(StructField(c, LongType()) for c in COUNTS)])

    def row_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for large in batches:
            for batch in pieces(large, 1 << 20):
                counts = counts_of(batch)
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(counts[c], pa.int64()) for c in COUNTS)], names=["row", *COUNTS])

    return told.mapInArrow(lean(row_counts), fields).filter(~base_failed() & votes(rules).isin(good)).select("row.*")
