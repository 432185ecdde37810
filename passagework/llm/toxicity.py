"""Toxicity: gradient-boosted trees over dense text features, calibrated by isotonic regression."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagework.llm.arrow import map_rows
from passagework.llm.labels import labelled_sample
from passagework.sources.lineage import cut

#: Labelled documents that lexicon and trees are fitted on at most, entries of the learned lexicon at most.
SAMPLE_DOCS = 8_000
LEXICON_SIZE = 4_000
#: A lexicon entry stands in so many toxic texts at least and has this log ratio of rates at least.
SUPPORT, LOG_RATIO = 3, 2.5
STEMS = (4, 5, 6, 7)

# Common insults and second-person words.
INSULTS = frozenset(
    "idiot moron stupid loser scum trash garbage pathetic disgusting worthless clown fool dumb imbecile bastard vermin filth "
    "idiota imbécile stupide débile ordure estúpido imbécil basura dummkopf abschaum trottel".split())
SECOND_PERSON = frozenset(
    "you your yours yourself u ur du dich dir dein deine deiner ihr euch tu toi te ton ta tes vous votre vos tú ti usted "
    "ustedes vosotros tuyo".split())
LEET = str.maketrans("013457@$!|", "oieastasii")
EDGES = re.compile(r"^\W+|\W+$")
STRETCHED = re.compile(r"(.)\1{2,}")
ODD_INSIDE = re.compile(r"\w[*@$#!|0-9]+\w|\w[*]{2,}")

FEATURES = ("insults", "lexicon", "lexicon_weight", "lexicon_hits", "obfuscated_hits", "near_person", "person", "capitals",
            "upper_words", "exclaim", "punctuation", "obfuscation", "stretched", "log_words")
DDL = ", ".join(f"{f} double" for f in FEATURES)
INSULT, LEARNED, HIDDEN, PERSON, UPPER, ODD, LONG = (1 << k for k in range(7))
#: Words that a worker remembers the marks of when a text begins.
MEMO_WORDS = 400_000
REACH = 5


def plain(word: str) -> str:
    return EDGES.sub("", word).lower()


def stems(word: str) -> list[str]:
    """The plain word and its beginnings, which stand for its inflections."""
    w = plain(word)
    return [f"{w[:n]}-" for n in STEMS if len(w) > n] + [w] if w else []


class Marker:
    """Words → marks and lexicon weights, remembered per process."""

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon = lexicon
        self.memo: dict[str, int] = {}
        self.weight: dict[str, float] = {}

    def marks(self, word: str) -> int:
        w = plain(word)
        weight = max((self.lexicon[s] for s in stems(word) if s in self.lexicon), default=0.0)
        hidden = STRETCHED.sub(r"\1", w.translate(LEET).replace("*", "")) if w else w
        code = INSULT * (w in INSULTS) | LEARNED * (weight > 0) | PERSON * (w in SECOND_PERSON)
        code |= UPPER * (len(word) > 2 and word.isupper()) | ODD * bool(ODD_INSIDE.search(word)) | LONG * bool(STRETCHED.search(w))
        code |= HIDDEN * (hidden != w and (hidden in INSULTS or hidden in self.lexicon))
        self.memo[word] = code
        if weight:
            self.weight[word] = weight
        return code

    def features(self, text: str) -> tuple[float, ...]:
        if len(self.memo) >= MEMO_WORDS:  # never within a text, whose weights are read after all its words are marked
            self.memo, self.weight = {}, {}
        words = text.split()
        found = [self.memo.get(w) for w in words]
        if None in found:
            found = [self.marks(w) if c is None else c for w, c in zip(words, found)]
        codes = np.frombuffer(bytes(found), np.uint8)
        n, chars = max(len(words), 1), max(len(text), 1)
        hit = np.flatnonzero(codes & (INSULT | LEARNED | HIDDEN))
        person = np.flatnonzero(codes & PERSON)
        weights = [self.weight.get(words[k], 0.0) for k in hit]
        near = 0.0
        if len(hit) and len(person):
            at = np.searchsorted(person, hit)
            left = hit - person[np.maximum(at - 1, 0)]
            right = person[np.minimum(at, len(person) - 1)] - hit
            near = float(np.mean((np.abs(left) <= REACH) | (np.abs(right) <= REACH)))

        def rate(bit: int) -> float:
            return np.count_nonzero(codes & bit) / n

        upper = sum(map(str.isupper, text)) if any(c.isupper() for c in words[:1]) or not text.islower() else 0
        return (rate(INSULT), rate(LEARNED), sum(weights) / n, math.log1p(len(hit)), rate(HIDDEN), near, len(person) / n, upper / chars,
                rate(UPPER), text.count("!") / chars, sum(map(text.count, ".,;:?'\"-()")) / chars, rate(ODD), rate(LONG), math.log1p(len(words)))


def feature_table(docs: DataFrame, lexicons: dict[int, dict[str, float]], extra: tuple[str, ...] = ()) -> DataFrame:
    """Features of every whole text with the lexicon of its ``fold`` (0 where there is no such column)."""
    names = ["doc_id", *extra]
    types = dict(docs.dtypes)

    def rows(records: Iterator[dict]) -> Iterator[tuple]:
        markers = {k: Marker(v) for k, v in lexicons.items()}
        for r in records:
            yield *[r[c] for c in names], *map(float, markers[r.get("fold") or 0].features(r["text"] or ""))

    return map_rows(docs, rows, ", ".join([*(f"{c} {types[c]}" for c in names), DDL]))


def learned_lexicons(sample: DataFrame) -> dict[int, dict[str, float]]:
    """Word beginnings that mark toxic texts, learned on fold 0, on fold 1 and (key 2) on both.

    Counted once per text, summed in the tasks before the shuffle; at most ``LEXICON_SIZE`` entries reach the driver.
    """
    def counts(records: Iterator[dict]) -> Iterator[tuple]:
        held: Counter = Counter()
        for r in records:
            seen = {s for w in set((r["text"] or "").split()) for s in stems(w)}
            held.update((s, r["fold"], r["label"]) for s in seen)
            if len(held) > 200_000:
                yield from ((*k, v) for k, v in held.items())
                held = Counter()
        yield from ((*k, v) for k, v in held.items())

    def total(fold: int | None, label: int) -> Column:
        wanted = (F.col("label") == label) & (F.lit(True) if fold is None else F.col("fold") == fold)
        return F.coalesce(F.sum(F.when(wanted, F.col("n"))), F.lit(0))

    grams = map_rows(sample.select("text", "fold", "label"), counts, "gram string, fold int, label int, n long")
    size = {(r["fold"], r["label"]): r["n"] for r in sample.groupBy("fold", "label").agg(F.count("*").alias("n")).collect()}
    per_gram = cut(grams.groupBy("gram").agg(*[
        total(f, label).alias(f"n{f if f is not None else 2}{label}") for f in (0, 1, None) for label in (0, 1)])
        .filter(F.col("n21") >= SUPPORT))
    lexicons = {}
    for fold in (0, 1, 2):
        folds = (0, 1) if fold == 2 else (fold,)
        all_0, all_1 = (sum(size.get((f, label), 0) for f in folds) for label in (0, 1))
        score = F.log((F.col(f"n{fold}1") + 0.5) / (all_1 + 1)) - F.log((F.col(f"n{fold}0") + 0.5) / (all_0 + 1))
        lexicons[fold] = per_gram.filter(F.col(f"n{fold}1") >= SUPPORT).select(
            F.lit(fold).alias("of"), "gram", score.alias("score")).filter(F.col("score") >= LOG_RATIO).orderBy(
            F.desc("score"), "gram").limit(LEXICON_SIZE)
    rows = lexicons[0].union(lexicons[1]).union(lexicons[2]).collect()
    return {k: {r["gram"]: r["score"] for r in rows if r["of"] == k} for k in (0, 1, 2)}


@dataclass
class Trees:
    """Boosted trees of logistic loss; a tree is arrays of feature, threshold and leaf values in heap order."""

    depth: int = 3
    rounds: int = 60
    rate: float = 0.15
    bins: int = 48
    least: int = 8
    ridge: float = 1.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        self.start = math.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, self.bins + 1)[1:-1], method="lower")) for f in range(x.shape[1])]
        binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
        margin = np.full(len(y), self.start)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-margin))
            tree = self._grow(binned, edges, p - y, p * (1 - p) + 1e-6)
            self.trees.append(tree)
            margin = margin + self._leaf(tree, x)
        return self

    def _grow(self, binned, edges, g, h):
        inner = (1 << self.depth) - 1
        feature, threshold = np.zeros(inner, int), np.full(inner, np.inf)
        where = np.zeros(len(g), int)
        for node in range(inner):
            rows = np.flatnonzero(where == node)
            best = 1e-6
            for f, e in enumerate(edges):
                if not len(e) or len(rows) < 2 * self.least:
                    continue
                b = binned[rows, f]
                gs, hs, n = (np.bincount(b, w, len(e) + 1).cumsum()[:-1] for w in (g[rows], h[rows], np.ones(len(rows))))
                all_g, all_h = g[rows].sum(), h[rows].sum()
                gain = gs**2 / (hs + self.ridge) + (all_g - gs)**2 / (all_h - hs + self.ridge) - all_g**2 / (all_h + self.ridge)
                gain[(n < self.least) | (len(rows) - n < self.least)] = 0
                if (k := int(gain.argmax())) is not None and gain[k] > best:
                    best, feature[node], threshold[node] = gain[k], f, e[k]
            right = binned[rows, feature[node]] > np.searchsorted(edges[feature[node]], threshold[node], side="left")
            where[rows] = 2 * node + 1 + (right & np.isfinite(threshold[node]))
        leaves = where - inner
        n = 1 << self.depth
        value = -self.rate * np.bincount(leaves, g, n) / (np.bincount(leaves, h, n) + self.ridge)
        return feature, threshold, value

    def _leaf(self, tree, x):
        feature, threshold, value = tree
        at = np.zeros(len(x), int)
        for _ in range(self.depth):
            at = 2 * at + 1 + (x[np.arange(len(x)), feature[at]] > threshold[at])
        return value[at - (1 << self.depth) + 1]

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.start + sum(self._leaf(t, x) for t in self.trees)


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots and values of the rising step function nearest to ``y``, between-knot values interpolated."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []  # sum, count, least and greatest score
    for s, v in zip(score[order], y[order]):
        blocks.append([float(v), 1.0, float(s), float(s)])
        while len(blocks) > 1 and (blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1] or blocks[-2][3] >= blocks[-1][2]):
            a = blocks.pop()
            blocks[-1] = [blocks[-1][0] + a[0], blocks[-1][1] + a[1], blocks[-1][2], a[3]]
    knots = [k for b in blocks for k in (b[2], b[3])]
    values = [(b[0] + 0.05) / (b[1] + 0.1) for b in blocks for _ in (0, 1)]
    return np.array(knots), np.maximum.accumulate(np.array(values))


@dataclass
class Model:
    lexicon: dict[str, float]
    trees: Trees | None
    knots: np.ndarray | None = None
    values: np.ndarray | None = None
    rate: float = 0.0

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.trees is None:
            return np.full(len(x), self.rate)
        return np.clip(np.interp(self.trees.margin(x), self.knots, self.values), 0.0, 1.0)


def fit(docs: DataFrame, labels: DataFrame, learn: Column, rows: int = SAMPLE_DOCS) -> Model:
    """Learn from at most ``rows`` labelled documents for which ``learn`` (over ``doc_id``) holds.

    The lexicon of each half makes the features of the other half, so that no text is described by words learned from
    itself; words beyond its ``LEXICON_SIZE`` best entries say nothing.  Isotonic calibration is fitted on margins of trees
    that have not seen the row: those of one half on the rows of the other, while scores come from trees of both, whose
    margins are spread a little wider.  With fewer than ten rows of
    either label the score is the share of toxic rows (0 without any).
    """
    sample = cut(labelled_sample(docs, labels, "toxic", learn, rows))
    lexicons = learned_lexicons(sample)
    table = feature_table(sample, {0: lexicons[1], 1: lexicons[0]}, ("fold", "label")).orderBy("doc_id").toPandas()
    x, y, fold = table[list(FEATURES)].to_numpy(float), table["label"].to_numpy(float), table["fold"].to_numpy()
    if min(y.sum(), len(y) - y.sum()) < 10:
        return Model(lexicons[2], None, rate=float(y.mean()) if len(y) else 0.0)
    margins = np.zeros(len(y))
    for k in (0, 1):
        if (fold == k).any() and (fold != k).any():
            margins[fold == k] = Trees().fit(x[fold != k], y[fold != k]).margin(x[fold == k])
    knots, values = isotonic(margins, y)
    return Model(lexicons[2], Trees().fit(x, y), knots, values, float(y.mean()))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id`` and ``score`` (0 to 1) of every row; null text counts as empty.  Narrow, whole texts, no other column read."""
    def rows(records: Iterator[dict]) -> Iterator[tuple]:
        marker, held = Marker(model.lexicon), []

        def scored():
            return zip([d for d, _ in held], map(float, model.score(np.array([f for _, f in held], float)))) if held else ()

        for r in records:
            held.append((r["doc_id"], marker.features(r["text"] or "")))
            if len(held) == 2048:
                yield from scored()
                held = []
        yield from scored()

    return map_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), rows,
                    "doc_id long, score double")
