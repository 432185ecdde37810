"""Language by Bayesian fusion of text likelihoods, declared language, address suffix and host priors."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from passagework.functions.once import once
from passagework.llm.arrow import arrow_map, map_batches, pieces
from passagework.llm.text_bytes import column_bytes, windows
from passagework.sources.lineage import cut

LANGUAGES = ("en", "fr", "de", "es")
#: The hypothesis that a text is of none of the languages.
OTHER = "other"
OTHER_PRIOR = 1e-3
#: Places of the hash of three bytes, and one more for threes that count nothing.
PLACES = 1 << 16
#: Weight of one three-byte likelihood: neighbouring threes say much the same.
TEMPER = 0.15
#: Pseudo-counts with which a host leans on its domain, a domain on its suffix, a suffix on all documents, and those of evidence tables.
HOST_PULL, DOMAIN_PULL, SUFFIX_PULL, TABLE_PULL = 10.0, 20.0, 50.0, 1.0
#: A document is kept with this posterior of its best language and at least one letter.
SURE = 0.6

#: Prefix of the columns that carry evidence beside a table's own.
EV = "_lid_"

FOLD = np.arange(256, dtype=np.uint8)
FOLD[ord("A"):ord("Z") + 1] += 32
FOLD[:ord("A")] = 32
FOLD[[*range(91, 97), *range(123, 128)]] = 32


def threes(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(texts, starts, places) per window: the hashed three bytes that begin at each byte; PLACES where they count nothing,
    which is where two of three bytes are no letters or the text ends."""
    ends = offsets[1:][np.diff(offsets) > 0]
    for low, high, texts, starts in windows(offsets):
        x = FOLD[data[low:high + 2]]
        x = np.concatenate([x, np.full(high + 2 - low - len(x), 32, np.uint8)]).astype(np.uint32)
        a, b, c = x[:-2], x[1:-1], x[2:]
        h = (((a * np.uint32(0x9E5) + b) * np.uint32(0x85F1) + c) * np.uint32(0x9E3779B1)) >> np.uint32(16)
        h[((a == 32).astype(np.uint8) + (b == 32) + (c == 32)) > 1] = PLACES
        last = ends[(ends > low) & (ends <= high + 1)] - low
        tail = np.concatenate([last - 1, last - 2])
        h[tail[(tail >= 0) & (tail < high - low)]] = PLACES
        yield texts, starts, h


def primary(declared: Column) -> Column:
    """The main language of a declared tag: ``en`` of ``EN-us``."""
    return F.lower(F.trim(F.split(declared.cast("string"), "[-_]")[0]))


def evidence_of_pages(pages: DataFrame) -> DataFrame:
    """``page_id`` with ``text``, ``declared``, ``host``, ``domain`` and ``suffix`` of raw pages; tags, scripts and styles are cut from the text."""
    html, url = F.coalesce("html", F.lit("")), F.coalesce("url", F.lit(""))
    body = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    labels = F.split(host, r"\.")
    return pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.regexp_replace(body, r"<[^>]*>", " ").alias("text"),
        F.nullif(F.regexp_extract(html, r"(?i)<html[^>]*\blang\s*=\s*[\"']?([A-Za-z-]+)", 1), F.lit("")).alias("declared"),
        F.nullif(host, F.lit("")).alias("host"),
        F.nullif(F.array_join(F.slice(labels, -F.least(F.size(labels), F.lit(3)), 3), "."), F.lit("")).alias("domain"),
        F.nullif(F.element_at(labels, -1), F.lit("")).alias("suffix"))


def evidence_of_documents(docs: DataFrame) -> DataFrame:
    """``docs`` with ``declared`` (their ``lang``) and ``host`` (their ``source``); documents have no address, so no suffix."""
    none = F.lit(None).cast("string")
    return docs.withColumns({EV + "declared": F.col("lang").cast("string"), EV + "host": F.col("source").cast("string"),
                             EV + "domain": none, EV + "suffix": none})


def likelihoods(docs: DataFrame, languages: Sequence[str], text: str, declared: Column) -> np.ndarray:
    """Counts of threes by declared language over all documents, summed per task and then grouped; smoothed logarithms.

    What reaches the driver is bounded by languages x PLACES whatever the input.
    """
    coded = docs.select(F.col(text).cast("string").alias("text"), F.coalesce(
        F.array_position(F.array(*map(F.lit, languages)), primary(declared)), F.lit(0)).cast("int").alias("code")).filter("code > 0")
    size = PLACES + 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterable[tuple]:
        total = np.zeros(len(languages) * size, np.int64)
        for batch in batches:
            data, offsets = column_bytes(batch.column(0))
            code = batch.column(1).to_numpy() - 1
            for texts, starts, h in threes(data, offsets):
                of = np.repeat(code[texts].astype(np.int64) * size, np.diff(np.append(starts, len(h))))
                total += np.bincount(of + h, minlength=len(total))
        for k in np.flatnonzero(total):
            if k % size < PLACES:
                yield int(k // size), int(k % size), int(total[k])

    rows = map_batches(coded, count, "code int, place int, n long").groupBy("code", "place").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros((PLACES + 1, len(languages)))
    counts[rows["place"].to_numpy(), rows["code"].to_numpy()] = rows["n"].to_numpy()
    out = np.full((PLACES + 1, len(languages) + 1), -np.log(PLACES))
    out[:, :-1] = np.log((counts + 0.05) / (counts.sum(axis=0) + 0.05 * PLACES))
    out[PLACES] = 0
    return (out * TEMPER).astype(np.float32)


def text_scores(docs: DataFrame, likelihood: np.ndarray, text: str = "text") -> DataFrame:
    """``docs`` with the log likelihood of each whole text under every language and other, and its count of counted threes."""
    names = docs.columns
    schema = StructType([*docs.schema.fields, StructField(EV + "likelihood", ArrayType(DoubleType())), StructField(EV + "threes", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole):
                column = batch.column(names.index(text))
                data, offsets = column_bytes(column)
                sums, counted = np.zeros((len(column), likelihood.shape[1])), np.zeros(len(column), np.int64)
                for texts, starts, h in threes(data, offsets):
                    sums[texts] += np.add.reduceat(likelihood[h], starts, axis=0)
                    counted[texts] += np.add.reduceat((h < PLACES).astype(np.int64), starts)
                lists = pa.ListArray.from_arrays(np.arange(0, sums.size + 1, sums.shape[1], dtype=np.int32), sums.ravel())
                yield pa.RecordBatch.from_arrays([*batch.columns, lists, pa.array(counted)], names=[*names, EV + "likelihood", EV + "threes"])

    return arrow_map(docs, run, schema)


def given_language(scored: DataFrame, column: Column, best: Column, n: int) -> DataFrame:
    """P(value | language) of every value of ``column`` as an array by language: counted by the language that the text alone
    gives, smoothed towards the value's share of all rows.  Null values are no evidence and are not counted."""
    of = [F.sum((best == k).cast("long")).alias(f"n{k}") for k in range(n)]
    counts = scored.filter(column.isNotNull()).groupBy(column.alias("value")).agg(*of)
    total = counts.agg(*[F.coalesce(F.sum(f"n{k}"), F.lit(0)) for k in range(n)]).first()
    share = sum(F.col(f"n{k}") for k in range(n)) / max(sum(total), 1)
    return counts.select("value", F.array(*[
        F.log((F.col(f"n{k}") + TABLE_PULL * share + 1e-9) / (total[k] + TABLE_PULL)) for k in range(n)]).alias("given"))


def host_priors(scored: DataFrame, languages: Sequence[str]) -> DataFrame:
    """Language shares by host, domain, suffix and overall, by grouped aggregation; each level leans on the one above.

    One row per (host, domain, suffix): ``counts`` of its host by declared language and ``parent``, the smoothed shares of
    its domain, so that a document's own declaration can be taken out before the host's share is formed.
    """
    code = F.array_position(F.array(*map(F.lit, languages)), primary(F.col(EV + "declared")))
    levels = [EV + "host", EV + "domain", EV + "suffix"]
    per = scored.groupBy(*levels).agg(*[F.sum((code == k + 1).cast("long")).alias(f"c{k}") for k in range(len(languages))])
    per = cut(per.select(*levels, *[F.coalesce(f"c{k}", F.lit(0)).alias(f"c{k}") for k in range(len(languages))]))
    n = range(len(languages))

    def summed(by: list[str], prefix: str) -> DataFrame:
        return per.groupBy(*by).agg(*[F.sum(f"c{k}").alias(f"{prefix}{k}") for k in n])

    def shares(prefix: str, above: list[Column], pull: float) -> list[Column]:
        total = sum(F.col(f"{prefix}{k}") for k in n)
        return [(F.col(f"{prefix}{k}") + pull * above[k]) / (total + pull) for k in n]

    def same(left: DataFrame, right: DataFrame, by: list[str], prefix: str) -> DataFrame:
        named = right.withColumnsRenamed({c: f"{prefix}_{c}" for c in by})
        on = [left[c].eqNullSafe(named[f"{prefix}_{c}"]) for c in by]
        return left.join(named, on).drop(*(f"{prefix}_{c}" for c in by))

    total = per.agg(*[F.coalesce(F.sum(f"c{k}"), F.lit(0)) for k in n]).first()
    overall = [F.lit((total[k] + 1 / len(languages)) / (sum(total) + 1)) for k in n]
    table = same(per, summed([EV + "suffix"], "s"), [EV + "suffix"], "s")
    table = same(table, summed([EV + "domain", EV + "suffix"], "d"), [EV + "domain", EV + "suffix"], "d")
    table = same(table, summed([EV + "host"], "h"), [EV + "host"], "h")
    by_domain = shares("d", shares("s", overall, SUFFIX_PULL), DOMAIN_PULL)
    return table.select(*levels, F.array(*[F.col(f"h{k}").cast("double") for k in n]).alias("counts"), F.array(*by_domain).alias("parent"))


@dataclass(frozen=True)
class Fusion:
    """All that documents are judged by: likelihoods of threes, and the tables of the other evidence."""

    languages: tuple[str, ...]
    likelihood: np.ndarray
    declared: DataFrame
    suffix: DataFrame
    hosts: DataFrame


def best_of(values: Column) -> Column:
    """Place of the greatest value, the first of equal ones, from 0."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def learn(docs: DataFrame, languages: Sequence[str] = LANGUAGES, text: str = "text") -> tuple[Fusion, DataFrame]:
    """The tables of evidence from all of ``docs`` (with the evidence columns), and the scored rows without their texts."""
    likelihood = likelihoods(docs, languages, text, F.col(EV + "declared"))
    scored = text_scores(docs, likelihood, text).drop(text)
    scored = cut(scored)
    n = len(languages) + 1
    lettered = scored.filter(F.col(EV + "threes") > 0)
    best = best_of(F.col(EV + "likelihood"))
    declared = cut(given_language(lettered, primary(F.col(EV + "declared")), best, n))
    suffix = cut(given_language(lettered, F.col(EV + "suffix"), best, n))
    return Fusion(tuple(languages), likelihood, declared, suffix, cut(host_priors(scored, languages))), scored


def fuse(scored: DataFrame, fusion: Fusion) -> DataFrame:
    """``scored`` with ``language``, ``probability`` and ``accepted``, its evidence columns dropped.

    Null evidence says nothing.  A text without counted threes is judged by the other evidence and never accepted.
    The tables are joined by value: Spark broadcasts them where they are small, a host table of any size shuffles.
    """
    n = len(fusion.languages)
    own = F.array_position(F.array(*map(F.lit, fusion.languages)), primary(F.col(EV + "declared")))
    neutral = F.array_repeat(F.lit(0.0), n + 1)
    rows = scored.withColumn(EV + "primary", primary(F.col(EV + "declared")))
    rows = rows.join(fusion.declared.withColumnsRenamed({"value": EV + "dv", "given": EV + "dg"}), F.col(EV + "primary") == F.col(EV + "dv"), "left")
    rows = rows.join(fusion.suffix.withColumnsRenamed({"value": EV + "sv", "given": EV + "sg"}), F.col(EV + "suffix") == F.col(EV + "sv"), "left")
    hosts = fusion.hosts.withColumnsRenamed({c: f"{EV}h_{c.removeprefix(EV)}" for c in fusion.hosts.columns})
    rows = rows.join(hosts, [F.col(EV + c).eqNullSafe(F.col(f"{EV}h_{c}")) for c in ("host", "domain", "suffix")], "left")
    counts, parent = F.col(EV + "h_counts"), F.col(EV + "h_parent")
    left = F.transform(counts, lambda c, i: c - F.when(i == own - 1, 1.0).otherwise(0.0))
    total = F.aggregate(left, F.lit(0.0), lambda a, c: a + c)
    prior = F.zip_with(left, parent, lambda c, p: F.log((1 - OTHER_PRIOR) * (c + HOST_PULL * p) / (total + HOST_PULL)))
    prior = F.concat(F.coalesce(prior, F.array_repeat(F.log(F.lit((1 - OTHER_PRIOR) / n)), n)), F.array(F.log(F.lit(OTHER_PRIOR))))

    def plus(a: Column, b: Column) -> Column:
        return F.zip_with(a, b, lambda x, y: x + y)

    joint = plus(plus(F.col(EV + "likelihood"), prior), plus(F.coalesce(EV + "dg", neutral), F.coalesce(EV + "sg", neutral)))
    names = F.array(*map(F.lit, (*fusion.languages, OTHER)))
    rows = once(rows, **{EV + "joint": joint})
    top = F.array_max(EV + "joint")
    sure = 1 / F.aggregate(F.col(EV + "joint"), F.lit(0.0), lambda a, v: a + F.exp(v - top))
    rows = rows.withColumn(EV + "at", best_of(F.col(EV + "joint"))).withColumn(EV + "sure", sure)
    accepted = (F.col(EV + "at") < n) & (F.col(EV + "sure") >= SURE) & (F.col(EV + "threes") > 0)
    rows = rows.withColumns({"language": names[F.col(EV + "at")], "probability": F.col(EV + "sure"), "accepted": accepted})
    return rows.drop(*[c for c in rows.columns if c.startswith(EV)])


def identify(docs: DataFrame, languages: Sequence[str] = LANGUAGES, text: str = "text") -> DataFrame:
    """Language of every row of ``docs``, which carries the evidence columns: its columns without them and ``text``, and
    ``language``, ``probability``, ``accepted``.

    ``languages`` are the hypotheses, beside *other*.  Null and empty texts are judged by the other evidence alone and are
    not accepted; repeated rows stay repeated.  Two passes over the texts: counts of threes by declared language, then
    scores; only rows of a few numbers are joined.
    """
    fusion, scored = learn(docs, languages, text)
    return fuse(scored, fusion)


def accept(docs: DataFrame, languages: Sequence[str] = LANGUAGES) -> DataFrame:
    """The rows of a table like ``documents`` (text, lang, source) whose language is accepted, with the same columns."""
    names = docs.columns
    plain = docs.toDF(*[c if c in ("text", "lang", "source") else f"{EV}own_{k}" for k, c in enumerate(names)])
    given = evidence_of_documents(plain)
    fusion, _ = learn(given.select("text", *[EV + c for c in ("declared", "host", "domain", "suffix")]), languages)
    hidden = {c: f"{EV[1:]}own_{k}" for k, c in enumerate(plain.columns) if c != "text"}
    kept = fuse(text_scores(given.withColumnsRenamed(hidden), fusion.likelihood), fusion).filter("accepted")
    return kept.select(*[hidden.get(c, c) for c in plain.columns]).toDF(*names)
