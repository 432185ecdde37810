"""Near-duplicates by SetSketch: bands of registers, joint likelihood estimates, links confirmed on full sets."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from passagework.functions.graph import components
from passagework.llm.arrow import lean, map_batches, pieces
from passagework.llm.id_filter import split_by_filter
from passagework.llm.setsketch import REGISTERS, band_keys, jaccard_estimate, registers
from passagework.llm.shingles import shingle_sets
from passagework.llm.words import mix
from passagework.sources.lineage import cut

WIDTH = 5
PERCENT = 80
#: Registers of a band, and which registers the bands take: all in one random order, half of them again in another.  With 63
#: bands a pair at similarity 0.8 meets in none with a chance of 5 in a thousand million.
BAND = 6
ORDER = np.concatenate([np.random.default_rng(8).permutation(REGISTERS)[:252], np.random.default_rng(9).permutation(REGISTERS)[:126]])
#: Elements of a set, and of those that it may have beside the common ones, for which sets also meet without any chance of a miss.
SMALL, SMALL_REST = 14, 2
#: Registers that travel with a pair for its estimate, and how far below the threshold an estimate may lie (over four deviations).
HEAD = 128
MARGIN = 0.16
#: Rows of the two sides of a block in which sets are compared with each other.
MINOR_BLOCK, BLOCK = 256, 1024

ND = "_nd_"


def small_keys(elements: np.ndarray, percent: int) -> list[int]:
    """Keys of a small set that every set linked with it shares, if that is small too.

    Linked sets of n and m elements have at least ``percent`` of the greater of both in common.  So the common set is
    what is left of each after so few elements are taken out, and every such rest is a key.  Larger sets have none.
    """
    n = len(elements)
    rest = n * (100 - percent) // 100
    if not 0 < n <= SMALL or rest > SMALL_REST:
        return []
    codes = mix(elements + np.uint64(SMALL)).tolist()
    whole = sum(codes)
    left = [whole - sum(out) & (1 << 64) - 1 for k in range(rest + 1) for out in combinations(codes, k)]
    return mix(np.array(left, np.uint64)).view(np.int64).tolist()


def sketches(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """``doc_id``, ``n`` (size of its set), ``digest`` of the set, ``registers`` (null for an empty set) and ``small`` keys of every row."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterable[tuple]:
        for whole in batches:
            for batch in pieces(whole, 1 << 20):
                elements, offsets = shingle_sets(batch.column(1), width)
                found = registers(elements, offsets)
                for k, doc in enumerate(batch.column(0).to_pylist()):
                    own = elements[offsets[k]:offsets[k + 1]]
                    yield (doc, len(own), hashlib.blake2b(own.tobytes(), digest_size=16).digest(), found[k].tobytes() if len(own) else None,
                           small_keys(own, percent))

    return map_batches(docs, rows, "doc_id long, n long, digest binary, registers binary, small array<long>")


def bucket_rows(nodes: DataFrame) -> DataFrame:
    """(key, node): a row for every band of every node's registers and for every key of a small set."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(k, 2048) for k in range(0, batch.num_rows, 2048)):
                sketch = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint16).reshape(-1, REGISTERS)
                keys = band_keys(sketch[:, ORDER], BAND)
                node = part.column(0).to_numpy()
                small = part.column(2).to_pylist()
                few = np.array([k for own in small for k in own], np.int64)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.concatenate([keys.ravel().view(np.int64), few])),
                    pa.array(np.concatenate([np.repeat(node, keys.shape[1]), np.repeat(node, [len(own) for own in small])]))], names=["key", "node"])

    return nodes.select("node", "registers", "small").mapInArrow(lean(rows), "key long, node long")


def estimated(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) with the ``estimate`` of their similarity, those left out that lie ``MARGIN`` below the threshold, unless both are
    small, or whose set sizes rule a link out."""
    heads = nodes.select("node", "n", F.substring("registers", 1, 2 * HEAD).alias("head"))

    def side(name: str) -> DataFrame:
        return heads.select(F.col("node").alias(name), F.col("n").alias("n_" + name), F.col("head").alias("head_" + name))

    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "n_b", "head_a", "head_b")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b, n_a, n_b = (batch.column(k).to_numpy() for k in range(4))
            head_a, head_b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint16).reshape(-1, HEAD) for k in (4, 5))
            guess = jaccard_estimate(head_a, head_b, n_a.astype(float), n_b.astype(float))
            on = ((guess >= percent / 100 - MARGIN) | (np.maximum(n_a, n_b) <= SMALL)) & (100 * np.minimum(n_a, n_b) >= percent * np.maximum(n_a, n_b))
            yield pa.RecordBatch.from_arrays([pa.array(a[on]), pa.array(b[on]), pa.array(guess[on])], names=["a", "b", "estimate"])

    return both.mapInArrow(lean(rows), "a long, b long, estimate double")


def confirmed(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar; ``texts``: node and text."""
    a = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    b = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    both = pairs.select("a", "b").join(a, "a").join(b, "b").select("a", "b", "text_a", "text_b")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, 1 << 20):
                left, at_left = shingle_sets(batch.column(2), width)
                right, at_right = shingle_sets(batch.column(3), width)
                on = []
                for k in range(batch.num_rows):
                    x, y = left[at_left[k]:at_left[k + 1]], right[at_right[k]:at_right[k + 1]]
                    joined = np.sort(np.concatenate([x, y]), kind="stable")
                    common = int(np.count_nonzero(joined[1:] == joined[:-1]))
                    on.append(100 * common >= percent * (len(x) + len(y) - common))
                yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(on, pa.bool_()))

    return both.mapInArrow(lean(rows), "a long, b long")


def rooted(nodes: DataFrame, roots: DataFrame, name: str) -> DataFrame:
    """``nodes`` with the component of column ``name`` as ``<name>_root``."""
    renamed = roots.select(F.col("node").alias(name), F.col("root").alias(name + "_root"))
    return nodes.join(renamed, name, "left").withColumn(name + "_root", F.coalesce(name + "_root", name))


def links_across(buckets: DataFrame, roots: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Links (a, b) between components that share a bucket, found by comparing full sets block by block.

    In each bucket the rows of all components but the most frequent one meet every row.  Rows are dealt into blocks of
    bounded size, and a pair of blocks is a task of its own; it returns one link for each two components that it links.
    """
    rows = rooted(buckets, roots, "node")
    mixed = rows.groupBy("key").agg(F.min("node_root").alias("low"), F.max("node_root").alias("high")).filter("low != high").select("key")
    rows = cut(rows.join(mixed, "key"))
    sizes = rows.groupBy("key", "node_root").agg(F.count("*").alias("n"))
    frame = cut(sizes.groupBy("key").agg(
        F.max(F.struct("n", F.col("node_root").alias("root"))).alias("major"), F.sum("n").alias("all")).select(
        "key", F.col("major.root").alias("major"), F.ceil((F.col("all") - F.col("major.n")) / MINOR_BLOCK).cast("int").alias("minors"),
        F.ceil(F.col("all") / BLOCK).cast("int").alias("blocks")))
    told = rows.join(frame, "key").withColumn("h", F.xxhash64("node"))
    minor = told.filter("node_root != major").select(
        "key", F.pmod("h", "minors").cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("j"), "node", "node_root",
        F.lit(True).alias("minor"))
    every = told.select("key", F.explode(F.sequence(F.lit(0), F.col("minors") - 1)).alias("i"), F.pmod("h", "blocks").cast("int").alias("j"),
                        "node", "node_root", F.lit(False).alias("minor"))
    dealt = minor.unionByName(every).join(texts, "node").select("key", "i", "j", "node", "node_root", "minor", "text")

    def compare(table: pa.Table) -> pa.Table:
        node, root = (table.column(k).to_numpy() for k in (3, 4))
        minor = table.column(5).to_numpy()
        sets, at = shingle_sets(pa.concat_arrays(table.column(6).chunks) if table.num_rows else pa.array([], pa.string()), width)
        size = np.diff(at)
        of = np.repeat(np.arange(len(node)), size)
        values, place = np.unique(sets, return_inverse=True)
        in_both = (np.bincount(place[minor[of]], minlength=len(values)) > 0) & (np.bincount(place[~minor[of]], minlength=len(values)) > 0)
        column = np.cumsum(in_both) - 1
        kept = in_both[place]
        of, place = of[kept], column[place[kept]]
        common = np.zeros((int(minor.sum()), int((~minor).sum())), np.float32)
        row = np.where(minor, np.cumsum(minor) - 1, np.cumsum(~minor) - 1)
        order = np.argsort(place, kind="stable")
        of, place = of[order], place[order]
        step = 4096
        for k in range(0, int(in_both.sum()), step):
            part = slice(*np.searchsorted(place, [k, k + step]))
            o, c = of[part], place[part] - k
            x, y = np.zeros((common.shape[0], step), np.float32), np.zeros((common.shape[1], step), np.float32)
            x[row[o[minor[o]]], c[minor[o]]] = 1
            y[row[o[~minor[o]]], c[~minor[o]]] = 1
            common += x @ y.T
        union = size[minor][:, None] + size[~minor][None, :] - common
        linked = (100 * common >= percent * union) & (root[minor][:, None] != root[~minor][None, :])
        a, b = np.nonzero(linked)
        pairs = np.stack([root[minor][a], root[~minor][b], node[minor][a], node[~minor][b]], axis=1)
        _, one = np.unique(pairs[:, :2], axis=0, return_index=True)
        return pa.table({"a": pairs[one, 2], "b": pairs[one, 3]}, schema=pa.schema([("a", pa.int64()), ("b", pa.int64())]))

    return dealt.groupBy("key", "i", "j").applyInArrow(compare, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """Per row ``doc_id``, ``n_shingles``, ``component_id`` (the least id that links reach, itself included) and ``kept``.

    Texts are linked where 100 * intersection >= ``percent`` * union of their sets of ``width``-word shingles.  Empty sets
    (null text too) and rows without id are linked with nothing; a row without id has a null component and is kept.
    Rows that share an id are judged text by text.

    Equal sets are one node, the least id that has them.  Nodes that share a band of registers, or a key of small sets, meet the least
    node of that bucket, never each other all at once: estimates by likelihood sort out pairs, the rest is
    confirmed on full sets.  Buckets that hold several components after that are compared block by block, so that no link is lost whatever a bucket's size.
    """
    ready = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = cut(sketches(ready, width, percent))
    linkable = found.filter("n > 0 and doc_id is not null")
    classes = cut(linkable.groupBy("digest").agg(F.min("doc_id").alias("node")))
    nodes = cut(linkable.join(classes, "digest").filter("doc_id = node").dropDuplicates(["digest"]).select("node", "n", "registers", "small"))

    rows = bucket_rows(nodes)
    shared = cut(rows.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("low"), F.max("node").alias("high")).filter("low != high"))
    met = cut(rows.join(shared, "key").select("key", "node", "n", "low", "high"))
    # In buckets of two or three nodes that is every pair; larger ones meet their least node first, and are gone through later.
    ends = met.select("node", F.explode(F.when(F.col("n") > 3, F.array("low")).otherwise(F.array("low", "high"))).alias("end")).filter("node != end")
    pairs = ends.select(F.least("node", "end").alias("a"), F.greatest("node", "end").alias("b")).distinct()
    likely = cut(estimated(pairs, nodes, percent))

    wanted = likely.select(F.explode(F.array("a", "b")).alias("doc_id")).unionByName(
        met.filter("n > 3").select(F.col("node").alias("doc_id"))).distinct()
    wanted = cut(wanted.withColumnRenamed("doc_id", "node"))
    chosen = split_by_filter(ready, wanted.withColumnRenamed("node", "doc_id"), "doc_id", True)
    texts = cut(chosen.join(wanted.withColumnRenamed("node", "doc_id"), "doc_id", "left_semi").withColumnRenamed("doc_id", "node"))

    links = cut(confirmed(likely, texts, width, percent))
    roots = components(links)
    more = cut(links_across(met.filter("n > 3").select("key", "node"), roots, texts, width, percent))
    if more.take(1):
        roots = components(links.unionByName(more))

    judged = found.select("doc_id", "n", "digest").join(classes, "digest", "left").withColumn("node", F.when(F.col("n") > 0, F.col("node")))
    judged = rooted(judged, roots, "node")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("node_root", "doc_id"))
    return judged.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"),
                         F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """``docs`` with the same columns, of every component of near-duplicates the document of the least id.

    Rows that share id and text are one document, of which one row stays (any, if other columns differ; null and empty texts
    too).  Texts of the same id are documents of their own, in the order of their digests, and rows without id stand after
    all others: both are linked by their texts like any other document here.

    Ids that are no integers are ordered by the integer that they spell, then by their own order.

    Where all ids are integers and there once, rows whose id no filter suspects stay where they are; only suspected rows
    are moved to meet the list of dropped ids.  Else every distinct document is numbered first, which moves the texts.
    Jobs run while the frame is built.
    """
    number = ND + "number"
    if isinstance(docs.schema["doc_id"].dataType, IntegralType):
        shared = docs.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1 or doc_id is null")
        if not shared.take(1):
            return without_dropped(docs.withColumn(number, F.col("doc_id").cast("long")), number, width, percent).drop(number)
    told = docs.withColumn(ND + "text", F.coalesce(F.md5(F.col("text").cast("string").cast("binary")), F.lit("")))
    spelled = F.col("doc_id").cast("string").try_cast("long")
    told = told.dropDuplicates(["doc_id", ND + "text"]).orderBy(spelled.asc_nulls_last(), F.col("doc_id").asc_nulls_last(), ND + "text")
    numbered = cut(told.withColumn(number, F.monotonically_increasing_id()))
    return without_dropped(numbered, number, width, percent).drop(number, ND + "text")


def without_dropped(docs: DataFrame, number: str, width: int, percent: int) -> DataFrame:
    """The rows of ``docs`` whose ``number``, a long that no two rows share, is the least of its component."""
    judged = near_duplicates(docs.select(F.col(number).alias("doc_id"), "text"), width, percent)
    dropped = cut(judged.filter("not kept").select(F.col("doc_id").alias(number)).distinct())
    clear = split_by_filter(docs, dropped, number, False)
    left = split_by_filter(docs, dropped, number, True).join(dropped, number, "left_anti")
    return clear.unionByName(left)
