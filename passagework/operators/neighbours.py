"""Exact nearest neighbours by squared Euclidean distance, without a pair table.

A small question side travels: its vectors are sent in batches of bounded bytes to the corpus rows where they are read, and
only the best of each input split are shuffled.  Two large sides meet by cells: corpus vectors lie in the cell of their
nearest pivot, a cell knows its radius, and a question meets only cells that the triangle inequality does not rule
out after it has seen the ones nearest to it.  What is left is met in tiles, crowds of questions against slabs of cells: both
sides move once for each crowd or slab of the other, which are large, and a slab streams past the crowd.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S
from pyspark.sql.pandas.types import to_arrow_schema

from passagework.functions.once import once
from passagework.functions.windows import top_per_key
from passagework.sources.lineage import cut

#: Bytes of question vectors that may travel to the corpus, and how many of them go at once.
SMALL_SIDE_BYTES, BATCH_BYTES = 4 << 20, 2 << 20
#: Values of a scope column that a filter lists.
MOST_SCOPES = 1000
#: Cells of all scopes that travel to the questions; more of them meet these in a join.
SENT_CELLS = 1 << 18
#: Distances that a task holds at once.
MATRIX = 1 << 20
#: Vectors of a side that meet in one task.
VECTOR_BLOCK = 4096
#: Questions that a task holds while corpus rows stream past them, and about how many of these.
CROWD, SLAB = 1 << 14, 1 << 17
#: Candidates that a task gathers before they are ranked.
GATHERED = 1 << 18
#: Cells of the corpus at most; the pivots of all cells travel to every task.
MOST_PIVOTS = 1024
#: Distances are compared after rounding to this many places, ties go by key; bounds leave room for it.
TIE_DIGITS = 6
SLACK = 1e-5


def vectors(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A list column without nulls as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of ``a`` to all rows of ``b``."""
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * (a @ b.T), 0.0)


def best(distance: np.ndarray, k: int, key_rank: np.ndarray, limit: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the ``k`` least of each row of ``distance``, rounded, ties by ``key_rank`` of the column.

    ``limit`` leaves out what lies beyond it in its row.
    """
    rounded = np.round(distance, TIE_DIGITS)
    if rounded.shape[1] > k:
        edge = np.partition(rounded, k - 1, axis=1)[:, k - 1]
        row, col = np.nonzero(rounded <= (edge if limit is None else np.minimum(edge, limit))[:, None])
    else:
        row, col = np.nonzero(np.ones(rounded.shape, bool) if limit is None else rounded <= limit[:, None])
    order = np.lexsort((key_rank[col], rounded[row, col], row))
    row, col = row[order], col[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    return row[place < k], col[place < k]


def rank_of(keys: np.ndarray) -> np.ndarray:
    out = np.empty(len(keys), np.int64)
    out[np.argsort(keys, kind="stable")] = np.arange(len(keys))
    return out


def knn(queries: DataFrame, corpus: DataFrame, k: int, scope: list[str], block: int = VECTOR_BLOCK,
        small_bytes: int = SMALL_SIDE_BYTES) -> DataFrame:
    """The ``k`` nearest corpus rows of every question: scope columns, ``query_id``, ``key``, ``distance``, ``rank``.

    ``scope`` names columns that a question and a corpus row must share.  Rows without a vector or with a null in the
    scope are left out.  A corpus in folders by scope is read only where there are questions, if they name no more than
    ``MOST_SCOPES`` of them.  Jobs that measure the question side run while the frame is built.
    """
    def side(df: DataFrame, ident: str) -> DataFrame:
        for x in scope:
            df = df.filter(F.col(x).isNotNull())
        # A filter on a vector that Python makes would have it made twice, by two Python processes of a task.
        made = once(df.select(*scope, ident, "vector"), vector=F.col("vector").cast("array<double>"))
        return made.filter(F.col("vector").isNotNull())

    q, c = cut(side(queries, "query_id")), side(corpus, "key")
    for x in scope:  # a corpus that is stored by scope is read where there are questions
        values = [r[0] for r in q.select(x).distinct().limit(MOST_SCOPES + 1).collect()]
        if len(values) <= MOST_SCOPES:
            c = c.filter(F.col(x).isin(values))
    size = q.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max(F.size("vector")), F.lit(0)).alias("dims")).first()
    if 8 * size.n * size.dims <= small_bytes:
        local = sent(q, c, k, scope, 8 * size.dims)
    else:
        local = by_cells(q, cut(c), k, scope, block)
    return top_per_key(local, [*scope, "query_id"], [F.round("distance", TIE_DIGITS), "key"], k)


def result_schema(q: DataFrame, c: DataFrame, scope: list[str]) -> S.StructType:
    return S.StructType([*[S.StructField(x, q.schema[x].dataType) for x in scope], S.StructField("query_id", q.schema["query_id"].dataType),
                         S.StructField("key", c.schema["key"].dataType), S.StructField("distance", S.DoubleType())])


# --- a small question side ----------------------------------------------------------------------------
class Nearest:
    """The best so far of a batch of questions against rows that come in parts."""

    def __init__(self, questions: np.ndarray, k: int):
        self.questions, self.k = questions, k
        self.reach = np.full(len(questions), np.inf)  # rounded distance of the k-th
        self.found = pd.DataFrame({"q": np.zeros(0, np.int64), "rounded": np.zeros(0), "key": np.zeros(0, object), "distance": np.zeros(0)})
        self.pending, self.gathered = [], 0
        self.parts = self.skipped = 0

    def meet(self, keys: np.ndarray, rows: np.ndarray) -> None:
        """Questions that the part's ball, about its mean, cannot serve are left out of the product."""
        for part in np.array_split(np.arange(len(rows)), -(-len(rows) * len(self.questions) // MATRIX)):
            some = rows[part]
            centre = some.mean(axis=0, keepdims=True)
            radius = math.sqrt(distances(some, centre).max())
            near = np.maximum(np.sqrt(distances(self.questions, centre)[:, 0]) - radius, 0) ** 2 <= self.reach + SLACK
            self.parts += len(near)
            self.skipped += int((~near).sum())
            asked = np.flatnonzero(near)
            if len(asked):
                self.gather(asked, distances(self.questions[asked], some), keys[part])
        self.settle()

    def take(self, asked: np.ndarray, d: np.ndarray, keys: np.ndarray) -> None:
        """Distances of the questions ``asked`` to rows ``keys``; infinite ones are none."""
        self.gather(asked, d, keys)
        self.settle()

    def gather(self, asked: np.ndarray, d: np.ndarray, keys: np.ndarray) -> None:
        """Candidates within the reach; they are ranked when there are many of them, or while a question has no reach."""
        reach = self.reach[asked]
        if endless := bool(np.isinf(reach).any()):
            row, col = best(d, self.k, rank_of(keys), reach)
        else:
            row, col = np.nonzero(d <= (reach + SLACK)[:, None])
        value = d[row, col]
        rounded = np.round(value, TIE_DIGITS)
        some = np.isfinite(value) & (rounded <= reach[row])
        if some.any():
            self.pending.append((asked[row[some]], rounded[some], keys[col[some]], value[some]))
            self.gathered += int(some.sum())
            if endless or self.gathered > GATHERED:
                self.settle()

    def settle(self) -> None:
        if not self.pending:
            return
        new = pd.DataFrame(dict(zip(self.found.columns, (np.concatenate(x) for x in zip(*self.pending)))))
        self.pending, self.gathered = [], 0
        both = (pd.concat([self.found, new]) if len(self.found) else new).sort_values(["q", "rounded", "key"])
        place = both.groupby("q").cumcount()
        self.found = both[place < self.k]
        last = both[place == self.k - 1]
        q = last["q"].to_numpy()
        self.reach[q] = np.minimum(self.reach[q], last["rounded"].to_numpy())


def sent(q: DataFrame, c: DataFrame, k: int, scope: list[str], row_bytes: int) -> DataFrame:
    """``k`` rows at most per question and input split of the corpus, which is not shuffled.

    The questions reach the driver, which knows that they are few, and go to the tasks batch by batch.
    """
    spark, schema = c.sparkSession, result_schema(q, c, scope)
    arrow = to_arrow_schema(schema)
    asked = q.toArrow()
    step = max(1, BATCH_BYTES // max(row_bytes, 1))
    out = None
    for at in range(0, max(asked.num_rows, 1), step):
        part = asked.slice(at, step)
        shared = spark.sparkContext.broadcast((part.drop_columns(["vector"]).to_pandas(), vectors(part.column("vector"))))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            names, matrix = shared.value
            groups = {g if isinstance(g, tuple) else (g,): at for g, at in names.groupby(scope).indices.items()} if scope else {(): np.arange(len(names))}
            state = {g: Nearest(matrix[at], k) for g, at in groups.items()}
            for batch in batches:
                rows, keys = vectors(batch.column("vector")), batch.column("key").to_pandas().to_numpy()
                if not len(rows):
                    continue
                if not scope:
                    state[()].meet(keys, rows) if len(names) else None
                    continue
                for g, where in batch.select(scope).to_pandas().groupby(scope).indices.items():
                    if (mine := state.get(g if isinstance(g, tuple) else (g,))) is not None:
                        mine.meet(keys[where], rows[where])
            for g, nearest in state.items():
                if len(nearest.found):
                    own = names.iloc[groups[g][nearest.found["q"].to_numpy()]]
                    columns = [*(own[x].to_numpy() for x in [*scope, "query_id"]), nearest.found["key"].to_numpy(), nearest.found["distance"].to_numpy()]
                    yield pa.RecordBatch.from_pandas(pd.DataFrame(dict(zip(arrow.names, columns))), schema=arrow, preserve_index=False)

        local = c.mapInArrow(run, schema)
        out = local if out is None else out.unionByName(local)
    return out


# --- two large sides ----------------------------------------------------------------------------------
def pivots_of(c: DataFrame, block: int) -> np.ndarray:
    """Vectors of corpus rows in the order of a hash, one for each ``block`` rows, at most ``MOST_PIVOTS``."""
    n = min(MOST_PIVOTS, max(1, math.ceil(c.count() / block)))
    return vectors(c.orderBy(F.xxhash64("key"), "key").limit(n).select("vector").toArrow().column("vector"))


def in_cells(c: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Corpus rows with the ``cell`` of their nearest pivot and the ``away`` (distance) to it."""
    schema = S.StructType([*c.schema.fields, S.StructField("cell", S.IntegerType()), S.StructField("away", S.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = distances(vectors(batch.column("vector")), pivots) if batch.num_rows else np.zeros((0, 1))
            cell = d.argmin(axis=1)
            away = np.sqrt(d[np.arange(len(cell)), cell])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32()), pa.array(away)], names=schema.names)

    return c.mapInArrow(run, schema)


def cells_of(placed: DataFrame, scope: list[str], block: int) -> DataFrame:
    """Per scope its ``cells``: number, rows, radius, and the ``subs`` that a cell of many rows is dealt into."""
    one = placed.groupBy(*scope, "cell").agg(F.count(F.lit(1)).alias("n"), F.max("away").alias("radius"))
    one = one.withColumn("subs", F.ceil(F.col("n") / block).cast("int"))
    return one.groupBy(*scope).agg(F.array_sort(F.collect_list(F.struct("cell", "n", "radius", "subs"))).alias("cells"))


def with_cells(q: DataFrame, cells: DataFrame, columns: list[str], scope: list[str]) -> tuple[DataFrame, Callable]:
    """Questions of known scopes, and what says a batch's cells (number, rows, radius, subs as arrays) for each of its scopes.

    A list of cells is long, so it travels once to every task and not with every question, unless there are very many scopes.
    """
    def arrays(listed: list) -> tuple:
        return tuple(np.array([x[name] for x in listed]) for name in ("cell", "n", "radius", "subs"))

    total = cells.agg(F.sum(F.size("cells")).alias("n")).first()["n"] or 0
    if scope and total > SENT_CELLS:
        return q.join(cells, scope).select(*columns, "cells"), lambda batch, g, row: arrays(batch.column("cells")[row].as_py())
    shared = q.sparkSession.sparkContext.broadcast({tuple(r[x] for x in scope): arrays([x.asDict() for x in r["cells"]]) for r in cells.collect()})
    known = q.join(cells.select(*scope), scope, "left_semi") if scope else q
    return known.select(*columns), lambda batch, g, row: shared.value[g]


def visits(q: DataFrame, cells: DataFrame, pivots: np.ndarray, k: int, scope: list[str], first: bool) -> DataFrame:
    """(question, ``cell``, ``sub``): the blocks that questions go to.

    First one block of each of their nearest cells, until these hold ``k`` rows.  Then, with the column ``reach`` (rounded
    squared distance of the k-th row seen, or null), every other block of a cell that may hold a row at least as near: its
    pivot is no farther than the reach and its radius together.  Without a reach the radii alone bound it: ``k`` rows lie
    within the farthest ends of the first cells that hold them.
    """
    kept = [*scope, "query_id", "vector"]
    own = [] if first else ["reach"]
    told, cells_in = with_cells(q, cells, [*kept, *own], scope)
    schema = S.StructType([*[told.schema[x] for x in kept], S.StructField("cell", S.IntegerType()), S.StructField("sub", S.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(at, 256) for at in range(0, whole.num_rows, 256)):
                away = np.sqrt(distances(vectors(batch.column("vector")), pivots))
                reach = [None] * batch.num_rows if first else batch.column("reach").to_pylist()
                row, cell, sub = [], [], []
                groups = [tuple(g) for g in batch.select(scope).to_pandas().itertuples(index=False)] if scope else [()] * batch.num_rows
                seen = {}
                for r, g in enumerate(groups):
                    if g not in seen:
                        seen[g] = cells_in(batch, g, r)
                    number, n, radius, subs = seen[g]
                    d = away[r, number]
                    near = np.argsort(d, kind="stable")
                    home = near[:np.searchsorted(np.cumsum(n[near]), k) + 1]  # cells whose first blocks are seen first
                    if first:
                        go = {(int(number[x]), r % int(subs[x])) for x in home}
                    else:
                        ends = np.argsort(d + radius, kind="stable")
                        limit = ((d + radius)[ends][min(np.searchsorted(np.cumsum(n[ends]), k), len(ends) - 1)]) ** 2 if n.sum() >= k else np.inf
                        limit = min(limit, reach[r] if reach[r] is not None else np.inf)
                        may = np.flatnonzero(np.maximum(d - radius, 0) ** 2 <= limit + SLACK)
                        go = {(int(number[x]), s) for x in may for s in range(int(subs[x]))}
                    row += [r] * len(go)
                    cell += [x for x, _ in go]
                    sub += [x for _, x in go]
                own = batch.select(kept).take(pa.array(row, pa.int64()))
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(cell, pa.int32()), pa.array(sub, pa.int32())], names=schema.names)

    return told.mapInArrow(run, schema)


def met(going: DataFrame, placed: DataFrame, cells: DataFrame, k: int, scope: list[str], block: int) -> DataFrame:
    """The ``k`` best of every question in every block that it goes to.

    A block that many questions go to meets them in several tasks, each with about ``block`` of them.
    """
    sizes = cells.select(*scope, F.explode("cells").alias("c")).select(*scope, F.col("c.cell").alias("cell"), F.col("c.subs").alias("subs"))
    place = [*scope, "cell", "sub"]
    turns = going.groupBy(*place).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("turns"))
    asked = going.join(turns, place).withColumn("turn", F.pmod(F.xxhash64("query_id"), "turns").cast("int")).drop("turns")
    held = placed.drop("away").join(sizes, [*scope, "cell"]).withColumn("sub", F.pmod(F.xxhash64("key"), "subs").cast("int")).drop("subs")
    held = held.join(turns, place).withColumn("turn", F.explode(F.sequence(F.lit(0), F.col("turns") - 1))).drop("turns")
    group = [*place, "turn"]
    held = held.select(*[F.col(x).alias(f"{x}_c") for x in group], "key", "vector")  # both sides may come from one table
    schema = result_schema(going, placed, scope)

    def search(questions: pa.Table, rows: pa.Table) -> pa.Table:
        if not questions.num_rows or not rows.num_rows:
            return empty.empty_table()
        a, b = vectors(questions.column("vector")), vectors(rows.column("vector"))
        keys = rows.column("key")
        rank = rank_of(keys.to_pandas().to_numpy())
        parts = []
        for some in np.array_split(np.arange(len(a)), -(-len(a) * len(b) // MATRIX)):
            d = distances(a[some], b)
            row, col = best(d, k, rank)
            parts.append((some[row], col, d[row, col]))
        row, col, d = (np.concatenate(x) for x in zip(*parts))
        own = questions.select([*scope, "query_id"]).take(pa.array(row))
        return own.append_column("key", keys.take(pa.array(col))).append_column("distance", pa.array(d))

    empty = to_arrow_schema(schema)
    return asked.groupBy(*group).cogroup(held.groupBy(*[f"{x}_c" for x in group])).applyInArrow(search, schema)


def by_cells(q: DataFrame, c: DataFrame, k: int, scope: list[str], block: int) -> DataFrame:
    """``k`` rows at most per question and tile that it meets.  A first round, among the blocks nearest to a question, gives
    its reach; corpus rows move once to their block there, and once more for each further ``block`` questions that meet it."""
    pivots = pivots_of(c, block)
    if not len(pivots):
        return c.sparkSession.createDataFrame([], result_schema(q, c, scope))
    placed = cut(in_cells(c, pivots))
    cells = cut(cells_of(placed, scope, block))
    home = cut(met(cut(visits(q, cells, pivots, k, scope, True)), placed, cells, k, scope, block))
    kth = top_per_key(home, [*scope, "query_id"], [F.round("distance", TIE_DIGITS), "key"], k).filter(F.col("rank") == k)
    kth = kth.select(*scope, "query_id", F.round("distance", TIE_DIGITS).alias("reach"))
    return tiles(q.join(kth, [*scope, "query_id"], "left"), placed, cells, pivots, k, scope)


def in_line(pivots: np.ndarray) -> np.ndarray:
    """The place of every pivot along the direction in which they differ most, from 0 to below 1."""
    away = pivots - pivots.mean(axis=0)
    return rank_of(away @ np.linalg.svd(away, full_matrices=False)[2][0]) / len(pivots)


def needs(q: DataFrame, cells: DataFrame, pivots: np.ndarray, k: int, scope: list[str], crowds: int) -> tuple[DataFrame, DataFrame]:
    """Questions (with ``reach``) in their ``crowd``, and the cells that some question of a crowd may need: scope, ``crowd``, ``cell``.

    A crowd has the questions of pivots in line; a cell is needed as in :func:`visits`.
    """
    line = in_line(pivots)
    schema = S.StructType([*q.schema.fields, S.StructField("crowd", S.IntegerType())])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nearest = distances(vectors(batch.column("vector")), pivots).argmin(axis=1) if batch.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array((line[nearest] * crowds).astype(np.int32), pa.int32())], names=schema.names)

    dealt = cut(q.mapInArrow(deal, schema))
    told, cells_in = with_cells(dealt, cells, [*scope, "crowd", "vector", "reach"], scope)
    wanted = S.StructType([*[q.schema[x] for x in scope], S.StructField("crowd", S.IntegerType()), S.StructField("cell", S.IntegerType())])
    arrow = to_arrow_schema(wanted)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups = batch.select([*scope, "crowd"]).to_pandas().groupby([*scope, "crowd"]).indices if batch.num_rows else {}
            out = []
            for g, where in groups.items():
                g = g if isinstance(g, tuple) else (g,)
                number, n, radius, _ = cells_in(batch, g[:-1], int(where[0]))
                rows = batch.select(["vector", "reach"]).take(pa.array(where))
                reach = rows.column("reach").to_numpy(zero_copy_only=False).astype(float)
                d = np.sqrt(distances(vectors(rows.column("vector")), pivots[number]))
                ends = np.argsort(d + radius, axis=1, kind="stable")  # k rows lie within the farthest ends of the first cells that hold them
                first = np.minimum((np.cumsum(n[ends], axis=1) < k).sum(axis=1), len(number) - 1)
                at = np.arange(len(where))
                limit = (d + radius)[at, ends[at, first]] ** 2 if n.sum() >= k else np.full(len(where), np.inf)
                limit = np.fmin(limit, reach)
                may = (np.maximum(d - radius, 0) ** 2 <= (limit + SLACK)[:, None]).any(axis=0)
                out += [(*g, int(x)) for x in number[may]]
            yield pa.RecordBatch.from_pandas(pd.DataFrame(out, columns=arrow.names), schema=arrow, preserve_index=False)

    return dealt, told.mapInArrow(look, wanted).distinct()


def tiles(q: DataFrame, placed: DataFrame, cells: DataFrame, pivots: np.ndarray, k: int, scope: list[str]) -> DataFrame:
    """The ``k`` best within its ``reach`` of every question in every slab of cells that its crowd needs.

    A tile is a crowd and a slab.  It comes to its task as rows in order, the questions first; corpus rows then stream past
    them, so that memory is bounded by a crowd, however many rows a cell has.
    """
    session = q.sparkSession
    cores, scopes = session.sparkContext.defaultParallelism, max(1, cells.count())
    crowds = max(1, math.ceil(q.count() / scopes / CROWD))
    slabs = max(math.ceil(placed.count() / scopes / SLAB), math.ceil(2 * cores / (crowds * scopes)))
    dealt, wanted = needs(q, cells, pivots, k, scope, crowds)
    slab = F.lit([int(x * slabs) for x in in_line(pivots)])[F.col("cell")]
    wanted = cut(wanted.withColumn("slab", slab))
    # A crowd about which most questions gather is several.
    turns = dealt.groupBy(*scope, "crowd").agg(F.ceil(F.count(F.lit(1)) / CROWD).cast("int").alias("turns"))
    wanted = wanted.join(turns, [*scope, "crowd"])
    dealt = dealt.join(turns, [*scope, "crowd"]).withColumn("turn", F.pmod(F.xxhash64("query_id"), "turns").cast("int"))
    tile = F.to_json(F.struct(*scope, "crowd", "turn", "slab")).alias("tile")
    asked = dealt.join(wanted.select(*scope, "crowd", "slab").distinct(), [*scope, "crowd"]).select(
        tile, F.lit(0).alias("cell"), *scope, "query_id", F.lit(None).cast(placed.schema["key"].dataType).alias("key"), "vector", "reach")
    held = placed.join(wanted.withColumn("turn", F.explode(F.sequence(F.lit(0), F.col("turns") - 1))), [*scope, "cell"]).select(
        tile, (F.col("cell") + 1).alias("cell"), *scope, F.lit(None).cast(q.schema["query_id"].dataType).alias("query_id"), "key", "vector",
        F.lit(None).cast("double").alias("reach"))
    count = min(8 * cores, 2 * cores + crowds * scopes * slabs)
    rows = asked.unionByName(held).repartition(count, "tile").sortWithinPartitions("tile", "cell")
    schema = result_schema(q, placed, scope)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, crowd, nearest, own = None, [], None, None

        def told() -> Iterator[pa.RecordBatch]:
            if nearest is not None and len(found := nearest.found):
                mine = own.take(pa.array(found["q"].to_numpy()))
                columns = [*[mine.column(x).combine_chunks() for x in [*scope, "query_id"]], pa.array(found["key"], arrow.field("key").type), pa.array(found["distance"])]
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)

        for batch in batches:
            names, asks = batch.column("tile").to_pandas().to_numpy(), batch.column("cell").to_numpy() == 0
            edges = np.flatnonzero((names[1:] != names[:-1]) | (asks[1:] != asks[:-1])) + 1
            for lo, hi in zip([0, *edges], [*edges, batch.num_rows]):
                if lo == hi:
                    continue
                part = batch.slice(lo, hi - lo)
                if names[lo] != name:
                    yield from told()
                    name, crowd, nearest = names[lo], [], None
                if asks[lo]:
                    crowd.append(part.select([*scope, "query_id", "vector", "reach"]))
                    continue
                if nearest is None:
                    own = pa.Table.from_batches(crowd)
                    nearest = Nearest(vectors(own.column("vector")), k)
                    reach = own.column("reach").to_numpy().astype(float)
                    nearest.reach = np.where(np.isnan(reach), np.inf, reach)
                nearest.meet(part.column("key").to_pandas().to_numpy(), vectors(part.column("vector")))
        yield from told()

    return rows.mapInArrow(run, schema)
