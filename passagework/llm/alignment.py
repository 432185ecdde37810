"""Cross-tokenizer alignment: an inverted index from id pairs to compressed document bitmaps with multiplicity planes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from passagework.llm.arrow import lean, pieces, schema_of
from passagework.llm.two_tokenizers import ID_BITS, Aligner, aligner
from passagework.sources.lineage import cut

#: Documents of a block at most (their numbers are 16 bits wide), links after which a block is closed, links that are sorted together.
BLOCK_DOCS, BLOCK_LINKS, RUN_LINKS = 1 << 16, 4 << 20, 1 << 20
#: Characters of texts whose parts are looked up together.
LOOK_UP_CHARS = 1 << 19

DOC_COLUMNS = "block long, doc int, doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, groups string"
PAIR_COLUMNS = "a int, b int, size int, n_docs long, n_links long, planes array<binary>"


def container(members: np.ndarray, size: int) -> bytes:
    """A set of numbers below ``size``: a list of 16-bit numbers, or a bit map of ``size`` bits where that is no longer."""
    width = -(-size // 8)
    if 2 * len(members) < width:
        return members.astype("<u2").tobytes()
    bits = np.zeros(size, bool)
    bits[members] = True
    return np.packbits(bits, bitorder="little").tobytes()


def members(data: bytes, size: int) -> np.ndarray:
    """The numbers of a :func:`container`."""
    if len(data) < -(-size // 8):
        return np.frombuffer(data, "<u2").astype(np.int64)
    return np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little")[:size])


def or_merge(containers: list[bytes], size: int) -> bytes:
    """The union of containers."""
    bits = np.zeros(size, bool)
    for c in containers:
        bits[members(c, size)] = True
    return container(np.flatnonzero(bits), size)


def popcount(data: bytes, size: int) -> int:
    """How many numbers a container holds."""
    return len(data) // 2 if len(data) < -(-size // 8) else int(np.bitwise_count(np.frombuffer(data, np.uint8)).sum())


class Block:
    """Documents in work: their rows, and their links as sorted runs of (pair, document) with multiplicities."""

    def __init__(self, number: int):
        self.number = number
        self.docs: list[tuple] = []
        self.open: list[np.ndarray] = []
        self.runs: list[tuple[np.ndarray, np.ndarray]] = []
        self.held = self.links = 0

    def add(self, codes: bytes) -> None:
        """Links of the next document, or some of them."""
        own = np.frombuffer(codes, np.int64)
        self.open.append((own << 16) | len(self.docs))
        self.held += len(own)
        self.links += len(own)
        if self.held >= RUN_LINKS:
            self._run()

    def _run(self) -> None:
        if self.open:
            self.runs.append(np.unique(np.concatenate(self.open), return_counts=True))
        self.open, self.held = [], 0

    def full(self) -> bool:
        return len(self.docs) >= BLOCK_DOCS or self.links >= BLOCK_LINKS

    def index(self) -> dict[str, list]:
        """Columns of the pair rows.  A pair's plane k holds the documents whose multiplicity has bit k; their union is its document bitmap."""
        self._run()
        size = len(self.docs)
        if not self.runs:
            return {}
        keys, counts = (np.concatenate(x) for x in zip(*self.runs))
        if len(self.runs) > 1:
            order = np.argsort(keys, kind="stable")
            keys, counts = keys[order], counts[order]
            new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            keys, counts = keys[new], np.add.reduceat(counts, new)
        if not len(keys):
            return {}
        pair, doc = keys >> 16, (keys & 0xFFFF).astype("<u2")
        first = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
        of = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(pair))))
        planes: list[list[bytes]] = [[] for _ in first]
        width, links = -(-size // 8), np.zeros(len(first), np.int64)
        for k in range(int(counts.max()).bit_length()):
            on = (counts >> k) & 1 == 1
            card = np.bincount(of[on], minlength=len(first))
            links += card << k
            inside = doc[on]
            at = np.concatenate([[0], np.cumsum(card)])
            data = inside.tobytes()
            top = np.flatnonzero(np.maximum.reduceat(counts, first) >> k)
            for row, x, y in zip(top.tolist(), at[top].tolist(), at[top + 1].tolist()):
                planes[row].append(data[2 * x:2 * y] if 2 * (y - x) < width else container(inside[x:y], size))
        code = pair[first]
        return {"a": code >> ID_BITS, "b": code & (1 << ID_BITS) - 1, "size": np.full(len(first), size), "n_docs": np.diff(np.append(first, len(pair))),
                "n_links": links, "planes": planes}


def lossless(tool: Aligner, text: str) -> bool:
    """Whether the joined bytes of both sides are those of space + text."""
    made = [hashlib.blake2b() for _ in range(3)]
    for parts in tool.parts(text):
        for part, s in zip(parts, tool.segments(parts)):
            own = part.encode("utf-8", "surrogatepass")
            for digest, data in zip(made, (own, *(s.joined or (own, own)))):
                digest.update(data)
    return made[0].digest() == made[1].digest() == made[2].digest()


def align(docs: DataFrame, byte_level: str, pieces_model: str, with_groups: bool = False) -> DataFrame:
    """The stored alignment of all ``docs`` (``doc_id``, ``text``): rows of documents and rows of pairs, by ``block``.

    Side A encodes space + text by a byte-level vocabulary, side B the text by a sentence-piece model that adds the space;
    strings of special tokens are plain text.  Where both end at the same byte, a group ends, and the two tokens that end
    there are linked.  Null and empty texts, and texts that a side does not give back byte for byte, have no tokens.
    Every row of ``docs`` is a document of its own, repeated rows too; ids may be null; other columns are not read.

    A block is a task's next documents, up to ``BLOCK_DOCS`` of them or some ``BLOCK_LINKS`` links.  A document row has
    ``doc`` (its number in the block), counts, the digest of its groups and with ``with_groups`` the groups; a pair row
    has ``a``, ``b``, ``planes`` over document numbers below ``size``, and their weighed popcounts.  A long text is worked on
    slice by slice.  The table is written once, so that blocks are the same for all that read it, whatever executors are lost.
    """
    fields = schema_of(f"{DOC_COLUMNS}, {PAIR_COLUMNS}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, schema = aligner(byte_level, pieces_model), to_arrow_schema(fields)
        context = TaskContext.get()
        block = Block((context.partitionId() if context else 0) << 24)

        def table(columns: dict) -> pa.RecordBatch:
            n = len(next(iter(columns.values())))
            return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)

        def closed() -> Iterator[pa.RecordBatch]:
            names = [f.name for f in schema][:8]
            for k in range(0, len(block.docs), 4096):
                yield table(dict(zip(names, zip(*block.docs[k:k + 4096]))))
            found = block.index()
            for k in range(0, len(found.get("a", ())), 4096):
                part = {name: column[k:k + 4096] for name, column in found.items()}
                yield table(part | {"block": np.full(len(part["a"]), block.number)})

        def document(doc_id: int | None, text: str, known: list | None) -> None:
            n_a = n_b = n_groups = 0
            digest, kept = hashlib.sha256(), []
            if text and (known is None or any(s.joined for s in known)) and not lossless(tool, text):
                text = ""
            for segments in () if not text else (known,) if known is not None else (tool.segments(parts) for parts in tool.parts(text)):
                codes = b"".join([s.links for s in segments])
                groups = ";".join([s.groups for s in segments])
                digest.update(((";" if n_groups else "") + groups).encode())
                if with_groups:
                    kept.append(groups)
                n_a, n_b, n_groups = n_a + sum([s.n_a for s in segments]), n_b + sum([s.n_b for s in segments]), n_groups + len(codes) // 8
                block.add(codes)
            block.docs.append((block.number, len(block.docs), doc_id, n_a, n_b, n_groups, digest.hexdigest() if text else "",
                               ";".join(kept) if with_groups else None))

        for whole in batches:
            for batch in pieces(whole, LOOK_UP_CHARS):
                ids, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
                if sum(map(len, texts)) <= 4 * LOOK_UP_CHARS:
                    parts = [[p for some in tool.parts(t) for p in some] for t in texts]
                    found = iter(tool.segments([p for own in parts for p in own]))
                    known: list = [[next(found) for _ in own] for own in parts]
                else:
                    known = [None] * len(texts)
                for doc_id, text, segments in zip(ids, texts, known):
                    document(doc_id, text, segments if text else None)
                    if block.full():
                        yield from closed()
                        block = Block(block.number + 1)
        yield from closed()
        tool.forget()

    ready = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return cut(ready.mapInArrow(lean(run), fields))


def pair_counts(aligned: DataFrame) -> DataFrame:
    """Every linked id pair of the corpus: ``a``, ``b``, ``n_docs``, ``n_links``, and ``best``: no other A id is linked more often with its B id.

    Popcounts of blocks are summed before they are shuffled, so a pair that is in every block is one row of a task.
    """
    counts = aligned.filter("a is not null").groupBy("a", "b").agg(F.sum("n_docs").alias("n_docs"), F.sum("n_links").alias("n_links"))
    counts = cut(counts)
    top = counts.groupBy("b").agg(F.max("n_links").alias("top"))
    return counts.join(top, "b").select("a", "b", "n_docs", "n_links", (F.col("n_links") == F.col("top")).alias("best"))


def postings(table: pa.Table, docs: int, values: list[np.ndarray]) -> list[np.ndarray]:
    """For each array of values (one for every pair row of ``table``) its sum over the links of each document."""
    sums = [np.zeros(docs, np.int64) for _ in values]
    size = table.column("size").to_pylist()
    rows = table.column("planes").to_pylist()
    for k in range(max(map(len, rows), default=0)):
        some = [(r, p[k]) for r, p in enumerate(rows) if len(p) > k and p[k]]
        sparse = [(r, c) for r, c in some if len(c) < -(-size[r] // 8)]
        parts = [(np.array([r for r, _ in sparse], np.int64), np.array([len(c) // 2 for _, c in sparse], np.int64), np.frombuffer(b"".join(c for _, c in sparse), "<u2"))]
        for r, c in some:
            if len(c) >= -(-size[r] // 8):
                found = members(c, size[r])
                parts.append((np.array([r]), np.array([len(found)]), found))
        for row, n, doc in parts:
            for total, value in zip(sums, values):
                np.add.at(total, doc, np.repeat(value[row] << k, n))
    return sums


def scores(aligned: DataFrame) -> DataFrame:
    """Per document of :func:`align` its row, ``n_links``, ``n_best`` (links whose pair is the best of its B id, ties included) and ``count_sum``
    (over its links, how many links of the corpus hold the same pair).

    Only (pair, block) meets the pair's count, never its bitmaps: a pair of every block is joined, which adaptive execution can
    split.  A block's pair rows then return their scores to its documents in one task; blocks are bounded.
    """
    counts = pair_counts(aligned).select("a", "b", F.col("n_links").alias("count"), "best")
    places = aligned.filter("a is not null").select(F.col("block").alias("at"), F.col("a").alias("id_a"), F.col("b").alias("id_b"))
    told = places.join(counts, (F.col("id_a") == F.col("a")) & (F.col("id_b") == F.col("b"))).select("at", "a", "b", "count", "best")
    columns = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string, groups string"
    fields = schema_of(columns)

    def score(rows: pa.Table, told: pa.Table) -> pa.Table:
        is_pair = rows.column("a").is_valid()
        docs, index = rows.filter(pa.compute.invert(is_pair)), rows.filter(is_pair)
        code, known = ((t.column("a").to_numpy().astype(np.int64) << ID_BITS) | t.column("b").to_numpy() for t in (index, told))
        order = np.argsort(known)
        at = order[np.searchsorted(known[order], code)] if len(code) else np.zeros(0, np.int64)
        count, best = told.column("count").to_numpy()[at], told.column("best").to_numpy()[at].astype(np.int64)
        links, n_best, count_sum = postings(index, docs.num_rows, [np.ones(len(code), np.int64), best, count])
        doc = docs.column("doc").to_numpy()
        made = {"n_links": links[doc], "n_best": n_best[doc], "count_sum": count_sum[doc]}
        schema = to_arrow_schema(fields)
        return pa.table([pa.array(made[f.name]) if f.name in made else docs.column(f.name) for f in schema], schema=schema)

    return aligned.groupBy("block").cogroup(told.groupBy("at")).applyInArrow(score, fields)
