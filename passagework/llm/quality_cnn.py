"""Quality by a byte-level convolutional network in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passagework.llm.arrow import map_rows
from passagework.llm.labels import labelled_sample

#: Labelled documents that are learned from at most, and bytes of their texts; a document is taken whole or not at all.
SAMPLE_DOCS = 2_500
SAMPLE_BYTES = 16 << 20
#: Chunks whose responses are held at once in training.
TRAIN_CHUNKS = 1024
#: A chunk is two blocks and begins every block, so neighbours overlap by half.
BLOCK = 256
WIDTH = 8
FILTERS = 16
#: Bytes that may be repeated, how far back they are looked for, and bytes that are searched at once.
GRAM, LOOK, SLICE = 4, 128, 1 << 16
#: Bytes of documents that are convolved at once.
BATCH_BYTES = 1 << 18


def repeats(data: np.ndarray) -> np.ndarray:
    """Whether the ``GRAM`` bytes from a place on stand within the last ``LOOK`` places before it as well."""
    out = np.zeros(len(data), np.uint16)
    for low in range(0, len(data), SLICE):
        begin = max(0, low - LOOK)
        part = data[begin:low + SLICE + GRAM - 1].astype(np.int64)
        n = len(part) - GRAM + 1
        if n < 1:
            continue
        code = sum(part[k:k + n] << 8 * k for k in range(GRAM))
        order = np.argsort(code, kind="stable")
        again = (code[order[1:]] == code[order[:-1]]) & (order[1:] - order[:-1] <= LOOK)
        places = begin + order[1:][again]
        out[places[places >= low]] = 1
    return out


def blocks_of(text: bytes) -> np.ndarray:
    """Symbols of ``text`` and zeros up to whole blocks, at least one filter width of them.

    A symbol is a byte, and above it one bit that tells a filter what no few bytes show: that the place repeats what stands just before it.
    """
    n = -(-(len(text) + WIDTH) // BLOCK) * BLOCK
    out = np.zeros(n, np.uint16)
    data = np.frombuffer(text, np.uint8)
    out[:len(text)] = data | repeats(data) << np.uint16(8)
    return out


@dataclass
class Network:
    """Filters over bytes, pooled to maxima per chunk; the mean and the greatest chunk give one logistic unit."""

    kernel: np.ndarray  # width, 256, filters: by byte
    repeat: np.ndarray  # width, filters: for a repeat
    bias: np.ndarray
    weight: np.ndarray  # 2 * filters
    offset: float

    def tables(self) -> list[np.ndarray]:
        """Responses to every pair of bytes at every second place, and to repeats: a filter is a sum of look-ups."""
        pairs = [(self.kernel[j][:, None] + self.kernel[j + 1][None, :]).reshape(65536, -1).astype(np.float32) for j in range(0, WIDTH, 2)]
        bits = np.arange(1 << WIDTH)[:, None] >> np.arange(WIDTH) & 1  # repeats of the places under a filter
        return [*pairs, (bits @ self.repeat).astype(np.float32)]

    def block_maxima(self, data: np.ndarray, tables: list[np.ndarray], ends: np.ndarray) -> np.ndarray:
        """Greatest response of every filter in every block of ``data``.

        Texts end at ``ends``, behind zeros.  Filters that begin so near an end that they reach the next text do not count; the
        one before them sees nothing but zeros, as they would.
        """
        x = np.concatenate([data, np.zeros(WIDTH, np.uint16)])
        byte, n = x & np.uint16(255), len(data)
        pair = byte[:-1] * np.uint16(256) + byte[1:]
        out = tables[0][pair[:n]]
        for j, t in enumerate(tables[1:-1], 1):
            out += t[pair[2 * j:2 * j + n]]
        again = x >> np.uint16(8)
        out += tables[-1][sum(again[j:j + n] << np.uint16(j) for j in range(WIDTH))]
        out[(ends[:, None] - np.arange(1, WIDTH)).ravel()] = -np.inf
        return out.reshape(-1, BLOCK, out.shape[1]).max(axis=1)

    def score(self, texts: list[bytes], tables: list[np.ndarray]) -> np.ndarray:
        parts = [blocks_of(t) for t in texts]
        sizes = [len(p) // BLOCK for p in parts]
        whole = np.concatenate(parts)
        step, ends = BATCH_BYTES // BLOCK * BLOCK, np.cumsum(sizes) * BLOCK
        maxima = np.concatenate([self.block_maxima(whole[k:k + step + BLOCK], tables, ends[(ends > k) & (ends <= k + step + BLOCK)] - k)[:step // BLOCK]
                                 for k in range(0, len(whole), step)])
        first = np.cumsum([0, *sizes[:-1]])
        chunk = maxima.copy()
        chunk[:-1] = np.maximum(maxima[:-1], maxima[1:])
        last = first + np.array(sizes) - 1
        chunk[last] = maxima[last]
        chunk = np.maximum(chunk + self.bias, 0)
        mean = np.add.reduceat(chunk, first, axis=0) / np.array(sizes)[:, None]
        z = np.concatenate([mean, np.maximum.reduceat(chunk, first, axis=0)], axis=1) @ self.weight + self.offset
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def sample_chunks(sample: DataFrame, most_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """All chunks of the sampled documents, as many documents in the order of a hash as ``most_bytes`` allow."""
    so_far = F.sum(F.octet_length("text")).over(Window.orderBy(F.xxhash64("doc_id"), "doc_id"))  # over a sample of bounded rows
    whole = sample.withColumn("so_far", so_far).filter(F.col("so_far") <= most_bytes)

    def rows(records: Iterator[dict]) -> Iterator[tuple]:
        for r in records:
            data = blocks_of(r["text"].encode("utf-8", "surrogatepass"))
            for k in range(len(data) // BLOCK):
                part = data[k * BLOCK:(k + 2) * BLOCK + WIDTH]
                yield r["doc_id"], r["label"], k, np.pad(part, (0, 2 * BLOCK + WIDTH - len(part))).tobytes()

    return map_rows(whole.select("doc_id", "text", "label"), rows, "doc_id long, label int, chunk long, data binary")


def train(data: np.ndarray, doc: np.ndarray, label: np.ndarray, epochs: int = 12, batch: int = 64, rate: float = 0.02, seed: int = 11) -> Network:
    """Adam on the logistic loss, in which both labels weigh the same however rare one is.  ``data``: chunks of symbols; ``doc``: the document of each chunk, rising; ``label`` by document.

    The gradient of a maximum reaches the winning place alone, so a step touches few kernel entries.
    """
    rng = np.random.default_rng(seed)
    p = [rng.normal(0, 0.05, (WIDTH, 256, FILTERS)), np.zeros(FILTERS), rng.normal(0, 0.1, 2 * FILTERS), np.zeros(1),
         rng.normal(0, 0.05, (WIDTH, FILTERS))]
    data, again = (data & 255).astype(np.uint8), (data >> 8).astype(np.uint8)
    share = np.clip(label.mean(), 0.02, 0.98)
    weight = np.where(label == 1, 0.5 / share, 0.5 / (1 - share))
    m, v, t = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    first = np.searchsorted(doc, np.arange(len(label) + 1))
    place, patterns = np.arange(WIDTH), np.arange(1 << WIDTH)[:, None] >> np.arange(WIDTH) & 1
    for epoch in range(epochs):
        for part in np.array_split(rng.permutation(len(label)), max(1, len(label) // batch)):
            rows = np.concatenate([np.arange(first[d], first[d + 1]) for d in part])
            sizes = first[part + 1] - first[part]
            start = np.cumsum(np.r_[0, sizes[:-1]])
            x, twice = data[rows], again[rows]
            span = x.shape[1] - WIDTH
            kernel, by_repeats = p[0].astype(np.float32), (patterns @ p[4]).astype(np.float32)
            at, raw = np.zeros((len(x), FILTERS), np.int64), np.zeros((len(x), FILTERS))
            for low in range(0, len(x), TRAIN_CHUNKS):
                some = x[low:low + TRAIN_CHUNKS]
                y = by_repeats[sum(twice[low:low + TRAIN_CHUNKS, k:k + span] << np.uint8(k) for k in range(WIDTH))]
                for k in range(WIDTH):
                    y += kernel[k][some[:, k:k + span]]
                best = y.argmax(axis=1)
                at[low:low + TRAIN_CHUNKS] = best
                raw[low:low + TRAIN_CHUNKS] = np.take_along_axis(y, best[:, None, :], 1)[:, 0] + p[1]
            act = np.maximum(raw, 0)
            mean = np.add.reduceat(act, start, axis=0) / sizes[:, None]
            top = np.maximum.reduceat(act, start, axis=0)
            hidden = np.concatenate([mean, top], axis=1)
            out = 1 / (1 + np.exp(-np.clip(hidden @ p[2] + p[3], -30, 30)))
            g = weight[part] * (out - label[part]) / len(part)
            owner = np.repeat(np.arange(len(part)), sizes)
            g_hidden = g[:, None] * p[2][None, :]
            winner = act == top[owner]
            g_act = g_hidden[owner, :FILTERS] / sizes[owner][:, None] + g_hidden[owner, FILTERS:] * winner / np.maximum(
                np.add.reduceat(winner.astype(float), start, axis=0)[owner], 1)
            g_act *= raw > 0
            g_kernel = np.zeros_like(p[0])
            where = x[np.arange(len(x))[:, None, None], at[:, :, None] + place]  # chunk, filter, place
            np.add.at(g_kernel, (np.broadcast_to(place, where.shape), where, np.broadcast_to(np.arange(FILTERS)[:, None], where.shape)),
                      np.broadcast_to(g_act[:, :, None], where.shape))
            under = twice[np.arange(len(x))[:, None, None], at[:, :, None] + place]
            grads = [g_kernel, g_act.sum(axis=0), hidden.T @ g + 1e-4 * p[2], np.array([g.sum()]), np.einsum("cfp,cf->pf", under, g_act)]
            t += 1
            step = rate * min(1.0, 2 * (1 - epoch / epochs))
            for a, b, m1, m2 in zip(p, grads, m, v):
                m1 += 0.1 * (b - m1)
                m2 += 0.005 * (b * b - m2)
                a -= step * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.995**t)) + 1e-7)
    return Network(p[0].astype(np.float32), p[4].astype(np.float32), p[1].astype(np.float32), p[2].astype(np.float32), float(p[3][0]))


def fit(docs: DataFrame, labels: DataFrame, learn: Column, rows: int = SAMPLE_DOCS) -> Network:
    """Learn from at most ``rows`` labelled documents, and ``SAMPLE_BYTES`` of them, for which ``learn`` (over ``doc_id``) holds.

    All chunks of these documents reach the driver, four times their bytes.  Null and empty texts are texts of zeros, of equal
    texts one counts, and labels other than 0 and 1 are left out (see :func:`labelled_sample`).  Without labels every
    score is one half."""
    got = sample_chunks(labelled_sample(docs, labels, "quality", learn, rows)).orderBy("doc_id", "chunk").toPandas()
    if got.empty:
        return Network(np.zeros((WIDTH, 256, FILTERS), np.float32), np.zeros((WIDTH, FILTERS), np.float32), np.zeros(FILTERS), np.zeros(2 * FILTERS), 0.0)
    data = np.frombuffer(b"".join(got["data"]), np.uint16).reshape(len(got), -1)
    _, doc = np.unique(got["doc_id"].to_numpy(), return_inverse=True)
    label = np.zeros(doc.max() + 1)
    label[doc] = got["label"].to_numpy()
    return train(data, doc, label)


def score(docs: DataFrame, network: Network) -> DataFrame:
    """``doc_id`` and ``score`` (0 to 1) of every row by chunks that cover its whole text, however long.

    Null text counts as empty, and an empty one has a score too.  Equal texts have equal scores, repeated rows and null
    ids stay, other columns are not read, an empty table gives no rows."""
    def rows(records: Iterator[dict]) -> Iterator[tuple]:
        tables = network.tables()
        ids, texts, size = [], [], 0
        for r in records:
            ids.append(r["doc_id"])
            texts.append((r["text"] or "").encode("utf-8", "surrogatepass"))
            size += len(texts[-1]) + BLOCK
            if size >= BATCH_BYTES:
                yield from zip(ids, map(float, network.score(texts, tables)))
                ids, texts, size = [], [], 0
        if ids:
            yield from zip(ids, map(float, network.score(texts, tables)))

    return map_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), rows,
                    "doc_id long, score double")
