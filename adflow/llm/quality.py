"""Quality classifier: random-indexing word vectors, pooled per document, under a two-layer network.

Random indexing: a word's index vector is sparse and signed, drawn from its
hash; its context vector is the sum of the index vectors of its neighbours over
all documents.  Words are hashed into ``WORDS`` rows, so the vectors are a
table of fixed size however large the vocabulary grows; each task sums its own
share, the shares are added per block of rows (streamed, one block in memory),
and the driver gets the finished table.

A document is the mean of its words' context vectors and of their index
vectors, and the mean likeness of neighbouring words.  The network (one hidden
layer, numpy) learns from a bounded sample of the labelled rows, ``SAMPLE``
rows drawn by hash; a part of them that it does not see sets the temperature
of its probabilities.  Vectors are counted over all rows and whole texts; every
row is scored.

Defined results: null and empty texts have the zero vector, which the network
scores as any other; a document id labelled more than once counts with its mean
label; rows with a null id or label are not learned from; without labelled rows
of both kinds, every score is the share of good labels (0.5 if there are none);
repeated rows each get their row; an empty table gives an empty table; further
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adflow.llm.base import arrow_map, crc32_fold, early
from adflow.llm.words import KINDS, byte_sizes, mix, stretches, word_hashes

WORDS = 1 << 14     # rows that words are hashed into
DIMS = 32           # of a vector
SIGNS = 4           # entries of an index vector that are not 0
BLOCK = 256         # rows of the table that are summed at a time
SAMPLE = 20_000     # labelled rows to learn from
CALIBRATION = 0.2   # of them set the temperature
HIDDEN, EPOCHS, BATCH, RATE, DECAY = 24, 40, 256, 0.01, 1e-4
AS_IS = np.arange(256, dtype=np.uint8)   # case tells


def rows_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    words, _, ends = word_hashes(texts, KINDS, AS_IS)
    return (words >> np.uint64(50)).astype(np.int64) % WORDS, ends


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """The dimensions and signs of each row's index vector."""
    draw = mix(np.arange(1, WORDS * SIGNS + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)).reshape(WORDS, SIGNS)
    dims = (draw % np.uint64(DIMS // SIGNS)).astype(np.int64) + np.arange(SIGNS) * (DIMS // SIGNS)
    return dims, np.where(draw >> np.uint64(63), 1.0, -1.0)


def add_contexts(table: np.ndarray, rows: np.ndarray, ends: np.ndarray) -> None:
    dims, signs = index_vectors()
    if len(rows) < 2:
        return
    inside = np.ones(len(rows) - 1, bool)
    inside[ends[1:-1][(ends[1:-1] > 0) & (ends[1:-1] < len(rows))] - 1] = False
    left, right = rows[:-1][inside], rows[1:][inside]
    for word, near in ((left, right), (right, left)):
        for k in range(SIGNS):
            table += np.bincount(word * DIMS + dims[near, k], weights=signs[near, k], minlength=WORDS * DIMS)


def context_vectors(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """The table of unit context vectors, counted over all of ``docs``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(WORDS * DIMS)
        for batch in batches:
            texts = batch.column(0)
            for start, stop in stretches(byte_sizes(texts)):
                add_contexts(table, *rows_of(texts.slice(start, stop - start)))
        blocks = table.reshape(-1, BLOCK * DIMS)
        used = np.flatnonzero(blocks.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(
            [blocks[b].astype(np.int32).tobytes() for b in used], pa.binary())], ["block", "sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for b, sums in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                part = np.frombuffer(sums.as_buffer(), np.int32)
                total[b] = total[b] + part if b in total else part.astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(
            [t.astype(np.int64).tobytes() for t in total.values()], pa.binary())], ["block", "sums"])

    shares = arrow_map(docs.select(text_col), count, "block int, sums binary")
    sums = arrow_map(shares.repartition("block"), add, "block int, sums binary").collect()   # WORDS x DIMS numbers
    table = np.zeros((WORDS // BLOCK, BLOCK * DIMS))
    for r in sums:
        table[r["block"]] = np.frombuffer(r["sums"], np.int64)
    table = table.reshape(WORDS, DIMS)
    return (table / np.maximum(np.linalg.norm(table, axis=1, keepdims=True), 1e-12)).astype(np.float32)


def pool(texts: pa.Array, table: np.ndarray) -> np.ndarray:
    """The vector of each document."""
    parts = list(stretches(byte_sizes(texts)))
    if len(parts) > 1:
        return np.concatenate([pool(texts.slice(start, stop - start), table) for start, stop in parts])
    rows, ends = rows_of(texts)
    counts = np.diff(ends)
    out = np.zeros((len(counts), 2 * DIMS + 1))
    dims, signs = index_vectors()
    index = np.zeros((WORDS, DIMS), np.float32)
    np.put_along_axis(index, dims, signs.astype(np.float32), axis=1)
    full = np.flatnonzero(counts)
    start = 0
    while start < len(full):   # some documents at a time
        stop = max(start + 1, int(np.searchsorted(np.cumsum(counts[full[start:]]), 1 << 18)) + start)
        some = full[start:stop]
        own = rows[ends[some[0]]:ends[some[-1] + 1]]
        at = ends[some] - ends[some[0]]
        vectors = table[own]
        out[some, :DIMS] = np.add.reduceat(vectors, at, axis=0)
        out[some, DIMS:2 * DIMS] = np.add.reduceat(index[own], at, axis=0)
        like = np.zeros(len(own))
        like[1:] = np.einsum("ij,ij->i", vectors[1:], vectors[:-1])
        like[at] = 0
        out[some, 2 * DIMS] = np.add.reduceat(like, at)
        start = stop
    return out / np.maximum(counts, 1)[:, None]


@dataclass(frozen=True)
class Network:
    """Two layers over standardised vectors; ``temperature`` divides the logit."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x) / self.temperature, -60, 60)))


def constant(share: float) -> Network:
    width = 2 * DIMS + 1
    share = min(max(share, 1e-6), 1 - 1e-6)
    return Network(np.zeros(width), np.ones(width), np.zeros((width, 1)), np.zeros(1), np.zeros(1),
                   float(np.log(share / (1 - share))))


def train(x: np.ndarray, y: np.ndarray, seed: int = 11) -> Network:
    if len(y) < 10 or y.min() > 0.5 or y.max() < 0.5:
        return constant(float(y.mean()) if len(y) else 0.5)
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    cut = int(len(y) * CALIBRATION)
    held, used = order[:cut], order[cut:]
    mean, scale = x[used].mean(axis=0), x[used].std(axis=0) + 1e-6
    z = (x[used] - mean) / scale
    target = y[used]
    p = [rng.normal(0, z.shape[1] ** -0.5, (z.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN ** -0.5, HIDDEN), np.zeros(1)]
    m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    step = 0
    for _ in range(EPOCHS):
        shuffled = rng.permutation(len(z))
        for at in range(0, len(z), BATCH):
            some = shuffled[at:at + BATCH]
            hidden = np.tanh(z[some] @ p[0] + p[1])
            error = (1 / (1 + np.exp(-(hidden @ p[2] + p[3][0]))) - target[some]) / len(some)
            back = np.outer(error, p[2]) * (1 - hidden ** 2)
            grads = [z[some].T @ back + DECAY * p[0], back.sum(axis=0), hidden.T @ error + DECAY * p[2], np.array([error.sum()])]
            step += 1
            for a, g, m_, v_ in zip(p, grads, m, v, strict=True):   # Adam
                m_ += 0.1 * (g - m_)
                v_ += 0.001 * (g * g - v_)
                a -= RATE * (m_ / (1 - 0.9 ** step)) / (np.sqrt(v_ / (1 - 0.999 ** step)) + 1e-8)
    net = Network(mean, scale, p[0], p[1], p[2], float(p[3][0]))
    if not cut:
        return net
    logit, truth = net.logit(x[held]), y[held]
    warmth = np.exp(np.linspace(-2, 3, 101))
    loss = [np.mean(np.logaddexp(0, logit / t) - truth * logit / t) for t in warmth]
    return Network(mean, scale, p[0], p[1], p[2], float(p[3][0]), float(warmth[int(np.argmin(loss))]))


def learn(docs: DataFrame, labels: DataFrame, may_learn: Column, table: np.ndarray, label_col: str = "quality",
          id_col: str = "doc_id", text_col: str = "text") -> Network:
    """The network of at most ``SAMPLE`` rows of ``labels`` where ``may_learn`` (of the id) holds."""
    wide = docs.sparkSession.sparkContext.broadcast(table)
    usable = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & may_learn)
    share = min(1.0, 1.2 * SAMPLE / max(usable.agg(F.approx_count_distinct(id_col)).first()[0], 1))
    named = (usable.where(early(F.xxhash64(id_col), share)).groupBy(id_col).agg(F.avg(label_col).alias("__label"))
             .orderBy(F.xxhash64(id_col), id_col).limit(SAMPLE))
    rows = docs.select(id_col, F.col(text_col).alias("__text")).join(F.broadcast(named), id_col)
    rows = rows.groupBy(id_col, "__label").agg(F.max("__text").alias("__text"))   # of an id's texts, the one that sorts last

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = pool(batch.column(0), wide.value)
            yield pa.RecordBatch.from_arrays(
                [pa.array([v.tobytes() for v in x], pa.binary()), batch.column(1), batch.column(2)], ["x", "y", "id"])

    got = arrow_map(rows.select("__text", "__label", F.col(id_col).cast("long")), vectors, "x binary, y double, id long").collect()
    got.sort(key=lambda r: r["id"])
    x = np.array([np.frombuffer(r["x"]) for r in got]).reshape(len(got), 2 * DIMS + 1)
    return train(x, np.array([r["y"] for r in got]))


def classify(docs: DataFrame, table: np.ndarray, net: Network, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``id, score, predicted`` of each row."""
    wide = docs.sparkSession.sparkContext.broadcast((table, net))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, net = wide.value
        for batch in batches:
            score = net.score(pool(batch.column(1), table))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array((score >= 0.5).astype(np.int32))],
                                             [id_col, "score", "predicted"])

    return arrow_map(docs.select(F.col(id_col).cast("long"), text_col), run, f"{id_col} long, score double, predicted int")


def held_out() -> Column:
    return F.coalesce(crc32_fold(F.col("doc_id"), 3) == 1, F.lit(False))


def quality_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The columns of query ``op4_quality``."""
    table = context_vectors(docs)
    net = learn(docs, labels, ~held_out(), table)
    return classify(docs, table, net).select("doc_id", held_out().alias("held_out"), "score", "predicted")
