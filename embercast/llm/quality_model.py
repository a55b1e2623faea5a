"""Quality classifier: a byte-level convolutional network in numpy.

A document's UTF-8 bytes are cut into chunks of ``CHUNK`` bytes that overlap by
half, so that every byte is covered and no pattern is lost at a cut. Learned
filters run over byte embeddings inside each chunk (width ``WIDTH``, stride
``STRIDE``). Each filter is max-pooled over its chunk; a learned layer turns the
pooled values into one logit per chunk, and the mean of the logits over all
chunks gives the document's probability. Embeddings, filters and weights are
learned together by Adam on the log loss. An epoch takes some chunks of each
document, other ones each time, so that all have been learned from at the end.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from embercast.llm.arrays import schema_with, slices, utf8, with_columns

CHUNK, HOP = 512, 256
EMBED, WIDTH, STRIDE, FILTERS = 6, 8, 2, 16


@dataclass
class Network:
    embed: np.ndarray  # (256, EMBED)
    filters: np.ndarray  # (WIDTH * EMBED, FILTERS)
    offset: np.ndarray  # (FILTERS,)
    weights: np.ndarray  # (FILTERS,)
    bias: np.ndarray  # (1,)

    def parts(self) -> list[np.ndarray]:
        return [self.embed, self.filters, self.offset, self.weights, self.bias]


def chunks(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All chunks of all rows, padded with zero bytes, and the row of each; an empty row has one."""
    lengths = np.diff(offsets)
    counts = np.maximum(1, -(-(lengths - (CHUNK - HOP)) // HOP))
    rows = np.repeat(np.arange(len(lengths)), counts)
    k = np.arange(len(rows)) - np.repeat(np.cumsum(counts) - counts, counts)
    begin = offsets[:-1][rows] + k * HOP
    at = begin[:, None] + np.arange(CHUNK)
    inside = at < offsets[1:][rows][:, None]
    padded = np.append(data, np.uint8(0))
    return np.where(inside, padded[np.minimum(at, len(data))], np.uint8(0)), rows


def windows(net: Network, x: np.ndarray) -> np.ndarray:
    n = (x.shape[1] - WIDTH) // STRIDE + 1
    e = net.embed[x].reshape(len(x), -1)
    step = e.strides[1] * EMBED * STRIDE
    return np.lib.stride_tricks.as_strided(e, (len(x), n, WIDTH * EMBED), (e.strides[0], step, e.strides[1]))


def pooled(net: Network, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Largest response of each filter in each chunk, and its place."""
    z = (windows(net, x).reshape(-1, WIDTH * EMBED) @ net.filters).reshape(len(x), -1, FILTERS)
    place = z.argmax(axis=1)
    return np.take_along_axis(z, place[:, None, :], 1)[:, 0, :] + net.offset, place


def chunk_logits(net: Network, x: np.ndarray) -> np.ndarray:
    h = np.maximum(pooled(net, x)[0], 0)
    return h @ net.weights + net.bias[0]


def scores(net: Network, data: np.ndarray, offsets: np.ndarray, most: int = 512) -> np.ndarray:
    """One probability for each row; ``most`` chunks are worked on at a time."""
    x, rows = chunks(data, offsets)
    z = np.concatenate([chunk_logits(net, x[i:i + most]) for i in range(0, len(x), most)]) if len(x) else np.zeros(0)
    n = len(offsets) - 1
    mean = np.bincount(rows, z, n) / np.maximum(1, np.bincount(rows, minlength=n))
    return 1 / (1 + np.exp(-np.clip(mean, -30, 30)))


def drawn(n: int, epoch: int, epochs: int, most: int, order: np.ndarray) -> np.ndarray:
    """The chunks of a document with n that an epoch takes: ``most``, or as many as all epochs need to take each one."""
    k = min(n, max(most, -(-n // epochs)))
    return order[(epoch * k + np.arange(k)) % n]


def fit(x: np.ndarray, rows: np.ndarray, labels: np.ndarray, epochs: int = 12, batch: int = 64, rate: float = 0.01, seed: int = 7, chunks_an_epoch: int = 8) -> Network:
    """Learn from all chunks ``x`` of documents ``rows`` (ascending) with 0/1 ``labels`` by document."""
    rng = np.random.default_rng(seed)
    net = Network(
        rng.normal(0, 0.5, (256, EMBED)).astype(np.float32), rng.normal(0, 0.2, (WIDTH * EMBED, FILTERS)).astype(np.float32),
        np.zeros(FILTERS, np.float32), rng.normal(0, 0.1, FILTERS).astype(np.float32), np.zeros(1, np.float32),
    )
    first = np.searchsorted(rows, np.arange(len(labels) + 1))
    orders = [rng.permutation(n) for n in np.diff(first).tolist()]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in net.parts()]
    positive = max(1, labels.sum())
    balance = np.where(labels == 1, len(labels) / (2 * positive), len(labels) / (2 * max(1, len(labels) - positive)))
    step = 0
    for epoch in range(epochs if len(labels) else 0):
        order = rng.permutation(len(labels))
        for at in range(0, len(order), batch):
            docs = order[at:at + batch]
            parts = [first[d] + drawn(len(orders[d]), epoch, epochs, chunks_an_epoch, orders[d]) for d in docs]
            take, own = np.concatenate(parts), np.repeat(np.arange(len(docs)), [len(p) for p in parts])
            size = np.bincount(own, minlength=len(docs))
            xb = x[take]
            z, place = pooled(net, xb)
            h = np.maximum(z, 0)
            logit = np.bincount(own, h @ net.weights + net.bias[0], len(docs)) / size
            p = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
            g = ((p - labels[docs]) * balance[docs] / len(docs) / size)[own].astype(np.float32)
            gh = (g[:, None] * net.weights) * (z > 0)
            w = windows(net, xb)
            chosen = np.take_along_axis(w, place[:, :, None], 1)  # (chunks, FILTERS, WIDTH * EMBED)
            g_filters = np.einsum("cf,cfk->kf", gh, chosen)
            g_in = gh[:, :, None] * net.filters.T[None]
            g_embed = np.zeros_like(net.embed)
            byte_at = place[:, :, None] * STRIDE + np.arange(WIDTH)
            bytes_in = np.take_along_axis(xb, byte_at.reshape(len(xb), -1), 1).reshape(-1)
            np.add.at(g_embed, bytes_in, g_in.reshape(-1, EMBED))
            grads = [g_embed, g_filters, gh.sum(0), h.T @ g, np.array([g.sum()])]
            step += 1
            for part, grad, (m, v) in zip(net.parts(), grads, moments, strict=True):
                m += 0.1 * (grad - m)
                v += 0.001 * (grad * grad - v)
                part -= (rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)).astype(np.float32)
    return net


def train(docs: DataFrame, labels: DataFrame, rows_at_most: int = 3000, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> Network:
    """Fit on the whole texts of at most ``rows_at_most`` labelled documents, those with the smallest hashes of
    their id; that bound holds the sample, whatever the tables' size.

    Rows without a label, a label other than 0 and 1, or a null id are left out; of several texts of
    one id the first in order counts. Null and empty texts are one chunk of padding. With no labels at
    all, or an empty table, the network gives every document about the same score. Other columns are ignored.
    """
    key = F.col(doc_id).cast("string")
    marked = labels.where(F.col(label).isin(0, 1) & key.isNotNull()).groupBy(key.alias("_k")).agg(F.max(label).cast("int").alias("_y"))
    marked = marked.orderBy(F.xxhash64("_k"), "_k").limit(rows_at_most)
    found = docs.select(key.alias("_k"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_t")).join(F.broadcast(marked), "_k")
    sample = found.groupBy("_k").agg(F.first("_y").alias("y"), F.min("_t").alias("t")).collect()  # rows_at_most rows
    sample = sorted(((r["_k"], r["t"].encode(), r["y"]) for r in sample), key=lambda r: r[0])
    texts = np.frombuffer(b"".join(t for _, t, _ in sample), np.uint8)
    x, rows = chunks(texts, np.cumsum([0, *(len(t) for _, t, _ in sample)]))
    return fit(x, rows, np.array([y for _, _, y in sample], np.int64))


def score(df: DataFrame, net: Network, text: str = "text", out: str = "score") -> DataFrame:
    """``df`` with the probability of label 1 of each whole text, in 0 to 1.

    Null and empty texts are one chunk of padding and get a score too; repeated
    rows get equal scores; a column called ``out`` is replaced, others stay.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            yield with_columns(batch, **{out: pa.array(scores(net, *utf8(batch.column(text))), pa.float64())})

    return df.mapInArrow(run, schema_with(df, {out: "double"}))
