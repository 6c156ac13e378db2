"""Quality classifier: a byte-level convolutional network in numpy.

Bytes are embedded; learned filters read windows of 12 bytes at every fourth byte, so neighbouring windows overlap and
together cover the whole text, the end padded. Each filter keeps its maximum over the text; a dense layer combines the
maxima into one probability. Weights are learned by Adam from a sample of labelled rows of bounded size; a text of any
length is scored whole, in blocks of windows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metrum.llm.tables import table
from metrum.llm.text import map_arrow, view

WIDTH, STRIDE, EMBEDDED, FILTERS = 12, 4, 4, 32
PAD = 256
#: Labelled rows of each class that the model is fitted on at most, and the longest text among them, in bytes.
SAMPLE_ROWS, SAMPLE_BYTES = 2000, 16_384
#: Share of the good texts that an epoch sees as an excerpt.
EXCERPTS = 0.4
EPOCHS, MINIBATCH, RATE, DECAY = 12, 32, 0.01, 1e-4
CUTOFF = 0.3
BLOCK = 8192


@dataclass
class Network:
    """embed (257, EMBEDDED); filters (WIDTH * EMBEDDED, FILTERS); bias and dense (FILTERS,); last (1,)."""

    embed: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    dense: np.ndarray
    last: np.ndarray

    @classmethod
    def fresh(cls, seed: int = 5) -> Network:
        draw = np.random.default_rng(seed)
        embed = draw.normal(0, 1, (PAD + 1, EMBEDDED)).astype(np.float32)
        embed[PAD] = 0
        filters = draw.normal(0, (WIDTH * EMBEDDED) ** -0.5, (WIDTH * EMBEDDED, FILTERS)).astype(np.float32)
        return cls(embed, filters, np.zeros(FILTERS, np.float32), draw.normal(0, FILTERS**-0.5, FILTERS).astype(np.float32), np.zeros(1, np.float32))

    def parts(self) -> list[np.ndarray]:
        return [self.embed, self.filters, self.bias, self.dense, self.last]


def layout(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Padded bytes of all rows, the starts of all windows in them, and the first window of each row (with the total)."""
    sizes = np.diff(offsets)
    counts = np.maximum(1, -(-np.maximum(0, sizes - WIDTH) // STRIDE) + 1)
    room = (counts - 1) * STRIDE + WIDTH
    begins = np.concatenate([[0], np.cumsum(room)])
    padded = np.full(begins[-1], PAD, np.int16)
    padded[np.arange(len(data)) + np.repeat(begins[:-1] - offsets[:-1], sizes)] = data
    first = np.concatenate([[0], np.cumsum(counts)])
    starts = np.repeat(begins[:-1], counts) + (np.arange(first[-1]) - np.repeat(first[:-1], counts)) * STRIDE
    return padded, starts, first


def pooled(net: Network, padded: np.ndarray, starts: np.ndarray, first: np.ndarray, places: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """Each row's maximum of every filter; with ``places`` also the windows that hold them."""
    n = len(first) - 1
    best = np.full((n, FILTERS), -np.inf, np.float32)
    at = np.zeros((n, FILTERS), np.int64) if places else None
    reach = np.arange(WIDTH)
    for low in range(0, len(starts), BLOCK):
        high = min(low + BLOCK, len(starts))
        values = net.embed[padded[starts[low:high, None] + reach]].reshape(high - low, -1) @ net.filters
        r0, r1 = int(np.searchsorted(first, low, "right")) - 1, int(np.searchsorted(first, high, "left"))
        cut = np.maximum(first[r0:r1], low) - low
        top = np.maximum.reduceat(values, cut, axis=0)
        if places:
            ends = np.append(cut[1:], high - low)
            for k, (a, b) in enumerate(zip(cut, ends)):
                better = top[k] > best[r0 + k]
                at[r0 + k, better] = low + a + values[a:b].argmax(axis=0)[better]
        best[r0:r1] = np.maximum(best[r0:r1], top)
    return best, at


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def score(net: Network, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Probability of each row, from its whole bytes."""
    if len(offsets) < 2:
        return np.zeros(0)
    best, _ = pooled(net, *layout(data, offsets))
    return sigmoid(np.maximum(best + net.bias, 0).astype(np.float64) @ net.dense + net.last[0])


def excerpt(text: bytes, draw: np.random.Generator) -> bytes:
    """A random part of 16 to 400 bytes: part of a good text is good, so short texts need no proof of quality."""
    size = int(draw.integers(16, 400))
    low = int(draw.integers(0, max(1, len(text) - size)))
    return text[low : low + size]


def fit(texts: list[bytes], labels: np.ndarray, weights: np.ndarray, seed: int = 5) -> Network:
    """Adam on the weighted log loss; a maximum passes its gradient to the one window that holds it."""
    net, draw = Network.fresh(seed), np.random.default_rng(seed + 1)
    if not texts:
        return net
    share = float(np.clip((weights * labels).sum() / weights.sum(), 0.01, 0.99))
    net.last[:] = np.log(share / (1 - share))
    first, second, step = ([np.zeros_like(p) for p in net.parts()] for _ in range(2)), None, 0
    first, second = first
    reach = np.arange(WIDTH)
    for epoch in range(EPOCHS):
        order = draw.permutation(len(texts))
        rate = RATE * (1 - epoch / EPOCHS)
        for low in range(0, len(order), MINIBATCH):
            pick = order[low : low + MINIBATCH]
            chosen = [excerpt(texts[i], draw) if labels[i] and draw.random() < EXCERPTS else texts[i] for i in pick]
            offsets = np.concatenate([[0], np.cumsum([len(t) for t in chosen])])
            padded, starts, rows = layout(np.frombuffer(b"".join(chosen), np.uint8), offsets)
            best, at = pooled(net, padded, starts, rows, places=True)
            hidden = np.maximum(best + net.bias, 0)
            error = ((sigmoid(hidden @ net.dense + net.last[0]) - labels[pick]) * weights[pick] / weights[pick].sum()).astype(np.float32)
            back = error[:, None] * net.dense * (hidden > 0)
            window = padded[starts[at][..., None] + reach]
            inputs = net.embed[window].reshape(len(pick), FILTERS, -1)
            to_filters = np.einsum("rf,rfw->wf", back, inputs)
            to_embed = np.zeros_like(net.embed)
            np.add.at(to_embed, window, (back[..., None] * net.filters.T).reshape(len(pick), FILTERS, WIDTH, EMBEDDED))
            to_embed[PAD] = 0
            gradients = [to_embed, to_filters + DECAY * net.filters, back.sum(axis=0), hidden.T @ error + DECAY * net.dense, error.sum(keepdims=True)]
            step += 1
            for p, g, m, v in zip(net.parts(), gradients, first, second):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return net


def train(documents: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, longest: int = SAMPLE_BYTES) -> Network:
    """Fit on at most ``rows`` labelled documents of each class, chosen by the order of a hash of their id.

    ``labels`` has doc_id and quality; other qualities than 0 and 1 and null ids are passed over. Each class weighs as
    much as it does among all labels. Texts of more than ``longest`` bytes are not learned from (but are scored).
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label")).where("label IN (0, 1) AND doc_id IS NOT NULL")
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    texts: list[bytes] = []
    marks: list[int] = []
    weights: list[float] = []
    for label, count in sorted(counts.items()):
        ids = known.where(F.col("label") == label).select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(2 * rows)
        docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).where(F.octet_length("text") <= longest)
        found = docs.join(F.broadcast(ids), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(rows)
        own = [r["text"].encode("utf-8", "surrogatepass") for r in found.select("text").collect()]
        texts += own
        marks += [label] * len(own)
        weights += [count / max(1, len(own))] * len(own)
    scale = np.array(weights, np.float32)
    return fit(texts, np.array(marks, np.float32), scale / scale.mean() if len(scale) else scale)


def scored(documents: DataFrame, net: Network, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id`` and ``score`` of each row, from its whole text; a null text counts as empty. Other columns are not read."""
    held = documents.sparkSession.sparkContext.broadcast(net)  # a few kilobytes

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(score(held.value, *view(batch.column(1))))], ["doc_id", "score"])

    docs = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return map_arrow(docs, run, "doc_id long, score double")


def accepted(documents: DataFrame, net: Network, text: str = "text", cutoff: float = CUTOFF) -> DataFrame:
    """The rows, with all their columns, whose whole text scores at least ``cutoff``."""
    held = documents.sparkSession.sparkContext.broadcast(net)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array(score(held.value, *view(batch.column(text))) >= cutoff))

    return map_arrow(documents, run, documents.schema)


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def op5_quality(spark, sf_dir: str) -> DataFrame:
    """The contract's columns: the model learns from labels outside the held-out fold only."""
    documents = table(spark, sf_dir, "documents")
    net = train(documents, table(spark, sf_dir, "labels").where(~held_out()))
    found = scored(documents, net)
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= CUTOFF).cast("int").alias("predicted"))
