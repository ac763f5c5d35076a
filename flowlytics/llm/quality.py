"""Byte-level convolutional quality classifier in numpy.

Bytes are embedded, learned filters slide over them, and each of a row of overlapping chunks that cover the whole document
is described by the maximum and the mean of every filter. A hidden layer reads each chunk; the maximum over all chunks of a
document and a last layer give one probability. The weights are trained here, on a bounded sample of labelled rows, and a
document is scored whole however long it is.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlytics.llm import texts
from flowlytics.sources.stage import materialise

BLOCK = 128  # bytes; a chunk is two blocks in a row, so chunks overlap by half
STRIDE = 2  # the filters stand at every second byte
WIDTH = 8  # bytes that a filter sees
EMBED, FILTERS, HIDDEN = 6, 24, 32
PAD = 256
PIECE = 1024  # blocks whose filters are computed at once
PER_CLASS = 1000  # labelled documents of each class that training uses at most
POOL = 32  # chunks of a labelled document that training uses at most, spread over the whole of it
DRAWN, STEPS, BATCH, RATE, SEED = 8, 384, 64, 0.004, 11


@dataclass
class Network:
    """Weights: byte embedding, filters, hidden layer over a chunk's pooled filters, output layer."""

    embed: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    hidden: np.ndarray
    hidden_bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    @classmethod
    def fresh(cls, seed: int) -> Network:
        rng = np.random.default_rng(seed)

        def draw(fan: float, *shape: int) -> np.ndarray:
            return (rng.standard_normal(shape) * np.sqrt(2 / fan)).astype(np.float32)

        return cls(draw(4, 257, EMBED), draw(WIDTH * EMBED, WIDTH * EMBED, FILTERS), np.zeros(FILTERS, np.float32),
                   draw(2 * FILTERS, 2 * FILTERS, HIDDEN), np.zeros(HIDDEN, np.float32), draw(HIDDEN, HIDDEN), np.zeros(1, np.float32))

    def weights(self) -> list[np.ndarray]:
        return [self.embed, self.filters, self.bias, self.hidden, self.hidden_bias, self.out, self.out_bias]


def padded(raw: bytes) -> np.ndarray:
    """The bytes, then padding: the last filter sees no other text, and there are two blocks at least."""
    blocks = max(2, -(-(len(raw) + WIDTH) // BLOCK))
    codes = np.full(blocks * BLOCK, PAD, np.int16)
    codes[:len(raw)] = np.frombuffer(raw, np.uint8)
    return codes


def _windows(embedded: np.ndarray, places: int) -> np.ndarray:
    """What each filter place sees, a row per place; ``embedded`` is (..., bytes, EMBED) with WIDTH - STRIDE more bytes."""
    s = embedded.strides
    shape = (*embedded.shape[:-2], places, WIDTH * EMBED)
    return np.lib.stride_tricks.as_strided(embedded, shape, (*s[:-2], STRIDE * s[-2], s[-1]))


def scores(net: Network, raws: list[bytes]) -> np.ndarray:
    """The logit of each whole text."""
    docs = [padded(r) for r in raws]
    ends = np.cumsum([len(d) // BLOCK for d in docs])
    codes = np.concatenate([*docs, np.full(WIDTH, PAD, np.int16)])
    total, per, last = int(ends[-1]), BLOCK // STRIDE, ends - 1
    beyond = WIDTH // STRIDE - 1
    blank = np.maximum(np.tile(net.embed[PAD], WIDTH) @ net.filters + net.bias, 0)
    most, mean = np.empty((total, FILTERS), np.float32), np.empty((total, FILTERS), np.float32)
    for a in range(0, total, PIECE):
        b = min(a + PIECE, total)
        seen = net.embed[codes[a * BLOCK:b * BLOCK + WIDTH]]
        acts = np.ascontiguousarray(_windows(seen, (b - a) * per)) @ net.filters
        acts += net.bias
        np.maximum(acts, 0, out=acts)
        acts = acts.reshape(b - a, per, FILTERS)
        acts[last[(last >= a) & (last < b)] - a, -beyond:] = blank  # these places would see the next text
        most[a:b], mean[a:b] = acts.max(axis=1), acts.mean(axis=1)
    chunk = np.concatenate((np.maximum(most[:-1], most[1:]), (mean[:-1] + mean[1:]) / 2), axis=1)
    read = np.maximum(chunk @ net.hidden + net.hidden_bias, 0)
    starts = np.concatenate(([0], ends[:-1]))
    # a pair of blocks of two documents is no chunk: it may not win the maximum
    read[ends[:-1] - 1] = 0
    pooled = np.maximum.reduceat(read, starts, axis=0)
    return pooled @ net.out + net.out_bias[0]


def training_chunks(raw: bytes, most: int = POOL) -> list[bytes]:
    """Chunks of a text as 16-bit codes with the bytes after them, all of them or ``most`` spread evenly."""
    codes = np.append(padded(raw), np.full(WIDTH, PAD, np.int16))
    n = (len(codes) - WIDTH) // BLOCK - 1
    picked = range(n) if n <= most else np.unique(np.linspace(0, n - 1, most).astype(int)).tolist()
    return [codes[i * BLOCK:(i + 2) * BLOCK + WIDTH].tobytes() for i in picked]


def train(chunks: list[np.ndarray], labels: np.ndarray, shift: float, seed: int = SEED, steps: int = STEPS) -> Network:
    """Adam on the cross-entropy of documents, each given as an array of chunks; ``shift`` moves the logit to the true share."""
    net, rng = Network.fresh(seed), np.random.default_rng(seed)
    weights = net.weights()
    first, second, step = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
    epochs = -(-steps // -(-len(chunks) // BATCH))
    total = epochs * -(-len(chunks) // BATCH)
    hardest = [0] * len(chunks)
    for _ in range(epochs):
        order = rng.permutation(len(chunks))
        for at in range(0, len(order), BATCH):
            batch = order[at:at + BATCH]
            # some chunks of each document by lot, and the one that decided it last
            picks = [np.unique(np.append(rng.choice(len(chunks[i]), min(DRAWN, len(chunks[i])), replace=False), hardest[i])) for i in batch]
            data = np.concatenate([chunks[i][p] for i, p in zip(batch, picks)])
            starts = np.concatenate(([0], np.cumsum([len(p) for p in picks])[:-1]))
            grads, best = _gradients(net, data, starts, labels[batch])
            for i, p, s, b in zip(batch, picks, starts, best):
                hardest[i] = int(p[b - s])
            step += 1
            rate = RATE * (1 - step / (total + 1)) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for w, g, m, v in zip(weights, grads, first, second):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                w -= rate * m / (np.sqrt(v) + 1e-7)
    net.out_bias += np.float32(shift)
    return net


def _gradients(net: Network, codes: np.ndarray, starts: np.ndarray, labels: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    n, places = len(codes), 2 * BLOCK // STRIDE
    seen = np.ascontiguousarray(net.embed[codes])
    win = np.ascontiguousarray(_windows(seen, places)).reshape(n * places, WIDTH * EMBED)
    acts = np.maximum(win @ net.filters + net.bias, 0).reshape(n, places, FILTERS)
    top = acts.argmax(axis=1)
    chunk = np.concatenate((np.take_along_axis(acts, top[:, None, :], 1)[:, 0], acts.mean(axis=1)), axis=1)
    read = np.maximum(chunk @ net.hidden + net.hidden_bias, 0)
    ends = np.append(starts[1:], n)
    winner = np.stack([s + read[s:e].argmax(axis=0) for s, e in zip(starts, ends)])
    pooled = np.take_along_axis(read, winner, 0)
    logit = pooled @ net.out + net.out_bias[0]
    err = ((1 / (1 + np.exp(-logit)) - labels) / len(labels)).astype(np.float32)
    d_out = pooled.T @ err
    d_pooled = err[:, None] * net.out
    d_read = np.zeros_like(read)
    np.add.at(d_read, (winner, np.broadcast_to(np.arange(HIDDEN), winner.shape)), d_pooled)
    d_read *= read > 0
    d_hidden, d_chunk = chunk.T @ d_read, d_read @ net.hidden.T
    d_acts = np.repeat((d_chunk[:, None, FILTERS:] / places), places, axis=1)
    rows = np.arange(n)[:, None]
    d_acts[rows, top, np.arange(FILTERS)[None, :]] += d_chunk[:, :FILTERS]
    d_acts *= acts > 0
    d_acts = d_acts.reshape(n * places, FILTERS)
    d_win = (d_acts @ net.filters.T).reshape(n, places, WIDTH, EMBED)
    d_seen = np.zeros((n, 2 * BLOCK + WIDTH, EMBED), np.float32)
    for j in range(WIDTH):
        d_seen[:, j:j + STRIDE * places:STRIDE] += d_win[:, :, j]
    flat = codes.reshape(-1)
    d_embed = np.stack([np.bincount(flat, d_seen[:, :, e].reshape(-1), 257) for e in range(EMBED)], axis=1).astype(np.float32)
    decisive = np.array([s + (read[s:e] @ np.abs(net.out)).argmax() for s, e in zip(starts, ends)])
    return [d_embed, win.T @ d_acts, d_acts.sum(axis=0), d_hidden, d_read.sum(axis=0), d_out, np.array([err.sum()], np.float32)], decisive


def held_out(doc_id: Column) -> Column:
    """Whether a document's labels are kept from training; one without doc_id has no remainder and isn't held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", doc_id: str = "doc_id", text: str = "text", per_class: int = PER_CLASS) -> Network | float:
    """Trains on labelled rows that aren't held out, at most ``per_class`` of each class, drawn by a hash of doc_id.

    Class shares are counted over all these labels. Without both classes there is nothing to learn: the share of class 1
    comes back instead, smoothed.
    """
    known = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).cast("int").alias("label"))
    known = known.filter(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("label").alias("label"))
    shares = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    zeros, ones = shares.get(0, 0), shares.get(1, 0)
    if not zeros + ones:
        return (ones + 1) / (ones + zeros + 2)
    picked = [known.filter(F.col("label") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for c in (0, 1)]
    drawn = materialise(picked[0].unionAll(picked[1]))  # at most 2 x per_class rows

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raws in texts.slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array([training_chunks(r) for r in raws], pa.list_(pa.binary()))],
                                             names=["doc_id", "label", "chunks"])

    joined = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).join(F.broadcast(drawn), "doc_id")
    joined = joined.groupBy("doc_id", "label").agg(F.min("text").alias("text"))  # one text where rows repeat a doc_id
    got = joined.mapInArrow(cut, f"doc_id {joined.schema['doc_id'].dataType.simpleString()}, label int, chunks array<binary>").toArrow().sort_by("doc_id")
    y = got["label"].to_numpy().astype(np.float32)
    if not 0 < y.sum() < len(y):
        return (ones + 1) / (ones + zeros + 2)
    chunks = [np.stack([np.frombuffer(c, np.int16) for c in cs]) for cs in got["chunks"].to_pylist()]
    shift = np.log(ones / zeros) - np.log(y.sum() / (len(y) - y.sum()))
    return train(chunks, y, float(shift))


def scored(docs: DataFrame, model: Network | float, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted. The score sees nothing but the bytes of the whole text.

    A null text is scored as an empty one, from padding alone. Repeated rows are scored each; an empty table gives no row. A
    null doc_id is not held out.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raws in texts.slices(batches, "text"):
            if isinstance(model, Network):
                p = 1 / (1 + np.exp(-np.clip(scores(model, raws).astype(np.float64), -40, 40)))
            else:
                p = np.full(len(raws), model)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(p)], names=["doc_id", "score"])

    found = rows.mapInArrow(score, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that the classifier doesn't reject."""
    model = fit(docs, labels, doc_id=doc_id, text=text)
    columns = docs.columns
    schema = docs.schema

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raws in texts.slices(batches, text):
            good = scores(model, raws) >= 0 if isinstance(model, Network) else np.full(len(raws), model >= 0.5)
            yield batch.filter(pa.array(good)).select(columns)

    return docs.mapInArrow(judge, schema)
