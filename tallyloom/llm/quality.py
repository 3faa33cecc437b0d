"""Quality classifier: a convolutional network on bytes, in numpy.

A text's UTF-8 bytes are embedded and passed, in overlapping chunks that cover all of it, through learned filters.
The largest response of every filter in a chunk, with how often it responds, describes the chunk; the chunks' hidden units
are averaged and maximised over the document, and a last layer makes one probability of them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import text_of

#: Bytes of a chunk, and how far the next one begins: chunks overlap by a quarter.
CHUNK, STRIDE = 256, 192
#: Bytes seen by a filter, step between its places, size of a byte's embedding, filters, hidden units.
WIDTH, STEP, EMBED, FILTERS, HIDDEN = 8, 2, 6, 24, 16
#: Labelled rows that the network learns from, taken by a hash of their id, and bytes of them all.
TRAIN_ROWS = 2000
TRAIN_BYTES = 16 << 20
EPOCHS = 13
SEED = 11
#: Chunks that are scored or learned from as one array.
BLOCK = 512

PLACES = (CHUNK - WIDTH) // STEP + 1


def chunks_of(raw: bytes) -> np.ndarray:
    """Overlapping chunks (n, CHUNK) of byte numbers that cover ``raw``; 0 fills the last one."""
    n = max(1, -(-(len(raw) - CHUNK) // STRIDE) + 1)
    padded = np.zeros((n - 1) * STRIDE + CHUNK, np.uint8)
    padded[: len(raw)] = np.frombuffer(raw, np.uint8)
    return np.lib.stride_tricks.sliding_window_view(padded, CHUNK)[::STRIDE]


@dataclass
class ByteNet:
    """Weights: byte embedding, filters, hidden layer over a chunk's pooled responses, last layer over the document."""

    embed: np.ndarray
    conv: np.ndarray
    bias: np.ndarray
    hidden: np.ndarray
    hidden_bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    @classmethod
    def fresh(cls, seed: int = SEED) -> ByteNet:
        rng = np.random.default_rng(seed)

        def normal(*shape: int, fan: int) -> np.ndarray:
            return rng.normal(0, np.sqrt(2 / fan), shape).astype(np.float32)

        zeros = np.zeros
        return cls(
            normal(256, EMBED, fan=2), normal(WIDTH * EMBED, FILTERS, fan=WIDTH * EMBED), zeros(FILTERS, np.float32),
            normal(2 * FILTERS, HIDDEN, fan=2 * FILTERS), zeros(HIDDEN, np.float32), normal(2 * HIDDEN, fan=2 * HIDDEN), zeros(1, np.float32),
        )

    def weights(self) -> list[np.ndarray]:
        return [self.embed, self.conv, self.bias, self.hidden, self.hidden_bias, self.out, self.out_bias]

    def _windows(self, chunks: np.ndarray) -> np.ndarray:
        """Embedded windows (chunks, PLACES, WIDTH * EMBED)."""
        embedded = self.embed[chunks].reshape(len(chunks), CHUNK * EMBED)
        return np.lib.stride_tricks.sliding_window_view(embedded, WIDTH * EMBED, axis=1)[:, :: STEP * EMBED]

    def chunk_units(self, chunks: np.ndarray) -> np.ndarray:
        """Hidden units (chunks, HIDDEN)."""
        windows = np.ascontiguousarray(self._windows(chunks)).reshape(-1, WIDTH * EMBED)
        response = np.maximum(windows @ self.conv + self.bias, 0).reshape(len(chunks), PLACES, FILTERS)
        pooled = np.concatenate([response.max(axis=1), response.mean(axis=1)], axis=1)
        return np.maximum(pooled @ self.hidden + self.hidden_bias, 0)

    def score(self, units: np.ndarray) -> float:
        pooled = np.concatenate([units.mean(axis=0), units.max(axis=0)])
        z = float(np.clip(pooled.astype(np.float64) @ self.out.astype(np.float64) + float(self.out_bias[0]), -30, 30))
        return 1 / (1 + np.exp(-z))

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """Probabilities of label 1. Each text is scored whole and by itself, a long one in blocks of chunks."""
        result = np.zeros(len(texts))
        for i, raw in enumerate(texts):
            chunks = chunks_of(raw)
            result[i] = self.score(np.concatenate([self.chunk_units(chunks[at : at + BLOCK]) for at in range(0, len(chunks), BLOCK)]))
        return result


def _gradients(net: ByteNet, chunks: np.ndarray, owner: np.ndarray, labels: np.ndarray, weight: np.ndarray, block: int = BLOCK) -> list[np.ndarray]:
    """Gradients of the weighted log loss, for chunks with the number of the document that owns each (ascending).

    All chunks count. They are gone through in blocks, once for the units that the documents pool and once backwards.
    """
    docs = len(labels)
    units = np.concatenate([net.chunk_units(chunks[at : at + block]) for at in range(0, len(chunks), block)])
    first = np.searchsorted(owner, np.arange(docs))
    many = np.bincount(owner, minlength=docs)[:, None]
    mean = np.add.reduceat(units, first) / many
    most = np.maximum.reduceat(units, first)
    z = np.concatenate([mean, most], axis=1) @ net.out + net.out_bias[0]
    error = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels) * weight / docs).astype(np.float32)
    g_out = np.concatenate([mean, most], axis=1).T @ error
    g_mean, g_most = error[:, None] * net.out[:HIDDEN], error[:, None] * net.out[HIDDEN:]
    winner = units == most[owner]
    share = winner / np.maximum(1, np.add.reduceat(winner.astype(np.float32), first))[owner]
    g_units = (((g_mean / many)[owner] + g_most[owner] * share) * (units > 0)).astype(np.float32)
    below = [_back(net, chunks[at : at + block], g_units[at : at + block]) for at in range(0, len(chunks), block)]
    return [*(sum(parts) for parts in zip(*below)), g_out, error.sum(keepdims=True)]


def _back(net: ByteNet, chunks: np.ndarray, g_units: np.ndarray) -> list[np.ndarray]:
    """Gradients of all weights below the hidden units, for one block of chunks."""
    windows = np.ascontiguousarray(net._windows(chunks)).reshape(-1, WIDTH * EMBED)
    response = np.maximum(windows @ net.conv + net.bias, 0).reshape(len(chunks), PLACES, FILTERS)
    top = response.argmax(axis=1)
    pooled = np.concatenate([np.take_along_axis(response, top[:, None], 1)[:, 0], response.mean(axis=1)], axis=1)
    g_pooled = g_units @ net.hidden.T
    g_response = np.repeat(g_pooled[:, None, FILTERS:] / PLACES, PLACES, axis=1)
    np.put_along_axis(g_response, top[:, None], np.take_along_axis(g_response, top[:, None], 1) + g_pooled[:, None, :FILTERS], 1)
    g_response = (g_response * (response > 0)).reshape(-1, FILTERS).astype(np.float32)
    g_windows = (g_response @ net.conv.T).reshape(len(chunks), PLACES, WIDTH, EMBED)
    g_bytes = np.zeros((len(chunks), CHUNK, EMBED), np.float32)
    for w in range(WIDTH):
        g_bytes[:, w : w + (PLACES - 1) * STEP + 1 : STEP] += g_windows[:, :, w]
    g_embed = np.stack([np.bincount(chunks.ravel(), g_bytes[:, :, e].ravel(), 256) for e in range(EMBED)], axis=1)
    return [g_embed, windows.T @ g_response, g_response.sum(axis=0), pooled.T @ g_units, g_units.sum(axis=0)]


def train(texts: list[bytes], labels: list[int], epochs: int = EPOCHS, seed: int = SEED) -> ByteNet:
    """A network fitted by Adam. The rarer class weighs as much as the other; with one class the scores are constant."""
    net = ByteNet.fresh(seed)
    y = np.asarray(labels, np.float32)
    if len(set(labels)) < 2:
        for w in net.weights():
            w[...] = 0
        net.out_bias[0] = 0 if not labels else 3 if labels[0] else -3
        return net
    share = float(y.mean())
    weight = np.where(y > 0, 0.5 / share, 0.5 / (1 - share)).astype(np.float32)
    rng = np.random.default_rng(seed)
    every = [chunks_of(t) for t in texts]
    moments = [[np.zeros_like(w), np.zeros_like(w)] for w in net.weights()]
    step, batch = 0, 32
    for epoch in range(epochs):
        order = rng.permutation(len(texts))
        rate = 0.004 * (1 - epoch / epochs) + 0.0004
        for at in range(0, len(order), batch):
            ids = order[at : at + batch]
            drawn = [every[i] for i in ids]
            owner = np.repeat(np.arange(len(ids)), [len(c) for c in drawn])
            step += 1
            for w, (m, v), g in zip(net.weights(), moments, _gradients(net, np.concatenate(drawn), owner, y[ids], weight[ids])):
                m *= 0.9
                m += 0.1 * g
                v *= 0.999
                v += 0.001 * g * g
                w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-7)
    return net


def _held_out():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, most_bytes: int = TRAIN_BYTES) -> list[tuple[bytes, int]]:
    """Texts and labels of at most ``rows`` labelled documents that are not held out, of ``most_bytes`` bytes in all.

    They are the first by a hash of the id, up to the first that would go beyond the bytes, so a text's length has no say in whether it
    is learned from. Of rows that share an id the least text counts. The sample's ids are bounded, so they are broadcast; texts come to the driver once their sizes are known.
    """
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~_held_out())
    sample = known.select("doc_id", "quality").distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(rows)
    texts = docs.select("doc_id", text_of().alias("text"))
    found = texts.join(F.broadcast(sample), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text"))
    sizes = found.select("doc_id", "quality", F.octet_length("text").alias("n"), F.xxhash64("doc_id").alias("h")).collect()
    chosen, held = [], 0
    for r in sorted(sizes, key=lambda r: (r["h"], r["doc_id"], r["quality"])):
        held += r["n"]
        if held > most_bytes:
            break
        chosen.append((r["doc_id"], r["quality"]))
    if not chosen:
        return []
    kinds = sample.schema
    wanted = F.broadcast(docs.sparkSession.createDataFrame(chosen, kinds))
    kept = texts.join(wanted, "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text")).collect()
    return [(t.encode("utf-8"), int(q)) for _, q, t in sorted((r["doc_id"], r["quality"], r["text"]) for r in kept)]


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, most_bytes: int = TRAIN_BYTES) -> ByteNet:
    """A network for ``labels.quality``, from a bounded sample of labelled documents that are not held out."""
    found = labelled_sample(docs, labels, rows, most_bytes)
    return train([t for t, _ in found], [q for _, q in found])


def score_documents(docs: DataFrame, net: ByteNet) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``.

    A null text counts as empty and gets a score like any other. Repeated rows each give one, a null ``doc_id`` is kept (its
    ``held_out`` is false), and an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(shared.value.scores([t.encode("utf-8") for t in texts]))

    scored = docs.select("doc_id", F.coalesce(_held_out(), F.lit(False)).alias("held_out"), score(text_of()).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
