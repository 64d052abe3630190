"""Byte-level convolutional quality classifier in numpy.

Bytes are embedded; filters of 8 bytes move in steps of 4 over chunks of 256 bytes that
overlap by one step and cover the whole text. Each chunk's responses are max-pooled and give
a chunk logit; the mean and the extremes of a document's chunk logits give one probability.
Filters, embedding and both output layers are learned here.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.llm.common import bounded_batches, claim, remainder, slices, written

STEP, DIM, FILTERS = 4, 8, 32
CHUNK_STEPS = 64
#: Bound of the training sample: labelled rows, each with all its chunks.
TRAIN_ROWS = 3000
THRESHOLD = 0.3


def padded(text: bytes) -> bytes:
    """Zero bytes up to a multiple of the step, two steps at least."""
    return text + b"\0" * max(2 * STEP - len(text), -len(text) % STEP)


def chunks_of(text: bytes) -> list[bytes]:
    """Overlapping chunks that cover the text, the last one possibly shorter."""
    data = padded(text)
    width = STEP * CHUNK_STEPS
    return [data[a : a + width + STEP] for a in range(0, max(1, len(data) - STEP), width)]


class Network:
    """Embedding, filters, pooling and output; float32 throughout."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        normal = lambda *n, s: rng.normal(0, s, n).astype(np.float32)
        width = STEP * DIM
        self.embed, self.w1, self.w2 = normal(256, DIM, s=0.5), normal(width, FILTERS, s=0.12), normal(width, FILTERS, s=0.12)
        self.bias, self.out, self.shift = np.zeros(FILTERS, np.float32), normal(FILTERS, s=0.2), np.zeros(1, np.float32)
        self.combine = np.array([1.0, 0.0, 0.0, 0.0], np.float32)  # of the mean, maximum, minimum and one

    def parameters(self) -> list[np.ndarray]:
        return [self.embed, self.w1, self.w2, self.bias, self.out, self.shift]

    def learn(self, chunks: np.ndarray, sizes: np.ndarray, label: np.ndarray, weight: np.ndarray, epochs: int = 6, batch: int = 256, rate: float = 4e-3, seed: int = 3) -> None:
        """Adam on the weighted logistic loss of single chunks; windows past ``sizes`` bytes do not count."""
        rng, params = np.random.default_rng(seed), self.parameters()
        m, v, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        for _ in range(epochs):
            order = rng.permutation(len(chunks))
            for a in range(0, len(order), batch):
                at = order[a : a + batch]
                raw = chunks[at].reshape(len(at), CHUNK_STEPS + 1, STEP)
                x = self.embed[raw].reshape(len(at), CHUNK_STEPS + 1, -1)
                y = x[:, :-1] @ self.w1
                y += x[:, 1:] @ self.w2
                y[np.arange(CHUNK_STEPS) >= sizes[at][:, None] // STEP - 1] = -np.inf
                best = y.argmax(1)
                pooled = np.take_along_axis(y, best[:, None], 1)[:, 0] + self.bias
                active = np.maximum(pooled, 0)
                p = 1 / (1 + np.exp(-(active @ self.out + self.shift[0])))
                d = ((p - label[at]) * weight[at] / len(at)).astype(np.float32)
                g_pool = d[:, None] * self.out * (pooled > 0)
                rows = np.arange(len(at))[:, None]
                here, after = x[rows, best], x[rows, best + 1]
                g_embed = np.zeros_like(self.embed)
                for w, k in ((self.w1, 0), (self.w2, 1)):
                    part = (g_pool[:, :, None] * w.T).reshape(-1, DIM)
                    into = raw[rows, best + k].reshape(-1)
                    for c in range(DIM):
                        g_embed[:, c] += np.bincount(into, part[:, c], 256)
                grads = [g_embed, np.einsum("bfk,bf->kf", here, g_pool), np.einsum("bfk,bf->kf", after, g_pool), g_pool.sum(0), active.T @ d, d.sum(keepdims=True)]
                t += 1
                for k, (param, g) in enumerate(zip(params, grads)):
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    param -= (rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)

    def learn_combination(self, summary: np.ndarray, label: np.ndarray, steps: int = 400, rate: float = 0.3) -> None:
        """Logistic regression on document summaries by gradient descent on scaled inputs."""
        scale = np.maximum(np.abs(summary).max(0), 1e-6)
        x = np.column_stack((summary / scale, np.ones(len(summary))))
        w = np.append(self.combine[:3] * scale, 0.0)
        for _ in range(steps):
            w -= rate * x.T @ (1 / (1 + np.exp(-np.clip(x @ w, -50, 50))) - label) / len(x)
        self.combine = np.append(w[:3] / scale, w[3]).astype(np.float32)

    def summary(self, texts: list[bytes]) -> np.ndarray:
        """Mean, maximum and minimum of the chunk logits of each whole text."""
        data = [padded(x) for x in texts]
        steps = np.fromiter(map(len, data), np.int64, len(data)) // STEP
        x = self.embed[np.frombuffer(b"".join(data), np.uint8)].reshape(-1, STEP * DIM)
        y = x[:-1] @ self.w1
        y += x[1:] @ self.w2
        first = np.cumsum(steps) - steps
        n_chunks = -(-(steps - 1) // CHUNK_STEPS)
        number = np.arange(int(n_chunks.sum())) - np.repeat(np.cumsum(n_chunks) - n_chunks, n_chunks)
        start = np.repeat(first, n_chunks) + CHUNK_STEPS * number
        y[(first + steps - 1)[:-1]] = -np.inf  # windows across two texts
        pooled = np.maximum(np.maximum.reduceat(y, start, 0) + self.bias, 0)
        logit = pooled @ self.out + self.shift[0]
        at = np.cumsum(n_chunks) - n_chunks
        return np.column_stack((np.add.reduceat(logit, at) / n_chunks, np.maximum.reduceat(logit, at), np.minimum.reduceat(logit, at)))

    def probability(self, texts: list[bytes]) -> np.ndarray:
        z = self.summary(texts) @ self.combine[:3] + self.combine[3]
        return 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -50, 50)))


def train(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, modulus: int, held_out: int, max_rows: int = TRAIN_ROWS) -> Network:
    """A network fitted on at most ``max_rows`` labelled rows, chosen by a hash of their ids, with their whole texts."""
    usable = labels.where((remainder(F.col(id_col), modulus) != held_out) & F.col(label_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("double").alias("label"))
    sample = written(usable.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(max_rows).distinct(), "labelled")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(sample), "doc_id")
    # of an id with several rows the first text by order, so that the sample stays within its bound
    got = texts.groupBy("doc_id", "label").agg(F.min("text").alias("text")).toPandas().sort_values(["doc_id", "label"])
    net, label = Network(), got["label"].to_numpy()
    if len(set(label)) < 2:
        net.combine = np.array([0, 0, 0, 4 * label[0] - 2 if len(label) else 0], np.float32)
        return net
    whole = [x.encode() for x in got["text"]]
    parts = [chunks_of(x) for x in whole]
    n = np.array([len(x) for x in parts])
    flat = [x for some in parts for x in some]
    sizes = np.array([len(x) for x in flat])
    full = STEP * (CHUNK_STEPS + 1)
    chunks = np.frombuffer(b"".join(x.ljust(full, b"\0") for x in flat), np.uint8).reshape(-1, full)
    net.learn(chunks, sizes, np.repeat(label, n).astype(np.float32), (np.repeat(1 / n, n) * (len(chunks) / len(n))).astype(np.float32))
    # the combination is learned from the summaries that scoring will see: those of whole texts
    summary = np.concatenate([net.summary(whole[a:b]) for a, b in slices(np.array([len(x) for x in whole]), 1 << 18)])
    net.learn_combination(summary, label)
    return net


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", modulus: int = 5, held_out: int = 0, threshold: float = THRESHOLD) -> DataFrame:
    """Probability that each whole text is of good quality.

    Returns doc_id, held_out, score, predicted. Null counts as empty; empty texts are scored
    like any other, and very long ones whole. Documents without a label are scored, labels without a document ignored.
    Repeated rows are scored one by one; an id labelled twice trains with both labels. Without two classes of labels the score is constant.
    Other columns are ignored; an empty table gives no rows.
    """
    bounded_batches(docs.sparkSession)
    net = docs.sparkSession.sparkContext.broadcast(train(docs, labels, id_col, text_col, label_col, modulus, held_out))  # some 20 KB

    def score(frames):
        claim("quality")
        for frame in frames:
            texts = [x.encode() for x in frame["text"].tolist()]
            parts = [net.value.probability(texts[a:b]) for a, b in slices(np.fromiter(map(len, texts), np.int64, len(texts)), 1 << 18)]
            yield frame[["doc_id", "held_out"]].assign(score=np.concatenate(parts) if parts else [])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (remainder(F.col(id_col), modulus) == held_out).alias("held_out"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInPandas(score, "doc_id long, held_out boolean, score double").withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))
