"""Quality by supervised subword embeddings: hashed vectors of words and of their character n-grams, averaged over the
document, with a softmax output, trained by numpy stochastic gradient descent.

Once trained, the output of an average is the average of the vectors' outputs: a word needs one number, the sum of the
outputs of its parts, and their count.
"""

from __future__ import annotations

from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .word_scores import training_rows, word_sums

BUCKETS, WIDTH, SHORTEST, LONGEST = 1 << 16, 16, 3, 4
MIX = np.uint64(0x9E3779B97F4A7C15)


def parts(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of each word and of its n-grams between angle brackets, and the word that each belongs to."""
    lengths = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
    flat = np.frombuffer(b"".join(b"<" + w + b">" for w in words), np.uint8).astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), lengths)
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(flat))
    keys, owners = [np.fromiter((crc32(w) for w in words), np.uint64, len(words)) + np.uint64(1 << 40)], [np.arange(len(words))]
    for n in range(SHORTEST, LONGEST + 1):
        if len(flat) < n:
            continue
        key = np.full(len(flat) - n + 1, n << 36, np.uint64)
        for k in range(n):
            key |= flat[k : len(flat) - n + 1 + k] << np.uint64(8 * k)
        fits = left[: len(key)] >= n
        keys.append(key[fits])
        owners.append(owner[: len(key)][fits])
    every = np.concatenate(keys)
    return ((every * MIX) >> np.uint64(64 - 16)).astype(np.int64), np.concatenate(owners)


class Outputs:
    """For each word: the summed outputs of its parts, and their count."""

    def __init__(self, outputs: np.ndarray):
        self.outputs = outputs

    def __call__(self, words: list[bytes]) -> np.ndarray:
        buckets, owners = parts(words)
        return np.stack((np.bincount(owners, self.outputs[buckets], len(words)), np.bincount(owners, minlength=len(words)).astype(float)), axis=1)


def _train(rows: list[tuple[int, np.ndarray, np.ndarray]], epochs: int, rate: float, seed: int = 1) -> tuple[np.ndarray, float]:
    """(output of each bucket, bias): the difference of the two classes' softmax inputs."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / WIDTH, 1 / WIDTH, (BUCKETS, WIDTH))
    weights, bias = np.zeros((2, WIDTH)), np.zeros(2)
    steps, done = epochs * len(rows), 0
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            label, buckets, share = rows[i]
            lr = rate * (1 - done / steps)
            done += 1
            own = vectors[buckets]
            mean = share @ own
            z = weights @ mean + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[label] -= 1
            back = p @ weights
            weights -= lr * np.outer(p, mean)
            bias -= lr * p
            # Each part gets the whole step, not its share of it, as is usual for such models.
            vectors[buckets] = own - lr * np.minimum(1.0, share * 50)[:, None] * back
    return vectors @ (weights[1] - weights[0]), float(bias[1] - bias[0])


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", doc_id: str = "doc_id", text: str = "text", sample: int = 2500, epochs: int = 5, rate: float = 0.5) -> tuple[Outputs, float]:
    """Learnt from at most `sample` labelled rows. Without any, scores are 0.5."""
    rows = training_rows(docs, labels, label, doc_id, text, sample)

    def count(batches):
        for batch in batches:
            ys, buckets, shares = [], [], []
            for y, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = t.split()
                if words:
                    found, n = np.unique(parts(words)[0], return_counts=True)
                    ys.append(y)
                    buckets.append(found.astype(np.int32))
                    shares.append((n / n.sum()).astype(np.float32))
            yield pa.RecordBatch.from_arrays([pa.array(ys, pa.int32()), pa.array(buckets, pa.list_(pa.int32())), pa.array(shares, pa.list_(pa.float32()))], names=["label", "buckets", "shares"])

    got = rows.select("label", F.col("text").cast("binary"), "id").orderBy("id").drop("id").mapInArrow(count, "label int, buckets array<int>, shares array<float>").toArrow()
    if not got.num_rows:
        return Outputs(np.zeros(BUCKETS)), 0.0
    trained = [(y, b.values.to_numpy(), s.values.to_numpy()) for y, b, s in zip(got["label"].to_pylist(), got["buckets"], got["shares"])]
    outputs, bias = _train(trained, epochs, rate)
    return Outputs(outputs), bias


def scores(docs: DataFrame, labels: DataFrame, label: str = "quality", doc_id: str = "doc_id", text: str = "text", keep: dict | None = None, **options) -> DataFrame:
    """A row per row of docs: doc_id, score (probability of the label 1, 0 to 1) and the kept columns. Empty and null texts
    have the score of the bias alone. Whole texts are read; repeated rows score alike."""
    outputs, bias = fit(docs, labels, label, doc_id, text, **options)
    sums = word_sums(docs, outputs, F.col(doc_id), F.col(text), False, 2, keep)
    margin = F.col("sums")[0] / F.greatest(F.col("sums")[1], F.lit(1.0)) + bias
    return sums.select("doc_id", (1 / (1 + F.exp(-margin))).alias("score"), *(keep or {}))
