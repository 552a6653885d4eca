"""Toxicity by class-conditional Kneser-Ney models over the characters (bytes) of words.

The highest order is counted for toxic and ordinary texts apart; what it lacks backs off to continuation counts that both
classes share, so that a rare expression is judged by what its parts say. The shared part of the two likelihoods is
equal and cancels: an n-gram's ratio needs its counts in either class, an unseen one only those of its context.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .word_scores import LOWER, training_rows, whole_sums, word_sums

ORDER = 5  # symbols of an n-gram
START, STOP = 1, 2


def grams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of the words as numbers (last symbol lowest, zeros before the start), and where each word's begin."""
    lengths = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
    begins = np.concatenate(([0], np.cumsum(lengths)))
    flat = np.frombuffer(b"".join(b"\x01" + w + b"\x02" for w in words), np.uint8).astype(np.int64)
    place = np.arange(len(flat)) - np.repeat(begins[:-1], lengths)
    out = flat.copy()
    for k in range(1, ORDER):
        before = np.zeros_like(flat)
        before[k:] = flat[:-k]
        before[place < k] = 0
        out |= before << (8 * k)
    return out[place > 0], np.concatenate(([0], np.cumsum(lengths - 1)))


def _summed(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    distinct, place = np.unique(keys, return_inverse=True)
    return distinct, np.bincount(place, weights, len(distinct))


def _at(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, missing: float = 0.0) -> np.ndarray:
    if not len(keys):
        return np.full(len(wanted), missing)
    i = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[i] == wanted, values[i], missing)


class Ratios:
    """Log-likelihood ratios of n-grams and, for those that neither class has, of contexts."""

    def __init__(self, counts: list[tuple[np.ndarray, np.ndarray]], discount: float = 0.95):
        every = np.unique(np.concatenate([k for k, _ in counts]))
        # Shared continuation probabilities, from order 1 up to ORDER - 1, of the suffixes of the n-grams.
        shared = np.full(len(every), 1 / 256)
        longer = every
        kinds = {}
        for order in range(ORDER - 1, 0, -1):
            longer, n = _summed(longer & ((1 << 8 * order) - 1), np.ones(len(longer)))
            kinds[order] = (longer, n)
        for order in range(1, ORDER):
            keys, n = kinds[order]
            contexts, total = _summed(keys >> 8, n)
            _, follow = _summed(keys >> 8, np.ones(len(keys)))
            own, context = every & ((1 << 8 * order) - 1), (every & ((1 << 8 * order) - 1)) >> 8
            t = _at(contexts, total, context, 1.0)
            shared = np.maximum(_at(keys, n, own) - discount, 0) / t + discount * _at(contexts, follow, context) / t * shared
        logs, self.contexts = [], np.unique(every >> 8)
        back = []
        for keys, n in counts:
            contexts, total = _summed(keys >> 8, n)
            _, follow = _summed(keys >> 8, np.ones(len(keys)))
            context = every >> 8
            t = _at(contexts, total, context)
            p = np.where(t > 0, (np.maximum(_at(keys, n, every) - discount, 0) + discount * _at(contexts, follow, context) * shared) / np.maximum(t, 1), shared)
            logs.append(np.log(np.maximum(p, 1e-300)))
            t = _at(contexts, total, self.contexts)
            back.append(np.log(np.where(t > 0, discount * _at(contexts, follow, self.contexts) / np.maximum(t, 1), 1.0)))
        self.grams, self.ratios, self.backoffs = every, logs[1] - logs[0], back[1] - back[0]

    def __call__(self, words: list[bytes]) -> np.ndarray:
        """For each word: the sum of the log ratios (toxic over ordinary), and its symbols."""
        keys, begins = grams(words)
        back = _at(self.contexts, self.backoffs, keys >> 8)
        each = np.where(_at(self.grams, np.ones(len(self.grams)), keys) > 0, _at(self.grams, self.ratios, keys), back)
        return np.stack((np.add.reduceat(each, begins[:-1]), np.diff(begins).astype(float)), axis=1)


def _logistic(x: np.ndarray, y: np.ndarray, rounds: int = 50, ridge: float = 1.0) -> np.ndarray:
    """Newton's method; the last weight is the intercept."""
    a = np.column_stack((x, np.ones(len(x))))
    w = np.zeros(a.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        hess = (a * (p * (1 - p))[:, None]).T @ a + ridge * np.eye(len(w))
        w = w + np.linalg.solve(hess, a.T @ (y - p) - ridge * w)
    return w


def _features(total: np.ndarray, symbols: np.ndarray) -> np.ndarray:
    """The ratio by length and by its root, scaled."""
    n = np.maximum(symbols, 1)
    return np.column_stack((10 * total / n, total / np.sqrt(n)))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", doc_id: str = "doc_id", text: str = "text", sample: int = 4000) -> tuple[Ratios, list[float]]:
    """The ratios and the weights that turn them into a probability, learnt from at most `sample` rows of each class (three
    quarters for the counts, the rest for the weights). Without rows of both classes the weights are 0 and scores 0.5."""
    rows = training_rows(docs, labels, label, doc_id, text, sample, per_class=True).withColumn("part", F.pmod(F.xxhash64("id", F.lit(7)), F.lit(4)))

    def count(batches):
        for batch in batches:
            out: dict[tuple[int, bytes], int] = {}
            for y, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for w in t.translate(LOWER).split():
                    out[y, w] = out.get((y, w), 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array([y for y, _ in out], pa.int32()), pa.array([w for _, w in out], pa.binary()), pa.array(list(out.values()), pa.int64())], names=["label", "word", "n"])

    words = rows.where("part > 0").select("label", F.col("text").cast("binary")).mapInArrow(count, "label int, word binary, n long").groupBy("label", "word").agg(F.sum("n").alias("n")).toArrow()
    counts = []
    for y in (0, 1):
        own = words.filter(pa.compute.equal(words["label"], y))
        keys, begins = grams(own["word"].to_pylist())
        counts.append(_summed(keys, np.repeat(own["n"].to_numpy().astype(float), np.diff(begins))))
    if not all(len(k) for k, _ in counts):
        return Ratios([(np.zeros(0, np.int64), np.zeros(0))] * 2), [0.0, 0.0, 0.0]
    ratios = Ratios(counts)
    got = word_sums(rows.where("part = 0"), ratios, F.col("id"), F.col("text"), True, 2, {"label": F.col("label")}).select("label", "sums").toArrow()
    if not got.num_rows:
        return ratios, [1.0, 0.0, 0.0]
    sums = np.array(got["sums"].to_pylist()).reshape(-1, 2)
    return ratios, _logistic(_features(sums[:, 0], sums[:, 1]), got["label"].to_numpy().astype(float)).tolist()


def _score(weights: list[float]) -> Column:
    n = F.greatest(F.col("sums")[1], F.lit(1.0))
    margin = weights[0] * 10 * F.col("sums")[0] / n + weights[1] * F.col("sums")[0] / F.sqrt(n) + weights[2]
    return 1 / (1 + F.exp(-margin))


def scores(docs: DataFrame, labels: DataFrame, label: str = "toxic", doc_id: str = "doc_id", text: str = "text", keep: dict | None = None, **options) -> DataFrame:
    """A row per row of docs: doc_id, score (probability of toxic, 0 to 1) and the kept columns. Empty and null texts have
    the score of no evidence. Whole texts are read, and only text and label are used; repeated rows score alike, an empty
    table gives an empty result."""
    ratios, weights = fit(docs, labels, label, doc_id, text, **options)
    sums = word_sums(docs, ratios, F.col(doc_id), F.col(text), True, 2, keep)
    return sums.select("doc_id", _score(weights).alias("score"), *(keep or {}))


def below(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, label: str = "toxic", doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of docs whose score is under the threshold, with all their columns, whatever their names."""
    ratios, weights = fit(docs, labels, label, doc_id, text, **options)
    sums = whole_sums(docs, ratios, text, True, 2)
    return sums.where(_score(weights) < threshold).select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(docs.columns)])
