"""Benchmark decontamination by latent semantic retrieval.

Benchmark items are cut into passages; a distributed randomised SVD of their TF-IDF matrix gives every term a latent
vector. Each document is read once, in windows of WINDOW words that overlap by half; windows near a passage by cosine are
candidates, and a longest common subsequence of words, over the passage and over its answer if it has one, decides. The
benchmark is the query set: it is treated in blocks of BLOCK passages, which bound what is sent to the executors.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sweep

PASSAGE, WINDOW, BLOCK = 64, 64, 1000
EDGES = re.compile(rb"^[^\w\x80-\xff]+|[^\w\x80-\xff]+$")
UPPER = bytes(range(65, 91))
LOWER = bytes.maketrans(UPPER, UPPER.lower())


class Words:
    """The words of a text: lower-case (A to Z), without signs at their edges, none empty. Keeps what it has cleaned."""

    def __init__(self):
        self.known: dict[bytes, bytes] = {}

    def __call__(self, text: bytes) -> list[bytes]:
        raw = text.translate(LOWER).split()
        known = self.known
        if len(known) > 500_000:
            known.clear()
        for w in raw:
            if w not in known:
                known[w] = EDGES.sub(b"", w)
        return [x for x in map(known.__getitem__, raw) if x]


def common_length(pattern: list[bytes], text: list[bytes]) -> int:
    """Length of the longest common subsequence, bit-parallel (Hyyro)."""
    places: dict[bytes, int] = {}
    for i, w in enumerate(pattern):
        places[w] = places.get(w, 0) | 1 << i
    full = (1 << len(pattern)) - 1
    v = full
    for w in text:
        if m := places.get(w):
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(pattern) - bin(v).count("1")


class Index:
    """One block of passages: terms with latent vectors, passages with unit vectors, words and answer words."""

    def __init__(self, items, terms, vectors, passages):
        self.items, self.terms, self.vectors, self.passages = items, terms, vectors, passages
        self.plain: list[tuple[int, bytes]] = []
        self.known: dict[bytes, int] = {}
        self.holds, self.least = np.zeros((0, 0), np.uint8), np.zeros(0)


def _passages(items: DataFrame, item_id: str, text: str, answer: str | None) -> list[tuple[int, list[bytes], list[bytes]]]:
    """(item, words, answer words) of each passage. Answer words are empty without an answer: the share of
    the passage decides alone. Null ids, null and wordless texts have none."""
    words, out = Words(), []
    for row in items.select(F.col(item_id).alias("i"), F.col(text).alias("t"), (F.col(answer) if answer else F.lit(None).cast("string")).alias("a")).where("i is not null and t is not null").orderBy("i", "t").toLocalIterator():
        own = words(row["t"].encode())
        count = max(1, round(len(own) / PASSAGE))
        for k in range(count):
            part = own[len(own) * k // count : len(own) * (k + 1) // count]
            if part:
                out.append((row["i"], part, words(row["a"].encode()) if row["a"] else []))
    return out


def _index(spark, block: list[tuple[int, list[bytes], list[bytes]]], rank: int, common: float) -> Index:
    """Randomised SVD (Halko, Martinsson, Tropp) of the block's TF-IDF matrix X: Y = X Omega, Q = orth(Y), one power step,
    B = Q'X by term, singular vectors of the small B B'. Products over terms run on the executors; the driver holds
    matrices of passages x rank."""
    counts = pa.table({"passage": pa.array([p for p, (_, ws, _) in enumerate(block) for _ in ws], pa.int32()), "term": pa.array([w for _, ws, _ in block for w in ws], pa.binary())})
    rows = spark.createDataFrame(counts).groupBy("passage", "term").agg(F.count("*").alias("tf"))
    n, most = len(block), max(2.0, common * len(block))
    df = rows.groupBy("term").agg(F.count("*").alias("df")).where(F.col("df") <= most)
    cells = rows.join(df, "term").select("passage", "term", ((1 + F.log("tf")) * (F.log(F.lit(1.0 + n) / (1 + F.col("df"))) + 1)).alias("w")).repartition("term").persist()
    try:
        rank = max(1, min(rank, n))
        width = min(n, rank + 8)

        def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """X Omega of the batch's terms; a term's row of Omega follows from its bytes."""
            for b in batches:
                out = np.zeros((n, width))
                for p, t, w in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                    out[p] += w * np.random.default_rng(list(t) + [len(t)]).standard_normal(width)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(n), pa.int32()), pa.array(list(out), pa.list_(pa.float64()))], names=["passage", "v"])

        def against(q: np.ndarray):
            """X' q by term: (term, vector)."""

            def of(got: pa.Table) -> pa.Table:
                terms, place = np.unique(np.array(got["term"].to_pylist(), object), return_inverse=True)
                out = np.zeros((len(terms), q.shape[1]))
                np.add.at(out, place, got["w"].to_numpy()[:, None] * q[got["passage"].to_numpy()])
                return pa.table({"term": pa.array(list(terms), pa.binary()), "v": pa.array(list(out), pa.list_(pa.float64()))})

            return cells.withColumn("part", F.pmod(F.xxhash64("term"), F.lit(16))).groupBy("part").applyInArrow(of, "term binary, v array<double>").toArrow()

        y = np.zeros((n, width))
        # Not as Python's numbers: there is a matrix for each batch.
        for part in cells.select("passage", "term", "w").mapInArrow(sketch, "passage int, v array<double>").toArrow().to_batches():
            np.add.at(y, part["passage"].to_numpy(), part["v"].flatten().to_numpy().reshape(-1, width))
        own = cells.toArrow()
        for step in range(2):
            q, _ = np.linalg.qr(y)
            got = against(q)
            terms, b = got["term"].to_pylist(), np.array(got["v"].to_pylist()).reshape(-1, q.shape[1])
            if step == 0:
                at = {t: i for i, t in enumerate(terms)}
                y = np.zeros((n, b.shape[1]))
                np.add.at(y, own["passage"].to_numpy(), own["w"].to_numpy()[:, None] * b[[at[t] for t in own["term"].to_pylist()]])
        u, s, _ = np.linalg.svd(b, full_matrices=False) if len(b) else (np.zeros((0, 1)), np.zeros(1), None)
        vectors = u[:, :rank]
        at = {t: i for i, t in enumerate(terms)}
        latent = np.zeros((n, vectors.shape[1]))
        place = [at[t] for t in own["term"].to_pylist()]
        np.add.at(latent, own["passage"].to_numpy(), own["w"].to_numpy()[:, None] * vectors[place])
        idf = np.zeros(len(terms))
        for t, d in zip(*[c.to_pylist() for c in df.toArrow().columns]):
            if t in at:
                idf[at[t]] = np.log((1 + n) / (1 + d)) + 1
        norms = np.linalg.norm(latent, axis=1, keepdims=True)
        return Index([b_[0] for b_ in block], at, (vectors * idf[:, None]).astype(np.float32), [(latent / np.where(norms > 0, norms, 1)).astype(np.float32), norms[:, 0] > 0, [b_[1] for b_ in block], [b_[2] for b_ in block]])
    finally:
        cells.unpersist()


class Scanner:
    """Finds the leaks of a text: (item, first word of the window, cosine, share of the passage in common)."""

    def __init__(self, indexes: list[Index], cosine: float, share: float, answer_share: float, terms: int):
        for index in indexes:
            _, has, texts, _ = index.passages
            index.plain = [(p, b" " + b" ".join(t) + b" ") for p, t in enumerate(texts) if not has[p] or sum(w in index.terms for w in t) < terms]
            index.holds = np.zeros((len(index.terms), len(texts)), np.uint8)
            for p, t in enumerate(texts):
                index.holds[[index.terms[w] for w in t if w in index.terms], p] = 1
            index.least = index.holds.sum(axis=0) - np.array([(1 - share) * len(t) + 1e-9 for t in texts])
        self.indexes, self.cosine, self.share, self.answer_share, self.terms, self.words = indexes, cosine, share, answer_share, terms, Words()

    def __call__(self, text: bytes) -> list[tuple[int, int, float, float]]:
        raw, found, half = text.translate(LOWER).split(), {}, WINDOW // 2
        for index in self.indexes:
            known, (units, _, texts, answers) = index.known, index.passages
            if len(known) > 500_000:
                known.clear()
            for w in set(raw).difference(known):
                known[w] = index.terms.get(EDGES.sub(b"", w), -1)
            ids = np.fromiter(map(known.__getitem__, raw), np.int64, len(raw))
            hits = np.flatnonzero(ids >= 0)
            if len(hits) >= self.terms:
                # Half windows that have hits, and sums over them; hits of a half are consecutive.
                at, begins, counts = np.unique(hits // half, return_index=True, return_counts=True)
                terms, size = ids[hits], len(raw) // half + 2
                many, vectors = np.zeros(size, np.int64), np.zeros((size, units.shape[1]), np.float32)
                many[at], vectors[at] = counts, np.add.reduceat(index.vectors[terms], begins, axis=0)
                open_ = np.flatnonzero(many[:-1] + many[1:] >= self.terms)
                own = vectors[open_] + vectors[open_ + 1]
                near = own @ units.T / np.maximum(np.linalg.norm(own, axis=1, keepdims=True), 1e-9)
                # A passage misses at most so many words, so at least the rest of its terms are in reach.
                held = np.zeros((size + 1, len(texts)), np.int32)
                held[at + 1] = np.add.reduceat(index.holds[terms].astype(np.int32), begins, axis=0)
                held = np.cumsum(held, axis=0)
                reach = held[np.minimum(open_ + 4, size)] - held[np.maximum(open_ - 2, 0)]
                for k, p in zip(*np.nonzero((near >= self.cosine) & (reach >= index.least))):
                    h = int(open_[k])
                    inside = terms[np.searchsorted(hits, max(0, h - 2) * half) : np.searchsorted(hits, (h + 4) * half)]
                    if index.holds[np.unique(inside), p].sum() < index.least[p]:
                        continue
                    self._verify(index, int(p), raw, h * half, float(near[k, p]), texts, answers, found)
            # Passages without enough terms of their own are sought word for word.
            if index.plain:
                whole = b" " + b" ".join(self.words(text)) + b" "
                for p, joined in index.plain:
                    if joined in whole:
                        found.setdefault(index.items[p], (index.items[p], whole[: whole.index(joined)].count(b" "), 1.0, 1.0))
        return sorted(found.values())

    def _verify(self, index, p, raw, start, cosine, texts, answers, found):
        item, passage = index.items[p], texts[p]
        if item in found and found[item][3] == 1.0:
            return
        region = [x for w in raw[max(0, start - len(passage)) : start + WINDOW + len(passage)] if (x := EDGES.sub(b"", w))]
        share = common_length(passage, region) / len(passage)
        if share >= self.share and common_length(answers[p], region) >= self.answer_share * len(answers[p]) and (item not in found or found[item][3] < share):
            found[item] = (item, start, cosine, share)


def scanner(items: DataFrame, item_id: str = "item_id", text: str = "text", answer: str | None = None, rank: int = 160, common: float = 0.05, cosine: float = 0.35, share: float = 0.7, answer_share: float = 0.6, terms: int = 3) -> Scanner:
    passages = _passages(items, item_id, text, answer)
    return Scanner([_index(items.sparkSession, passages[k : k + BLOCK], rank, common) for k in range(0, len(passages), BLOCK)], cosine, share, answer_share, terms)


def matches(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """A row per document and leaked item: doc_id, item_id, start (word of the window), cosine, share (of the passage's
    words in common order). options: those of scanner(). Terms in more than `common` of the passages have no weight.
    Null and empty texts leak nothing; repeated rows repeat; a benchmark without passages matches nothing."""
    finder = scanner(items, **options)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("binary").alias("text")).where("text is not null")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [(i, *m) for i, t in zip(batch.column(0).to_pylist(), batch.column(1)) for m in finder(t.as_py())]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in got], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()))], names=["doc_id", "item_id", "start", "cosine", "share"])

    return rows.mapInArrow(of, "doc_id long, item_id long, start long, cosine double, share double")


def decontaminate(docs: DataFrame, items: DataFrame, text: str = "text", **options) -> DataFrame:
    """The rows of docs in which no item leaks, with all their columns; texts do not move between executors."""
    finder, at = scanner(items, **options), docs.columns.index(text)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sweep()
        for batch in batches:
            yield batch.filter(pa.array([not (t.is_valid and finder(t.as_py().encode())) for t in batch.column(at)], pa.bool_()))

    return docs.mapInArrow(of, docs.schema)
