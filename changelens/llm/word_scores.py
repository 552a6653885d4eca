"""Scores of documents as sums over their words, for models that score each distinct word once a task."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import bounded_batches, remainder, sweep

#: Distinct words that a task keeps before it starts afresh, and bytes of text that it treats at once.
KEPT_WORDS, AT_ONCE = 300_000, 2 << 20
UPPER = bytes(range(65, 91))
LOWER = bytes.maketrans(UPPER, UPPER.lower())


def training_rows(docs: DataFrame, labels: DataFrame, label: str, doc_id: str, text: str, sample: int, divisor: int = 3, held: int = 1, per_class: bool = False) -> DataFrame:
    """(id, label, text) of at most `sample` labelled rows (of each class, if per_class) that are not held out, those of
    smallest xxhash64(doc_id): the bound of all that is learnt from. Null labels, ids and texts are left out."""
    known = labels.select(F.col(doc_id).alias("id"), F.col(label).cast("int").alias("label")).where(F.col("id").isNotNull() & F.col("label").isin(0, 1) & (remainder(F.col("id"), divisor) != held))
    first = lambda rows: rows.orderBy(F.xxhash64("id"), "id", "label").limit(sample)
    chosen = first(known.where("label = 0")).unionByName(first(known.where("label = 1"))) if per_class else first(known)
    # At most 2 * sample short rows: broadcast, so that texts do not move.
    return docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).where("text is not null").join(F.broadcast(chosen.dropDuplicates(["id"])), "id")


def word_sums(docs: DataFrame, values: Callable[[list[bytes]], np.ndarray], doc_id: Column, text: Column, lower: bool, width: int, keep: dict[str, Column] | None = None) -> DataFrame:
    """doc_id, the kept columns, n_words and sums (array of `width` doubles) of each row: values(words) gives a row a word.
    Words are split at ASCII white space; null texts count as empty. Each distinct word is valued once a task."""
    rows = docs.select(text.alias("_text"), doc_id.alias("doc_id"), *[c.alias(n) for n, c in (keep or {}).items()])
    return _summed(rows, 0, False, values, lower, width)


def whole_sums(docs: DataFrame, values: Callable[[list[bytes]], np.ndarray], text: str, lower: bool, width: int) -> DataFrame:
    """All columns of docs by place (c0, c1, ...), n_words and sums: texts go to Python and back once."""
    rows = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])
    return _summed(rows, docs.columns.index(text), True, values, lower, width)


def _summed(rows: DataFrame, at: int, whole: bool, values: Callable[[list[bytes]], np.ndarray], lower: bool, width: int) -> DataFrame:
    bounded_batches(rows.sparkSession)
    kept = [f for k, f in enumerate(rows.schema.fields) if whole or k != at]
    names = [*[f.name for f in kept], "n_words", "sums"]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sweep()
        known: dict[bytes, int] = {}
        table = np.zeros((0, width))
        for batch in batches:
            counts, sums = [], []
            texts = batch.column(at).cast(pa.binary())
            start = 0
            while start < len(texts):
                lists, size = [], 0
                while start + len(lists) < len(texts) and (not lists or size < AT_ONCE):
                    raw = texts[start + len(lists)].as_py() or b""
                    size += len(raw)
                    lists.append((raw.translate(LOWER) if lower else raw).split())
                start += len(lists)
                if len(known) > KEPT_WORDS:
                    known, table = {}, np.zeros((0, width))
                new = list({w for words in lists for w in words if w not in known})
                if new:
                    known.update(zip(new, range(len(known), len(known) + len(new))))
                    table = np.concatenate((table, values(new)))
                for words in lists:
                    counts.append(len(words))
                    sums.append(table[np.fromiter(map(known.__getitem__, words), np.int64, len(words))].sum(axis=0))
            flat = np.array(sums).reshape(-1)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, width), pa.int32()), pa.array(flat, pa.float64()))
            columns = [c for k, c in enumerate(batch.columns) if whole or k != at]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(counts, pa.int64()), lists], names=names)

    added = StructType.fromDDL("n_words long, sums array<double>")
    return rows.mapInArrow(of, StructType([*kept, *added.fields]))
