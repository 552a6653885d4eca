"""Documents dealt over blocks of bounded size, for operators that join texts with tables of words or n-grams.

A block names each of its distinct words (or n-grams) in one row, the rows meet the table, and the answers come back to
the block: a frequent word costs a row a block, not a row an occurrence. Rows follow the input: no count of buckets
grows with it. Texts travel compressed, one row a document.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from .common import bounded_batches, sweep

#: Blocks at least, so that small inputs use all cores.
LEAST = 12


def text_bytes(docs: DataFrame, text: str) -> int:
    return docs.agg(F.sum(F.octet_length(F.col(text)).cast("long"))).first()[0] or 0


def dealt(docs: DataFrame, columns: dict[str, str], text: str, size: int, block_bytes: int, least: int = LEAST) -> DataFrame:
    """(block int, the columns, z binary): each row's block and its compressed text; null texts count as empty. columns: SQL
    of what is kept of each row; size: bytes of all texts. Repeated rows are spread as well: the place of a row in its partition is hashed too."""
    bounded_batches(docs.sparkSession)
    count = max(least, -(-size // block_bytes))
    place = F.xxhash64(*[F.expr(sql) for sql in columns.values()], F.monotonically_increasing_id())
    kept = [F.expr(sql).alias(name) for name, sql in columns.items()]
    rows = docs.select(F.pmod(place, F.lit(count)).cast("int").alias("block"), *kept, F.coalesce(F.col(text), F.lit("")).cast("binary").alias("z"))

    def shrink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sweep()
        tool = zstandard.ZstdCompressor(level=5)
        for batch in batches:
            small = pa.array([tool.compress(x.as_py()) for x in batch.column(batch.num_columns - 1)], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], small], names=batch.schema.names)

    return rows.mapInArrow(shrink, StructType([*rows.schema.fields[:-1], StructField("z", BinaryType())]))


def chunks(block: pa.Table, size: int) -> Iterator[tuple[pa.Table, list[bytes]]]:
    """Some rows of a block and their texts, about `size` bytes at once."""
    tool, start, texts, total = zstandard.ZstdDecompressor(), 0, [], 0
    for small in block["z"]:
        texts.append(tool.decompress(small.as_py()))
        total += len(texts[-1])
        if total >= size:
            yield block.slice(start, len(texts)), texts
            start, texts, total = start + len(texts), [], 0
    if texts:
        yield block.slice(start, len(texts)), texts
