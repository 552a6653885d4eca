"""Byte-pair encoding and decoding with a public tokenizer file.

Texts are split into words (white space and what follows it, cut before a full stop or comma that follows a letter; the
tokenizer's own pieces never reach across such cuts). Each block of documents names its distinct words, each distinct
word of all blocks is encoded once, and the ids are joined back by the word's place in its block. The most frequent words,
a bounded number, are encoded first and need no join. Decoding joins ids with the id-to-piece table, whose size the
vocabulary bounds.
"""

from __future__ import annotations

import json
import os
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .blocks import chunks, dealt, text_bytes
from .common import bounded_batches, sweep

#: Unicode's White_Space (fixed values).
SPACES = "\\t\\n\\x0b\\x0c\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Letters and digits after which a word is cut before a full stop or comma: those of Latin-1 and Latin Extended-A.
LETTERS = "0-9A-Za-z\\xc0-\\xd6\\xd8-\\xf6\\xf8-\\u017f"
WORD = re.compile(f"[{SPACES}]*[^{SPACES}]+|[{SPACES}]+")
CUT = re.compile(f"[{SPACES}]*[^{SPACES}.,]+(?:(?<=[{LETTERS}])(?=[.,])|[^{SPACES}]*)|[{SPACES}]*[^{SPACES}]+|[{SPACES}]+")
BLOCK_BYTES, AT_ONCE = 28 << 20, 512 << 10
#: Words whose ids all blocks have at hand, at most: those most frequent in a sample of SAMPLE_BYTES of text. Ids do not
#: depend on them, only how many rows move.
FREQUENT, SAMPLE_BYTES = 400_000, 64 << 20
#: Words that are encoded at once: the library's answers take many times the ids' memory.
ENCODED = 1024


def default_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def words_of(model: str) -> re.Pattern:
    """How a tokenizer's texts are split: at punctuation only where its own pieces end there too (byte-level pieces of
    letters, digits, or other signs) and no token that is matched whole would be cut."""
    told = json.loads(model)
    split = told.get("pre_tokenizer") or {}
    whole = all(CUT.findall(x["content"]) == [x["content"]] for x in told.get("added_tokens") or [])
    return CUT if split.get("type") == "ByteLevel" and split.get("use_regex") and not told.get("normalizer") and whole else WORD


@lru_cache(maxsize=2)
def _tool(model: str):
    """The tokenizer of a file's content, read once per Python worker."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    tool = Tokenizer.from_str(model)
    tool.no_truncation()
    tool.no_padding()
    return tool


def _distinct(block: pa.Table, word: re.Pattern, frequent: pa.Array) -> tuple[dict[str, int], list[str]]:
    """The places of the block's distinct words among the frequent ones, and its other words in order. The block's words are
    hashed for that, which a block bounds, and not the frequent ones: as Python's objects these took 80 MB of each worker."""
    found: set[str] = set()
    for _, texts in chunks(block, AT_ONCE):
        for text in texts:
            found.update(word.findall(text.decode()))
    words = list(found)
    at = pc.index_in(frequent, value_set=pa.array(words, pa.large_string()))
    known = {words[k]: place for k, place in zip(at.drop_null().to_pylist(), np.flatnonzero(at.is_valid()).tolist())}
    return known, sorted(found.difference(known))


def _frequent(docs: DataFrame, word: re.Pattern, doc_id: str, text: str, size: int) -> pa.Array:
    """The words that a sample of the texts has more than once, FREQUENT at most."""
    share = min(1.0, SAMPLE_BYTES / max(1, size))
    some = docs.where(F.pmod(F.xxhash64(F.col(doc_id)), F.lit(1 << 30)) < int(share * (1 << 30)) + 1).select(F.col(text)).where(F.col(text).isNotNull())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sweep()
        for batch in batches:
            counts: Counter = Counter()
            for x in batch.column(0).to_pylist():
                counts.update(word.findall(x))
            yield pa.RecordBatch.from_arrays([pa.array(counts, pa.string()), pa.array(counts.values(), pa.int64())], names=["word", "n"])

    counted = some.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where("n > 1")
    return counted.orderBy(F.desc("n"), "word").limit(FREQUENT).select("word").toArrow()["word"].cast(pa.large_string()).combine_chunks()


def _ids(tool, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """How many ids each word has, and all ids in order."""
    sizes, flat = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
    for k in range(0, len(words), ENCODED):
        part = [e.ids for e in tool.encode_batch_fast(words[k : k + ENCODED].to_pylist(), add_special_tokens=False)]
        sizes.append(np.fromiter(map(len, part), np.int64, len(part)))
        flat.append(np.fromiter(chain.from_iterable(part), np.int32))
    return np.concatenate(sizes), np.concatenate(flat)


def _encoded(batches: Iterator[pa.RecordBatch], model: str) -> Iterator[pa.RecordBatch]:
    """(block, place, ids) of (block, place, word) in the order of the words: each distinct word is encoded once."""
    sweep()
    tool, last, ids = _tool(model), None, []
    for batch in batches:
        words = batch.column(2).to_pylist()
        new = [w for before, w in zip([last, *words], words) if w != before]
        told = chain.from_iterable(tool.encode_batch_fast(new[k : k + ENCODED], add_special_tokens=False) for k in range(0, len(new), ENCODED))
        sizes, flat = np.zeros(len(words) + 1, np.int32), []
        for k, w in enumerate(words):
            if w != last:
                last, ids = w, next(told).ids
            flat += ids
            sizes[k + 1] = len(flat)
        lists = pa.ListArray.from_arrays(pa.array(sizes), pa.array(flat, pa.int32()))
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], lists], names=["block", "place", "ids"])


def _gathered(starts: np.ndarray, flat: np.ndarray, places: list[np.ndarray]) -> pa.ListArray:
    """For each row, the lists at its places in one list; starts: where each list begins in flat."""
    every = np.concatenate(places) if places else np.zeros(0, np.int64)
    n = np.diff(starts)[every]
    ends = np.concatenate(([0], np.cumsum(n)))
    ids = flat[np.repeat(starts[:-1][every] - ends[:-1], n) + np.arange(ends[-1])]
    rows = np.concatenate(([0], np.cumsum([len(p) for p in places], dtype=np.int64)))
    return pa.ListArray.from_arrays(pa.array(ends[rows], pa.int32()), pa.array(ids, pa.int32()))


def _round(docs: DataFrame, tokenizer: str | None, doc_id: str, text: str, block_bytes: int, back: bool) -> DataFrame:
    with open(tokenizer or default_file(), encoding="utf-8") as f:
        model = f.read()
    word, size = words_of(model), text_bytes(docs, text)
    blocks = dealt(docs, {"doc_id": f"`{doc_id}`"}, text, size, block_bytes)
    frequent = _frequent(docs, word, doc_id, text, size)
    sizes, flat = _ids(_tool(model), frequent)
    told = docs.sparkSession.sparkContext.broadcast((model, frequent, sizes, flat, pieces(tokenizer) if back else []))

    def ask(block: pa.Table) -> pa.Table:
        sweep()
        _, words = _distinct(block, word, told.value[1])
        return pa.table({"block": pa.array([block["block"][0].as_py()] * len(words), pa.int32()), "place": pa.array(np.arange(len(words), dtype=np.int32)), "word": pa.array(words, pa.string())})

    def finish(block: pa.Table, got: pa.Table) -> pa.Table:
        sweep()
        _, frequent, sizes, flat, table = told.value
        lists = got.sort_by("place")["ids"].combine_chunks()
        places, own = _distinct(block, word, frequent)
        places.update(zip(own, range(len(frequent), len(frequent) + len(own))))
        if own:
            sizes, flat = np.concatenate((sizes, lists.value_lengths().to_numpy())), np.concatenate((flat, lists.flatten().to_numpy()))
        starts = np.concatenate(([0], np.cumsum(sizes)))
        out, table = [], Pieces(table) if back else None
        for rows, texts in chunks(block, AT_ONCE):
            found = [word.findall(t.decode()) for t in texts]
            ids = _gathered(starts, flat, [np.fromiter(map(places.__getitem__, ws), np.int64, len(ws)) for ws in found])
            out.append(pa.table({"doc_id": rows["doc_id"], "ids": ids} | ({"decoded": table(ids)} if back else {})))
        return pa.concat_tables(out)

    asked = blocks.groupBy("block").applyInArrow(ask, "block int, place int, word string")
    answers = asked.repartition("word").sortWithinPartitions("word").mapInArrow(lambda batches: _encoded(batches, told.value[0]), "block int, place int, ids array<int>")
    kind = docs.select(doc_id).schema[0].dataType.simpleString()
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(finish, f"doc_id {kind}, ids array<int>" + ", decoded string" * back)


def encode(docs: DataFrame, tokenizer: str | None = None, doc_id: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """A row per row of docs: doc_id, ids array<int>, as the tokenizers library encodes without added special tokens (the
    text of a special token counts as that token). Null counts as empty and gives an empty array; repeated rows and null
    ids stay rows of their own; other columns are not read. tokenizer: a file that the driver can read; its content (a
    few MB) is sent to the executors."""
    return _round(docs, tokenizer, doc_id, text, block_bytes, False)


def round_trip(docs: DataFrame, tokenizer: str | None = None, doc_id: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """encode() and decode() in one: doc_id, ids, decoded. Decoding what a block has encoded there saves a second Python
    worker for each core."""
    return _round(docs, tokenizer, doc_id, text, block_bytes, True)


def pieces(tokenizer: str | None = None) -> list[bytes | None]:
    """The id-to-piece table: the bytes of each id; None where the vocabulary has no such id."""
    from tokenizers import Tokenizer

    tool = Tokenizer.from_file(tokenizer or default_file())
    # The printable stand-ins of byte-level vocabularies: printable Latin-1 signs are themselves, others follow from 256.
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    signs = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}
    out: list[bytes | None] = [None] * (max(tool.get_vocab().values()) + 1)
    for piece, i in tool.get_vocab().items():
        out[i] = bytes(signs[c] for c in piece) if all(c in signs for c in piece) else piece.encode()
    return out


class Pieces:
    """The join of lists of ids with the id-to-piece table."""

    def __init__(self, table: list[bytes | None]):
        # The last piece is empty: that of ids without one.
        self.size = np.array([*[len(p or b"") for p in table], 0], np.int64)
        self.own = pa.array([*[p or b"" for p in table], b""], pa.large_binary())

    def __call__(self, lists: pa.ListArray) -> pa.Array:
        whole, ends, nulls = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_pylist(), lists.is_null().to_pylist()
        texts = []
        for a, b, null in zip(ends, ends[1:], nulls):
            flat = np.nan_to_num(whole[a:b], nan=-1).astype(np.int64)
            flat[(flat < 0) | (flat >= len(self.size))] = len(self.size) - 1
            joined = self.own.take(pa.array(flat)).buffers()[2] if not null and self.size[flat].any() else None
            texts.append(None if null else str(joined, "utf-8", "replace") if joined else "")
        return pa.array(texts, pa.string())


def decode(encoded: DataFrame, tokenizer: str | None = None, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """encoded with a text column `into` (in place of one of that name): the pieces of the ids, joined; broken UTF-8
    becomes U+FFFD, ids that are null or without a piece are left out, null lists give null."""
    bounded_batches(encoded.sparkSession)
    table = encoded.sparkSession.sparkContext.broadcast(pieces(tokenizer))
    kept = [c for c in encoded.columns if c != into]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        joined, at = Pieces(table.value), kept.index(ids)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, joined(batch.column(at))], names=[*kept, into])

    rows = encoded.select(*kept)
    return rows.mapInArrow(of, StructType([*rows.schema.fields, StructField(into, StringType())]))
