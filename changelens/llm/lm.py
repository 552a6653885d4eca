"""Language-model scores by a probabilistic suffix tree over the bytes of texts.

A text is the sequence of its words with a space between them and an end symbol after them. The tree's contexts are the
last symbols, up to DEPTH, across the borders of words; before a text's first symbol stand start symbols. A context stays
when what follows it diverges from what follows its suffix by more than chance allows; the next symbol's probability is
smoothed towards the suffix, down to the uniform one, and the longest kept suffix gives it. Probabilities sum to one
over the symbols, so a text's score is the log probability of that very text.

Everything is counted over all training documents. Each block of documents names its distinct words and n-grams once,
with their counts; counts and tree are made by joins and windows, and the answers go back to the blocks: neither
vocabulary nor tree is ever in one place.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blocks import chunks, dealt, text_bytes
from .common import saved

DEPTH = 5  # context symbols
SYMBOLS = 256
START, END = 0xFE, 0xFF  # bytes that no UTF-8 text has
UPPER = bytes(range(65, 91))
LOWER = bytes.maketrans(UPPER, UPPER.lower())
#: Bytes of a block's text; of texts whose words are looked up at once; symbols whose n-grams are made at once; rows that
#: go back to Spark at once. Blocks come and go in batches, so that neither side holds a block's rows in one Arrow buffer.
BLOCK_BYTES, AT_ONCE, SLICE, ROWS = 16 << 20, 2 << 20, 1 << 19, 1 << 16


def words_of(texts: list[bytes]) -> tuple[pa.Array, np.ndarray, pa.Array]:
    """The words of all texts in one array, how many each text has, and each text's words with a space between them."""
    ends = np.cumsum([0, *map(len, texts)], dtype=np.int64)
    whole = pa.Array.from_buffers(pa.string(), len(texts), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(b"".join(texts).translate(LOWER))])
    lists = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(whole))
    words, lengths = lists.flatten(), lists.value_lengths().to_numpy()
    some = pc.binary_length(words).to_numpy() > 0  # a text without words has one empty word
    owner = np.repeat(np.arange(len(texts)), lengths)
    joined = pc.binary_join(lists, " ").cast(pa.binary())
    return words.filter(pa.array(some)).cast(pa.binary()), np.bincount(owner[some], minlength=len(texts)), joined


def grams(joined: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For some texts at once: the first one's place, the n-gram that ends at each symbol (last symbol lowest) and where
    each text's begin."""
    ends = np.cumsum(pc.binary_length(joined).to_numpy() + 1)
    start = 0
    while start < len(joined):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + SLICE, "right")))
        flat = np.frombuffer(b"".join(x + bytes([END]) for x in joined[start:stop].to_pylist()), np.uint8).astype(np.int64)
        begins = np.concatenate(([0], ends[start : stop - 1] - before)).astype(np.int64)
        place = np.arange(len(flat)) - np.repeat(begins, np.diff(np.append(begins, len(flat))))
        out = flat.copy()
        for k in range(1, DEPTH + 1):
            shifted = np.full_like(flat, START)
            shifted[k:] = flat[:-k]
            shifted[place < k] = START
            out |= shifted << (8 * k)
        yield start, out, begins
        start = stop


class Counts:
    """Sums by number, merged when many have gathered."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, keys: np.ndarray, weight: int) -> None:
        distinct, n = np.unique(keys, return_counts=True)
        self.parts.append((distinct, n * weight))
        self.held += len(distinct)
        if self.held > 300_000:
            self.parts = [self.total()]
            self.held = 0  # what stays is merged again only after as many more

    def total(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        keys, place = np.unique(np.concatenate([k for k, _ in self.parts]), return_inverse=True)
        return keys, np.bincount(place, np.concatenate([n for _, n in self.parts]), len(keys)).astype(np.int64)


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, gram, word, n): the distinct n-grams and words of a block and how often training rows have them."""
    counts, tables, block = Counts(), [], None
    for batch in batches:
        block = batch["block"][0].as_py()
        for rows, texts in chunks(pa.Table.from_batches([batch]), AT_ONCE):
            held = rows["held_out"].to_numpy()
            words, lengths, joined = words_of(texts)
            weights = np.repeat((~held).astype(np.int64), lengths)
            tables.append(pa.table({"word": words, "n": weights}).group_by("word", use_threads=False).aggregate([("n", "sum")]))
            for start, keys, begins in grams(joined):
                sizes = np.diff(np.append(begins, len(keys)))
                out = np.repeat(held[start : start + len(begins)], sizes)
                counts.add(keys[~out], 1)
                counts.add(keys[out], 0)
    keys, n = counts.total()
    for k in range(0, len(keys), ROWS):
        part = pa.array(keys[k : k + ROWS])
        yield _asking(block, part, pa.nulls(len(part), pa.binary()), pa.array(n[k : k + ROWS]))
    del counts, keys, n
    words = pa.concat_tables(tables).group_by("word", use_threads=False).aggregate([("n_sum", "sum")]).sort_by("word")
    for part in words.to_batches(max_chunksize=ROWS):
        yield _asking(block, pa.nulls(len(part), pa.int64()), part["word"], part["n_sum_sum"])


def _asking(block: int, gram: pa.Array, word: pa.Array, n: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(n), block, np.int32)), gram, word, n], names=["block", "gram", "word", "n"])


class Places:
    """Where distinct numbers stand in their array, by open addressing: a few reads a number, not a binary search over all."""

    def __init__(self, keys: np.ndarray):
        bits = max(4, int(2 * len(keys)).bit_length())
        self.keys, self.shift, self.mask = keys, np.uint64(64 - bits), (1 << bits) - 1
        self.slots = np.full(1 << bits, -1, np.int32)
        rest, at = np.arange(len(keys), dtype=np.int32), self._slot(keys)
        while len(rest):
            free = self.slots[at] < 0
            self.slots[at[free]] = rest[free]
            lost = self.slots[at] != rest
            rest, at = rest[lost], (at[lost] + 1) & self.mask

    def _slot(self, wanted: np.ndarray) -> np.ndarray:
        return ((wanted.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def __call__(self, wanted: np.ndarray) -> np.ndarray:
        """The places of numbers that are all among the keys."""
        at = self._slot(wanted)
        out = self.slots[at]
        if (out < 0).any():
            raise KeyError("a number that is not among the keys")
        miss = np.flatnonzero(self.keys[out] != wanted)
        at = at[miss]
        while len(miss):
            at = (at + 1) & self.mask
            got = self.slots[at]
            if (got < 0).any():
                raise KeyError("a number that is not among the keys")
            out[miss] = got
            left = self.keys[got] != wanted[miss]
            miss, at = miss[left], at[left]
        return out


def tree(counts: DataFrame, smoothing: float = 2.0, least: int = 2, divergence: float = 1.0) -> DataFrame:
    """counts: gram, n (0 where only seen in held-out texts), with all symbols up to the depth. (gram, logp): log10 of the
    probability of the last symbol by the longest kept suffix. A context is kept when it was seen `least` times and
    sum over next symbols of n * ln(p / p by its suffix) exceeds `divergence` times its number of next symbols."""
    tables = [counts.select("gram", "n")]
    for k in range(DEPTH - 1, -1, -1):
        mask = (1 << 8 * (k + 1)) - 1
        shorter = tables[0].select(F.col("gram").bitwiseAND(F.lit(mask)).alias("gram"), "n").groupBy("gram").agg(F.sum("n").alias("n"))
        tables.insert(0, saved(shorter))
    lower = None
    for k, own in enumerate(tables):
        context = Window.partitionBy("context")  # at most SYMBOLS rows each
        rows = own.withColumn("context", F.shiftright("gram", 8))
        if lower is None:
            rows = rows.withColumn("q", F.lit(1 / SYMBOLS))
        else:
            below = lower.select(F.col("gram").alias("suffix"), F.col("p").alias("q"))
            rows = rows.withColumn("suffix", F.col("gram").bitwiseAND(F.lit((1 << 8 * k) - 1))).join(below, "suffix").drop("suffix")
        rows = rows.withColumn("total", F.sum("n").over(context)).withColumn("kinds", F.sum((F.col("n") > 0).cast("long")).over(context))
        smooth = smoothing * F.greatest(F.col("kinds"), F.lit(1))
        rows = rows.withColumn("r", (F.col("n") + smooth * F.col("q")) / (F.col("total") + smooth))
        rows = rows.withColumn("gain", F.sum(F.col("n") * F.log(F.col("r") / F.col("q"))).over(context))
        keep = (F.col("total") >= least) & (F.col("gain") > divergence * F.col("kinds"))
        rows = rows.select("gram", F.when(keep, F.col("r")).otherwise(F.col("q")).alias("p"))
        lower = saved(rows)
    return lower.select("gram", F.log10("p").alias("logp"))


def _answers(batches: Iterator[pa.RecordBatch]) -> tuple[pa.Table, np.ndarray, np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """What a block has got, in any order: its documents (doc_id, held_out, z); n-grams and their logarithms; words, their
    counts and whether this block is the first with them. Each row is one of three: with data alone a document, with
    data and value a word, with value alone an n-gram."""
    docs, keys, logs, words, counts, first = [], [], [], [], [], []
    for batch in batches:
        data, value = batch["data"].is_valid(), batch["value"].is_valid()
        own = batch.filter(pc.and_not(data, value))
        docs.append(pa.table({"doc_id": own["doc_id"], "held_out": pc.not_equal(own["key"], 0), "z": own["data"]}))
        own = batch.filter(pc.and_not(value, data))
        keys.append(own["key"].to_numpy())
        logs.append(own["value"].to_numpy())
        own = batch.filter(pc.and_(data, value))
        words.append(own["data"])
        counts.append(own["value"].to_numpy().astype(np.int64))
        first.append(own["key"].to_numpy() > 0)
    return pa.concat_tables(docs), np.concatenate(keys), np.concatenate(logs), pa.concat_arrays(words), np.concatenate(counts), np.concatenate(first)


def _scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of each text of a block by the answers; and a last row with the block's share of the training words."""
    block, keys, logs, known, c, first = _answers(batches)
    at = Places(keys)
    out: dict[str, list] = {"doc_id": [], "held_out": [], "n_words": [], "n_known": [], "logs": [], "score": []}
    sums = lambda values, owner, size: np.bincount(owner, values, size)
    for rows, texts in chunks(block, AT_ONCE):
        ws, lengths, joined = words_of(texts)
        own = c[pc.index_in(ws, known).to_numpy()] if len(ws) else np.zeros(0, np.int64)
        owner = np.repeat(np.arange(len(texts)), lengths)
        out["doc_id"] += rows["doc_id"].to_pylist()
        out["held_out"] += rows["held_out"].to_pylist()
        out["n_words"] += lengths.tolist()
        out["n_known"] += sums(own > 0, owner, len(texts)).astype(np.int64).tolist()
        out["logs"] += sums(np.log10(own + 1.0), owner, len(texts)).tolist()
        for _, places, begins in grams(joined):
            out["score"] += np.add.reduceat(logs[at(places)], begins).tolist()
    # Numbers, so that no id is lost in the last row: (training words, distinct ones) of this block's first sightings.
    held = np.array(out["held_out"])
    last = {"doc_id": None, "held_out": None, "n_words": int(c[first].sum()), "n_known": int((c[first] > 0).sum()), "logs": float(len(held) - held.sum()), "score": None}
    kinds = {"doc_id": block.schema.field("doc_id").type, "held_out": pa.bool_(), "n_words": pa.int64(), "n_known": pa.int64(), "logs": pa.float64(), "score": pa.float64()}
    yield pa.RecordBatch.from_arrays([pa.array([*out[name], last[name]], kind) for name, kind in kinds.items()], names=list(kinds))


def scores(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", divisor: int = 7, held: int = 2, block_bytes: int = BLOCK_BYTES, **options) -> DataFrame:
    """A row per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    A to Z in lower case; tokens are the words between white space and one end. Trained on the rows whose crc32(doc_id as
    text) mod divisor is not held. base_score: sum of log10((c + 1) / (N + V + 1)); score: log10 probability by the suffix
    tree. Null texts count as empty (the end alone); null ids have the remainder of the empty text, 0. Repeated rows
    count each time; other columns are not read. Without training rows N and V are 0 and the tree is uniform.
    """
    id_sql = f"`{doc_id}`"
    blocks = dealt(docs, {"doc_id": id_sql, "held_out": f"crc32(cast(coalesce(cast({id_sql} as string), '') as binary)) % {divisor} = {held}"}, text, text_bytes(docs, text), block_bytes)
    asked = saved(blocks.groupBy("block").applyInArrow(_asked, "block int, gram long, word binary, n long"))
    asked_grams = asked.where("gram is not null").select("block", "gram", "n")
    model = tree(asked_grams.groupBy("gram").agg(F.sum("n").alias("n")), **options)

    same = Window.partitionBy("word")
    words = asked.where("word is not null").select("block", "word", F.sum("n").over(same).alias("c"), (F.row_number().over(same.orderBy("block")) == 1).alias("first"))
    kind = docs.select(doc_id).schema[0].dataType.simpleString()
    # Documents and answers in one exchange, with the columns that _answers() names.
    none = f"cast(null as {kind}) as doc_id"
    texts = blocks.selectExpr("block", "doc_id", "cast(held_out as long) as key", "cast(null as double) as value", "z as data")
    told = asked_grams.join(model, "gram").selectExpr("block", none, "gram as key", "logp as value", "cast(null as binary) as data")
    counted = words.selectExpr("block", none, "cast(first as long) as key", "cast(c as double) as value", "word as data")
    answered = texts.unionByName(told).unionByName(counted).groupBy("block")
    sums = saved(answered.applyInArrow(_scored, f"doc_id {kind}, held_out boolean, n_words long, n_known long, logs double, score double"))

    seen = sums.where("held_out is null").agg(F.sum("n_words"), F.sum("n_known"), F.sum("logs")).first()
    texts = int(seen[2] or 0)
    total, kinds = (seen[0] or 0) + texts, (seen[1] or 0) + (1 if texts else 0)
    tokens = F.col("n_words") + 1
    base = F.col("logs") + F.log10(F.lit(texts + 1.0)) - tokens * F.log10(F.lit(total + kinds + 1.0))
    rows = sums.where("held_out is not null")
    return rows.select("doc_id", "held_out", tokens.alias("n_tokens"), (F.col("n_known") + (1 if texts else 0)).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), base.alias("base_score"), "score")
