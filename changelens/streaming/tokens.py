"""Reassembly of generated text from chunks of token streams.

chunks: request_id, seq, chunk, is_last. Three dialects: `ndjson` (a JSON object a line with `response` and `done`),
`chat` (data: lines with choices[0].delta.content and finish_reason) and `events` (data: lines with a type).
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

LIMIT = 1 << 20
OUTPUT = "request_id string, text string, error string"


class Reader:
    """Feeds on chunks; keeps what is not a whole line, the text, and whether the stream has ended."""

    def __init__(self, dialect: str, buffer: str = "", text: str = "", done: bool = False, error: str | None = None):
        self.dialect, self.buffer, self.text, self.done, self.error = dialect, buffer, text, done, error

    def feed(self, chunk: str, last: bool = False) -> None:
        if self.done or self.error:
            return
        self.buffer += chunk or ""
        if len(self.buffer) > LIMIT:
            self.error = "line too long"
            return
        *lines, self.buffer = self.buffer.split("\n")
        if last:
            lines.append(self.buffer)
            self.buffer = ""
        for line in lines:
            self._line(line.strip())
            if self.done or self.error:
                return

    def _line(self, line: str) -> None:
        if self.dialect != "ndjson":
            if not line.startswith("data: ") or line == "data: [DONE]":
                return
            line = line[6:]
        try:
            got = json.loads(line)
        except ValueError:
            return  # lines that are no JSON are left out
        if not isinstance(got, dict):
            return
        if self.dialect == "ndjson":
            new, self.done = got.get("response"), bool(got.get("done"))
        elif self.dialect == "chat":
            choice = (got.get("choices") or [{}])[0]
            new, self.done = (choice.get("delta") or {}).get("content"), choice.get("finish_reason") is not None
        else:
            new = (got.get("delta") or {}).get("text") if got.get("type") == "content_block_delta" else None
            self.done = got.get("type") == "message_stop"
        self.text += new or ""
        if len(self.text) > LIMIT:
            self.error = "response too long"


def reassemble(chunks: DataFrame, dialect: str = "ndjson") -> DataFrame:
    """A row per request of a batch: request_id, text, error."""

    def one(data: pd.DataFrame) -> pd.DataFrame:
        reader = Reader(dialect)
        for c in data.sort_values("seq").itertuples(index=False):
            reader.feed(c.chunk)
        reader.feed("", True)
        return pd.DataFrame([(data["request_id"].iloc[0], reader.text, reader.error)], columns=["request_id", "text", "error"])

    return chunks.groupBy("request_id").applyInPandas(one, OUTPUT)


def reassemble_stream(chunks: DataFrame, dialect: str = "ndjson", idle_ms: int = 300_000) -> DataFrame:
    """The same over a stream: a row when a request's stream ends, by its own mark, by is_last or after idle time. A
    request's chunks are taken in order of seq within a batch, and batches in turn."""

    def one(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        buffer, text, done, error = state.get if state.exists else ("", "", False, None)
        reader = Reader(dialect, buffer, text, done, error)
        ended = state.hasTimedOut
        if ended:
            reader.feed("", True)
        rows = [] if ended else [c for b in batches for c in b.itertuples(index=False)]
        for c in sorted(rows, key=lambda c: c.seq):
            reader.feed(c.chunk, bool(c.is_last))
            ended = ended or bool(c.is_last)
        if ended or reader.done or reader.error:
            state.remove()
            yield pd.DataFrame([(key[0], reader.text, reader.error)], columns=["request_id", "text", "error"])
        else:
            state.update((reader.buffer, reader.text, reader.done, reader.error))
            state.setTimeoutDuration(idle_ms)

    return chunks.groupBy("request_id").applyInPandasWithState(one, OUTPUT, "buffer string, text string, done boolean, error string", "append", GroupStateTimeout.ProcessingTimeTimeout)


def joined(deltas: DataFrame) -> DataFrame:
    """The text of each request where chunks are plain deltas (request_id, seq, chunk): the batch form without parsing."""
    return deltas.groupBy("request_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "chunk"))), lambda s: s["chunk"]), "").alias("text"))
