"""Mixture-controlled packing: deficit round-robin over source queues fills every window to the mixture."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assayer.llm.coding import coder
from assayer.llm.common import columns, offer_broadcast, settle, slices

WINDOW = 2048
END_ID = 1
# Entries of boundary vectors a task remembers.
REMEMBERED_ENTRIES = 2_000_000

_TOKENS = pa.schema([("doc_id", pa.int64()), ("source", pa.string()), ("task", pa.int32()), ("before", pa.int64()), ("n", pa.int64()), ("ids", pa.binary())])
_TOKENS_DDL = "doc_id long, source string, task int, before long, n long, ids binary"
_PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])
_PIECES_DDL = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _tokenize(*vocabulary: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, task = coder(*vocabulary), TaskContext.get().partitionId()
        end = np.array([END_ID], dtype=code.dtype).tobytes()
        before: dict[str, int] = {}
        for batch in batches:
            out = []
            for doc_id, source, text in zip(*columns(batch, "doc_id", "source", "text")):
                ids = code.encode(text) + end
                n = len(ids) // code.dtype.itemsize
                out.append((doc_id, source, task, before.get(source, 0), n, ids))
                before[source] = before.get(source, 0) + n
            yield from slices(out, _TOKENS, 512)

    return run


class Mixture:
    """How many tokens of each queue the first w windows hold.

    Every round of the round-robin gives a queue its share of a window as quantum; the deficit it carries on is the
    whole-number remainder w * quantum - served. Serving always the queue that is furthest behind makes ``served`` the
    apportionment by odd divisors, which only grows with w and has a closed form: so any partition can start at any
    window with the right deficits, without running through the windows before it.
    """

    def __init__(self, sizes: list[int], window: int):
        self.sizes, self.window, self.total = sizes, window, sum(sizes)
        self.small = self.total < 1 << 30
        self.array = np.array(sizes, dtype=np.int64)
        self.seen: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def served(self, w: int) -> np.ndarray:
        seats = min(w * self.window, self.total)
        if self.small:
            c = (2 * self.array * seats + self.total) // (2 * self.total)
        else:
            c = np.array([(2 * n * seats + self.total) // (2 * self.total) for n in self.sizes], dtype=np.int64)
        left = seats - int(c.sum())
        while left > 0:
            c[int(np.argmin((2 * c + 1) / self.array))] += 1
            left -= 1
        while left < 0:
            behind = (2 * c - 1) / self.array
            c[len(c) - 1 - int(np.argmax(behind[::-1]))] -= 1
            left += 1
        return c

    def window_of(self, w: int) -> tuple[np.ndarray, np.ndarray]:
        """(tokens of each queue before window w, place of each queue inside it)."""
        if w not in self.seen:
            if len(self.seen) * len(self.sizes) > REMEMBERED_ENTRIES:
                self.seen.clear()
            here, after = self.served(w), self.served(w + 1)
            width = after - here
            self.seen[w] = (here, np.cumsum(width) - width)
        return self.seen[w]

    def pieces(self, queue: int, at: int, n: int) -> Iterator[tuple[int, int, int, int]]:
        """(start, length, window, offset) of the pieces of n tokens that begin at place ``at`` of a queue."""
        w = int(at * self.total // self.sizes[queue] // self.window)
        while self.window_of(w)[0][queue] > at:
            w -= 1
        done = 0
        while done < n:
            until = int(self.window_of(w + 1)[0][queue])
            take = min(at + n, until) - at - done
            if take > 0:
                here, place = self.window_of(w)
                yield done, take, w, int(place[queue] + at + done - here[queue])
                done += take
            w += 1


def _cut(names: list[str], sizes: list[int], window: int, dtype: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mixture, queue = Mixture(sizes, window), {name: k for k, name in enumerate(names)}
        for batch in batches:
            out = []
            for doc_id, source, offset, before, n, ids in zip(*columns(batch, "doc_id", "source", "ahead", "before", "n", "ids")):
                body = memoryview(np.frombuffer(ids, dtype=dtype).astype("<u4").tobytes())
                for start, length, w, place in mixture.pieces(queue[source], offset + before, n):
                    out.append((doc_id, start, length, zlib.crc32(body[4 * start : 4 * (start + length)]), n, w, place))
            yield from slices(out, _PIECES)

    return run


def pack(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, ranks_path: str | None = None, pattern: str | None = None) -> DataFrame:
    """All tokens of ``docs`` in windows of ``window`` tokens that each hold every source in its share of all tokens.

    A document's ids are those of its text (null: empty) and END_ID. Sources are queues in the order scanned; a null
    source is a queue of its own name. Every window is full but the last. Each source may deviate from its share by
    about a token per window, carried on as deficit; documents are cut where a window is full. Texts are encoded
    whole; repeated rows are packed each; an empty table gives an empty result; other columns are ignored. The driver
    holds one number per source.
    Result, a row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.
    """
    vocabulary = (tokenizer_path, ranks_path, pattern)
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("source", F.lit("")).cast("string").alias("source"), F.coalesce("text", F.lit("")).alias("text"))
    tokens = settle(read.mapInArrow(_tokenize(*vocabulary), _TOKENS_DDL))
    runs = tokens.groupBy("source", "task").agg(F.max(F.col("before") + F.col("n")).alias("total"))
    earlier = Window.partitionBy("source").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    ahead = settle(runs.withColumn("ahead", F.coalesce(F.sum("total").over(earlier), F.lit(0))))
    sizes = {r["source"]: r["n"] for r in ahead.groupBy("source").agg(F.sum("total").alias("n")).collect()}
    names = sorted(sizes)
    placed = tokens.join(offer_broadcast(ahead.select("source", "task", "ahead"), 64), ["source", "task"])
    return placed.mapInArrow(_cut(names, [sizes[n] for n in names], window, coder(*vocabulary).dtype.str), _PIECES_DDL)
