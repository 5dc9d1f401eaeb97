"""Hashed words, sentences and byte statistics of texts, and bounded samples of labelled rows."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.llm.common import binary

# Labelled rows a classifier is fitted on at most: those with the smallest hash of doc_id. All rows are scored.
TRAIN_ROWS = 6000
REMEMBERED = 300_000

# Bytes that are no part of a word become blanks, A-Z become lower case; ends of sentences stay apart as line feeds.
_WORDS = [c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)]
TO_WORDS = bytes(_WORDS)
TO_SENTENCES = bytes(10 if c in b".!?\n" else _WORDS[c] for c in range(256))

# Classes of bytes for the statistics: lower, upper, digit, blank, line feed, end of sentence, other ASCII, non-ASCII lead, continuation.
_CLASSES = np.array([0 if 97 <= c <= 122 else 1 if 65 <= c <= 90 else 2 if 48 <= c <= 57 else 4 if c == 10 else 3 if c in b" \t\r\x0b\x0c" else 5 if c in b".!?" else 6 if c < 128 else 8 if c < 192 else 7 for c in range(256)], dtype=np.uint8)


class Hashes(dict):
    """Feature number of a word, remembered for as long as there is room."""

    def __init__(self, size: int):
        super().__init__()
        self.size = size

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = at = zlib.crc32(word) % self.size
        return at


def sentences(raws: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """(words, first word of each sentence, first sentence of each text); sentences without words are left out.

    A text without words has one empty sentence of the word b"".
    """
    words: list[bytes] = []
    starts: list[int] = []
    texts = np.empty(len(raws), dtype=np.int64)
    for k, raw in enumerate(raws):
        texts[k] = len(starts)
        for part in raw.translate(TO_SENTENCES).split(b"\n"):
            found = part.split()
            if found:
                starts.append(len(words))
                words += found
        if texts[k] == len(starts):
            starts.append(len(words))
            words.append(b"")
    return words, np.array(starts, dtype=np.int64), texts


def counted(owner: np.ndarray, feature: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (owner, feature) pairs in order, and how often each occurs."""
    keys, n = np.unique(owner * size + feature, return_counts=True)
    return keys // size, keys % size, n


def statistics(raw: bytes) -> np.ndarray:
    """Shares of the byte classes, and measures of how words and lines repeat."""
    n = np.bincount(_CLASSES[np.frombuffer(raw, dtype=np.uint8)], minlength=9).astype(float)
    total = max(1.0, n.sum() - n[8])
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x]
    letters = max(1.0, n[0] + n[1] + n[7])
    return np.array([
        n[1] / letters, n[2] / total, n[3] / total, n[4] / total, n[5] / total, n[6] / total, n[7] / letters,
        min(1.0, np.log1p(total) / 12), min(2.0, total / max(1, len(words)) / 10),
        len(set(words)) / max(1, len(words)), len(set(lines)) / max(1, len(lines)), min(2.0, len(words) / max(1.0, n[5]) / 40),
    ])


N_STATISTICS = 12


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2


def training_rows(docs: DataFrame, labels: DataFrame, label: str, rows: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, y, raw, n_chars): at most ``rows`` labelled documents that are not held out, in one partition.

    A document with several labels takes the largest; of rows that share an id the smallest text stands for them.
    """
    usable = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    drawn = usable.groupBy("doc_id").agg(F.max(label).cast("int").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    extra = F.col("n_chars").cast("double") if "n_chars" in docs.columns else F.char_length("text").cast("double")
    read = docs.select("doc_id", binary("text").alias("raw"), F.coalesce(extra, F.lit(0.0)).alias("n_chars"))
    # At most ``rows`` ids, so the broadcast is bounded.
    found = read.join(F.broadcast(drawn), "doc_id").groupBy("doc_id").agg(F.min(F.struct("raw", "n_chars", "y")).alias("x"))
    return found.select("doc_id", "x.y", "x.raw", "x.n_chars").coalesce(1).sortWithinPartitions("doc_id")


def fitted(sample: DataFrame, fit, names: list[str]) -> dict[str, np.ndarray]:
    """Run ``fit(raws, n_chars, y)`` in one task on the bounded sample and bring its arrays to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raws, n_chars, y = [], [], []
        for batch in batches:
            for name, into in (("raw", raws), ("n_chars", n_chars), ("y", y)):
                into += batch.column(batch.schema.get_field_index(name)).to_pylist()
        model = fit(raws, np.array(n_chars, dtype=float), np.array(y, dtype=float))
        for name in names:
            body = np.ascontiguousarray(model[name], dtype=np.float64)
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([list(body.shape)], pa.list_(pa.int64())), pa.array([body.tobytes()], pa.binary())], names=["name", "shape", "body"])

    rows = sample.mapInArrow(run, "name string, shape array<long>, body binary").collect()
    if not rows:  # a sample that is known to be empty runs no task
        return fit([], np.zeros(0), np.zeros(0))
    return {r["name"]: np.frombuffer(bytes(r["body"])).reshape(r["shape"]) for r in rows}


def adam(parameters: dict[str, np.ndarray], gradient, steps: int, rate: float) -> None:
    """Minimise in place by full-batch Adam; ``gradient()`` gives an array for each parameter."""
    first = {k: np.zeros_like(v) for k, v in parameters.items()}
    second = {k: np.zeros_like(v) for k, v in parameters.items()}
    for step in range(1, steps + 1):
        for k, g in gradient().items():
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.999 * second[k] + 0.001 * g * g
            parameters[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
