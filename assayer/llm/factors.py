"""Quality by a factorisation machine over hashed words, structure statistics and metadata."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm.common import binary, columns
from assayer.llm.features import N_STATISTICS, TRAIN_ROWS, Hashes, adam, counted, fitted, held_out, sentences, statistics, training_rows

WORDS = 1 << 16
# After the hashed words come the statistics of the text, its logarithmic n_chars column and whether that is right.
FEATURES = WORDS + N_STATISTICS + 2
RANK = 6
THRESHOLD = 0.7
STEPS, RATE, SHRINK = 120, 0.05, 1e-4


def _rows(raws: list[bytes], n_chars: np.ndarray, hashes: Hashes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows of the texts: (text, feature, value), words scaled to unit length."""
    words, starts, texts = sentences(raws)
    first_word = starts[texts]
    feature = np.fromiter(map(hashes.__getitem__, words), dtype=np.int64, count=len(words))
    owner = np.repeat(np.arange(len(raws)), np.diff(np.append(first_word, len(words))))
    row, col, n = counted(owner, feature, WORDS)
    value = 1.0 + np.log(n)
    value /= np.sqrt(np.bincount(row, weights=value * value, minlength=len(raws)))[row]
    dense = np.empty((len(raws), N_STATISTICS + 2))
    for k, raw in enumerate(raws):
        dense[k, :N_STATISTICS] = statistics(raw)
        dense[k, N_STATISTICS:] = np.log1p(max(0.0, n_chars[k])) / 12, float(len(raw.decode("utf-8", "replace")) == n_chars[k])
    width = N_STATISTICS + 2
    row = np.concatenate([row, np.repeat(np.arange(len(raws)), width)])
    col = np.concatenate([col, np.tile(np.arange(WORDS, FEATURES), len(raws))])
    value = np.concatenate([value, dense.ravel()])
    order = np.argsort(row, kind="stable")
    return row[order], col[order], value[order]


def _machine(b: float, w: np.ndarray, v: np.ndarray, row: np.ndarray, col: np.ndarray, value: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Margins in linear time: pairwise terms are half of (sum of v x) squared less the sum of (v x) squared."""
    heads = np.searchsorted(row, np.arange(n))
    terms = v[col] * value[:, None]
    sums = np.add.reduceat(terms, heads, axis=0)
    pairs = 0.5 * (sums**2 - np.add.reduceat(terms**2, heads, axis=0)).sum(axis=1)
    return b + np.add.reduceat(w[col] * value, heads) + pairs, sums


def _fit(raws: list[bytes], n_chars: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(7)
    model = {"b": np.zeros(1), "w": np.zeros(FEATURES), "v": rng.normal(0, 0.05, (FEATURES, RANK))}
    if not len(y):
        return model
    row, col, value = _rows(raws, n_chars, Hashes(WORDS))
    flat = (col[:, None] * RANK + np.arange(RANK)).ravel()

    def gradient() -> dict[str, np.ndarray]:
        margin, sums = _machine(model["b"][0], model["w"], model["v"], row, col, value, len(raws))
        error = (1 / (1 + np.exp(-margin)) - y) / len(y)
        weight = error[row] * value
        pull = weight[:, None] * (sums[row] - model["v"][col] * value[:, None])
        return {
            "b": np.array([error.sum()]),
            "w": np.bincount(col, weights=weight, minlength=FEATURES) + SHRINK * model["w"] / 10,
            "v": np.bincount(flat, weights=pull.ravel(), minlength=FEATURES * RANK).reshape(FEATURES, RANK) + SHRINK * model["v"],
        }

    adam(model, gradient, STEPS, RATE)
    return model


_SCORED = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64())])


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b, w, v = shared.value
        hashes = Hashes(WORDS)
        for batch in batches:
            doc_id, held, raws, n_chars = columns(batch, "doc_id", "held_out", "raw", "n_chars")
            if not raws:
                continue
            row, col, value = _rows(raws, np.array(n_chars, dtype=float), hashes)
            margin, _sums = _machine(b, w, v, row, col, value, len(raws))
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip((doc_id, held, 1 / (1 + np.exp(-np.clip(margin, -500, 500)))), _SCORED)], schema=_SCORED)

    return run


def quality(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """A quality score for every text.

    Learned from at most ``train_rows`` labelled rows whose crc32(doc_id as text) mod 4 is not 2; labels, lang, source
    and doc_id are no inputs of a score. Null text is empty and null n_chars 0; where the column is missing the text's
    length takes its place. Repeated rows are scored each, very long texts whole; no labels give every text 0.5 or so;
    an empty table gives an empty result; other columns are ignored.
    Result: doc_id, held_out, score.
    """
    model = fitted(training_rows(docs, labels, "quality", train_rows), _fit, ["b", "w", "v"])
    shared = docs.sparkSession.sparkContext.broadcast((float(model["b"][0]), model["w"], model["v"]))
    extra = F.col("n_chars").cast("double") if "n_chars" in docs.columns else F.char_length("text").cast("double")
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), binary("text").alias("raw"), F.coalesce(extra, F.lit(0.0)).alias("n_chars"))
    return read.mapInArrow(_score(shared), "doc_id long, held_out boolean, score double")
