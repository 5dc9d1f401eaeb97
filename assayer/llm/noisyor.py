"""Toxicity by multiple-instance learning: sentence scores under a noisy-or, trained from document labels."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayer.llm.common import binary, columns, free_name
from assayer.llm.features import REMEMBERED, TRAIN_ROWS, adam, counted, fitted, held_out, sentences, training_rows

FEATURES = 1 << 18
THRESHOLD = 0.3
# A sentence is reported where it alone would reach this score.
SENTENCE_THRESHOLD = 0.3
STEPS, RATE, SHRINK = 150, 0.08, 2e-5
# A word counts by itself and by its beginnings of these many bytes, which catches compounds of a toxic stem.
BEGINNINGS = (5, 6, 7, 8)
# A feature takes part where presence and label of the training documents depend on each other at least this much.
LEAST_CHI_SQUARE, LEAST_DOCUMENTS = 15.0, 4


def _softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0.0, z)


def _features(word: bytes) -> list[int]:
    parts = [word, *(word[:k] + b"-" for k in BEGINNINGS if len(word) > k)]
    return [zlib.crc32(part) % FEATURES for part in parts]


class _Weights(dict):
    """Weight of a word, the sum over its features, remembered for as long as there is room."""

    def __init__(self, w: np.ndarray):
        super().__init__()
        self.w = w

    def __missing__(self, word: bytes) -> float:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = weight = float(self.w[_features(word)].sum())
        return weight


def _chi_square(with_toxic: np.ndarray, with_clean: np.ndarray, toxic: int, clean: int) -> np.ndarray:
    n, held = toxic + clean, with_toxic + with_clean
    off = with_toxic * (clean - with_clean) - with_clean * (toxic - with_toxic)
    return n * off.astype(float) ** 2 / np.maximum(1.0, held * (n - held) * float(toxic) * float(clean))


def _fit(raws: list[bytes], _: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    """Weights w and bias b with P(toxic) = 1 - prod over sentences of (1 - sigmoid(b + sum of w over its words))."""
    model = {"w": np.zeros(FEATURES), "b": np.array([-6.0])}
    if not len(y):
        return model | {"b": np.array([-30.0])}
    words, starts, texts = sentences(raws)
    n_sentences = len(starts)
    numbers: dict[bytes, int] = {}
    word = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), dtype=np.int64, count=len(words))
    owner = np.repeat(np.arange(n_sentences), np.diff(np.append(starts, len(words))))
    row, word, _n = counted(owner, word, len(numbers))
    lists = [_features(w) for w in numbers]
    sizes = np.array([len(x) for x in lists])
    flat, heads = np.concatenate(lists), np.concatenate([[0], np.cumsum(sizes)[:-1]])
    reach = sizes[word]
    row = np.repeat(row, reach)
    within = np.arange(len(row)) - np.repeat(np.cumsum(reach) - reach, reach)
    col = flat[np.repeat(heads[word], reach) + within]
    doc_of = np.repeat(np.arange(len(raws)), np.diff(np.append(texts, n_sentences)))
    doc, held, _n = counted(doc_of[row], col, FEATURES)
    with_toxic = np.bincount(held[y[doc] > 0], minlength=FEATURES)
    with_clean = np.bincount(held[y[doc] <= 0], minlength=FEATURES)
    telling = (_chi_square(with_toxic, with_clean, int((y > 0).sum()), int((y <= 0).sum())) >= LEAST_CHI_SQUARE) & (with_toxic + with_clean >= LEAST_DOCUMENTS)
    keep = telling[col]
    row, col = row[keep], col[keep]

    def gradient() -> dict[str, np.ndarray]:
        z = model["b"][0] + np.bincount(row, weights=model["w"][col], minlength=n_sentences)
        loss = np.add.reduceat(_softplus(z), texts)
        # d/dz of -log P(label): sigmoid(z) for a clean document, minus that times the odds of all clean for a toxic one.
        pull = np.where(y > 0, -np.exp(-loss) / np.maximum(-np.expm1(-loss), 1e-12), 1.0)
        push = pull[doc_of] / (1 + np.exp(-z)) / len(y)
        return {"w": np.bincount(col, weights=push[row], minlength=FEATURES) + SHRINK * model["w"], "b": np.array([push.sum()])}

    adam(model, gradient, STEPS, RATE)
    return model


_SCORED = pa.schema([
    ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("n_sentences", pa.int64()),
    ("offending", pa.list_(pa.struct([("sentence", pa.int64()), ("score", pa.float64()), ("words", pa.string())]))),
])
_SCORED_DDL = "doc_id long, held_out boolean, score double, n_sentences long, offending array<struct<sentence: long, score: double, words: string>>"


def _evaluate(raws: list[bytes], weights: _Weights, b: float) -> tuple[np.ndarray, np.ndarray, list[bytes], np.ndarray, np.ndarray]:
    """(score of each text, score of each sentence, words, first word of each sentence, first sentence of each text)."""
    words, starts, texts = sentences(raws)
    weight = np.fromiter(map(weights.__getitem__, words), dtype=float, count=len(words))
    # A word counts once in a sentence; words without weight drop out before that.
    seen: dict[tuple[int, bytes], float] = {}
    for k in np.flatnonzero(weight):
        seen[int(np.searchsorted(starts, k, "right")) - 1, words[k]] = weight[k]
    row = np.fromiter((key[0] for key in seen), dtype=np.int64, count=len(seen))
    z = b + np.bincount(row, weights=np.fromiter(seen.values(), dtype=float, count=len(seen)), minlength=len(starts))
    score = -np.expm1(-np.add.reduceat(_softplus(z), texts))
    return np.clip(score, 0.0, 1.0), 1 / (1 + np.exp(-z)), words, starts, texts


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, b = shared.value
        weights = _Weights(w)
        for batch in batches:
            doc_id, held, raws = columns(batch, "doc_id", "held_out", "raw")
            if not raws:
                continue
            score, p, words, starts, texts = _evaluate(raws, weights, b)
            bad: list[list[dict]] = [[] for _ in raws]
            ends = np.append(starts, len(words))
            for s in np.flatnonzero(p >= SENTENCE_THRESHOLD):
                k = int(np.searchsorted(texts, s, "right") - 1)
                bad[k].append({"sentence": int(s - texts[k]), "score": float(p[s]), "words": b" ".join(words[ends[s] : ends[s + 1]]).decode("utf-8", "replace")})
            n = np.diff(np.append(texts, len(starts)))
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip((doc_id, held, score, n, bad), _SCORED)], schema=_SCORED)

    return run


def _append(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, b = shared.value
        weights = _Weights(w)
        for batch in batches:
            raws = batch.column(batch.num_columns - 1).to_pylist()
            if raws:
                score = _evaluate(raws, weights, b)[0]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(score)], names=batch.schema.names)

    return run


def _model(docs: DataFrame, labels: DataFrame, train_rows: int):
    model = fitted(training_rows(docs, labels, "toxic", train_rows), _fit, ["w", "b"])
    return docs.sparkSession.sparkContext.broadcast((model["w"], float(model["b"][0])))


def toxicity(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """A toxicity score for every text, and the sentences that cause it.

    Sentences end at . ! ? and line feeds; words are in lower case without punctuation. Weights are learned from at most
    ``train_rows`` labelled rows whose crc32(doc_id as text) mod 4 is not 2; labels, lang, source and doc_id are no
    inputs of a score. Null text is empty; a text without words gets the bias alone. Repeated rows are scored each,
    very long texts whole; no labels give every text a score near 0; an empty table gives an empty result; other columns
    are ignored.
    Result: doc_id, held_out, score, n_sentences, offending (sentence from 0, its own score, its words).
    """
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), binary("text").alias("raw"))
    return read.mapInArrow(_score(_model(docs, labels, train_rows)), _SCORED_DDL)


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """The rows of ``docs`` that score below the threshold, all their columns unchanged; one pass, no shuffle of texts."""
    mark = free_name(docs, "__toxicity")
    wide = docs.withColumn(mark, binary("text"))
    schema = T.StructType([*docs.schema.fields, T.StructField(mark, T.DoubleType())])
    return wide.mapInArrow(_append(_model(docs, labels, train_rows)), schema).filter(F.col(mark) < threshold).drop(mark)
