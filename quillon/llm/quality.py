"""Quality classifier: a linear-chain conditional random field labels every line good or bad.

A line is described by its own features and those of the lines before and after
it; forward-backward gives each line's probability, and a document's quality is
the mean over its lines, weighted by their lengths.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm.common import named

#: Bound of the training sample: so many labelled documents at most, and of each so many lines in a row at most.
TRAIN_DOCS, TRAIN_LINES = 4000, 250
#: Fixed by the contract: documents with this remainder are never learnt from, and the decision.
FOLDS, THRESHOLD = 5, 0.3
ROUNDS, RATE, SHRINK = 300, 0.1, 1e-3

#: Upper limits of the first bins; a value beyond the last falls into one more.
SHARES = (0.0, 0.01, 0.03, 0.08, 0.2, 0.4, 0.7)
FEATURES = (
    ("upper", SHARES), ("symbol", SHARES), ("digit", SHARES), ("stop", SHARES),
    ("words", (0, 2, 5, 10, 20, 50, 200)), ("word_length", (0, 2, 3, 4, 5, 7, 10)), ("distinct", (0.1, 0.3, 0.5, 0.7, 0.8, 0.9, 0.99)), ("seen", (0, 1, 2, 4, 8, 16, 32)),
)
BINS = 8
#: Codes of a line: its own bins, then those of its neighbours; the last code of each place means that there is no such line.
PLACE = len(FEATURES) * BINS + 1
CODES = 3 * PLACE

_UPPER, _SYMBOL, _DIGIT, _STOP = 1, 2, 3, 4
_CLASS = np.zeros(256, np.uint8)
_CLASS[ord("A") : ord("Z") + 1] = _UPPER
for _c in b"!\"#$%&*+/<=>@[\\]^_`{|}~":
    _CLASS[_c] = _SYMBOL
_CLASS[ord("0") : ord("9") + 1] = _DIGIT
for _c in b".,;:?":
    _CLASS[_c] = _STOP


def line_codes(text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """Feature bins of each line (lines x features) and its length plus one. A text has one line at least."""
    text = text or b""
    lines = text.split(b"\n")
    size = np.array([len(x) for x in lines])
    start = np.cumsum(size + 1) - size - 1
    kind = _CLASS[np.frombuffer(text + b"\n", np.uint8)]
    total = np.maximum(size, 1)
    shares = [np.add.reduceat((kind == k).astype(np.int64), start) / total for k in (_UPPER, _SYMBOL, _DIGIT, _STOP)]
    words, length, distinct, seen = [], [], [], []
    before: dict[bytes, int] = {}
    for x in lines:
        w = x.split()
        n = len(w)
        words.append(n)
        length.append((len(x) - n + 1) / n if n else 0.0)
        distinct.append(len(set(w)) / n if n else 1.0)
        k = before[x] = before.get(x, -1) + 1
        seen.append(k if n else 0)
    values = [*shares, words, length, distinct, seen]
    codes = np.stack([np.searchsorted(bounds, v, side="left") for (_, bounds), v in zip(FEATURES, values)], axis=1)
    return codes.astype(np.uint8), size + 1


def chain_codes(codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Codes of each line and of its neighbours, for chains one after the other that begin at ``starts``."""
    own = codes.astype(np.int32) + np.arange(len(FEATURES), dtype=np.int32) * BINS
    none = np.full((1, len(FEATURES)), PLACE - 1, np.int32)
    before, after = np.concatenate([none, own[:-1]]), np.concatenate([own[1:], none])
    before[starts] = PLACE - 1
    after[np.append(starts[1:], len(own)) - 1] = PLACE - 1
    return np.concatenate([own, before + PLACE, after + 2 * PLACE], axis=1)


@dataclass(frozen=True)
class Model:
    """``weights`` per code, towards good; ``moves[a, b]`` is the weight of b after a (0 bad, 1 good)."""

    weights: np.ndarray
    moves: np.ndarray


def _pass(r: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Log-odds of good on one side of a move, from those on the other: ``m`` has the weights by (this side, that side)."""
    return np.logaddexp(m[1, 1] + r, m[1, 0]) - np.logaddexp(m[0, 1] + r, m[0, 0])


def marginals(odds: np.ndarray, starts: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward and backward log-odds (without the line's own) and the probability of good for each line of each chain."""
    n = np.diff(np.append(starts, len(odds)))
    ahead, behind = np.zeros(len(odds)), np.zeros(len(odds))
    order = np.argsort(-n, kind="stable")
    s, k = starts[order], n[order]
    live = np.searchsorted(-k, -np.arange(1, (k[0] if len(k) else 0)), side="left")  # chains with more than i lines
    for i, c in enumerate(live.tolist(), 1):
        at = s[:c] + i
        ahead[at] = _pass(ahead[at - 1] + odds[at - 1], moves.T)
    ends = s + k - 1
    for i, c in enumerate(live.tolist(), 1):
        at = ends[:c] - i
        behind[at] = _pass(behind[at + 1] + odds[at + 1], moves)
    return ahead, behind, 1 / (1 + np.exp(-np.clip(ahead + behind + odds, -500, 500)))


def gradient(model: Model, codes: np.ndarray, starts: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the log-likelihood of the lines' labels ``y`` (0 bad, 1 good), by weight and by move."""
    w, m = model.weights, model.moves
    inner = np.ones(len(codes), bool)
    inner[starts] = False
    right = np.flatnonzero(inner)
    left = right - 1
    odds = w[codes].sum(axis=1)
    ahead, behind, p = marginals(odds, starts, m)
    slope = np.bincount(codes.ravel(), np.repeat(y - p, codes.shape[1]), len(w))
    a, b = ahead[left] + odds[left], behind[right] + odds[right]
    joint = np.stack([np.full(len(a), m[0, 0]), m[0, 1] + b, m[1, 0] + a, m[1, 1] + a + b])
    joint = np.exp(joint - joint.max(axis=0))
    joint /= joint.sum(axis=0)
    seen = np.array([np.sum((y[left] == u) & (y[right] == v)) for u in (0, 1) for v in (0, 1)])
    return slope, (seen - joint.sum(axis=1)).reshape(2, 2)


def fit(codes: np.ndarray, starts: np.ndarray, good: np.ndarray) -> Model:
    """Maximum likelihood by Adam, each line with its document's label; deterministic."""
    w, m = np.zeros(CODES), np.zeros((2, 2))
    if not len(codes):
        return Model(w, m)
    y = np.repeat(good.astype(float), np.diff(np.append(starts, len(codes))))
    first, second = np.zeros(CODES + 4), np.zeros(CODES + 4)
    for t in range(1, ROUNDS + 1):
        slope, turn = gradient(Model(w, m), codes, starts, y)
        g = np.append(slope, turn) / len(starts) - SHRINK * np.append(w, m.ravel())
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        step = RATE * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
        w, m = w + step[:CODES], m + step[CODES:].reshape(2, 2)
    return Model(w, m)


def excerpt(text: bytes | None) -> np.ndarray:
    """The codes of TRAIN_LINES lines in a row of a text, from a place that depends on the text; all lines of shorter ones."""
    codes = line_codes(text)[0]
    at = zlib.crc32(text or b"") % (len(codes) - TRAIN_LINES + 1) if len(codes) > TRAIN_LINES else 0
    return codes[at : at + TRAIN_LINES]


def score_texts(model: Model, texts: Iterable[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Quality of each text, probability of good for each line, and where each text's lines begin."""
    pairs = [line_codes(t) for t in texts]
    if not pairs:
        return np.zeros(0), np.zeros(0), np.zeros(0, np.int64)
    sizes = np.array([len(c) for c, _ in pairs])
    starts = np.cumsum(sizes) - sizes
    codes = chain_codes(np.concatenate([c for c, _ in pairs]), starts)
    length = np.concatenate([s for _, s in pairs]).astype(float)
    odds = np.zeros(len(codes))
    for k in range(codes.shape[1]):
        odds += model.weights[codes[:, k]]
    p = marginals(odds, starts, model.moves)[2]
    return np.add.reduceat(p * length, starts) / np.add.reduceat(length, starts), p, starts


def training_fold(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % FOLDS, F.lit(-1))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """Learns from a sample of labelled documents, TRAIN_DOCS at most, of those outside the held-out fold.

    The sample is that of the smallest id hashes; of a document with many lines
    an excerpt of TRAIN_LINES is learnt from. Only bins of features come to the
    driver, 8 MB of them at most.
    Null labels and null ids are skipped; an id that occurs or is labelled
    several times counts as often, within the bound. Without any label, every text scores 0.5.
    """
    sample = (
        labels.select(named(id_col).alias("l_id"), named(label_col).cast("int").alias("good"))
        .where(F.col("l_id").isNotNull() & F.col("good").isNotNull() & (training_fold(F.col("l_id")) != 0))
        .orderBy(F.xxhash64("l_id"), "l_id", "good")
        .limit(TRAIN_DOCS)
    )
    rows = docs.select(named(id_col).alias("id"), named(text_col).alias("text"))
    rows = rows.join(F.broadcast(sample), F.col("id") == F.col("l_id")).select(F.xxhash64("id").alias("place"), "good", F.col("text").cast("binary").alias("text"))

    def codes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [excerpt(t.as_py()).tobytes() for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.binary())], ["place", "good", "codes"])

    found = rows.mapInArrow(codes, "place long, good int, codes binary").orderBy("place", "good", "codes").limit(TRAIN_DOCS).collect()
    chains = [np.frombuffer(c, np.uint8).reshape(-1, len(FEATURES)) for _, _, c in found]
    if not chains:
        return Model(np.zeros(CODES), np.zeros((2, 2)))
    sizes = np.array([len(c) for c in chains])
    starts = np.cumsum(sizes) - sizes
    return fit(chain_codes(np.concatenate(chains), starts), starts, np.array([g > 0 for _, g, _ in found]))


def line_quality(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, score, lines``; ``lines`` has each line's probability of being good.

    Null text is empty; an empty text is one empty line. Each row is scored from
    its text alone. An empty table gives an empty result; further columns are
    ignored.
    """

    def emit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score, p, starts = score_texts(model, (t.as_py() for t in batch.column(1)))
            lines = pa.ListArray.from_arrays(pa.array(np.append(starts, len(p)), pa.int32()), pa.array(p))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), lines], ["doc_id", "score", "lines"])

    schema = T.StructType().add("doc_id", docs.schema[id_col].dataType).add("score", "double").add("lines", T.ArrayType(T.DoubleType()))
    return docs.select(named(id_col).alias("doc_id"), named(text_col).cast("binary").alias("text")).mapInArrow(emit, schema)


def classify_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """:func:`line_quality` by a model that is trained on the labels, with ``predicted``: 1 from THRESHOLD on, else 0."""
    found = line_quality(docs, train(docs, labels, id_col, text_col, label_col), id_col, text_col)
    return found.withColumn("predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """The rows that are not predicted to be bad, with all their columns; nothing is shuffled.

    Null text is an empty one; null ids and repeated rows are rows like others;
    an empty table gives an empty result.
    """
    model = train(docs, labels, id_col, text_col, label_col)

    @F.pandas_udf("double")
    def score(texts):
        import pandas as pd

        return pd.Series(score_texts(model, texts)[0])

    return docs.where(score(F.coalesce(named(text_col), F.lit("")).cast("binary")) >= THRESHOLD)
