"""Quality scores by naive Bayes support vectors.

Features are indicators of n-grams over tokens that tell the make of a text: a word
gives its shape (runs of small letters, capitals, digits, each other sign), or a mark
if it repeats the word before; a line seen before in the text gives marks too. An
indicator says "this n-gram takes at least 2^-k of the text's tokens", k from 0 to
``LEVELS``. Each is scaled by the log ratio of its smoothed frequencies in the two
classes, texts are brought to unit length, and a linear hinge-loss model is fitted by dual
coordinate descent. A logistic curve turns its margin into a score.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CACHE_BYTES, ENTRY_BYTES, only, per_worker, text_chunks

#: log2 of the number of hashed n-grams, and the levels of share an indicator is made for.
GRAM_BITS, LEVELS = 14, 8
DIMENSIONS = (LEVELS + 1) << GRAM_BITS
#: Labelled rows to fit on at most: those with the smallest hash of doc_id.
SAMPLE_ROWS = 12_000
_SAME, _AGAIN = 1, 2


class Model(NamedTuple):
    """``ratio`` and ``weight * ratio`` per indicator, the margin's offset, and its curve."""

    ratio: np.ndarray
    scaled: np.ndarray
    offset: float
    slope: float
    shift: float


def shape(word: str) -> str:
    """``Then,!!`` to ``Aa,!``: one sign for each run of capitals, small letters, digits or another sign."""
    signs = "".join("A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c for c in word)
    return re.sub(r"(.)\1+", r"\1", signs, flags=re.DOTALL)


class Shapes(dict):
    """Word to the number of its shape."""

    def __missing__(self, word: str) -> int:
        self[word] = value = 3 + xxhash.xxh3_64_intdigest(shape(word)) % 2**31
        return value


def _tokens(text: str, shapes: Shapes) -> np.ndarray:
    seen, out = set(), []
    for line in text.split("\n"):
        parts = line.split()
        if not parts:
            continue
        if line in seen:
            out.append(np.full(len(parts), _AGAIN, np.int64))
        seen.add(line)
        row = np.fromiter(map(shapes.__getitem__, parts), np.int64, len(parts))
        row[1:][np.fromiter(map(str.__eq__, parts[1:], parts), bool, len(parts) - 1)] = _SAME
        out.append(row)
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def features(texts: list[str], shapes: Shapes) -> tuple[np.ndarray, np.ndarray]:
    """Indicator numbers of all texts, one text after another, and how many each text has."""
    if len(shapes) * ENTRY_BYTES > CACHE_BYTES:
        shapes.clear()
    tokens = [_tokens(t, shapes) for t in texts]
    lengths = np.array([len(t) for t in tokens], np.int64)
    flat = np.concatenate([np.zeros(0, np.int64), *tokens])
    owner = np.repeat(np.arange(len(texts)), lengths)
    inside = owner[1:] == owner[:-1]
    grams = np.concatenate([flat, (flat[:-1] * 1_000_003 + flat[1:])[inside]]).astype(np.uint64)
    grams = grams * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - GRAM_BITS)
    owners = np.concatenate([owner, owner[1:][inside]])
    key, count = np.unique((owners << GRAM_BITS) + grams.astype(np.int64), return_counts=True)
    who, gram = key >> GRAM_BITS, key & ((1 << GRAM_BITS) - 1)
    level = np.clip(np.ceil(np.log2(lengths[who] / count)), 0, LEVELS).astype(np.int64)
    repeat = LEVELS + 1 - level
    first = np.cumsum(repeat) - repeat
    levels = np.repeat(level - first, repeat) + np.arange(repeat.sum())
    return np.repeat(gram, repeat) * (LEVELS + 1) + levels, np.bincount(who, repeat, len(texts)).astype(np.int64)


def _log_ratio(rows: list[np.ndarray], positive: np.ndarray, smoothing: float) -> np.ndarray:
    ratio = np.zeros(DIMENSIONS)
    for sign, mine in ((1.0, positive), (-1.0, ~positive)):
        counts = smoothing + np.bincount(np.concatenate([rows[i] for i in np.flatnonzero(mine)]), minlength=DIMENSIONS)
        ratio += sign * np.log(counts / counts.sum())
    return ratio


def _descend(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, upper: np.ndarray, epochs: int) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the hinge loss, a constant feature for the offset."""
    weights, offset, alpha = np.zeros(DIMENSIONS), 0.0, np.zeros(len(rows))
    diagonal = np.array([float(v @ v) for v in values]) + 1.0
    order = np.random.default_rng(7)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            gradient = y[i] * (float(weights[rows[i]] @ values[i]) + offset) - 1.0
            new = min(max(alpha[i] - gradient / diagonal[i], 0.0), upper[i])
            if new != alpha[i]:
                step, alpha[i] = (new - alpha[i]) * y[i], new
                weights[rows[i]] += step * values[i]
                offset += step
    return weights, offset


def _curve(margin: np.ndarray, positive: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve, by Newton steps with a light prior on the slope."""
    slope, shift = 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(slope * margin + shift, -30, 30)))
        error, w = p - positive, np.maximum(p * (1 - p), 1e-6)
        bend = np.array([[w @ margin**2 + 1.0, w @ margin], [w @ margin, w.sum() + 1e-3]])
        move = np.linalg.solve(bend, [error @ margin + slope - 1.0, error.sum()])
        slope, shift = slope - move[0], shift - move[1]
        if np.abs(move).max() < 1e-8:
            break
    return float(slope), float(shift)


def fit(rows: list[np.ndarray], labels: np.ndarray, cost: float = 1.0, epochs: int = 10, smoothing: float = 1.0) -> Model:
    """The model of indicator rows and labels 0/1. Without both classes every score is 1, or 0 if all labels are 0."""
    positive = np.asarray(labels) == 1
    if positive.all() or not positive.any():
        only_low = len(positive) > 0 and not positive.any()
        return Model(np.zeros(DIMENSIONS), np.zeros(DIMENSIONS), 0.0, 1.0, -30.0 if only_low else 30.0)
    ratio = _log_ratio(rows, positive, smoothing)
    values = [ratio[x] / max(1e-9, float(np.linalg.norm(ratio[x]))) for x in rows]
    y, share = np.where(positive, 1.0, -1.0), positive.mean()
    weights, offset = _descend(rows, values, y, cost * np.where(positive, 0.5 / share, 0.5 / (1 - share)), epochs)
    margin = np.array([float(weights[x] @ v) + offset for x, v in zip(rows, values, strict=True)])
    return Model(ratio, weights * ratio, offset, *_curve(margin, positive))


def scored(model: Model, flat: np.ndarray, counts: np.ndarray) -> np.ndarray:
    owner = np.repeat(np.arange(len(counts)), counts)
    norm = np.sqrt(np.bincount(owner, model.ratio[flat] ** 2, len(counts)))
    margin = np.bincount(owner, model.scaled[flat], len(counts)) / np.maximum(norm, 1e-9) + model.offset
    return 1 / (1 + np.exp(-np.clip(model.slope * margin + model.shift, -30, 30)))


def _in_chunks(column: pa.Array, shapes: Shapes) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    for i, j, texts in text_chunks(column):
        yield i, j, *features(texts, shapes)


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, id_column: str = "doc_id", text_column: str = "text", label_column: str = "quality") -> Model:
    """Fits on at most ``sample_rows`` rows of ``labels``, which holds what may be learnt from.

    The sample is the rows with the smallest hash of their id, the same in every run.
    Null ids and labels other than 0 and 1 are left out; an id with several labels takes
    the largest, an id with several texts each of them. The bounded list of ids is
    broadcast; a text becomes its indicators in its task, and only those, of at most ``DIMENSIONS``
    numbers a text, reach the driver.
    """
    labels = labels.filter(F.col(label_column).isin(0, 1) & F.col(id_column).isNotNull())
    labels = labels.groupBy(F.col(id_column).alias("doc_id")).agg(F.max(label_column).cast("int").alias("label"))
    sample = labels.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    picked = only(docs, id_column, text_column).join(F.broadcast(sample), "doc_id")
    picked = picked.select(F.col("doc_id").cast("string"), F.col("text").cast("binary").alias("text"), "label")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shapes = per_worker(Shapes)
        for batch in batches:
            for i, j, flat, counts in _in_chunks(batch.column(1), shapes):
                ends = np.cumsum(counts)
                rows = [flat[e - c : e].astype("<i4").tobytes() for e, c in zip(ends, counts, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], batch.column(2)[i:j], pa.array(rows, pa.binary())], ["doc_id", "label", "features"])

    found = picked.mapInArrow(run, "doc_id string, label int, features binary").toPandas().sort_values(["doc_id", "features"])
    return fit([np.frombuffer(x, "<i4") for x in found["features"]], found["label"].to_numpy())


def with_quality(docs: DataFrame, model: Model, text_column: str = "text", score_column: str = "score") -> DataFrame:
    """Adds the score of every whole text; a column of that name is replaced.

    The score depends on the text alone. A null or empty text has no indicators and
    gets the score of the offset. Rows are never joined, dropped or merged.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size: 2 x DIMENSIONS numbers

    @F.arrow_udf("double")
    def score(column: pa.Array) -> pa.Array:
        shapes, model = per_worker(Shapes), shared.value
        return pa.array(np.concatenate([np.zeros(0), *(scored(model, flat, counts) for _, _, flat, counts in _in_chunks(column, shapes))]))

    return docs.withColumn(score_column, score(F.col(text_column).cast("binary")))
