"""Quality scores from a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(b + sum w_i x_i + sum over pairs <v_i, v_j> x_i x_j), with the pairs summed in linear time as half of
(sum v x)^2 - sum v^2 x^2 in each of ``RANK`` dimensions (Rendle, 2010). Word features hold a word's share of the
text's words; the others are standardised. The model has a fixed size, whatever the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textkernels import U64, slices, word_hashes
from .training import labelled_sample, remainder

BITS = 16
WORDS = 1 << BITS
RANK = 8
#: Labelled texts of each class that the model is fitted on, at most.
PER_CLASS = 2000

_CLASSES = np.zeros((256, 6), bool)
_CLASSES[65:91, 0] = True  # A-Z
_CLASSES[48:58, 1] = True  # digits
_CLASSES[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)], 2] = True  # ASCII punctuation
_CLASSES[[44, 46, 59, 58, 39, 45], 3] = True  # punctuation of prose
_CLASSES[[10, 13], 4] = True  # line ends
_CLASSES[97:123, 5] = True  # a-z
#: Of a text: the shares of the byte classes, then log bytes, log words, mean bytes a word, distinct words, most frequent
#: word, repeated word pairs, words without a letter or digit, words ending in other punctuation; then log n_chars.
STATISTICS = _CLASSES.shape[1] + 9


@dataclass
class QualityModel:
    bias: float
    linear: np.ndarray  # float32[WORDS + STATISTICS]
    factors: np.ndarray  # float32[WORDS + STATISTICS, RANK]
    mean: np.ndarray
    spread: np.ndarray


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of values between the borders ``first``."""
    total = np.concatenate([[0], np.cumsum(values)])
    return total[first[1:]] - total[first[:-1]]


def features(data: np.ndarray, offsets: np.ndarray, n_chars: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word bucket, its share, text of each; statistics of each text)."""
    n = len(offsets) - 1
    with np.errstate(over="ignore"):
        words, starts, ends, first = word_hashes(data, offsets)
    size, count = np.diff(offsets).astype(np.float64), np.diff(first).astype(np.float64)
    row = np.repeat(np.arange(n), np.diff(first))
    stats = np.zeros((n, STATISTICS))
    for i in range(_CLASSES.shape[1]):
        stats[:, i] = _sums(_CLASSES[data, i], offsets) / np.maximum(1, size)
    k = _CLASSES.shape[1]
    stats[:, k], stats[:, k + 1], stats[:, k + 2] = np.log1p(size), np.log1p(count), _sums(ends - starts, first) / np.maximum(1, count)

    def grouped(x: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct (of, x) pairs with their counts."""
        order = np.lexsort((x, of))
        x, of = x[order], of[order]
        new = np.ones(len(x), bool)
        new[1:] = (x[1:] != x[:-1]) | (of[1:] != of[:-1])
        at = np.flatnonzero(new)
        return x[at], of[at], np.diff(np.append(at, len(x)))

    bucket, owner, times = grouped((words >> U64(64 - BITS)).astype(np.int64), row)
    share = times / np.maximum(1, count)[owner]
    stats[:, k + 3] = np.bincount(owner, minlength=n) / np.maximum(1, count)
    np.maximum.at(stats[:, k + 4], owner, share)
    pairs = words[:-1] * U64(0x9E3779B97F4A7C15) + words[1:] if len(words) else words
    inside = row[:-1] == row[1:]
    _, pair_owner, pair_times = grouped(pairs[inside], row[:-1][inside]) if len(words) > 1 else (None, np.zeros(0, np.int64), np.zeros(0))
    stats[:, k + 5] = np.bincount(pair_owner, weights=pair_times - 1, minlength=n) / np.maximum(1, count)
    alpha = np.concatenate([[0], np.cumsum(_CLASSES[data, 0] | _CLASSES[data, 1] | _CLASSES[data, 5] | (data >= 128))])
    stats[:, k + 6] = _sums(alpha[ends] == alpha[starts], first) / np.maximum(1, count) if len(words) else 0
    last = data[ends - 1] if len(words) else np.zeros(0, np.uint8)
    stats[:, k + 7] = _sums(_CLASSES[last, 2] & ~_CLASSES[last, 3], first) / np.maximum(1, count)
    stats[:, k + 8] = np.log1p(np.maximum(0, n_chars))
    return bucket, share, owner, stats


def _inputs(batch: pa.RecordBatch, text: pa.Array | None = None) -> Iterator[tuple[int, int, tuple]]:
    chars = batch.column("n_chars").to_numpy(zero_copy_only=False).astype(np.float64)
    for a, b, data, offsets in slices(batch.column("text") if text is None else text):
        yield a, b, features(data, offsets, np.nan_to_num(chars[a:b]))


def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, (bucket, share, owner, stats) in _inputs(batch):
            at = np.searchsorted(owner, np.arange(b - a + 1))
            cut = lambda x, kind: pa.array([x[i:j].astype(kind).tobytes() for i, j in zip(at[:-1], at[1:], strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("y").slice(a, b - a), cut(bucket, np.int32), cut(share, np.float32), pa.array([s.tobytes() for s in stats], pa.binary())], names=["y", "words", "shares", "stats"])


def _raw_scores(model: QualityModel, bucket: np.ndarray, share: np.ndarray, owner: np.ndarray, stats: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(scores before the sigmoid, sum of v x, standardised statistics). owner is sorted."""
    n = len(stats)
    dense = np.clip((stats - model.mean) / model.spread, -6, 6)
    v = model.factors[bucket] * share[:, None]
    at = np.searchsorted(owner, np.arange(n + 1))
    total = np.zeros((len(bucket) + 1, 2 * RANK + 1))
    np.cumsum(np.concatenate([v, v * v, (model.linear[bucket] * share)[:, None]], 1), axis=0, dtype=np.float64, out=total[1:])
    sums = total[at[1:]] - total[at[:-1]]
    rest = model.factors[WORDS:]
    vx = sums[:, :RANK] + dense @ rest
    squares = sums[:, RANK:-1] + dense**2 @ rest**2
    return model.bias + sums[:, -1] + dense @ model.linear[WORDS:] + 0.5 * (vx**2 - squares).sum(1), vx, dense


def fit_rows(rows: list[tuple[np.ndarray, np.ndarray]], stats: np.ndarray, y: np.ndarray, importance: np.ndarray, *, epochs: int = 30, batch: int = 64, rate: float = 0.02, ridge: float = 1e-4) -> QualityModel:
    """Fit by Adam on mini-batches, in a fixed order. Without rows of both classes the score is their smoothed share for any text."""
    random = np.random.default_rng(5)
    linear, factors = np.zeros(WORDS + STATISTICS), random.normal(0, 0.02, (WORDS + STATISTICS, RANK))
    if not len(y) or y.min() == y.max():
        share = (y.sum() + 1) / (len(y) + 2)
        return QualityModel(float(np.log(share / (1 - share))), linear, factors * 0, np.zeros(STATISTICS), np.ones(STATISTICS))
    model = QualityModel(0.0, linear, factors, stats.mean(0), np.maximum(stats.std(0), 1e-6))
    importance = importance / importance.mean()
    first, second = np.zeros((WORDS + STATISTICS, RANK + 1)), np.zeros((WORDS + STATISTICS, RANK + 1))
    m0 = v0 = 0.0
    t = 0
    for _ in range(epochs):
        for chosen in np.array_split(random.permutation(len(y)), -(-len(y) // batch)):
            t += 1
            bucket, share = (np.concatenate([rows[i][k] for i in chosen]) for k in (0, 1))
            owner = np.repeat(np.arange(len(chosen)), [len(rows[i][0]) for i in chosen])
            z, vx, dense = _raw_scores(model, bucket, share, owner, stats[chosen])
            error = importance[chosen] * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[chosen]) / len(chosen)
            touched, where = np.unique(bucket, return_inverse=True)
            x = share * error[owner]
            gradient = np.zeros((len(touched) + STATISTICS, RANK + 1))
            gradient[: len(touched), 0] = np.bincount(where, weights=x, minlength=len(touched))
            gradient[len(touched) :, 0] = error @ dense
            squared = np.bincount(where, weights=x * share, minlength=len(touched))
            for k in range(RANK):
                gradient[: len(touched), k + 1] = np.bincount(where, weights=x * vx[owner, k], minlength=len(touched)) - factors[touched, k] * squared
            gradient[len(touched) :, 1:] = (dense * error[:, None]).T @ vx - factors[WORDS:] * (error @ dense**2)[:, None]
            at = np.concatenate([touched, np.arange(WORDS, WORDS + STATISTICS)])
            gradient[:, 0] += ridge * linear[at]
            gradient[:, 1:] += ridge * factors[at]
            first[at] = 0.9 * first[at] + 0.1 * gradient
            second[at] = 0.99 * second[at] + 0.01 * gradient**2
            step = rate * (first[at] / (1 - 0.9**t)) / (np.sqrt(second[at] / (1 - 0.99**t)) + 1e-6)
            linear[at] -= step[:, 0]
            factors[at] -= 0.2 * step[:, 1:]
            m0, v0 = 0.9 * m0 + 0.1 * error.sum(), 0.99 * v0 + 0.01 * error.sum() ** 2
            model.bias -= rate * (m0 / (1 - 0.9**t)) / (np.sqrt(v0 / (1 - 0.99**t)) + 1e-6)
    return model


def _chars(docs: DataFrame) -> Column:
    length = F.length("text").cast("double")
    return F.coalesce(F.col("n_chars").cast("double") if "n_chars" in docs.columns else length, length, F.lit(0.0))


def _prepared(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", _chars(docs).alias("n_chars"))


def fit(docs: DataFrame, labels: DataFrame, *, per_class: int = PER_CLASS, folds: int = 3, held_out: int = 1) -> QualityModel:
    """Learn ``labels.quality`` from at most ``per_class`` texts of each class outside the held-out fold, of training.CLASS_BYTES in all.

    Defined cases: null texts are empty ones; ids without a text aren't learnt from; labels that are null or neither 0 nor 1 are left
    aside, and of labels that differ for one id 1 counts; without both classes the score is their smoothed share (0.5
    without any) for every text; without a column n_chars the text's length stands for it; other columns are left aside.
    """
    sample, totals = labelled_sample(_prepared(docs), labels, "quality", per_class=per_class, folds=folds, held_out=held_out)
    got = sample.select("y", "text", "n_chars").mapInArrow(_featurise, "y int, words binary, shares binary, stats binary").collect()
    got.sort(key=lambda x: (x["y"], bytes(x["stats"]), bytes(x["words"])))
    y = np.array([x["y"] for x in got], np.float64)
    rows = [(np.frombuffer(x["words"], np.int32).astype(np.int64), np.frombuffer(x["shares"], np.float32).astype(np.float64)) for x in got]
    stats = np.array([np.frombuffer(x["stats"]) for x in got]).reshape(-1, STATISTICS)
    # The rarer class weighs as its labels do, but a third as much as the other at least.
    share = {c: totals.get(c, 0) / max(1, (y == c).sum()) for c in (0, 1)}
    mass = {c: share[c] * (y == c).sum() for c in (0, 1)}
    least = max(mass.values()) / 3
    weight = {c: share[c] * max(1.0, least / mass[c]) if mass[c] else 0.0 for c in (0, 1)}
    return fit_rows(rows, stats, y, np.array([weight[int(c)] for c in y]))


def score(docs: DataFrame, model: QualityModel, *, folds: int = 3, held_out: int = 1, threshold: float = 0.5, keep: bool = False) -> DataFrame:
    """Score every whole text.

    Returns one row per row of docs: doc_id, held_out, score (0 to 1) and predicted (1 if score >= threshold); with
    keep, the rows of docs whose score is at least threshold, with all their columns.
    Defined cases: a null or empty text has no words and statistics of 0, and is scored on those; a null n_chars is the
    text's length; a null doc_id is in fold 0; an empty table gives an empty one; other columns are left aside.
    """
    shared = docs.sparkSession.sparkContext.broadcast(QualityModel(model.bias, model.linear.astype(np.float32), model.factors.astype(np.float32), model.mean, model.spread))

    def scores(batch: pa.RecordBatch, text: pa.Array | None = None) -> np.ndarray:
        out = [_raw_scores(shared.value, *x)[0] for _, _, x in _inputs(batch, text)]
        return 1 / (1 + np.exp(-np.clip(np.concatenate([*out, np.zeros(0)]), -50, 50)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = scores(batch)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = batch.column("row")
            yield pa.RecordBatch.from_arrays([row.filter(pa.array(scores(batch, row.field("text")) >= threshold))], names=["row"])

    if keep:
        rows = docs.select(F.struct(*docs.columns).alias("row"), _chars(docs).alias("n_chars"))
        return rows.mapInArrow(select, f"row {docs.schema.simpleString()}").select(*(F.col(f"row.`{c}`") for c in docs.columns))
    rows = _prepared(docs).withColumn("held_out", remainder(F.col("doc_id"), folds) == held_out)
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
