"""Toxicity scores from character n-grams scaled by naive Bayes log-count ratios.

A text's features are its distinct lower-cased character n-grams, hashed into ``BUCKETS`` places. Each is scaled by the
log ratio of its smoothed frequencies in toxic and other texts, and a logistic regression is fitted on the scaled
features (Wang and Manning, 2012). Ratio and weight multiply into one number for each bucket, so scoring is a
lookup and a sum. The model is BUCKETS floats, whatever the size of the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch
from .textkernels import LOWER, U64, mix, slices
from .training import labelled_sample, remainder

BUCKETS = 1 << 20
ORDERS = (3, 4, 5)
#: Labelled texts of each class that the model is fitted on, at most.
PER_CLASS = 2000
#: A bucket counts if the log odds ratio of the sampled texts that have it is so many standard errors from 0.
LEAST_Z = 3.0


@dataclass
class ToxicityModel:
    weights: np.ndarray  # float32[BUCKETS]
    bias: float


def _characters(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of lower-cased UTF-8 texts (A-Z only), and the first of each text."""
    low = LOWER[data]
    points = np.frombuffer(low.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    begins = np.concatenate([[0], np.cumsum((low & 0xC0) != 0x80)])
    if begins[-1] != len(points):  # not UTF-8: bytes stand for characters
        return low.astype(np.uint32), offsets
    return points, begins[offsets]


def ngram_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, text of each): the distinct n-grams of each text, with a blank before and after it."""
    points, first = _characters(data, offsets)
    sizes = np.diff(first)
    # Lay texts out with a blank on both sides, so that words at the ends look like others.
    room = np.concatenate([[0], np.cumsum(sizes + 2)])
    row = np.repeat(np.arange(len(sizes)), sizes + 2)
    laid = np.full(room[-1], 32, np.uint64)
    laid[np.arange(len(points)) + np.repeat(2 * np.arange(len(sizes)) + 1, sizes)] = points
    laid[(laid >= 9) & (laid <= 13)] = 32
    keys = []
    value = mix(laid + U64(1))
    for n in ORDERS:
        m = len(laid) - n + 1
        if m <= 0:
            continue
        h = np.full(m, n, np.uint64)
        for i in range(n):
            h = h * U64(0x100000001B3) + value[i : i + m]
        inside = row[:m] == row[n - 1 :]
        keys.append((row[:m].astype(np.uint64) << U64(20) | mix(h) >> U64(44))[inside])
    if not keys:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    keys = np.sort(np.concatenate(keys))
    keep = np.ones(len(keys), bool)
    np.not_equal(keys[1:], keys[:-1], out=keep[1:])
    keys = keys[keep]
    return (keys & U64(BUCKETS - 1)).astype(np.int64), (keys >> U64(20)).astype(np.int64)


def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, data, offsets in slices(batch.column(1)):
            with np.errstate(over="ignore"):
                bucket, row = ngram_features(data, offsets)
            ends = np.searchsorted(row, np.arange(b - a + 1))
            x = [bucket[i:j].astype(np.int32).tobytes() for i, j in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(x, pa.binary())], names=["y", "x"])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """y, x -> bucket, y, n: how many texts of a class have a bucket."""
    for batch in batches:
        y = batch.column("y").to_numpy()
        rows = [np.frombuffer(x, np.int32) for x in batch.column("x").to_pylist()]
        for side in (0, 1):
            flat = np.concatenate([np.zeros(0, np.int32), *(r for r, c in zip(rows, y, strict=True) if c == side)])
            bucket, n = np.unique(flat, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(np.full(len(bucket), side, np.int32)), pa.array(n)], names=["bucket", "y", "n"])


def _odds(p: np.ndarray, q: np.ndarray, ones: int, others: int, least_z: float) -> np.ndarray:
    """Whether each bucket's log odds ratio is least_z standard errors from 0, if p of the toxic texts have it and q of the others."""
    a, b, c, d = p + 0.5, ones - p + 0.5, q + 0.5, others - q + 0.5
    return np.abs(np.log(a * d / (b * c))) >= least_z * np.sqrt(1 / a + 1 / b + 1 / c + 1 / d)


def _placed(used: np.ndarray):
    """y, x -> y, x: the places among ``used`` (rising) of the buckets of x that are there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x in batch.column("x").to_pylist():
                bucket = np.frombuffer(x, np.int32)
                at = np.minimum(np.searchsorted(used, bucket), max(0, len(used) - 1))
                out.append(at[used[at] == bucket].astype(np.int32).tobytes() if len(used) else b"")
            yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array(out, pa.binary())], names=["y", "x"])

    return run


def fit_rows(rows: list[np.ndarray], y: np.ndarray, importance: np.ndarray, used: np.ndarray, ratio: np.ndarray, *, rounds: int = 120, rate: float = 0.05, ridge: float = 1e-4) -> ToxicityModel:
    """Fit on each row's places in ``used``, the buckets that count, with their log ratios. Without rows of both classes the score is their smoothed share for any text."""
    if not len(y) or y.min() == y.max():
        share = (y.sum() + 1) / (len(y) + 2)
        return ToxicityModel(np.zeros(BUCKETS, np.float32), float(np.log(share / (1 - share))))
    flat, owner = np.concatenate(rows), np.repeat(np.arange(len(y)), [len(r) for r in rows])
    scale = ratio / np.sqrt(max(1.0, len(flat) / len(y))) * 4
    importance = importance / importance.sum()
    w, b = np.full(len(used), 0.05), 0.0
    m, v = np.zeros(len(used) + 1), np.zeros(len(used) + 1)
    for t in range(1, rounds + 1):
        z = np.bincount(owner, weights=(w * scale)[flat], minlength=len(y)) + b
        error = importance * (1 / (1 + np.exp(-np.clip(z, -50, 50))) - y)
        gradient = np.append(np.bincount(flat, weights=error[owner], minlength=len(used)) * scale + ridge * w, error.sum())
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    weights = np.zeros(BUCKETS, np.float32)
    weights[used] = w * scale
    return ToxicityModel(weights, float(b))


def fit(docs: DataFrame, labels: DataFrame, *, per_class: int = PER_CLASS, folds: int = 3, held_out: int = 1, least_z: float = LEAST_Z) -> ToxicityModel:
    """Learn ``labels.toxic`` from at most ``per_class`` texts of each class outside the held-out fold, of training.CLASS_BYTES in all.

    Buckets are counted by class in the cluster, and only those that count come to the driver, at most BUCKETS with their counts,
    and of each text its places among them.
    Defined cases: null texts are empty ones; ids without a text aren't learnt from; labels that are null or neither 0 nor 1 are left
    aside, and of labels that differ for one id 1 counts; without both classes the score is their smoothed share (0.5
    without any) for every text; other columns are left aside.
    """
    scratch = Scratch(docs.sparkSession)
    sample, totals = labelled_sample(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), labels, "toxic", per_class=per_class, folds=folds, held_out=held_out)
    features = scratch.write(sample.select("y", "text").mapInArrow(_featurise, "y int, x binary"), "features")
    sizes = {int(r["y"]): int(r["n"]) for r in features.groupBy("y").agg(F.count("*").alias("n")).collect()}
    side = lambda c: F.coalesce(F.sum(F.when(F.col("y") == c, F.col("n"))), F.lit(0)).cast("long")
    counts = scratch.write(features.mapInArrow(_counted, "bucket int, y int, n long").groupBy("bucket").agg(side(1).alias("p"), side(0).alias("q")), "counts")
    all_p, all_q = counts.agg(F.coalesce(F.sum("p"), F.lit(0)), F.coalesce(F.sum("q"), F.lit(0))).first()

    def clear(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p, q = (batch.column(c).to_numpy().astype(np.float64) for c in ("p", "q"))
            yield batch.filter(pa.array(_odds(p, q, sizes.get(1, 0), sizes.get(0, 0), least_z)))

    kept = counts.mapInArrow(clear, counts.schema).toArrow().sort_by("bucket")
    used, p, q = (kept[c].to_numpy() for c in ("bucket", "p", "q"))
    ratio = np.log((p + 1) / (all_p + BUCKETS) * (all_q + BUCKETS) / (q + 1))
    got = features.mapInArrow(_placed(used), "y int, x binary").collect()
    scratch.drop(features, counts)
    got.sort(key=lambda x: (x["y"], bytes(x["x"])))
    y = np.array([x["y"] for x in got], np.float64)
    share = {c: totals.get(c, 0) / max(1, (y == c).sum()) for c in (0, 1)}
    return fit_rows([np.frombuffer(x["x"], np.int32) for x in got], y, np.array([share[int(c)] for c in y]), used, ratio)


def score(docs: DataFrame, model: ToxicityModel, *, folds: int = 3, held_out: int = 1, threshold: float = 0.7) -> DataFrame:
    """Score every whole text.

    Returns one row per row of docs: doc_id, held_out, score (0 to 1) and predicted (1 if score >= threshold).
    Defined cases: a null or empty text is scored on the blanks around it, that is by the bias; a null doc_id is in
    fold 0; an empty table gives an empty one; other columns are left aside.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = shared.value
        for batch in batches:
            out = []
            for a, b, data, offsets in slices(batch.column("text")):
                with np.errstate(over="ignore"):
                    bucket, row = ngram_features(data, offsets)
                z = np.bincount(row, weights=weights[bucket], minlength=b - a) + bias
                out.append(1 / (1 + np.exp(-np.clip(z, -50, 50))))
            s = np.concatenate([*out, np.zeros(0)])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (remainder(F.col("doc_id").cast("long"), folds) == held_out).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
