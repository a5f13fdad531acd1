"""The language of texts by character trigrams.

A profile is a table: for each trigram its log share in every language, smoothed, so a trigram costs one look-up whatever the number of languages. A text's trigrams are counted where it
is read; the different ones are looked up and summed by text, which combines before it shuffles; the texts themselves aren't shuffled. The language with the greatest sum is the text's; it is reliable if the
mean advantage over the next one is large enough for so many trigrams.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..steps import Steps

#: What is added to each count; trigrams from which a guess can be reliable, and the advantage a trigram that it then needs.
ADDED, LEAST_GRAMS, MARGIN = 0.5, 20, 0.05
#: Characters whose trigrams are counted at once.
AT_ONCE = 1 << 20


@dataclass
class Profiles:
    """grams: gram (its three code points, 21 bits each) and shares, log shares in the order of languages."""

    grams: DataFrame
    languages: tuple[str, ...]


def _letters(text: Column) -> Column:
    """A text in lower case, all that isn't a letter being one blank, with a blank at both ends."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}]+", " ")), F.lit(" "))


def _tally(groups: np.ndarray, lengths: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, gram, n) of texts whose code points stand one after the other; no gram goes over the end of a text."""
    seen = np.unique(points).astype(np.int64)
    letters, owner = np.searchsorted(seen, points), np.repeat(np.arange(len(lengths)), lengths)
    inside = owner[:-2] == owner[2:]
    k = len(seen)
    grams = ((letters[:-2] * k + letters[1:-1]) * k + letters[2:])[inside]
    width, names = max(k, 1) ** 3, None
    if (int(groups.max(initial=0)) + 1) * width >= 1 << 62:
        names, grams = np.unique(grams, return_inverse=True)
        width = max(len(names), 1)
    found, n = np.unique(groups[owner[:-2][inside]] * width + grams, return_counts=True)
    grams = found % width if names is None else names[found % width]
    return found // width, (seen[grams // (k * k)] << 42) | (seen[grams // k % k] << 21) | seen[grams % k], n


def _counted(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, gram, n): the trigrams of texts. A key may have several rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).dictionary_encode(null_encoding="encode")
            groups, ends = keys.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.cumsum(pc.utf8_length(batch.column(1)).to_numpy(zero_copy_only=False).astype(np.int64))
            first = 0
            while first < len(batch):
                start = ends[first - 1] if first else 0
                last = max(first + 1, int(np.searchsorted(ends, start + AT_ONCE, "right")))
                points = np.frombuffer("".join(batch.column(1)[first:last].to_pylist()).encode("utf-32-le"), np.uint32)
                group, gram, n = _tally(groups[first:last], np.diff(ends[first:last], prepend=start), points)
                yield pa.RecordBatch.from_arrays([keys.dictionary.take(pa.array(group)), pa.array(gram, pa.int64()), pa.array(n, pa.int64())], names=[key, "gram", "n"])
                first = last

    return texts.select(F.col(key), _letters(F.col(text)).alias("letters")).mapInArrow(run, f"`{key}` {dict(texts.dtypes)[key]}, gram long, n long")


def profiles(texts: DataFrame, *, text: str = "text", language: str = "lang") -> Profiles:
    """Profiles learnt from texts of known language. Null languages teach nothing."""
    steps = Steps(texts.sparkSession)
    grams = _counted(texts.where(F.col(language).isNotNull()).select(F.col(language).alias("language"), F.col(text).alias("text")), "language", "text")
    counts = steps.write(grams.groupBy("gram", "language").agg(F.sum("n").alias("n")))
    totals = {r["language"]: r["n"] for r in counts.groupBy("language").agg(F.sum("n").alias("n")).collect()}  # one row a language
    names = tuple(sorted(totals))
    wide = counts.groupBy("gram").agg(F.sum("n").alias("n"), *(F.coalesce(F.sum(F.when(F.col("language") == x, F.col("n"))), F.lit(0)).alias(f"n{i}") for i, x in enumerate(names)))
    distinct = wide.count()
    shares = [F.log((F.col(f"n{i}") + ADDED) / (totals[x] + ADDED * distinct)) for i, x in enumerate(names)]
    return Profiles(steps.write(wide.select("gram", F.array(*shares).cast("array<double>").alias("shares"))), names)


def detect(texts: DataFrame, known: Profiles, *, key: str, text: str = "text") -> DataFrame:
    """(key, language, n_grams, advantage, reliable) of every text, over its whole length.

    n_grams: trigrams that any profile has; advantage: how far the best language's log share is above the next one's, a trigram on average (null with one language).
    Defined cases: texts without known trigrams, null ones too, have a null language and aren't reliable; equal sums go to the first language by name; rows that share a
    key are one text.
    """
    count = len(known.languages)
    summed = _counted(texts, key, text).join(known.grams, "gram").groupBy(key).agg(F.sum("n").alias("n_grams"), *(F.sum(F.col("n") * F.col("shares")[i]).alias(f"s{i}") for i in range(count)))
    ranked = F.array_sort(F.array(*(F.struct((-F.col(f"s{i}")).alias("loss"), F.lit(x).alias("language")) for i, x in enumerate(known.languages)))) if count else F.array()
    if not count:
        return texts.select(key).distinct().select(key, F.lit(None).cast("string").alias("language"), F.lit(0).cast("long").alias("n_grams"), F.lit(None).cast("double").alias("advantage"), F.lit(False).alias("reliable"))
    best = summed.withColumn("r", ranked).select(key, F.col("r")[0]["language"].alias("language"), "n_grams", ((F.get("r", F.lit(1))["loss"] - F.col("r")[0]["loss"]) / F.col("n_grams")).alias("advantage"))
    out = texts.select(key).distinct().join(best, key, "left").withColumn("n_grams", F.coalesce("n_grams", F.lit(0)))
    return out.withColumn("reliable", F.coalesce((F.col("n_grams") >= LEAST_GRAMS) & (F.coalesce("advantage", F.lit(MARGIN)) >= MARGIN), F.lit(False)))
