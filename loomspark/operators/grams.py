"""Substring search over texts, and similar labels, through postings of character grams.

A text that holds a string holds all its trigrams, so the rarest of these leave few texts to be looked at. The same for labels similar under Jaro-Winkler:
``similarity`` tells how many characters, counted with repetition, a label of each length must share with the text asked for; so of the text's rarest
characters, all but that many and TOGETHER more, it has TOGETHER. What postings leave over is always verified on the text itself.

Postings are sorted by gram, within BUCKETS folders by hash of it: a search reads row groups of its few grams only.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..steps import buckets_of
from .similarity import EDGE
from .strings import jaro_winkler

BUCKETS = 16
#: Postings that a task sorts: they take about 100 bytes each there.
SORTED = 1 << 21
#: Lists of the rarest grams that a substring search intersects.
LISTS = 3
SUGGEST = 0.88
#: Rare characters that a similar label must have at once.
TOGETHER = 3


def trigrams(text: Column) -> Column:
    """Distinct trigrams of a text."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?s)(?=(.{3}))"), F.lit(1)))


def _bucketed(postings: DataFrame, most: int) -> DataFrame:
    """Postings, ``most`` at most, in order of gram within their buckets. Each bucket is dealt by id, so that a task sorts about SORTED postings however many there are."""
    parts = max(1, -(-most // SORTED))
    slices = -(-4 * parts // BUCKETS)
    dealt = postings.withColumn("bucket", F.pmod(F.xxhash64("gram"), F.lit(BUCKETS)).cast("int"))
    return dealt.repartition(parts, "bucket", F.pmod(F.xxhash64("id"), F.lit(slices))).sortWithinPartitions("bucket", "gram")


def _write(postings: DataFrame, path: str, most: int) -> None:
    """Postings, and how many there are of each gram, counted from what was written."""
    _bucketed(postings, most).write.partitionBy("bucket").parquet(f"{path}/postings")
    counts = postings.sparkSession.read.parquet(f"{path}/postings").groupBy("gram").agg(F.count("*").alias("n"))
    counts.repartitionByRange("gram").sortWithinPartitions("gram").write.parquet(f"{path}/counts")


def _asked(spark: SparkSession, grams: Sequence[str]) -> Column:
    """The condition on postings of some grams."""
    places = buckets_of(spark, list(grams), BUCKETS)
    return F.col("bucket").isin(places) & F.col("gram").isin(list(grams))


def _counts(spark: SparkSession, path: str, grams: Sequence[str]) -> dict[str, int]:
    return {r["gram"]: r["n"] for r in spark.read.parquet(f"{path}/counts").where(F.col("gram").isin(list(grams))).collect()}


# Texts


def write_text_index(texts: DataFrame, path: str, *, key: str, text: str) -> None:
    """Write the trigram postings of texts below path. Null and shorter texts have none."""
    # An explode that isn't outer would be preceded by a filter that makes all trigrams once more.
    listed = texts.select(F.col(key).alias("id"), F.explode_outer(trigrams(F.lower(text))).alias("gram")).where("gram is not null")
    _write(listed, path, texts.agg(F.coalesce(F.sum(F.length(text)), F.lit(0))).first()[0])


def holding(texts: DataFrame, wanted: str, path: str, *, key: str, text: str) -> DataFrame:
    """The rows of texts whose text holds ``wanted`` in any case. Fewer than three characters have no trigram: then all texts are read."""
    spark = texts.sparkSession
    lowered, grams = spark.range(1).select(F.lower(F.lit(wanted)).alias("w")).select("w", trigrams(F.col("w"))).first()
    fits = F.lower(text).contains(lowered)
    if not grams:
        return texts.where(fits)
    n = _counts(spark, path, grams)
    if len(n) < len(grams):
        return texts.limit(0)
    rare = sorted(grams, key=lambda g: (n[g], g))[:LISTS]
    lists = spark.read.parquet(f"{path}/postings").where(_asked(spark, rare))
    found = lists.groupBy("id").agg(F.count("*").alias("n")).where(F.col("n") == len(rare)).select(F.col("id").alias(key))
    return texts.join(found, key, "left_semi").where(fits)


# Labels


def _letters(label: str) -> list[str]:
    """The characters of a label, each with its number among equal ones."""
    seen: dict[str, int] = {}
    out = []
    for c in label:
        seen[c] = seen.get(c, 0) + 1
        out.append(f"{c}{seen[c]}")
    return out


def write_label_index(nodes: DataFrame, path: str) -> None:
    """Write the postings of nodes' labels (id, class_id, label, normalized_label) below path: trigrams, numbered characters with the label's length, and whole labels."""
    rows = nodes.where("normalized_label is not null and normalized_label != ''").select("id", "class_id", "label", "normalized_label")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array([_letters(t) for t in batch.column("t").to_pylist()], pa.list_(pa.string()))], names=["row", "letters"])

    schema = rows.schema.simpleString()
    lettered = rows.select(F.struct("*").alias("row"), F.col("normalized_label").alias("t")).mapInArrow(run, f"row {schema}, letters array<string>")
    marked = F.concat(F.transform("letters", lambda x: F.concat(F.lit("c"), x)), F.transform(trigrams(F.col("row.normalized_label")), lambda x: F.concat(F.lit("g"), x)), F.array(F.concat(F.lit("="), F.col("row.normalized_label"))))
    listed = lettered.select("row.*", F.length("row.normalized_label").alias("length"), F.explode(marked).alias("gram"))
    # A label has two postings for each of its characters and one for itself at most.
    _write(listed, path, rows.agg(F.coalesce(F.sum(2 * F.length("normalized_label") + 1), F.lit(0))).first()[0])


def needed(length: int, other: int, alike: float = SUGGEST) -> int:
    """Characters that two strings of these lengths share at least, if they are as similar as ``alike``; more than either has if they can't be."""
    least = (alike - EDGE - 0.4) / 0.6
    return math.ceil((3 * least - 1) * length * other / (length + other) - 1e-6)


def candidates(spark: SparkSession, path: str, wanted: str, *, alike: float = SUGGEST) -> DataFrame:
    """(id, class_id, label, normalized_label) of all labels that may hold ``wanted``, be held by it or be as similar; each once."""
    letters, n = _letters(wanted), len(wanted)
    grams = sorted({wanted[i : i + 3] for i in range(n - 2)})
    counts = _counts(spark, path, [f"c{x}" for x in letters] + [f"g{x}" for x in grams])
    rare = sorted(letters, key=lambda x: (counts.get(f"c{x}", 0), x))
    # Labels that hold the text hold its rarest trigram, or if it has none its rarest character; those that it holds are whole postings.
    holds = min((f"g{g}" for g in grams), key=lambda g: (counts.get(g, 0), g)) if grams else f"c{rare[0]}"
    whole = sorted({holds, *(f"={wanted[i:j]}" for i in range(n) for j in range(i + 1, n + 1))})
    by_size: dict[tuple[int, int], list[int]] = {}
    for other in range(1, 4 * n + 4):
        shared = needed(n, other, alike)
        if shared <= min(n, other):
            least = min(shared, TOGETHER)
            by_size.setdefault((n - shared + least, least), []).append(other)
    is_whole = F.col("gram").isin(whole)
    is_letter = reduce(Column.__or__, (F.col("gram").isin([f"c{x}" for x in rare[:size]]) & F.col("length").isin(lengths) for (size, _), lengths in by_size.items()), F.lit(False))
    enough = reduce(lambda e, x: F.when(F.col("length").isin(x[1]), x[0][1]).otherwise(e), by_size.items(), F.lit(n + 1))
    hits = spark.read.parquet(f"{path}/postings").where(_asked(spark, sorted({*whole, *(f"c{x}" for x in letters)})) & (is_whole | is_letter))
    met = hits.groupBy("id", "class_id", "label", "normalized_label", "length").agg(F.max(is_whole).alias("whole"), F.count(F.when(is_letter, 1)).alias("letters"))
    return met.where(F.col("whole") | (F.col("letters") >= enough)).select("id", "class_id", "label", "normalized_label")


def scored(found: DataFrame, wanted: str, *, alike: float = SUGGEST) -> DataFrame:
    """found with similarity, null where the characters in common already rule out ``alike`` and neither string holds the other."""
    n, letters = len(wanted), set(_letters(wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for label in batch.column("normalized_label").to_pylist():
                near = label in wanted or wanted in label or len(letters & set(_letters(label))) >= needed(n, len(label), alike)
                out.append(jaro_winkler(label, wanted) if near else None)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.float64())], names=[*batch.schema.names, "similarity"])

    return found.mapInArrow(run, f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in found.schema)}, similarity double")
