"""Pairs of similar strings under Jaro-Winkler, without comparing all pairs.

Let m characters match, of strings with la and lb characters and p common first ones (4 at most). Jaro's similarity is at most
(m/la + m/lb + 1)/3, and reaches the limit s only if it is (s - p/10)/(1 - p/10) at least. So m has a lower bound that depends on la, lb and p alone,
and as m is at most the number of common characters, counted with repetition, the strings must share that many of
them. Beyond the p first ones o must be shared; among all but o - j of a string's characters, in any fixed order, j of these are (the prefix principle).
Each string is listed under every j of that many of its characters, the rarest first; strings with a common listing are
candidates, and the similarity of candidates is computed. j depends on the pair's lengths alone, so both sides have it.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .strings import jaro_winkler_udf

#: Slack for what floating point makes of a similarity at the limit.
EDGE = 1e-9
#: (length of the longer string, most characters that a listing has): more of them hold back more, but a long string has very many listings.
_LISTED = ((12, 4), (24, 3), (48, 2), (1 << 60, 1))
#: Letters from rare to common; others count as rarer.
_RARITY = {c: i for i, c in enumerate("zqxjkvbpgwyfmculdhrsnioate_ ", 1)}


@lru_cache(maxsize=1 << 14)
def listed(length: int, prefix: int, alike: float) -> tuple[tuple[int, int], ...]:
    """(j, how many of the characters after the prefix) that strings of this length are listed by: for partners of some lengths j of them are shared, and found among so many."""
    least = (alike - EDGE - prefix / 10) / (1 - prefix / 10)
    ratio = 3 * least - 1
    if ratio <= 1:
        raise ValueError("such a low limit bounds nothing")
    found: dict[int, int] = {}
    for other in range(max(1, math.floor(length * (ratio - 1))), math.ceil(length / (ratio - 1)) + 1):
        matches = math.ceil(ratio * length * other / (length + other) - 1e-6)
        if matches > min(length, other):
            continue
        shared = max(0, matches - prefix)
        j = min(shared, next(most for upto, most in _LISTED if max(length, other) <= upto))
        found[j] = max(found.get(j, 0), min(length - prefix, length - prefix - shared + j))
    return tuple(sorted(found.items()))


def keys(text: str, alike: float) -> list[int]:
    """64-bit keys; two strings as similar as ``alike`` have one in common."""
    out = set()
    for prefix in range(min(4, len(text)) + 1):
        kinds = listed(len(text), prefix, alike)
        if not kinds:
            continue
        seen: dict[str, int] = {}
        rest = []
        for c in text[prefix:]:
            seen[c] = seen.get(c, 0) + 1
            rest.append((-seen[c], _RARITY.get(c, 0), c))
        rest.sort()
        for j, size in kinds:
            for chosen in combinations(rest[:size], j):
                out.add(f"{prefix}{text[:prefix]}\0" + "\0".join(f"{c}{n}" for n, _, c in chosen))
    return [int.from_bytes(hashlib.blake2b(k.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True) for k in out]


def listings(texts: DataFrame, column: str, alike: float) -> DataFrame:
    """(column, key): each distinct non-empty string under all its keys. A table to keep where many strings are looked up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([keys(t, alike) for t in batch.column(0).to_pylist()], pa.list_(pa.int64()))], names=["t", "keys"])

    one = texts.select(F.col(column).cast("string").alias("t")).where("t != ''").distinct()
    return one.mapInArrow(run, "t string, keys array<bigint>").select(F.col("t").alias(column), F.explode("keys").alias("key"))


def near_lengths(a: Column, b: Column, alike: float) -> Column:
    """Whether two lengths allow the similarity at all: the shorter string matches whole at best."""
    ratio = 3 * (alike - EDGE - 0.4) / 0.6 - 1
    return F.least(a, b) >= (ratio - 1) * F.greatest(a, b) - 1e-6


def similar_pairs(left: DataFrame, right: DataFrame | None = None, *, alike: float) -> DataFrame:
    """(a, b, similarity) of all pairs of strings of left (text) and right (text) as similar as ``alike``; equal strings aside. Without right, pairs within left, a < b.

    Defined cases: null and empty strings pair with nothing; repeated strings count once; the limit must be above 0.8, below which the bounds hold nothing back.
    """
    ours = listings(left, "text", alike).withColumnRenamed("text", "a")
    theirs = (ours if right is None else listings(right, "text", alike)).toDF("b", "key")
    fits = F.col("a") < F.col("b") if right is None else F.col("a") != F.col("b")
    met = ours.join(theirs, "key").where(fits & near_lengths(F.length("a"), F.length("b"), alike)).select("a", "b").distinct()
    return met.withColumn("similarity", jaro_winkler_udf()("a", "b")).where(F.col("similarity") >= alike - EDGE)
