"""String similarity as Arrow functions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F


def jaro(a: str, b: str) -> float:
    """Jaro similarity: matches within half the longer length, and half the matches that are out of order, rounded down."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    taken, hits = [False] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == c:
                taken[j] = True
                hits.append(c)
                break
    if not hits:
        return 0.0
    other = [c for c, t in zip(b, taken, strict=True) if t]
    swapped = sum(x != y for x, y in zip(hits, other, strict=True)) // 2
    m = len(hits)
    return (m / len(a) + m / len(b) + (m - swapped) / m) / 3


def jaro_winkler(a: str | None, b: str | None) -> float | None:
    """Jaro-Winkler similarity: a common prefix of up to 4 characters adds a tenth each of what is missing, from 0.7 up."""
    if a is None or b is None:
        return None
    s = jaro(a, b)
    if s <= 0.7:
        return s
    prefix = 0
    for x, y in zip(a[:4], b[:4], strict=False):
        if x != y:
            break
        prefix += 1
    return s + prefix * 0.1 * (1 - s)


def jaro_winkler_udf():
    """``jaro_winkler`` on columns, a batch at a time."""

    @F.pandas_udf("double")
    def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([jaro_winkler(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")

    return similarity
