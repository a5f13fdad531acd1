"""Cosine similarity of a column of vectors with a few query vectors."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F


def _matrix(vectors: pd.Series, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows that have a vector of that width, without nulls and not all 0; those vectors at length 1)."""
    ok = np.array([v is not None and len(v) == width for v in vectors], bool)
    rows = np.flatnonzero(ok)
    x = (np.concatenate(vectors.to_numpy()[rows]) if len(rows) else np.zeros(0)).astype(np.float64).reshape(len(rows), width)
    norm = np.sqrt((x * x).sum(1))
    good = np.isfinite(norm) & (norm > 0)
    return rows[good], x[good] / norm[good, None]


def _lists(vectors: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """As ``_matrix``, from the offsets of an Arrow list column."""
    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    sizes = pc.fill_null(pc.list_value_length(vectors), -1).to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(sizes == width)
    x = vectors.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), width)
    norm = np.sqrt((x * x).sum(1))
    good = np.isfinite(norm) & (norm > 0)
    return rows[good], x[good] / norm[good, None]


def cosine(query: Sequence[float]):
    """A function of a vector column: its cosine similarity with ``query``; null where there is none, as everywhere if the query is all 0 or isn't finite."""
    q = np.asarray(query, np.float64)
    length = np.sqrt((q * q).sum())
    q = q / length if np.isfinite(length) and length > 0 else np.full(len(q), np.nan)

    @F.arrow_udf("double")
    def similarity(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for vectors in batches:
            rows, x = _lists(vectors, len(q))
            out = np.full(len(vectors), np.nan)
            out[rows] = x @ q
            yield pa.array(out, pa.float64(), mask=np.isnan(out))

    return similarity
