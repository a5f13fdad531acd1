"""Results out: CSV, NDJSON, a JSON array, aligned and Markdown tables; tables replaced as a whole."""

from __future__ import annotations

import csv
import json
import uuid
from base64 import b64encode
from collections.abc import Iterator
from datetime import date, datetime
from decimal import Decimal
from math import isfinite
from typing import TextIO

from pyspark.sql import DataFrame, Row


def cell(x):
    """A value as it is shown: NaN and infinities as null, decimals as numbers if a double holds their digits, binary as base64, times in ISO form
    with microseconds only if there are any."""
    if isinstance(x, float):
        return x if isfinite(x) else None
    if isinstance(x, Decimal):
        return float(x) if Decimal(repr(float(x))) == x else format(x.normalize(), "f")
    if isinstance(x, datetime):
        return x.replace(tzinfo=None).isoformat(" ")
    if isinstance(x, date):
        return x.isoformat()
    if isinstance(x, (bytes, bytearray)):
        return b64encode(x).decode()
    if isinstance(x, Row):
        return {k: cell(v) for k, v in x.asDict().items()}
    if isinstance(x, dict):
        return {str(k): cell(v) for k, v in x.items()}
    return [cell(v) for v in x] if isinstance(x, (list, tuple)) else x


def _text(x) -> str:
    x = cell(x)
    return "" if x is None else x if isinstance(x, str) else json.dumps(x, ensure_ascii=False) if isinstance(x, (dict, list, bool)) else str(x)


def _rows(df: DataFrame) -> Iterator[Row]:
    """A partition at a time, in order; the driver never holds the whole result."""
    return df.toLocalIterator()


def to_csv(df: DataFrame, out: TextIO) -> int:
    w = csv.writer(out, lineterminator="\n")
    w.writerow(df.columns)
    n = 0
    for n, r in enumerate(_rows(df), 1):
        w.writerow([_text(x) for x in r])
    return n


def to_ndjson(df: DataFrame, out: TextIO) -> int:
    n = 0
    for n, r in enumerate(_rows(df), 1):
        out.write(json.dumps({c: cell(x) for c, x in zip(df.columns, r, strict=True)}, ensure_ascii=False) + "\n")
    return n


def to_json_array(df: DataFrame, out: TextIO) -> int:
    n = 0
    out.write("[")
    for n, r in enumerate(_rows(df), 1):
        out.write((",\n" if n > 1 else "\n") + json.dumps({c: cell(x) for c, x in zip(df.columns, r, strict=True)}, ensure_ascii=False))
    out.write("\n]\n")
    return n


def to_markdown(df: DataFrame, limit: int = 100) -> str:
    shown = lambda x: "NULL" if x is None else _text(x).replace("|", "\\|").replace("\n", " ")
    lines = ["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    return "\n".join([*lines, *("| " + " | ".join(map(shown, r)) + " |" for r in df.limit(limit).collect())])


def to_aligned(df: DataFrame, limit: int = 100) -> str:
    rows = [df.columns, *(["NULL" if x is None else _text(x).replace("\n", " ") for x in r] for r in df.limit(limit).collect())]
    widths = [max(len(r[i]) for r in rows) for i in range(len(df.columns))]
    return "\n".join("  ".join(c.ljust(w) for c, w in zip(r, widths, strict=True)).rstrip() for r in rows)


def write_folder(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """In parallel, a file for each partition."""
    df.write.mode("overwrite").format(kind).option("header", True).save(path)


def replace_table(df: DataFrame, path: str) -> None:
    """Swap a stored table for df, which may read the old one: it is written beside it and renamed. If writing fails, nothing of it stays and the old table does."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    staged, old, new = (jvm.org.apache.hadoop.fs.Path(p) for p in (f"{path}.{uuid.uuid4().hex[:8]}", f"{path}.old", path))
    fs = new.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    try:
        df.write.parquet(staged.toString())
    except Exception:
        fs.delete(staged, True)
        raise
    fs.delete(old, True)
    if fs.exists(new):
        fs.rename(new, old)
    fs.rename(staged, new)
    fs.delete(old, True)
