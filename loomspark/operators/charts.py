"""Small chart data from a result: labels in the order they come, and a list of numbers for each series."""

from __future__ import annotations

from pyspark.sql import DataFrame

MOST_POINTS, MOST_SERIES = 200, 8


def from_rows(df: DataFrame, *, x: str, y: str, series: str | None = None, title: str = "", kind: str = "bar") -> dict:
    """title, kind, labels and series. A missing or null value is 0; of a repeated label the last value counts."""
    rows = df.limit(MOST_POINTS * MOST_SERIES + 1).collect()
    labels: dict[str, int] = {}
    values: dict[str, dict[str, float]] = {}
    for r in rows:
        label, name = str(r[x]), str(r[series]) if series else y
        labels.setdefault(label, len(labels))
        values.setdefault(name, {})[label] = float(r[y]) if r[y] is not None else 0.0
    if len(labels) > MOST_POINTS or len(values) > MOST_SERIES:
        raise ValueError(f"a chart has {MOST_POINTS} points and {MOST_SERIES} series at most")
    return {"title": title, "kind": kind, "labels": list(labels), "series": [(n, [v.get(label, 0.0) for label in labels]) for n, v in values.items()]}
