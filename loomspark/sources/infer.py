"""Types of text columns, as workbook and tabular cells are read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPARK_TYPES = {"BIGINT": "bigint", "DOUBLE": "double", "BOOLEAN": "boolean", "DATE": "date", "TIMESTAMP": "timestamp_ntz", "VARCHAR": "string"}
_INT = r"^[+-]?\d{1,19}$"
_FLOAT = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
_DATE = r"^\d{4}-\d{2}-\d{2}$"
_TIME = r"^\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}(:\d{2}(\.\d{1,9})?)?$"


def cell_kind(cell: Column) -> Column:
    """The type of one cell: null if blank; a 64-bit integer, a finite number, true or false, an ISO date, an ISO date and time, or text."""
    x = F.trim(cell)
    return (
        F.when(cell.isNull() | (x == ""), None)
        .when(x.rlike(_INT) & x.try_cast("bigint").isNotNull(), "BIGINT")
        .when(x.rlike(_FLOAT) & (F.abs(x.try_cast("double")) < float("inf")), "DOUBLE")
        .when(F.lower(x).isin("true", "false"), "BOOLEAN")
        .when(x.rlike(_DATE) & x.try_cast("date").isNotNull(), "DATE")
        .when(x.rlike(_TIME) & F.replace(x, F.lit("T"), F.lit(" ")).try_cast("timestamp_ntz").isNotNull(), "TIMESTAMP")
        .otherwise("VARCHAR")
    )


def agreed(kinds: set[str]) -> str:
    """The one type that a column's cells agree on: numbers widen to DOUBLE, dates to TIMESTAMP, anything else is text."""
    if len(kinds) == 1:
        return next(iter(kinds))
    if kinds == {"BIGINT", "DOUBLE"}:
        return "DOUBLE"
    return "TIMESTAMP" if kinds == {"DATE", "TIMESTAMP"} else "VARCHAR"


def infer_types(df: DataFrame) -> dict[str, str]:
    """The type of each text column, in one pass that gathers at most six names a column."""
    got = df.agg(*(F.collect_set(cell_kind(F.col(f"`{c}`"))).alias(f"k{i}") for i, c in enumerate(df.columns))).first()
    return {c: agreed(set(got[i])) for i, c in enumerate(df.columns)}


def typed(df: DataFrame, types: dict[str, str] | None = None) -> DataFrame:
    """Text columns cast to their inferred types; blank cells are null, also in text columns."""
    types = types or infer_types(df)
    out = []
    for c in df.columns:
        x = F.trim(F.col(f"`{c}`"))
        cell = F.when(x == "", None).otherwise(F.replace(x, F.lit("T"), F.lit(" ")) if types[c] == "TIMESTAMP" else x if types[c] != "VARCHAR" else F.col(f"`{c}`"))
        out.append(cell.try_cast(SPARK_TYPES[types[c]]).alias(c))
    return df.select(*out)


def whole_floats(value: float | None) -> int | float | None:
    """A workbook's number: a whole one under 9e15 as an integer."""
    return int(value) if value is not None and value == value and abs(value) < 9e15 and value == int(value) else value
