"""Tables found inside documents, loaded as tables of their own: ``<stem>_tableN``.

A corpus holds very many small tables, each with columns of its own. Their types are worked out together, as one aggregate by table and column over the lattice
of kinds, and their rows are one write, partitioned by table. A table read back is its partition with its columns taken out of the cells and cast.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.names import header_names
from .infer import SPARK_TYPES, cell_kind

#: Rows from which a table inside a document is loaded.
LEAST_ROWS = 20


def _cells(line: Column) -> Column:
    """The cells of a line of a Markdown table; ``\\|`` is a bar within a cell."""
    inner = F.regexp_replace(F.trim(line), r"^\||(?<!\\)\|$", "")
    return F.transform(F.split(inner, r"(?<!\\)\|"), lambda c: F.replace(F.trim(c), F.lit("\\|"), F.lit("|")))


def _agreed(kinds: Column) -> Column:
    """``infer.agreed`` of a set of kinds as an expression; a column of blank cells is text."""
    within = lambda *allowed: F.size(F.array_except(kinds, F.array(*map(F.lit, allowed)))) == 0
    return F.when(F.size(kinds) == 0, "VARCHAR").when(F.size(kinds) == 1, kinds[0]).when(within("BIGINT", "DOUBLE"), "DOUBLE").when(within("DATE", "TIMESTAMP"), "TIMESTAMP").otherwise("VARCHAR")


def _named(header: Column) -> Column:
    """Column names of a table's header."""

    @F.pandas_udf("array<string>")
    def names(headers: pd.Series) -> pd.Series:
        return headers.map(lambda cells: header_names(list(cells)))

    return names(header)


def find_tables(sections: DataFrame, key: str, stem: Column, *, least_rows: int = LEAST_ROWS) -> DataFrame:
    """(table_name, columns, rows): one row for each table in sections (``documents.sections``) with ``least_rows`` rows of data or more.

    stem: the document's name without its extension. The tables of a document are numbered from 1 in its order, those that are too small left out. Characters other than letters, digits and _
    become _. Documents of one stem share their names: give them different ones. Cells beyond the header's width go, missing ones are null.
    """
    tables = sections.where("kind = 'table'").select(F.col(key).alias("document"), "section", stem.alias("stem"), F.split("text", "\n").alias("lines"))
    tables = tables.where(F.size("lines") - 2 >= least_rows)
    numbered = tables.withColumn("n", F.row_number().over(Window.partitionBy("document").orderBy("section")))
    clean = F.regexp_replace("stem", r"(?U)[^\w]", "_")
    name = F.concat(F.when(clean == "", "imported").otherwise(clean), F.lit("_table"), "n")
    rows = F.transform(F.slice("lines", 3, F.greatest(F.size("lines") - 2, F.lit(1))), _cells)
    return numbered.select(name.alias("table_name"), _named(_cells(F.col("lines")[0])).alias("columns"), rows.alias("rows"))


def load_tables(found: DataFrame, path: str) -> DataFrame:
    """Write the tables of ``find_tables`` below path; (table_name, position, column_name, data_type) of their columns, read from what was written.

    One write of rows for all tables, one of columns. Blank cells are null.
    """
    spark = found.sparkSession
    rows = found.select("table_name", F.size("columns").alias("width"), F.posexplode("rows").alias("row", "cells"))
    blank = lambda c: F.when(F.trim(c) == "", None).otherwise(c)
    rows = rows.withColumn("cells", F.transform(F.sequence(F.lit(1), "width"), lambda i: blank(F.get(F.col("cells"), i - 1)))).drop("width")
    rows.repartition("table_name").sortWithinPartitions("table_name", "row").write.mode("overwrite").partitionBy("table_name").parquet(f"{path}/rows")
    written = spark.read.schema("row int, cells array<string>, table_name string").parquet(f"{path}/rows")
    kinds = written.select("table_name", F.posexplode("cells").alias("position", "cell")).groupBy("table_name", "position").agg(F.collect_set(cell_kind(F.col("cell"))).alias("kinds"))
    names = found.select("table_name", F.posexplode("columns").alias("position", "column_name"))
    columns = names.join(kinds, ["table_name", "position"], "left").select("table_name", "position", "column_name", _agreed(F.coalesce("kinds", F.array().cast("array<string>"))).alias("data_type"))
    columns.write.mode("overwrite").parquet(f"{path}/columns")
    return spark.read.parquet(f"{path}/columns")


def read_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """One loaded table with its types; reads its partition only."""
    columns = spark.read.parquet(f"{path}/columns").where(F.col("table_name") == name).orderBy("position").collect()
    if not columns:
        raise ValueError(f"no table {name}")
    rows = spark.read.schema("row int, cells array<string>, table_name string").parquet(f"{path}/rows").where(F.col("table_name") == name)
    return rows.select(*(_cast(F.get("cells", F.lit(c["position"])), c["data_type"]).alias(c["column_name"]) for c in columns))


def _cast(cell: Column, kind: str) -> Column:
    if kind == "VARCHAR":
        return cell
    text = F.trim(cell)
    return (F.replace(text, F.lit("T"), F.lit(" ")) if kind == "TIMESTAMP" else text).try_cast(SPARK_TYPES[kind])
