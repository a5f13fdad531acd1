"""The first rows of a result, by number or by bytes, in the order of the input.

Places are counted as two levels: sums by block of input, then running sums before each block. Only the block in which the cap falls is
looked at row by row; blocks before it are kept and those after it left out as they are. So there is no sort of all rows, no order column, and no task that
all rows go through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..steps import Steps

_PLACE = ("loom_file", "loom_start", "loom_task")


def _placed(df: DataFrame, amount: Column) -> tuple[DataFrame, DataFrame]:
    """(rows with their block, place and amount, written once; sums of the blocks with what is before each). Blocks are pieces of files, or tasks where rows
    come from no file; their number is that of tasks, so one window over them is small."""
    rows = df.withColumns({"loom_file": F.input_file_name(), "loom_start": F.input_file_block_start(), "loom_task": F.spark_partition_id(), "loom_at": F.monotonically_increasing_id(), "loom_amount": amount})
    rows = Steps(df.sparkSession).write(rows)
    sums = rows.groupBy(*_PLACE).agg(F.sum("loom_amount").alias("loom_sum"))
    upto = Window.orderBy(*_PLACE).rowsBetween(Window.unboundedPreceding, -1)
    return rows, sums.withColumn("loom_before", F.coalesce(F.sum("loom_sum").over(upto), F.lit(0)))


def _upto(rows: DataFrame, sums: DataFrame, most: int) -> DataFrame:
    """The rows whose amount, added to all before, is at most ``most``."""
    blocks = sums.where(F.col("loom_before") < most) if most > 0 else sums.limit(0)
    met = rows.join(blocks, list(_PLACE))
    whole = met.where(F.col("loom_before") + F.col("loom_sum") <= most)
    running = F.sum("loom_amount").over(Window.partitionBy(*_PLACE).orderBy("loom_at"))
    cut = met.where(F.col("loom_before") + F.col("loom_sum") > most).withColumn("loom_upto", F.col("loom_before") + running).where(F.col("loom_upto") <= most)
    return whole.unionByName(cut.drop("loom_upto"))


def first_rows(df: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` rows in the order of the input: by file, place in it, and row. A limit of 0 or less keeps none."""
    rows, sums = _placed(df, F.lit(1))
    return _upto(rows, sums, limit).select(*df.columns)


def _json(value: Column) -> Column:
    """A value as it stands in compact JSON."""
    one = F.to_json(F.array(value))
    return F.substring(one, F.lit(2), F.length(one) - 2)


def byte_budget(df: DataFrame, max_bytes: int, max_cell: int) -> DataFrame:
    """The first rows whose JSON arrays fit in ``max_bytes`` together, the first row always, with cells of text cut to ``max_cell`` characters.

    A cut cell ends in ``…(+N chars)``, N being what was left out; ``cut_cells`` is their number in the row, and the budget counts rows as they are cut.
    """
    texts = [c for c, kind in df.dtypes if kind == "string"]
    over = {c: F.coalesce(F.length(c) > max_cell, F.lit(False)) for c in texts}
    short = {c: F.when(over[c], F.concat(F.substring(c, 1, max_cell), F.lit("…(+"), (F.length(c) - max_cell).cast("string"), F.lit(" chars)"))).otherwise(F.col(c)) for c in texts}
    counted = sum((over[c].cast("int") for c in texts), F.lit(0)).alias("cut_cells")
    cut = df.select(*(short[c].alias(c) if c in short else F.col(c) for c in df.columns), counted)
    size = F.octet_length(F.concat(F.lit("["), F.concat_ws(",", *(_json(F.col(c)) for c in df.columns)), F.lit("]"))).cast("long")
    rows, sums = _placed(cut, size)
    first = rows.join(sums.orderBy(*_PLACE).limit(1), list(_PLACE)).orderBy("loom_at").limit(1)
    kept = _upto(rows, sums, max_bytes)
    missing = first.join(kept.select("loom_at"), "loom_at", "left_anti").select(*kept.columns)
    return kept.unionByName(missing).select(*cut.columns)
