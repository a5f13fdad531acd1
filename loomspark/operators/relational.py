"""Relational operators that Spark lacks or orders differently, composed of DataFrame operations."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..steps import Steps


#: Rows of one key that an as-of join goes through in one task at most.
ASOF_ROWS = 4_000_000


def order_by(df: DataFrame, order: Sequence[tuple[str, bool]]) -> DataFrame:
    """Sort by (name, descending); nulls are last either way."""
    return df.orderBy(*(F.col(c).desc_nulls_last() if down else F.col(c).asc_nulls_last() for c, down in order))


def top_n_by(df: DataFrame, keys: Sequence[str], *, value: str, measure: str, n: int) -> DataFrame:
    """keys and ``top``: the values with the n greatest measures of each group, greatest first, ties by value.

    Rows are cut to n in each group before they are gathered, so no group's list exceeds n.
    """
    w = Window.partitionBy(*keys).orderBy(F.col(measure).desc_nulls_last(), F.col(value).desc_nulls_last())
    cut = df.select(*keys, value, measure).withColumn("loom_r", F.row_number().over(w)).where(F.col("loom_r") <= n)
    listed = F.transform(F.sort_array(F.collect_list(F.struct("loom_r", F.col(value).alias("loom_v")))), lambda x: x["loom_v"])
    return cut.groupBy(*keys).agg(listed.alias("top"))


def top_values(df: DataFrame, column: str, k: int) -> DataFrame:
    """(value, n): the k most frequent values, exactly, ties by value; nulls don't count."""
    counted = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    return counted.orderBy(F.col("n").desc(), F.col("value")).limit(k)


def asof_join(left: DataFrame, right: DataFrame, a: str, b: str, keys: Sequence[tuple[str, str]], left_at: str, right_at: str, op: str = ">=", how: str = "inner") -> DataFrame:
    """Each left row with the right row of equal keys that is nearest at or before it (op ``>=``, ``>``) or after it (``<=``, ``<``).

    The result has a struct column for each side, named a and b. Both sides are put in one order and the last right row
    is carried along by a window; no pairs are made. Where a key has more than ASOF_ROWS rows, or without an equal key, the order is cut into ranges: the
    window runs within each, and the last right row of each range, one row a key, is carried over to those that follow. Of right
    rows with one time the greatest, column by column, is taken.
    """
    forward, strict = op in (">=", ">"), op in (">", "<")
    key_names = [f"loom_k{i}" for i in range(len(keys))]
    lefts = left.select(*(F.col(x).alias(n) for (x, _), n in zip(keys, key_names, strict=True)), F.col(left_at).alias("loom_t"), F.struct(*left.columns).alias(a), F.lit(None).cast(right.select(F.struct(*right.columns)).schema[0].dataType).alias(b))
    rights = right.select(*(F.col(y).alias(n) for (_, y), n in zip(keys, key_names, strict=True)), F.col(right_at).alias("loom_t"), F.lit(None).cast(left.select(F.struct(*left.columns)).schema[0].dataType).alias(a), F.struct(*right.columns).alias(b))
    rights = rights.where(F.col("loom_t").isNotNull())
    # At equal times a right row comes before the left rows that may see it.
    rank = F.when(F.col(a).isNull(), 1 if strict else 0).otherwise(0 if strict else 1)
    time = F.col("loom_t").asc_nulls_last() if forward else F.col("loom_t").desc_nulls_last()
    tie = F.to_json(F.col(b)) if "map<" in right.select(F.struct(*right.columns)).dtypes[0][1] else F.col(b)
    both = lefts.unionByName(rights)
    upto = (Window.unboundedPreceding, Window.currentRow)
    most = both.groupBy(*key_names).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] if keys else None
    if keys and (most or 0) <= ASOF_ROWS:
        seen = both.withColumn("loom_b", F.last(b, ignorenulls=True).over(Window.partitionBy(*key_names).orderBy(time, rank, tie).rowsBetween(*upto)))
    else:
        ranges = both.repartitionByRange(*(F.col(n).asc() for n in key_names), time, rank)
        within = Window.partitionBy("loom_range", *key_names).orderBy(time, rank, tie)
        ranged = Steps(left.sparkSession).write(ranges.withColumn("loom_range", F.spark_partition_id()))
        seen = ranged.withColumn("loom_b", F.last(b, ignorenulls=True).over(within.rowsBetween(*upto)))
        ends = ranged.withColumn("loom_end", F.last(b, ignorenulls=True).over(within.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
        ends = ends.groupBy("loom_range", *key_names).agg(F.first("loom_end").alias("loom_end"))
        before = Window.partitionBy(*key_names).orderBy("loom_range").rowsBetween(Window.unboundedPreceding, -1)
        carried = ends.withColumn("loom_before", F.last("loom_end", ignorenulls=True).over(before)).drop("loom_end")
        seen = seen.join(carried, ["loom_range", *key_names], "left").withColumn("loom_b", F.coalesce("loom_b", "loom_before"))
    timed = F.col("loom_t").isNotNull()
    for n in key_names:
        timed = timed & F.col(n).isNotNull()
    out = seen.where(F.col(a).isNotNull()).select(a, F.when(timed, F.col("loom_b")).alias(b))
    return out if how == "left" else out.where(F.col(b).isNotNull())


def positional_join(left: DataFrame, right: DataFrame, a: str, b: str) -> DataFrame:
    """Rows side by side by their place in each input, the longer side with nulls; a struct column for each side.

    Places are kept as they come: each partition's rows are numbered from the count of those before, so no input
    goes through one task. An input is evaluated once, into a table, as a second evaluation may deal its rows otherwise.
    """
    steps = Steps(left.sparkSession)

    def numbered(df: DataFrame, name: str) -> DataFrame:
        part = df.select(F.struct(*df.columns).alias(name)).withColumn("loom_id", F.monotonically_increasing_id())
        part = steps.write(part)
        part = part.withColumn("loom_p", F.shiftright("loom_id", 33))
        counts = part.groupBy("loom_p").agg(F.count("*").alias("loom_n"))
        before = counts.withColumn("loom_before", F.coalesce(F.sum("loom_n").over(Window.orderBy("loom_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        return part.join(F.broadcast(before.drop("loom_n")), "loom_p").select((F.col("loom_before") + F.col("loom_id") - F.shiftleft("loom_p", 33)).alias("loom_place"), name)

    return numbered(left, a).join(numbered(right, b), "loom_place", "full").drop("loom_place")


def member_of_any(df: DataFrame, key: str, tests: Sequence[tuple[Column, DataFrame]]) -> DataFrame:
    """Rows that any of the semi joins finds, each once by ``key``: one equi-join for each test in place of an OR condition."""
    return functools.reduce(DataFrame.unionByName, (df.join(other, on, "left_semi") for on, other in tests)).dropDuplicates([key])


def groups_frame(df: DataFrame, partition: Sequence[str], order: str, aggregate: Column, before: int, after: int, name: str) -> DataFrame:
    """An aggregate over a GROUPS frame: the peer groups from ``before`` ahead to ``after`` behind, by rank of the group."""
    ranked = df.withColumn("loom_g", F.dense_rank().over(Window.partitionBy(*partition).orderBy(F.col(order).asc_nulls_last())))
    return ranked.withColumn(name, aggregate.over(Window.partitionBy(*partition).orderBy("loom_g").rangeBetween(-before, after))).drop("loom_g")


def summarize(df: DataFrame) -> DataFrame:
    """One row a column: column_name, column_type, non_null, null_share, distinct_values, min, max, mean (of numbers).

    One aggregate for all columns, unpivoted; only distinct counts are narrow aggregates, each of its column alone, so that they don't multiply the rows of one another.
    """
    kinds = dict(df.dtypes)
    numeric = {c for c, t in kinds.items() if t in ("tinyint", "smallint", "int", "bigint", "float", "double") or t.startswith("decimal")}
    columns, distinct = [], []
    for c in df.columns:
        x = F.col(f"`{c}`")
        plain = not kinds[c].startswith(("array", "map", "struct", "binary"))
        low, high = ((f(x).cast("string") if plain else F.lit(None).cast("string")) for f in (F.min, F.max))
        mean = F.avg(x.cast("double")) if c in numeric else F.lit(None).cast("double")
        share = F.when(F.count("*") > 0, 1 - F.count(x) / F.count("*"))
        columns.append(F.struct(F.lit(c).alias("column_name"), F.lit(kinds[c]).alias("column_type"), F.count(x).alias("non_null"), share.alias("null_share"), low.alias("min"), high.alias("max"), mean.alias("mean")))
        distinct.append(df.agg(F.lit(c).alias("column_name"), F.countDistinct(x if not kinds[c].startswith("map") else F.to_json(x)).alias("distinct_values")))
    rows = df.agg(F.array(*columns).alias("c")).select(F.explode("c").alias("c")).select("c.*")
    return rows.join(functools.reduce(DataFrame.unionByName, distinct), "column_name").select("column_name", "column_type", "non_null", "null_share", "distinct_values", "min", "max", "mean")


def capped(df: DataFrame, *, rows: int, count_on: int | None = 100_000) -> tuple[list[Row], int, bool]:
    """(the first rows, their number in all, whether that is exact): counting stops count_on rows beyond those kept; with None it goes on to the end."""
    if count_on is None:
        return df.limit(rows).collect(), df.count(), True
    total = df.limit(rows + count_on + 1).count()
    return df.limit(rows).collect(), min(total, rows + count_on), total <= rows + count_on


def cut_cell(text: str, most: int) -> str:
    """A cell of at most ``most`` characters, with a note of how many more there were."""
    return text if len(text) <= most else f"{text[:most]}…(+{len(text) - most} chars)"


def even_sample(df: DataFrame, group: str, key: str, limit: int) -> DataFrame:
    """About ``limit`` rows, as many from each group, spread evenly over it by ``key``: the rows at floor(k * size / take)."""
    groups = df.agg(F.countDistinct(group).alias("g")).first()["g"]
    quota = max(1, -(-limit // max(1, groups)))
    w = Window.partitionBy(group)
    ranked = df.withColumn("loom_k", F.row_number().over(w.orderBy(key)) - 1).withColumn("loom_n", F.count("*").over(w)).withColumn("loom_take", F.least("loom_n", F.lit(quota)))
    # Row k is taken if some p < take has p * n div take = k; the only candidate is the least p with p * n >= k * take.
    p = F.expr("(loom_k * loom_take + loom_n - 1) div loom_n")
    return ranked.where((p < F.col("loom_take")) & (F.expr("(((loom_k * loom_take + loom_n - 1) div loom_n) * loom_n) div loom_take") == F.col("loom_k"))).select(*df.columns)


def seeded_sample(df: DataFrame, key: str, n: int, *, seed: int) -> DataFrame:
    """n rows chosen by a seeded hash of ``key``: the same rows however the input is partitioned."""
    return df.orderBy(F.xxhash64(F.lit(seed), F.col(key)), key).limit(n)


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, n) of many tables in one job."""
    return functools.reduce(DataFrame.unionByName, (df.agg(F.lit(name).alias("name"), F.count("*").alias("n")) for name, df in tables.items()))


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """INSERT OR REPLACE: new rows win over old ones of equal keys; of new rows with equal keys any one stays."""
    return old.join(new.select(*keys), list(keys), "left_anti").unionByName(new.dropDuplicates(list(keys)), allowMissingColumns=True)


def insert_ignore(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """INSERT OR IGNORE / ON CONFLICT DO NOTHING: old rows win."""
    return old.unionByName(new.dropDuplicates(list(keys)).join(old.select(*keys), list(keys), "left_anti"), allowMissingColumns=True)


def update_from(df: DataFrame, changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """UPDATE ... FROM: the columns of changes replace those of df in rows with equal keys. Keys of changes must be unique."""
    names = [c for c in changes.columns if c not in keys]
    renamed = changes.select(*keys, *(F.col(c).alias(f"loom_{c}") for c in names), F.lit(True).alias("loom_hit"))
    out = df.join(renamed, list(keys), "left")
    return out.select(*(F.when(F.col("loom_hit"), F.col(f"loom_{c}")).otherwise(F.col(c)).alias(c) if c in names else F.col(c) for c in df.columns))


def append_row_number(df: DataFrame, order: Sequence[str], limit: int) -> DataFrame:
    """The first ``limit`` rows by an explicit order: a file's row cap with a defined result."""
    return df.orderBy(*order).limit(limit)
