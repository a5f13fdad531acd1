"""What the two text classifiers share: labelled rows to learn from, and held-out rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def remainder(doc_id: Column, divisor: int) -> Column:
    """crc32 of doc_id as text, modulo divisor; 0 for a null doc_id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % divisor, F.lit(0))


#: Bytes of text of each class that a model is fitted on, at most, and of one such text.
CLASS_BYTES, TEXT_BYTES = 16 << 20, 1 << 20


def labelled_sample(docs: DataFrame, labels: DataFrame, column: str, *, per_class: int, folds: int, held_out: int) -> tuple[DataFrame, dict[int, int]]:
    """The documents to learn from, with their label y, and the number of usable labels of each class.

    At most ``per_class`` labelled ids of each class, those with the least hash, which doesn't depend on order or
    partitioning, and in that order at most CLASS_BYTES of text, so what a driver fits on is bounded in rows and bytes; a text beyond
    TEXT_BYTES isn't learnt from. Ids in the held-out fold, null ids and labels other than 0 and 1 are left out; an id that is
    labelled twice counts as 1 if any label says so; of rows that repeat a doc_id the one with the least text is
    taken. The ids are at most 2 * per_class, so they are broadcast.
    """
    usable = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("int").alias("y"))
        .where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & (remainder(F.col("doc_id"), folds) != held_out))
        .groupBy("doc_id")
        .agg(F.max("y").alias("y"))
    )
    totals = {int(x["y"]): int(x["n"]) for x in usable.groupBy("y").agg(F.count("*").alias("n")).collect()}
    order = F.xxhash64("doc_id")
    ids = usable.where("y = 0").orderBy(order, "doc_id").limit(per_class).unionByName(usable.where("y = 1").orderBy(order, "doc_id").limit(per_class))
    others = [c for c in docs.columns if c != "doc_id"]
    found = docs.withColumn("size", F.coalesce(F.octet_length("text"), F.lit(0))).where(F.col("size") <= TEXT_BYTES).join(F.broadcast(ids), "doc_id")
    one = found.groupBy("doc_id", "y").agg(F.min(F.struct("text", *(c for c in others if c != "text"), "size")).alias("x")).select("doc_id", "y", "x.*")
    before = F.sum("size").over(Window.partitionBy("y").orderBy(order, "doc_id"))
    return one.withColumn("before", before).where(F.col("before") <= CLASS_BYTES).drop("before", "size"), totals
