"""A training-data pipeline: quality, near duplicates, repeated passages, benchmark leaks, encoding.

Each stage is an operator of ``loomspark.llm`` over all that the stage before kept; what it decides takes effect. Stages
but the last return the columns of documents.

Defined cases of all stages: an empty table gives an empty one; columns beside doc_id and text pass through, whatever their names; rows without a doc_id
are judged by their text; each stage's own cases are with its function.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.llm import decontam, minhash, pieces, quality_fm, suffix_dedup
from loomspark.llm.queries import PIECES_MODEL
from loomspark.llm.scratch import Scratch


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learnt from ``labels``, rejects go. Null and empty texts are scored like any other; several rows of one doc_id are each judged by their text."""
    model = quality_fm.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_fm.score(docs, model, keep=True)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one with the least doc_id. Null and blank texts and rows without a doc_id stay; of rows that repeat doc_id and text one does."""
    return minhash.without_near_duplicates(docs, words=5, least_percent=80)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte strings that also start elsewhere are cut out of the texts. Null and short texts stay as they are; a text may become empty; rows that repeat doc_id and text are one row to it."""
    return suffix_dedup.without_repeats(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of ``benchmark`` go. Null and short texts hold none; items that share an item_id are each looked for; without items all documents stay."""
    return decontam.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str, model: str = PIECES_MODEL) -> DataFrame:
    """doc_id, n_pieces and ids of each text that is left, and round_trip: whether the ids decode to the text."""
    return pieces.encode_and_back(docs, model).select("doc_id", F.size("ids").alias("n_pieces"), "ids", "round_trip")


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("benchmark_leaks", benchmark_leaks),
    ("encoding", encoding),
]

#: A factorisation machine's training can't be written in SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again; the last one's rows."""
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        kept = scratch.write(stage(spark, docs, sf_dir), name)
        scratch.drop(docs)
        docs = kept
    return docs
