"""Saved questions: pinned reads, run again, and whether their answers changed."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import dialect
from . import gate

KEPT_RUNS = 100
RUNS_SCHEMA = "question string, at timestamp, statements array<string>, digests array<string>, ok boolean, error string, changed boolean"


@dataclass
class SavedQuestion:
    name: str
    statements: list[str] = field(default_factory=list)


def run_saved(spark: SparkSession, question: SavedQuestion, runs: DataFrame, at: datetime | None = None) -> DataFrame:
    """The history with one more run. Each statement must be one read. changed: whether the digests differ from those of
    the last run that went well with the same statements; null if there is none. The newest KEPT_RUNS runs of a question stay,
    and its newest good one."""
    at = at or datetime.now(timezone.utc)
    digests, error = [], None
    try:
        for text in question.statements:
            if gate.check(spark, text) != gate.READ:
                raise gate.Refused("only reads can be saved")
            digests.append(gate.result_digest(dialect.run(spark, text)))
    except Exception as e:  # noqa: BLE001  a failed run is part of the history
        error, digests = str(e).splitlines()[0][:500], []
    last = runs.where((F.col("question") == question.name) & F.col("ok") & (F.col("statements") == F.array(*map(F.lit, question.statements)))).orderBy(F.desc("at")).limit(1).collect()
    changed = None if error or not last else list(last[0]["digests"]) != digests
    row = spark.createDataFrame([(question.name, at, question.statements, digests, error is None, error, changed)], RUNS_SCHEMA)
    every = runs.unionByName(row)
    newest = Window.partitionBy("question").orderBy(F.desc("at"))
    good = Window.partitionBy("question", "ok").orderBy(F.desc("at"))
    ranked = every.withColumn("r", F.row_number().over(newest)).withColumn("g", F.row_number().over(good))
    return ranked.where((F.col("r") <= KEPT_RUNS) | (F.col("ok") & (F.col("g") == 1))).drop("r", "g")
