"""Intermediate tables in the folder that driver and executors share.

Every multi-step operator cuts its lineage by writing Parquet below ``spark.checkpoint.dir``. A lost
executor then costs the tasks that were running, never a recomputation of the steps before.
"""

from __future__ import annotations

import atexit
import contextlib
import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The URI in ``spark.checkpoint.dir``; where that is unset in local mode (tests), one temporary folder for each process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    if "dir" not in _OWN:
        _OWN["dir"] = tempfile.mkdtemp(prefix="loomspark-")
        atexit.register(_remove_local, _OWN["dir"])
    return f"file://{_OWN['dir']}"


def _remove_local(path: str) -> None:
    import shutil

    shutil.rmtree(path, ignore_errors=True)


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/loomspark-{os.getpid()}/{name}-{uuid.uuid4().hex[:12]}"


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    with contextlib.suppress(Exception):
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def tasks_for(spark: SparkSession, amount: int, most: int, least: int) -> int:
    """Partitions for work of ``amount``: at most ``most`` of it in each, and if it is little, as many as keep all cores busy with ``least`` each."""
    return max(1, -(-amount // most), min(-(-amount // least), 2 * spark.sparkContext.defaultParallelism))


class Scratch:
    """Tables of one run of an operator. ``drop`` frees one early; the rest go when the process ends, as results are lazy and read them."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.paths: list[str] = []
        atexit.register(self._at_exit)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """Write df and read it back. The shuffle files behind it go as soon as it is written."""
        path = new_path(self.spark, name)
        before = self.spark.conf.get(_CLEANUP, "false")
        self.spark.conf.set(_CLEANUP, "true")
        try:
            df.write.parquet(path)
        finally:
            self.spark.conf.set(_CLEANUP, before)
        self.paths.append(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for df in tables:
            path = getattr(df, "_scratch_path", None)
            if path in self.paths:
                remove(self.spark, path)
                self.paths.remove(path)

    def _at_exit(self) -> None:
        with contextlib.suppress(Exception):
            for path in self.paths:
                remove(self.spark, path)
