"""Tables between the steps of an operator, in the folder that driver and executors share.

Writing a step cuts its lineage: a lost executor costs the tasks that ran, not the steps before.
"""

from __future__ import annotations

import atexit
import contextlib
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

try:
    import xxhash
except ImportError:
    xxhash = None

_OWN: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; one of the process's own where it is unset in local mode (as in tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith(("local[", "local")) or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    if "dir" not in _OWN:
        _OWN["dir"] = tempfile.mkdtemp(prefix="loomspark-steps-")
        atexit.register(shutil.rmtree, _OWN["dir"], ignore_errors=True)
    return f"file://{_OWN['dir']}"


def delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


class Steps:
    """The tables of one run. ``drop`` frees one early; the others stay until the process ends, as results are lazy and read them."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.paths = spark, {}
        atexit.register(self._end)

    def write(self, df: DataFrame) -> DataFrame:
        path = f"{shared_folder(self.spark)}/loomspark-{os.getpid()}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (path, out)
        return out

    def drop(self, *tables: DataFrame) -> None:
        for df in tables:
            if found := self.paths.pop(id(df), None):
                delete(self.spark, found[0])

    def _end(self) -> None:
        with contextlib.suppress(Exception):  # the session may have gone
            for path, _ in self.paths.values():
                delete(self.spark, path)


def buckets_of(spark: SparkSession, texts: list[str], count: int) -> list[int]:
    """The buckets that ``pmod(xxhash64(text), count)`` deals texts into, without a job where the xxHash library is there."""
    if xxhash is None:
        rows = spark.createDataFrame([(t,) for t in texts], "t string").select(F.pmod(F.xxhash64("t"), F.lit(count)).alias("b")).distinct().collect()
        return sorted(r["b"] for r in rows)
    signed = (h - (1 << 64) if h >> 63 else h for h in (xxhash.xxh64(t.encode(), seed=42).intdigest() for t in texts))
    return sorted({h % count for h in signed})
