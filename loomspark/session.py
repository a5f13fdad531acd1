"""Sessions, and the package on executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

#: Needed by the SQL that this engine accepts: names in double quotes, wall-clock timestamps, runtime re-planning.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.timestampType": "TIMESTAMP_NTZ",
}

_SHIPPED: set[str] = set()


def session(app: str = "loomspark", **conf: str) -> SparkSession:
    """A session with the engine's defaults; conf wins over them."""
    builder = SparkSession.builder.appName(app)
    for key, value in (DEFAULTS | conf).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package, also where it isn't installed: it goes to them as a zip, once an application."""
    root = Path(__file__).resolve().parent
    app = spark.sparkContext.applicationId
    if app in _SHIPPED or str(root.parent) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    target = Path(tempfile.mkdtemp()) / f"{root.name}.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(target))
    _SHIPPED.add(app)
