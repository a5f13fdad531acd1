"""Tables of a data folder as DataFrames and views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
STAR = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sql(text: str, *names: str):
    """A query that runs Spark SQL over the tables it names, as temporary views."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        for n in names:
            table(spark, sf_dir, n).createOrReplaceTempView(n)
        return spark.sql(text)

    return run
