"""Tables in the folder that the driver and all executors share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quern.functions.tables import materialize, release, shared_dir

__all__ = ["documents", "materialize", "release", "shared_dir", "small_batches"]

_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def small_batches(spark: SparkSession, size: str = "4m") -> None:
    """Batches between the JVM and Python workers have at most so many bytes from now on, unless the application sets its own limit: ten thousand long texts would be in memory twice."""
    if not spark.sparkContext.getConf().contains(_BATCH):
        spark.conf.set(_BATCH, size)
