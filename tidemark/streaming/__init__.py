"""An extension of ours: aggregates kept up to date while result files arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.operators.aggregate import by_method


def live_aggregates(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Mean error and budget by method over a growing folder of result files; write it in complete mode."""
    return by_method(spark.readStream.schema(schema).parquet(path))
