"""Reading tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(
    spark: SparkSession, folder: str, name: str, spread_by: str | None = None
) -> DataFrame:
    """Parquet table; a source with fewer splits than cores may be spread by a key first.

    Row-wise text work is CPU bound, and a small file is often a single row group. Large
    inputs have more splits than cores and are read as they are, without a shuffle.
    """
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if spread_by and df.rdd.getNumPartitions() < cores:
        df = df.repartition(cores, spread_by)
    return df
