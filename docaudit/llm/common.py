"""Table reading for the operators of this subpackage, and the helpers for stored intermediate tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docaudit.sources.storage import new_folder, shared_folder, stored

__all__ = ["as_json", "new_folder", "row_hash", "shared_folder", "stored", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_json(column: Column, kind: str) -> Column:
    """A column that can be hashed: one that holds a map, which Spark doesn't hash, as JSON text."""
    return F.to_json(F.struct(column)) if "map<" in kind else column


def row_hash(df: DataFrame) -> Column:
    """A hash of all columns."""
    return F.xxhash64(*(as_json(F.col(f"`{name}`"), kind) for name, kind in df.dtypes))
