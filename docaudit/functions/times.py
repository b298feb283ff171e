"""Time values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def millis(df: DataFrame, name: str) -> Column:
    """Milliseconds since 1970; a timestamp without zone is read as UTC in any session zone."""
    if isinstance(df.schema[name].dataType, T.TimestampNTZType):
        epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
        return F.timestamp_diff("MILLISECOND", epoch, F.col(name))
    return F.unix_millis(name)
