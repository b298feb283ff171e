"""Plan shaping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def settle(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """Evaluate the columns once at this point.

    The optimizer merges neighbouring projections and then repeats an array expression at
    every use, and once per element inside lambdas. A one-element generator keeps the
    projections apart; it neither shuffles nor buffers rows. The key column passes beside
    the generator, so that a partitioning by the key stays known.
    """
    rest = [F.col(c) for c in df.columns if c != key]
    if not rest:
        return df
    return df.select(key, F.inline(F.array(F.struct(*rest))))
