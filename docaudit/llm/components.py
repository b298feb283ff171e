"""Connected components of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docaudit.llm.common import stored


def _star(links: DataFrame, large: bool, rows: int) -> DataFrame:
    """Links each node's larger (or smaller) neighbours to its smallest one.

    Minima are sums with map-side combination; the join back is a broadcast where they are few,
    else one whose skewed parts Spark splits, so that a node with very many links is no hot spot.
    """
    if large:
        sides = links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
    else:
        sides = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = stored(sides.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "minima", 2 * rows)
    joined = sides.join(least, "u")
    if large:
        moved = joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        moved = joined.where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.where("u <> m").select("u", "m"))
    return stored(moved.where("a <> b").distinct(), "stars", 2 * rows)


def components(links: DataFrame, rows: int | None = None) -> DataFrame:
    """node and root (the smallest node it is connected with) for each end of the links a, b.

    `rows` is a bound of their number, if there is one.
    Nodes without links, links to oneself and nulls don't appear. Each round is a stored table.
    """
    now = stored(links.where("a <> b").select("a", "b").distinct(), "links", rows)
    rows, seen = now.count(), None
    while True:
        now = _star(_star(now, True, rows), False, rows)
        row = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if row == seen:
            break
        seen = row
    roots = now.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("root"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
