"""Shards of near equal bytes by a histogram sort.

Rows are ordered by a hash of their text, then of the whole row, then by their number, so that copies
of a text lie together and a group of any size can still be divided. Splitters are found on a narrow table of
keys and sizes: each round counts exactly the bytes below candidate keys across all partitions and
narrows the interval of every splitter, until the bytes below it meet the tolerance. Only then do
the rows move, once.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docaudit.llm.common import as_json, stored

WIDE = 24  # bytes of a key: hash of the text, hash of the row, number of the row
TOP = 1 << 8 * WIDE  # above every key
SHIFT = 1 << 63
EVEN = 8  # probes spaced evenly in the interval of a splitter
KEPT = 256  # keys asked for from the interval of a splitter
RANGES = 200_000  # in all, as many tasks as the exchange gets at most
OVERHEAD = 8  # bytes of a row besides its text


@dataclass(frozen=True)
class Point:
    """A key with the exact bytes and rows below it."""

    key: int
    bytes: int
    rows: int


def _packed(keys: list[int]) -> np.ndarray:
    return np.array([k.to_bytes(WIDE, "big") for k in keys], f"S{WIDE}")


def _keys(*parts: np.ndarray) -> np.ndarray:
    """The signed numbers of each row as bytes that compare in their order."""
    held = np.empty((len(parts[0]), len(parts)), ">u8")
    for n, part in enumerate(parts):
        held[:, n] = part.view("u8") ^ np.uint64(SHIFT)
    return held.reshape(-1).view(f"S{WIDE}")


def _round(sized: DataFrame, probes: list[int], rates: list[float], seed: int) -> list:
    """Bytes and rows between neighbouring probes, with keys drawn at the rate of each gap."""
    bounds, chance = _packed(probes), np.array(rates)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gaps = len(bounds) + 1
        total, rows, drawn = np.zeros(gaps, "i8"), np.zeros(gaps, "i8"), [[] for _ in range(gaps)]
        random = np.random.default_rng((seed, TaskContext.get().partitionId()))
        for batch in batches:
            keys = _keys(*(batch[c].to_numpy() for c in ("first", "second", "third")))
            gap = np.searchsorted(bounds, keys, side="right")
            np.add.at(total, gap, batch["size"].to_numpy())
            rows += np.bincount(gap, minlength=gaps)
            for at in np.flatnonzero(random.random(len(gap)) < chance[gap]):
                drawn[gap[at]].append(bytes(keys[at]).ljust(WIDE, b"\0"))
        full = np.flatnonzero(rows)
        yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(total[full]), pa.array(rows[full]), pa.array([drawn[g] for g in full], pa.list_(pa.binary()))], ["gap", "total", "rows", "keys"])

    parts = sized.mapInArrow(count, "gap int, total long, rows long, keys array<binary>")
    return parts.groupBy("gap").agg(F.sum("total").alias("total"), F.sum("rows").alias("rows"), F.flatten(F.collect_list("keys")).alias("keys")).collect()


def splitters(sized: DataFrame, targets: list[int], total: Point, tolerance: int) -> list[Point]:
    """For each target the point whose bytes below come closest to it, within the tolerance if any key is.

    `sized` has first, second, third and size. What reaches the driver is bounded by the number of
    targets: counts between probes, and some hundred keys for each open interval.
    """
    known = {0: Point(0, 0, 0), TOP: total}
    drawn: list[int] = []
    for number in range(200):
        points = sorted(known.values(), key=lambda p: p.key)
        below = [p.bytes for p in points]
        chosen, probes, share = [], set(), {}
        for target in targets:
            at = min(max(1, bisect_left(below, target)), len(points) - 1)
            low, high = points[at - 1], points[at]
            chosen.append(min((low, high), key=lambda p: abs(p.bytes - target)))
            if abs(chosen[-1].bytes - target) <= tolerance or high.key - low.key <= 1 or high.rows == low.rows:
                continue
            wide = high.key - low.key
            inside = drawn[bisect_left(drawn, low.key) : bisect_right(drawn, high.key)]
            few = inside[:: max(1, len(inside) // (2 * EVEN))] if high.rows - low.rows > KEPT else inside
            probes.update(p for p in [low.key + wide * n // (EVEN + 1) for n in range(1, EVEN + 1)] + few + [k + 1 for k in few] if low.key < p < high.key)
            share[low.key] = min(1.0, KEPT / (high.rows - low.rows))
        if not probes:
            return chosen
        # the ends of the open intervals are bounds too, so that each gap has one rate
        keys, starts = [p.key for p in points], sorted(share)
        ends = {start: keys[bisect_right(keys, start)] for start in starts}
        bounds = sorted(probes.union(starts, ends.values()) - {0, TOP})
        rates = []
        for key in [0, *bounds]:
            at = bisect_right(starts, key) - 1
            rates.append(share[starts[at]] if at >= 0 and key < ends[starts[at]] else 0.0)
        found = {r["gap"]: r for r in _round(sized, bounds, rates, number)}
        sum_bytes = sum_rows = 0
        for gap, bound in enumerate(bounds):
            if gap in found:
                sum_bytes, sum_rows = sum_bytes + found[gap]["total"], sum_rows + found[gap]["rows"]
            known[bound] = Point(bound, sum_bytes, sum_rows)
        drawn = sorted({int.from_bytes(k, "big") for r in found.values() for k in r["keys"]})
    raise RuntimeError("splitters did not settle")


def _named(columns: list[str]) -> list[Column]:
    return [F.col(f"`{c}`") for c in columns]


def shard(df: DataFrame, n_shards: int = 24, text: str = "text", tolerance: float = 0.001, range_bytes: int = 8 << 20) -> DataFrame:
    """All rows with size, law, shard (0 to n_shards - 1) and slot (gapless from 0 in each shard).

    Law `bytes`: shards hold near equal sizes, apart by `tolerance` of a shard or else by the row
    that lies on the border. A row's size is the UTF-8 bytes of its text (null: none) plus 8. The
    driver looks for the borders of the shards alone. A shard is dealt to ranges of about
    `range_bytes` (more where that gave over RANGES ranges), each put into one task by the exchange; how many rows lie before a range is summed
    up from the narrow table and travels to it as a row of its own. `df` is read twice and must give
    the same rows in the same partitions, as tables do: a row's number is the last part of its key,
    so that rows equal in all columns are divided too. Nulls order as a value of their own. Columns
    named as the new ones are replaced. An empty table stays empty.
    """
    columns = [c for c in df.columns if c not in ("size", "law", "shard", "slot")]
    size = F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long") + OVERHEAD
    whole = [as_json(F.col(f"`{c}`"), t) for c, t in df.dtypes if c in columns]
    keyed = df.select(*_named(columns), F.xxhash64(text).alias("__first"), F.xxhash64(*whole).alias("__second"), F.monotonically_increasing_id().alias("__third"), size.alias("size"))
    sized = stored(keyed.select(F.col("__first").alias("first"), F.col("__second").alias("second"), F.col("__third").alias("third"), "size"), "sizes")
    row = sized.agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).first()
    total = Point(TOP, row["bytes"] or 0, row["rows"])
    found = splitters(sized, [total.bytes * n // n_shards for n in range(1, n_shards)], total, int(total.bytes / n_shards * tolerance))
    bounds = _packed([p.key if p.key < TOP else TOP - 1 for p in found])
    parts = max(1, -(-total.bytes // (n_shards * max(range_bytes, total.bytes // RANGES))))  # ranges of a shard

    @F.arrow_udf("int")
    def place(first: pa.Array, second: pa.Array, third: pa.Array) -> pa.Array:
        return pa.array(np.searchsorted(bounds, _keys(first.to_numpy(), second.to_numpy(), third.to_numpy()), side="right"), pa.int32())

    def ranged(rows: DataFrame, first: str, second: str, third: str) -> DataFrame:
        """Adds the shard, and the range within it by a hash of the key."""
        return rows.withColumn("__shard", place(first, second, third)).withColumn("__part", F.pmod(F.xxhash64(first, second, third), F.lit(parts)))

    counts = ranged(sized, "first", "second", "third").groupBy("__shard", "__part").agg(F.count("*").alias("rows"))
    before = Window.partitionBy("__shard").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    heads = counts.select("__shard", "__part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("__from"))
    rows = ranged(keyed, "__first", "__second", "__third").withColumn("__from", F.lit(None).cast("long"))
    dealt = rows.unionByName(heads, allowMissingColumns=True).repartition(n_shards * parts, "__shard", "__part")
    own = Window.partitionBy("__shard", "__part").orderBy(F.col("__from").isNull(), "__first", "__second", "__third")
    numbered = dealt.withColumn("__rank", F.row_number().over(own)).withColumn("__base", F.first("__from").over(own))
    placed = numbered.where("__from IS NULL")
    return placed.select(*_named(columns), "size", F.lit("bytes").alias("law"), F.col("__shard").alias("shard"), (F.col("__base") + F.col("__rank") - 2).alias("slot"))


def write_shards(sharded: DataFrame, path: str) -> None:
    """Writes the rows as Parquet, one folder for each shard."""
    sharded.write.partitionBy("shard").parquet(path)
