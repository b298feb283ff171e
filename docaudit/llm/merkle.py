"""Merkle manifest of a dataset with a witness for every row.

Leaves are appended in order to their group's tree in aligned blocks, each a stream of its own. An
append opens a subtree of one leaf; when the last sibling of a run completes, the run becomes one
subtree and every leaf in it gets the hashes of its siblings, left and right, as a further step of
its witness. The roots of the blocks are appends to the next tier, and so on up to the group's root;
the groups' roots are appends to the tree at the top.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docaudit.llm.common import stored

FAN = 3  # nodes of a run
LEVELS = 7  # of a block, which so has at most FAN ** LEVELS leaves
ROWS_A_PART = 1_000_000
STEP = "struct<before: string, after: string>"


def encoded(value: Column) -> Column:
    """A field as its UTF-8 byte count and value, - if null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(*fields: Column) -> Column:
    return F.sha2(F.concat(*map(encoded, fields)).cast("binary"), 256)


def folded(leaf: Column, steps: Column) -> Column:
    """The root that follows from a leaf and the steps of its witness."""
    return F.aggregate(steps, leaf, lambda node, s: F.sha2(F.concat(s["before"], node, s["after"]).cast("binary"), 256))


class Appender:
    """One block's open subtrees: at each level fewer than FAN, each a node with its first leaf and their number."""

    def __init__(self, levels: int = LEVELS) -> None:
        self.levels = levels
        self.open: list[list[tuple[str, int, int]]] = [[]]
        self.steps: list[list[tuple[str, str]]] = []

    def append(self, node: str) -> None:
        self.steps.append([])
        self._add(0, (node, len(self.steps) - 1, 1))

    def _add(self, level: int, subtree: tuple[str, int, int]) -> None:
        if level == len(self.open):
            self.open.append([])
        self.open[level].append(subtree)
        if len(self.open[level]) == FAN:
            self._complete(level)

    def _complete(self, level: int) -> None:
        """The open run of a level becomes one subtree of the next."""
        run, self.open[level] = self.open[level], []
        nodes = [node for node, _, _ in run]
        for n, (_, first, leaves) in enumerate(run):
            step = ("".join(nodes[:n]), "".join(nodes[n + 1 :]))
            for at in range(first, first + leaves):
                self.steps[at].append(step)
        self._add(level + 1, (sha256("".join(nodes).encode()).hexdigest(), run[0][1], sum(leaves for _, _, leaves in run)))

    def close(self, whole: bool) -> str:
        """Completes what is open and gives the block's root.

        With `whole` the block is all of its group and ends where one node remains; else it goes on
        to the full number of levels, a run of one included, since further blocks stand beside it.
        """
        for level in range(self.levels):
            if whole and len(self.open[level]) == 1 and level == len(self.open) - 1:
                return self.open[level][0][0]
            if self.open[level]:
                self._complete(level)
        return self.open[self.levels][0][0]


def appended(nodes: DataFrame, levels: int) -> DataFrame:
    """Every node with block, steps (its witness within the block) and root (of the block, on its last node).

    `nodes` has group, pos (from 0 in each group), node, total (of the group) and columns that pass along.
    """
    parts = max(nodes.sparkSession.sparkContext.defaultParallelism, -(-nodes.count() // ROWS_A_PART))
    dealt = nodes.withColumn("block", F.floor(F.col("pos") / FAN**levels)).repartition(parts, "group", "block").sortWithinPartitions("group", "block", "pos")

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, tree = None, [], Appender(levels)

        def closed(whole: bool) -> Iterator[pa.RecordBatch]:
            root = tree.close(whole)
            rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            ends = [0]
            for steps in tree.steps:
                ends.append(ends[-1] + len(steps))
            sides = list(zip(*(s for steps in tree.steps for s in steps))) or [(), ()]
            flat = pa.StructArray.from_arrays([pa.array(s, pa.string()) for s in sides], ["before", "after"])
            found = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat), pa.array([None] * (rows.num_rows - 1) + [root], pa.string())]
            yield pa.RecordBatch.from_arrays([*rows.columns, *found], [*rows.schema.names, "steps", "root"])

        for batch in batches:
            start = 0
            keys = list(zip(batch["group"].to_pylist(), batch["block"].to_pylist()))
            for n, (key, node, total) in enumerate(zip(keys, batch["node"].to_pylist(), batch["total"].to_pylist())):
                if block is not None and block[0] != key:
                    if n > start:
                        held.append(batch.slice(start, n - start))
                    yield from closed(block[1])
                    start, held, tree = n, [], Appender(levels)
                block = (key, total <= FAN**levels)
                tree.append(node)
            if len(keys) > start:
                held.append(batch.slice(start))
        if block is not None:
            yield from closed(block[1])

    fields = ", ".join(f"`{n}` {t}" for n, t in dealt.dtypes)
    return dealt.mapInArrow(stream, f"{fields}, steps array<{STEP}>, root string")


def placed(nodes: DataFrame, order: list[str]) -> DataFrame:
    """Adds pos, from 0 in each group by `order`, and total to a stored table with group and node.

    Rows are dealt by ranges of the whole order, so that a large group is spread over many tasks; the
    parts are then counted and their counts summed up, a few numbers for each part and group.
    """
    spark = nodes.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, -(-nodes.count() // ROWS_A_PART))
    keys = ["group", *order]
    dealt = nodes.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id())
    dealt = stored(dealt.withColumn("part", F.shiftright("at", 33)), "ordered")
    runs = dealt.groupBy("group", "part").agg(F.min("at").alias("start"), F.count("*").alias("rows"))
    before = Window.partitionBy("group").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("group", "part", "start", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("before"), F.sum("rows").over(Window.partitionBy("group")).alias("total"))
    found = dealt.join(stored(runs, "runs"), ["group", "part"])
    return found.withColumn("pos", F.col("before") + F.col("at") - F.col("start")).drop("at", "part", "start", "before")


def witnessed(nodes: DataFrame, levels: int) -> tuple[DataFrame, DataFrame]:
    """(every node with block and the witness within it, for each block its group, witness above it and the group's root)."""
    tiers = [stored(appended(nodes, levels), "tier")]
    most = nodes.agg(F.max("total")).first()[0] or 0
    while (most := -(-most // FAN**levels)) > 1:
        roots = tiers[-1].where("root IS NOT NULL").select("group", F.col("block").alias("pos"), F.col("root").alias("node"), F.ceil(F.col("total") / FAN**levels).alias("total"))
        tiers.append(stored(appended(roots, levels), "tier"))
    above = tiers[-1].where("root IS NOT NULL").select("group", "block", F.array().cast(f"array<{STEP}>").alias("above"), F.col("root").alias("subroot"))
    for tier in reversed(tiers[1:]):
        above = tier.join(above, ["group", "block"]).select("group", F.col("pos").alias("block"), F.concat("steps", "above").alias("above"), "subroot")
    return tiers[0], above


def manifest(df: DataFrame, fields: list[str], key: str, group: str, changed: tuple[Column, dict[str, Column]] | None = None, levels: int = LEVELS) -> DataFrame:
    """The key, leaf, subroot, root, proof_sha256, folded_root and verified for every row.

    A leaf hashes the row's `fields`; rows of a group are ordered by the key (null first), then by
    leaf. Groups are ordered by their text in UTF-8 bytes, null, a group of its own, first. `changed`
    is a condition and the fields that tampering replaces where it holds: folded_root then follows
    from the replaced fields' leaf and the witness of the original, and verified is whether it is
    the root. Equal rows are leaves of their own with places next to each other. Null fields differ
    from empty ones. Other columns are left out; an empty table gives no rows. No task holds more
    than a block of leaves, and a large group is many blocks.
    """
    when, other = changed or (F.lit(False), {})
    leaf = leaf_hash(*(F.col(f"`{f}`") for f in fields))
    replaced = leaf_hash(*(other.get(f, F.col(f"`{f}`")) for f in fields))
    named = F.coalesce(F.concat(F.lit("="), F.col(f"`{group}`").cast("string")), F.lit(""))
    hashed = df.select(F.col(f"`{key}`").alias("key"), named.alias("group"), leaf.alias("node"), F.when(when, replaced).alias("other"), F.monotonically_increasing_id().alias("row"))
    leaves, above = witnessed(placed(stored(hashed, "leaves"), ["key", "node", "row"]), levels)

    tops = above.where("block = 0").select(F.lit("").alias("group"), F.col("group").alias("name"), F.col("subroot").alias("node"))
    top_leaves, top_above = witnessed(placed(stored(tops, "tops"), ["name"]), levels)
    top = top_leaves.join(top_above, ["group", "block"]).select(F.col("name").alias("group"), F.concat("steps", "above").alias("top"), F.col("subroot").alias("root"))

    up = stored(above.join(top, "group").select("group", "block", F.concat("above", "top").alias("above"), "subroot", F.col("root").alias("top_root")), "above")
    found = leaves.drop("root").join(up, ["group", "block"]).withColumn("steps", F.concat("steps", "above"))
    siblings = F.array_join(F.transform("steps", lambda s: F.concat(s["before"], s["after"])), "")
    found = found.withColumn("folded_root", folded(F.coalesce("other", "node"), F.col("steps")))
    return found.select(
        F.col("key").alias(key), F.col("node").alias("leaf"), "subroot", F.col("top_root").alias("root"), F.sha2(siblings.cast("binary"), 256).alias("proof_sha256"),
        "folded_root", (F.col("folded_root") == F.col("top_root")).alias("verified"),
    )
