"""Near-duplicates by SimHash with pigeonring filtering.

Fingerprints of 64 bits link at few differing bits. Cut into a ring of one segment more than that
limit, two linked fingerprints have a start from which every chain of l segments differs in l - 1
bits at most: the first segment agrees, the next differs in one bit at most, and so on. An equi-join
on the first two finds candidates, with all one-bit changes of the second on one side; longer chains
prune these before the full Hamming check. Equal fingerprints are one node throughout.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docaudit.llm.common import row_hash, stored
from docaudit.llm.components import components

BITS = 64
SHINGLE = 4
SEED = 42
LIMIT = 4
PROBES_A_TASK = 1_000_000


def fingerprint(text: str, size: int = SHINGLE) -> int:
    """The fingerprint of a whole text: A-Z lower-cased, words parted by ASCII white space."""
    words = text.encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    joined, hashed = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= size:
        return hashed(joined, SEED)
    starts = [0, *np.cumsum([len(w) + 1 for w in words]).tolist()]
    hashes = np.array([hashed(joined[a : b - 1], SEED) for a, b in zip(starts, starts[size:])], "<u8")
    counts = np.zeros(BITS, "i8")
    for part in range(0, len(hashes), 4096):
        counts += np.unpackbits(hashes[part : part + 4096].view("u1").reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype="i8")
    return int.from_bytes(np.packbits(2 * counts > len(hashes), bitorder="little").tobytes(), "little")


def fingerprinted(df: DataFrame, text: str = "text", size: int = SHINGLE) -> DataFrame:
    """Adds fp, the fingerprint as a signed long. A null text counts as empty, with fingerprint zero."""

    @F.arrow_udf("long")
    def prints(texts: pa.Array) -> pa.Array:
        return pa.array(np.array([fingerprint(t.as_py() or "", size) for t in texts], "u8").view("i8"), pa.int64())

    return df.withColumn("fp", prints(F.col(text)))


def segments(limit: int) -> list[tuple[int, int]]:
    """First bit and width of each segment of the ring."""
    count = limit + 1
    widths = [BITS // count + (n < BITS % count) for n in range(count)]
    return [(sum(widths[:n]), widths[n]) for n in range(count)]


def _mask(ring: list[tuple[int, int]], start: int, length: int) -> int:
    """The bits of a chain, as a signed long."""
    bits = sum(((1 << w) - 1) << at for at, w in (ring[(start + n) % len(ring)] for n in range(length)))
    return bits - (1 << BITS) if bits >> (BITS - 1) else bits


def _keys(fp: Column, ring: list[tuple[int, int]], changed: bool) -> Column:
    """Start and first two segments of each chain; with `changed`, also for each one-bit change of the second."""
    out = []
    for start, (at, width) in enumerate(ring):
        after, wide = ring[(start + 1) % len(ring)]
        first = F.shiftrightunsigned(fp, at).bitwiseAND(F.lit((1 << width) - 1))
        second = F.shiftrightunsigned(fp, after).bitwiseAND(F.lit((1 << wide) - 1))
        key = F.shiftleft(first, wide).bitwiseOR(second).bitwiseOR(F.lit(start << 58))
        out += [key, *(key.bitwiseXOR(F.lit(1 << n)) for n in range(wide) if changed)]
    return F.array(*out)


def links(nodes: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Links a, b between the distinct fingerprints `fp`, enough to connect all that differ in `limit` bits or fewer.

    Each bucket of equal keys has two pivots, its smallest and largest fingerprint. Whatever links
    with a pivot gives one row; pairs of which both link with the same pivot are connected by it and
    aren't given, so that a dense group costs rows in proportion to its size. All other pairs are
    held against the chains' budgets and then compared in full.
    """
    if not 1 <= limit <= 15:
        raise ValueError("the limit is 1 to 15 bits")
    ring = segments(limit)
    start = F.shiftrightunsigned(F.col("key"), 58).cast("int") + 1

    def near(a: Column, b: Column) -> Column:
        return F.bit_count(a.bitwiseXOR(b)) <= limit

    def chained(a: Column, b: Column) -> Column:
        """Whether every chain from the bucket's start keeps to its budget."""
        held = F.lit(True)
        for length in range(2, len(ring)):
            masks = F.array(*(F.lit(_mask(ring, n, length)) for n in range(len(ring))))
            held = held & (F.bit_count(a.bitwiseXOR(b).bitwiseAND(F.element_at(masks, start))) <= length - 1)
        return held

    probes_each = BITS + len(ring)
    kept = nodes.select("fp").repartition(max(1, math.ceil(nodes.count() * probes_each / PROBES_A_TASK)))
    index = kept.select(F.explode(_keys(F.col("fp"), ring, False)).alias("place"), F.col("fp").alias("b"))
    probes = kept.select(F.explode(_keys(F.col("fp"), ring, True)).alias("key"), F.col("fp").alias("a"))
    buckets = index.groupBy(F.col("place").alias("key")).agg(F.min("b").alias("low"), F.max("b").alias("high"))
    a, b, low, high = (F.col(c) for c in ("a", "b", "low", "high"))
    apart = ~(near(a, low) & near(b, low)) & ~(near(a, high) & near(b, high))
    others = (a < b) & ~b.isin(low, high) & ~a.isin(low, high) & chained(a, b) & near(a, b) & apart
    # the planner takes an exploded table for as many rows as before, and would broadcast the probes of tables of middling size
    joined = probes.hint("merge").join(buckets, "key").join(index.hint("merge"), (F.col("key") == F.col("place")) & others, "left")
    ends = [F.when((a != c) & near(a, c), F.struct(F.least(a, c).alias("a"), F.greatest(a, c).alias("b"))) for c in (low, high)]
    ends.append(F.when(b.isNotNull(), F.struct(a.alias("a"), b.alias("b"))))
    return joined.select(F.inline(F.array_compact(F.array(*ends)))).distinct()


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHINGLE, limit: int = LIMIT) -> DataFrame:
    """key, row_hash, fp, root and component for every row.

    root is a fingerprint that names the group of rows whose fingerprints are connected by links,
    component the smallest key in it; a null key counts only where there is no other. row_hash is of
    all columns, for telling rows with equal keys apart. Null and empty texts share fingerprint zero; repeated rows stay repeated; an
    empty table gives no rows. Texts are read once and never shuffled.
    """
    marked = df.select(F.col(key).alias("key"), row_hash(df).alias("row_hash"), F.col(text).alias("text"))
    prints = stored(fingerprinted(marked, "text", size).drop("text"), "fingerprints")
    rows = prints.count()
    nodes = stored(prints.groupBy("fp").agg(F.min("key").alias("least")), "nodes", rows)
    linked = stored(links(nodes, limit), "links")
    roots = stored(components(linked, linked.count()).select(F.col("node").alias("fp"), "root"), "roots", rows)
    placed = nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    smallest = stored(placed.groupBy("root").agg(F.min("least").alias("component")), "smallest", rows)
    found = stored(placed.join(smallest, "root").select("fp", "root", "component"), "found", rows)
    return prints.join(found, "fp").select("key", "row_hash", "fp", "root", "component")


def fingerprint_text(fp: Column) -> Column:
    """16 lower-case hex digits."""
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
