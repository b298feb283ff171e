"""Exact duplicates by deterministic block naming.

Texts without their white space are cut into blocks of a fixed number of bytes. Sorting the distinct
blocks gives each an integer name; adjacent pairs of names are named the same way, again and again,
until one name stands for a whole document. Equal names at a level mean equal bytes: names come from
comparing blocks and pairs in full, never from a hash alone. A block or pair that occurs once in the
corpus needs no name, and the document that holds it has no equal.

Whole blocks cross the network once, to be sorted. Documents then find their names by 128-bit marks of
the blocks; the sorted blocks show whether any two of them share a mark, and if so others are drawn.
"""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docaudit.functions.plan import settle
from docaudit.functions.text import let
from docaudit.llm.common import stored

BLOCK = 1024  # bytes
WHITE = "[\\x20\\x09-\\x0D]+"
NOTHING = -1  # stands for the missing right half of a last odd name


def normalised(text: Column) -> Column:
    """The text without spaces, tabs and line ends; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE, "")


def blocks(text: Column, size: int) -> Column:
    """The bytes of a text in blocks, the last one shorter; an empty text is one empty block."""

    def cut(data: Column) -> Column:
        last = F.greatest(F.lit(0), F.floor((F.octet_length(data) - 1) / size)).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda n: F.substring(data, n * size + 1, F.lit(size)))

    return let(text.cast("binary"), cut)


def mark(block: Column, draw: int) -> list[Column]:
    """Two 64-bit marks of a block; other ones for each draw."""
    return [F.xxhash64(F.lit(2 * draw + n), block) for n in (0, 1)]


def names(rows: DataFrame, *keys: str) -> DataFrame:
    """An integer for each key that occurs more than once, in sorted order within each partition of the keys."""
    repeated = rows.groupBy(*keys).agg(F.count("*").alias("times")).where("times > 1")
    return repeated.sortWithinPartitions(*keys).select(*keys, F.monotonically_increasing_id().alias("name"))


def named_blocks(texts: DataFrame, size: int, draw: int) -> DataFrame:
    """first and second (the marks), times and name of each distinct block; `texts` has key and plain."""
    cut = texts.select(F.explode(blocks(F.col("plain"), size)).alias("block"))
    distinct = cut.groupBy("block").agg(F.count("*").alias("times")).sortWithinPartitions("block")
    first, second = mark(F.col("block"), draw)
    return distinct.select(first.alias("first"), second.alias("second"), "times", F.monotonically_increasing_id().alias("name"))


def _paired(parts: DataFrame) -> DataFrame:
    """The adjacent pairs of each document's names, with the name of those that occur more than once.

    `parts` has row, at, n (names of the row) and name, null where the document is known to have no equal.
    """
    left, odd = F.floor(F.col("at") / 2).alias("at"), F.col("at") % 2 == 1
    pairs = parts.groupBy("row", left).agg(F.max("n").alias("n"), F.max(F.when(~odd, F.col("name"))).alias("a"), F.max(F.when(odd, F.col("name"))).alias("b"))
    pairs = pairs.withColumn("b", F.when(2 * F.col("at") + 1 < F.col("n"), F.col("b")).otherwise(NOTHING)).withColumn("n", F.ceil(F.col("n") / 2))
    whole = F.col("a").isNotNull() & F.col("b").isNotNull()
    known = pairs.where(whole).join(names(pairs.where(whole), "a", "b"), ["a", "b"], "left")
    return known.select("row", "at", "n", "name").union(pairs.where(~whole).select("row", "at", "n", F.lit(None).cast("long")))


def identities(parts: DataFrame) -> DataFrame:
    """row, level and name: equal for equal documents; a document without an equal has the name null."""
    done = []
    for level in count():
        done.append(parts.where("n = 1").select("row", F.lit(level).alias("level"), "name"))
        rest = parts.where("n > 1")
        if rest.isEmpty():
            return reduce(DataFrame.union, done)
        parts = stored(_paired(rest), "pairs")


def exact_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", size: int = BLOCK) -> DataFrame:
    """The key, keep_id, group_size, kept and text_sha256 for every row.

    Rows are equal if their texts are once white space is deleted; a null text is empty, and all
    empty texts are equal. Of equal rows that with the most code points in its text stays, then that
    with the smallest key (null last), then one of them. Repeated rows stay repeated, one of them kept.
    text_sha256 is of the text without white space. Other columns are left out; an empty table gives
    no rows. Texts are read twice, once for the blocks and once for the marks; only blocks, combined
    before the shuffle, travel. A group of any size is summed up before it meets, and its rows find
    their group in a join whose large parts Spark splits.
    """
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    texts = settle(rows.select("key", F.char_length(F.coalesce("text", F.lit(""))).alias("chars"), normalised(F.col("text")).alias("plain")), "key")
    for draw in count():
        known = stored(named_blocks(texts, size, draw), "blocks")
        if known.groupBy("first", "second").count().where("count > 1").isEmpty():
            break
    marks = F.transform(blocks(F.col("plain"), size), lambda b: F.struct(*(m.alias(n) for m, n in zip(mark(b, draw), ("first", "second")))))
    docs = texts.select(F.monotonically_increasing_id().alias("row"), "key", "chars", F.sha2("plain", 256).alias("sha"), marks.alias("marks"))
    docs = stored(docs, "marked")
    parts = docs.select("row", F.size("marks").cast("long").alias("n"), F.posexplode("marks").alias("at", "mark")).select("row", F.col("at").cast("long").alias("at"), "n", "mark.*")
    parts = parts.join(known.where("times > 1").drop("times"), ["first", "second"], "left").select("row", "at", "n", "name")
    found = stored(identities(stored(parts, "named")), "identities")
    members = docs.drop("marks").join(found, "row")
    order = F.struct((-F.col("chars")).alias("chars"), F.col("key").isNull().alias("none"), "key", "row")
    repeated = members.where("name IS NOT NULL")
    groups = stored(repeated.groupBy("level", "name").agg(F.count("*").alias("group_size"), F.min(order).alias("best")), "groups")
    one_of = repeated.join(groups, ["level", "name"]).select("key", F.col("best.key").alias("keep_id"), "group_size", (F.col("row") == F.col("best.row")).alias("kept"), "sha")
    alone = members.where("name IS NULL").select("key", F.col("key").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "sha")
    return one_of.union(alone).select(F.col("key").alias(key), "keep_id", "group_size", "kept", F.col("sha").alias("text_sha256"))
