"""Texts larger than a row: line blocks, with offsets by prefix sums in two levels.

A text is rows (key, block, lines): blocks in order, each a run of lines without their line ends. What
a block needs of those before it - its offset, how many paragraphs began, whether the last line was
blank - is summed up from a few numbers for each block, so that lines meet only those of their own
block and paragraph. Keys aren't null; a paragraph fits a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docaudit.functions import text as tx
from docaudit.operators.latex import starts

PARAGRAPHS_A_PART = 1024  # numbered together


def line_blocks(docs: DataFrame, key: str, text: str, lines: int) -> DataFrame:
    """The texts of rows as blocks of some lines."""
    split = F.split(F.col(text), "\n", -1)
    cut = tx.let(split, lambda all_lines: F.transform(F.sequence(F.lit(0), F.floor((F.size(all_lines) - 1) / lines).cast("int")), lambda n: F.slice(all_lines, n * lines + 1, lines)))
    return docs.select(key, F.posexplode(cut).alias("block", "lines"))


def _opens(lines: Column, blank_before: Column) -> Column:
    """For each line whether a paragraph begins with it: it holds something and the line before is empty."""
    return F.transform(lines, lambda line, n: (line != "") & F.when(n == 0, blank_before).otherwise(F.get(lines, n - 1) == ""))


def block_heads(blocks: DataFrame, key: str) -> DataFrame:
    """(key, block, base, blank_before, begun): the block's offset, the line before it, and paragraphs begun before it."""
    own = blocks.select(
        key, "block", F.aggregate("lines", F.lit(0).cast("long"), lambda s, line: s + F.length(line) + 1).alias("chars"),
        (F.element_at("lines", -1) == "").alias("blank_end"),
        (F.element_at("lines", 1) != "").alias("filled"),
        F.size(F.filter(_opens(F.col("lines"), F.lit(False)), lambda o: o)).alias("inside"),
    )
    order = Window.partitionBy(key).orderBy("block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    own = own.withColumn("blank_before", F.coalesce(F.lag("blank_end").over(order), F.lit(True)))
    own = own.withColumn("begins", F.col("inside") + (F.col("filled") & F.col("blank_before")).cast("int"))
    sums = [F.coalesce(F.sum(c).over(before), F.lit(0)).alias(name) for c, name in (("chars", "base"), ("begins", "begun"))]
    return own.select(key, "block", "blank_before", *sums)


def numbered(rows: DataFrame, key: str, place: str) -> DataFrame:
    """Adds ord, from 1 in each key by ``place`` (whole numbers): within parts, after the rows of the parts before."""
    parts = rows.withColumn("__part", F.floor(F.col(place) / PARAGRAPHS_A_PART))
    counts = parts.groupBy(key, "__part").agg(F.count("*").alias("__rows"))
    before = Window.partitionBy(key).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(key, "__part", F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__before"))
    inside = F.row_number().over(Window.partitionBy(key, "__part").orderBy(place))
    return parts.withColumn("ord", inside).join(counts, [key, "__part"]).withColumn("ord", F.col("ord") + F.col("__before")).drop("__part", "__before")


def chunk_table(blocks: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, ord, start, text): the blank-line chunks of each text, as ``latex.chunk_list`` gives them for a row."""
    held = blocks.where(F.size("lines") > 0)
    placed = held.join(block_heads(held, key), [key, "block"])
    sizes = F.transform("lines", lambda line: F.length(line) + 1)
    marks = F.transform(_opens(F.col("lines"), F.col("blank_before")), lambda o: o.cast("int"))
    placed = placed.select(key, "base", "begun", F.inline(F.arrays_zip(F.col("lines").alias("line"), starts(sizes).alias("at"), starts(marks).alias("earlier"), marks.alias("opens"))))
    lines = placed.where("line <> ''").select(key, (F.col("base") + F.col("at")).alias("at"), (F.col("begun") + F.col("earlier") + F.col("opens")).alias("chunk"), "line")
    whole = lines.groupBy(key, "chunk").agg(F.min("at").alias("at"), F.sort_array(F.collect_list(F.struct("at", "line"))).alias("lines"))
    joined = whole.withColumn("joined", F.array_join(F.transform("lines", lambda x: x["line"]), "\n"))
    lead = F.length("joined") - F.length(F.regexp_replace("joined", f"^{tx.WS}+", ""))
    chunks = joined.select(key, "chunk", (F.col("at") + lead).alias("start"), tx.js_trim(F.col("joined")).alias("text")).where("text <> ''")
    return numbered(chunks, key, "chunk").select(key, "ord", "start", "text")
