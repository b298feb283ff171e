"""Positioned text items of a page -> lines -> page text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docaudit import fixed as fx
from docaudit.functions import text as tx
from docaudit.functions.plan import settle

NO_SPACE_AFTER = list("([{/\"'-")
NO_SPACE_BEFORE = list(")]}:;,.!?")


def is_cjk(char: Column) -> Column:
    """Kana or kanji; a one-character text compares by code point."""
    return char.between("぀", "ヿ") | char.between("㐀", "鿿")


def binds_after(text: Column) -> Column:
    """No blank follows a text that ends so."""
    last = F.right(text, F.lit(1))
    return is_cjk(last) | last.isin(NO_SPACE_AFTER)


def binds_before(text: Column) -> Column:
    """No blank precedes a text that begins so."""
    first = F.left(text, F.lit(1))
    return is_cjk(first) | first.isin(NO_SPACE_BEFORE)


def _line_numbers():
    """UDF over the items of one page, sorted by falling y and rising x.

    Which line an item joins depends on all items before it (lines are anchored at their
    first y, an end-of-line flag on a merged item opens a new line), so this is a loop over
    numbers; everything else stays in column expressions. Returns the line of each item and
    the y and mean height of each line.
    """
    import pandas as pd

    tolerance = fx.LINE_MERGE_TOLERANCE

    def lines(ys: pd.Series, xs: pd.Series, hs: pd.Series, eols: pd.Series) -> pd.DataFrame:
        import numpy as np

        out = []
        for y, x, h, eol in zip(ys, xs, hs, eols):
            y, x, h, eol = (np.asarray(v) for v in (y, x, h, eol))
            group, anchor, number = [], None, -1
            for v in y.tolist():
                if anchor is None or abs(anchor - v) > tolerance:
                    anchor, number = v, number + 1
                group.append(number)
            order = np.lexsort((x, np.asarray(group, dtype=int)))
            member, place_of = [], order.tolist()
            line_y, line_h, line_n = [], [], []
            top = None
            for i, v, tall, ends in zip(place_of, y[order].tolist(), h[order].tolist(), eol[order].tolist()):
                if top is None or abs(top - v) > tolerance:
                    top = v
                    line_y.append(v), line_h.append(tall), line_n.append(1)
                    member.append(len(line_y) - 1)
                    continue
                before, n = line_h[-1], line_n[-1]
                line_h[-1], line_n[-1] = (before * n + tall) / (n + 1), n + 1
                member.append(len(line_y) - 1)
                if ends:
                    top = v - before
                    line_y.append(top), line_h.append(tall), line_n.append(0)
            used = [k for k, n in enumerate(line_n) if n]
            place = {k: j for j, k in enumerate(used)}
            out.append(
                (
                    [m for _, m in sorted(zip(place_of, map(place.get, member)))],
                    [line_y[k] for k in used],
                    [line_h[k] for k in used],
                )
            )
        return pd.DataFrame(out, columns=["line", "y", "h"])

    lines.__annotations__ = {
        "ys": pd.Series, "xs": pd.Series, "hs": pd.Series, "eols": pd.Series, "return": pd.DataFrame,
    }
    doubles = T.ArrayType(T.DoubleType())
    return F.pandas_udf(
        lines,
        T.StructType(
            [
                T.StructField("line", T.ArrayType(T.IntegerType())),
                T.StructField("y", doubles),
                T.StructField("h", doubles),
            ]
        ),
    )


def page_text(items: DataFrame) -> DataFrame:
    """Items (doc_id, page, seq, text, x, y, height, has_eol) -> (doc_id, page, text).

    A page holds as many items as fit on paper, so collecting one page is bounded.
    """
    clean = items.withColumn("text", tx.spaces(F.col("text"))).where(F.col("text") != "").select(
        "doc_id",
        "page",
        F.struct(
            (-F.col("y")).alias("down"),
            F.col("x").alias("x"),
            F.col("seq").alias("seq"),
            F.col("y").alias("y"),
            F.greatest(F.lit(1.0), F.col("height")).alias("h"),
            "text",
            F.coalesce("has_eol", F.lit(False)).alias("eol"),
            binds_after(F.col("text")).alias("tail"),
            binds_before(F.col("text")).alias("head"),
        ).alias("it"),
    )
    pages = clean.groupBy("doc_id", "page").agg(F.sort_array(F.collect_list("it")).alias("items"))
    placed = _line_numbers()(
        F.col("items.y"), F.col("items.x"), F.col("items.h"), F.col("items.eol")
    )
    pages = settle(pages.withColumn("at", placed))
    parts = F.sort_array(
        F.zip_with(
            "items",
            "at.line",
            lambda it, n: F.struct(n.alias("line"), it["x"].alias("x"), it["seq"].alias("seq"), it["text"].alias("text"), it["tail"].alias("tail"), it["head"].alias("head")),
        )
    )
    pages = settle(pages.select("doc_id", "page", parts.alias("parts"), "at.y", "at.h"))

    def rendered(page: Column) -> Column:
        def gap(line: Column) -> Column:
            wide = F.greatest(
                F.lit(6.0), F.greatest(F.get(page["h"], line - 1), F.get(page["h"], line)) * 1.25
            )
            return (F.get(page["y"], line - 1) - F.get(page["y"], line)) > wide

        def piece(p: Column, i: Column) -> Column:
            prev = F.get(page["parts"], i - 1)
            glue = (
                F.when(i == 0, "")
                .when(prev["line"] != p["line"], F.when(gap(p["line"]), "\n\n").otherwise("\n"))
                .when(prev["tail"] | p["head"], "")
                .otherwise(" ")
            )
            return F.concat(glue, p["text"])

        return tx.js_trim(F.array_join(F.transform(page["parts"], piece), ""))

    return pages.select(
        "doc_id", "page", tx.let(F.struct("parts", "y", "h"), rendered).alias("text")
    )
