"""Artifact text -> structure (sections, paragraphs, warnings), one row per artifact.

Every step is an array expression on the row that holds the text, so the whole
decomposition is a map-only stage: no shuffle, and no group larger than one artifact.
Line-oriented parsing splits before the lines that match, which stays linear in the text
length and needs no mark that a text could hold itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docaudit import fixed as fx
from docaudit.functions import arrays as aa
from docaudit.functions import text as tx
from docaudit.functions.json_text import pretty_json
from docaudit.functions.plan import settle

_LINE = "(?md)"  # multi-line, only \n ends a line
MARKDOWN_HEADING = f"^#{{1,6}}{tx.WS_IN_LINE}+{tx.NOT_WS}.*$"
LABEL_HEADING = f"^[A-Za-z][A-Za-z0-9 _\\-/]{{2,40}}:{tx.WS_IN_LINE}*$"
NOT_PROSE = "^(?:[^A-Za-z]|true|false|null|NaN|Inf)"
NUMBER_HEADING = f"^\\d{{1,2}}(?:\\.\\d{{1,2}})*{tx.WS_IN_LINE}+.+$"


def _split_before(c: Column, line_pattern: str) -> Column:
    """Split a text before every line that matches; the first piece precedes all matches.

    A line end in front of the text keeps that first piece, which a split at the very start
    would not give; it is taken off again.
    """
    pieces = F.split(F.concat(F.lit("\n"), c), f"{_LINE}(?={line_pattern})", -1)
    return F.transform(pieces, lambda p, i: F.when(i == 0, F.substring(p, 2, 1 << 30)).otherwise(p))


def _first_line(piece: Column) -> Column:
    return F.substring_index(piece, "\n", 1)


def _after_first_line(piece: Column) -> Column:
    at = F.instr(piece, "\n")
    return F.when(at > 0, F.substring(piece, at + 1, F.length(piece))).otherwise(F.lit(""))


def _paras(texts: Column, title: Column) -> Column:
    return F.transform(texts, lambda t: F.struct(t.alias("text"), title.alias("title")))


def _section(title: Column, level: Column) -> Column:
    return F.struct(title.alias("title"), level.cast("int").alias("level"))


def _lines(c: Column) -> Column:
    return F.filter(
        F.transform(F.split(tx.newlines(c), "\n", -1), tx.js_trim), lambda t: t != ""
    )


def _count(arr: Column, test) -> Column:
    return F.size(F.filter(arr, test))


def _strings(*items: Column) -> Column:
    """Array of the non-null items."""
    return F.array_compact(F.array(*items))


# ---- SHEET -----------------------------------------------------------------------


def sheet_blocks(docs: DataFrame, max_rows: int | None = None) -> DataFrame:
    """SHEET text: pretty-printed JSON, else the non-blank trimmed lines.

    With ``max_rows`` the column ``rows_left_out`` counts the lines beyond it.
    """
    norm = tx.js_trim(tx.newlines(F.col("text")))
    # Only text that starts like JSON reaches Python; the variant parser allows trailing text. It fails
    # by an exception, so prose, which starts with a letter of no JSON word, is not given to it.
    like_json = lambda t: t.rlike(NOT_PROSE) & F.try_parse_json(t).isNotNull()
    maybe = tx.let(norm, lambda t: F.when(like_json(t), t))
    df = docs.withColumn("lines", _lines(F.col("text"))).withColumn("pretty", pretty_json(maybe))
    df = settle(df.withColumn("is_json", F.col("pretty").isNotNull()))
    rows = tx.first_items("lines", max_rows)
    if max_rows is not None:
        df = df.withColumn("rows_left_out", F.when(F.col("is_json"), 0).otherwise(tx.left_out(F.size("lines"), max_rows)))
    pretty = tx.paragraph_list(F.col("pretty"))
    body = F.when(F.col("is_json"), _paras(pretty, F.lit(fx.SHEET_JSON_TITLE))).otherwise(
        _paras(rows, F.lit(fx.SHEET_ROWS_TITLE))
    )
    title = F.when(F.col("is_json"), fx.SHEET_JSON_TITLE).otherwise(fx.SHEET_ROWS_TITLE)
    df = df.withColumn("sections", F.array(_section(title, F.lit(1)))).withColumn("paras", body)
    return df.drop("is_json", "pretty")


def with_fallback_split(df: DataFrame) -> DataFrame:
    """No structured paragraph at all: plain blank-line split plus a warning."""
    none = F.size("paras") == 0
    plain = _paras(tx.paragraph_list(F.col("text")), F.lit(None).cast("string"))
    warning = F.when(none, fx.MSG["fallback_split"])
    df = df.withColumn("warnings", _strings(warning))
    return df.withColumn("paras", F.when(none, plain).otherwise(F.col("paras")))


def sheet_signal_counts(df: DataFrame) -> DataFrame:
    """Row counts behind the SHEET signals."""
    lines = F.col("lines")
    return df.select(
        "*",
        F.size(lines).alias("n_rows"),
        _count(
            lines, lambda t: tx.has_digit(t) & tx.matches(t, fx.SHEET_NUMERIC_ROW, False)
        ).alias("n_numeric"),
        _count(
            lines, lambda t: t.contains("=") & tx.matches(t, fx.SHEET_FORMULA_ROW, False)
        ).alias("n_formula"),
        tx.matches(F.col("text"), fx.SHEET_SOURCE_WORD).alias("has_source"),
    )


def _append_signals(df: DataFrame, signals: Column, warnings: Column) -> DataFrame:
    """Signals become paragraphs of a last section and so take part in later steps."""
    some = F.size("signals") > 0
    section = F.array(_section(F.lit(fx.ARTIFACT_SIGNALS_TITLE), F.lit(2)))
    df = settle(df.withColumn("signals", signals).withColumn("signal_warnings", warnings))
    return df.select(
        "*",
        F.when(some, F.concat("sections", section)).otherwise(F.col("sections")).alias("s2"),
        F.concat("paras", _paras(F.col("signals"), F.lit(fx.ARTIFACT_SIGNALS_TITLE))).alias("p2"),
        F.concat("warnings", "signal_warnings").alias("w2"),
    ).drop("sections", "paras", "warnings", "signals", "signal_warnings").withColumnsRenamed(
        {"s2": "sections", "p2": "paras", "w2": "warnings"}
    )


def sheet_extract(docs: DataFrame, max_rows: int | None = None) -> DataFrame:
    """SHEET artifacts (doc_id, text) -> extract rows."""
    df = sheet_signal_counts(settle(with_fallback_split(sheet_blocks(docs, max_rows))))
    df = settle(df.drop("text", "lines"))
    stat = F.format_string(
        "SHEET統計: rows=%d, paragraphs=%d, numeric_rows=%d", "n_rows", F.size("paras"), "n_numeric"
    )
    signals = _strings(
        stat,
        F.when(F.col("n_formula") == 0, fx.MSG["sheet_no_formula"]),
        F.when(F.col("n_numeric") == 0, fx.MSG["sheet_no_numbers"]),
        F.when(~F.col("has_source"), fx.MSG["sheet_no_source"]),
    )
    warnings = _strings(F.when(F.col("n_numeric") == 0, fx.MSG["sheet_no_numbers_warning"]))
    return finish_extract(_append_signals(df, signals, warnings), "SHEET")


# ---- DOC -------------------------------------------------------------------------


def _heading_of(piece: Column, marked: Column, other) -> Column:
    """Heading struct of a piece that starts with a heading line, else null."""
    line = _first_line(piece)
    hashes = tx.first_match(line, f"^(#{{1,6}}){tx.WS_IN_LINE}")
    md_title = tx.js_trim(F.regexp_replace(line, f"^#{{1,6}}{tx.WS_IN_LINE}+", ""))
    other_title, other_level = other(line)
    return F.when(
        marked,
        F.when(hashes != "", _section(md_title, F.length(hashes))).otherwise(
            _section(other_title, other_level)
        ),
    )


def _numbered(line: Column):
    number = tx.first_match(line, "^(\\d{1,2}(?:\\.\\d{1,2})*)")
    title = tx.js_trim(F.regexp_replace(line, "^\\d{1,2}(?:\\.\\d{1,2})*", ""))
    depth = F.length(F.regexp_replace(number, "[^.]", "")) + 1
    return title, F.least(F.lit(6), depth)


def _labelled(line: Column):
    return tx.js_trim(F.regexp_replace(tx.js_trim(line), ":$", "")), F.lit(2)


def doc_blocks(docs: DataFrame) -> DataFrame:
    """DOC text: markdown and numbered headings; blank lines end a block."""
    pattern = f"(?:{MARKDOWN_HEADING}|{NUMBER_HEADING})"
    pieces = _split_before(tx.newlines(F.col("text")), pattern)
    df = settle(docs.withColumn("pieces", pieces))
    df = df.withColumn(
        "pieces",
        F.transform(
            "pieces",
            lambda p, i: F.struct(
                _heading_of(p, i > 0, _numbered).alias("h"),
                F.when(i > 0, _after_first_line(p)).otherwise(p).alias("body"),
            ),
        ),
    )

    def blocks(body: Column) -> Column:
        cut = F.split(body, f"(?:^|\\n){tx.WS}*(?:\\n|\\z)", -1)
        return F.filter(F.transform(cut, tx.js_trim), lambda b: b != "")

    paras = F.flatten(
        F.transform("pieces", lambda p: _paras(blocks(p["body"]), F.nullif(p["h"]["title"], F.lit(""))))
    )
    heads = F.filter(
        F.transform("pieces", lambda p: p["h"]), lambda h: h.isNotNull() & (h["title"] != "")
    )
    df = settle(df).withColumn("heads", heads).withColumn("paras", paras)
    kept = aa.first_of_each(F.col("heads"), lambda h: F.lower(tx.js_trim(h["title"])))
    return df.withColumn("sections", kept).drop("pieces", "heads")


def doc_extract(docs: DataFrame) -> DataFrame:
    """DOC artifacts (doc_id, text) -> extract rows."""
    df = settle(with_fallback_split(settle(doc_blocks(docs))))
    lower = F.lower(F.col("text"))
    checks = [
        ("has_evidence", fx.DOC_EVIDENCE_WORD, "doc_no_evidence"),
        ("has_decision", fx.DOC_DECISION_WORD, "doc_no_decision"),
        ("has_risk", fx.DOC_RISK_WORD, "doc_no_risk"),
        ("has_assumption", fx.DOC_ASSUMPTION_WORD, "doc_no_assumption"),
    ]
    df = settle(df.select("*", *[tx.matches(lower, p).alias(n) for n, p, _ in checks]).drop("text"))
    stat = F.format_string(
        "DOC統計: sections=%d, paragraphs=%d", F.size("sections"), F.size("paras")
    )
    signals = _strings(stat, *[F.when(~F.col(n), fx.MSG[m]) for n, _, m in checks])
    warnings = _strings(F.when(~F.col("has_evidence"), fx.MSG["doc_no_evidence_warning"]))
    df = df.withColumn("n_sections", F.size("sections")).withColumn("n_paras", F.size("paras"))
    return finish_extract(_append_signals(df, signals, warnings), "DOC")


# ---- shared tail -------------------------------------------------------------------


def finish_extract(df: DataFrame, artifact_type: str) -> DataFrame:
    """Ids for sections and paragraphs, section lookup by title, the common extract shape."""
    df = df.withColumn(
        "sections",
        F.transform(
            "sections",
            lambda s, i: F.struct(
                tx.seq_id("sec", i + 1).alias("section_id"),
                s["title"].alias("title"),
                s["level"].alias("level"),
            ),
        ),
    )

    # The last section of a title
    by_title = F.map_from_entries(
        F.transform(
            aa.first_of_each(F.reverse("sections"), lambda s: s["title"]),
            lambda s: F.struct(s["title"], s["section_id"]),
        )
    )
    df = settle(df).withColumn(
        "paragraphs",
        tx.let(
            by_title,
            lambda ids: F.transform(
                "paras",
                lambda p, i: F.struct(
                    tx.seq_id("par", i + 1).alias("para_id"),
                    F.try_element_at(ids, p["title"]).alias("section_id"),
                    p["text"].alias("text"),
                ),
            ),
        ),
    ).drop("paras")
    no_heading = F.when(F.size("sections") == 0, fx.MSG["no_headings"])
    if artifact_type in ("DOC", "SHEET"):
        df = df.withColumn("warnings", F.concat("warnings", _strings(no_heading)))
    return settle(df.withColumn("artifact_type", F.lit(artifact_type)))


def paragraph_table(extracts: DataFrame) -> DataFrame:
    """Child table (doc_id, ord, para_id, section_id, text)."""
    return extracts.select("doc_id", F.posexplode("paragraphs").alias("pos", "p")).select(
        "doc_id", (F.col("pos") + 1).alias("ord"), "p.para_id", "p.section_id", "p.text"
    )


def section_table(extracts: DataFrame) -> DataFrame:
    """Child table (doc_id, ord, section_id, title, level)."""
    return extracts.select("doc_id", F.posexplode("sections").alias("pos", "s")).select(
        "doc_id", (F.col("pos") + 1).alias("ord"), "s.section_id", "s.title", "s.level"
    )


def warning_table(extracts: DataFrame) -> DataFrame:
    """Child table (doc_id, ord, warning)."""
    return extracts.select("doc_id", F.posexplode("warnings").alias("pos", "warning")).select(
        "doc_id", (F.col("pos") + 1).alias("ord"), "warning"
    )
