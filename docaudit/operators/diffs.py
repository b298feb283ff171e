"""Pull-request text: sections, unified-diff hunks, review signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docaudit import fixed as fx
from docaudit.functions import arrays as aa
from docaudit.functions import text as tx
from docaudit.functions.plan import settle
from docaudit.operators import structure as st

FILE_LINE = f"^diff --git{tx.WS_IN_LINE}+a/.+{tx.WS_IN_LINE}+b/.+$"
FILE_PATH = f"(?d)\\Adiff --git{tx.WS_IN_LINE}+a/.+{tx.WS_IN_LINE}+b/(.+)\\z"
HUNK_LINE = "^@@"
FLUSH_LINE = "(?:^diff --git |^@@ )"


# ---- sections of the PR text ----------------------------------------------------------


def pr_blocks(docs: DataFrame) -> DataFrame:
    """Headings (``#`` or ``Label:``) open sections; diff headers and hunk lines end a block."""
    norm = tx.js_trim(tx.newlines(F.col("text")))
    df = settle(docs.withColumn("norm", norm))
    heading = f"(?:{st.MARKDOWN_HEADING}|{st.LABEL_HEADING})"
    pieces = st._split_before(F.col("norm"), heading)
    default = st._section(F.lit(fx.PR_DEFAULT_TITLE), F.lit(1))
    df = df.withColumn(
        "pieces",
        F.transform(
            pieces,
            lambda p, i: F.struct(
                F.coalesce(st._heading_of(p, i > 0, st._labelled), default).alias("h"),
                F.when(i > 0, st._after_first_line(p)).otherwise(p).alias("body"),
            ),
        ),
    )

    def blocks(body: Column) -> Column:
        parts = st._split_before(body, FLUSH_LINE)
        # Every part but the first begins with the line that ended the block before it.
        bodies = F.transform(parts, lambda b, i: F.when(i > 0, st._after_first_line(b)).otherwise(b))
        return F.filter(F.transform(bodies, tx.js_trim), lambda b: b != "")

    def paragraphs(block: Column) -> Column:
        return tx.let(
            tx.paragraph_list(block),
            lambda ps: F.when(F.size(ps) > 0, ps).otherwise(F.array(block)),
        )

    df = settle(df).withColumn(
        "parsed",
        F.flatten(
            F.transform(
                "pieces",
                lambda p: F.transform(
                    blocks(p["body"]),
                    lambda b: F.struct(p["h"].alias("h"), paragraphs(b).alias("texts")),
                ),
            )
        ),
    )
    return settle(df.drop("pieces"))


# ---- hunks -------------------------------------------------------------------------------


def hunk_list(text: Column) -> Column:
    """Hunks with path, header and the added, removed and context lines, in text order."""

    def of_file(piece: Column) -> Column:
        path = tx.first_match(st._first_line(piece), FILE_PATH)
        hunks = F.slice(st._split_before(piece, HUNK_LINE), 2, 1 << 30)
        return tx.let(
            F.when(path != "", path).otherwise("unknown"),
            lambda path: F.transform(hunks, lambda h: of_hunk(path, h)),
        )

    def of_hunk(path: Column, hunk: Column) -> Column:
        def lists(lines: Column) -> Column:
            is_add = lambda x: x.startswith("+") & ~x.startswith("+++")
            is_del = lambda x: x.startswith("-") & ~x.startswith("---")
            cut = lambda x: F.substring(x, 2, 1 << 30)
            rest = F.filter(
                lines,
                lambda x: ~is_add(x) & ~is_del(x) & (x.startswith(" ") | ~tx.is_blank(x)),
            )
            return F.struct(
                path.alias("path"),
                st._first_line(hunk).alias("header"),
                F.transform(F.filter(lines, is_add), cut).alias("added"),
                F.transform(F.filter(lines, is_del), cut).alias("removed"),
                F.transform(rest, lambda x: F.regexp_replace(x, "^ ", "")).alias("context"),
            )

        return tx.let(F.split(st._after_first_line(hunk), "\n", -1), lists)

    return F.flatten(F.transform(st._split_before(text, FILE_LINE), of_file))


def preview(lines: Column, max_lines: int | None = None, max_chars: int | None = None) -> Column:
    """Non-blank lines, spaces normalised and joined."""
    return tx.let(
        tx.first_items(F.filter(F.transform(lines, tx.spaces), lambda x: x != ""), max_lines),
        lambda p: F.when(F.size(p) == 0, "(none)").otherwise(
            tx.first_chars(F.array_join(p, " ; "), max_chars)
        ),
    )


def hunk_summary(hunk: Column, number: Column) -> Column:
    return F.format_string(
        "Diff Hunk %d: file=%s | header=%s | added(%d)=%s | removed(%d)=%s | context=%s",
        number, hunk["path"], hunk["header"],
        F.size(hunk["added"]), preview(hunk["added"]),
        F.size(hunk["removed"]), preview(hunk["removed"]),
        preview(hunk["context"]),
    )


# ---- signals --------------------------------------------------------------------------------


def _hits(lines: Column, pattern: str, ignore_case: bool) -> Column:
    return F.size(F.filter(lines, lambda x: tx.matches(x, pattern, ignore_case)))


def changed_names(lines: Column) -> Column:
    """Function and class names on added lines, distinct, in line and pattern order."""
    per_line = lambda x: tx.let(
        tx.spaces(x),
        lambda line: F.array(
            *[F.regexp_extract(line, tx.spark_regex(p), 1) for p in fx.CHANGED_NAME_PATTERNS]
        ),
    )
    # Lines without any of these words cannot name anything.
    cue = "function|const|let|var|class"
    some = F.filter(lines, lambda x: x.rlike(cue))
    names = F.flatten(F.transform(some, per_line))
    return F.array_distinct(F.filter(names, lambda n: n != ""))


def diff_stats(hunked: DataFrame) -> DataFrame:
    """Counts behind the review signals of a row with ``norm`` and ``hunks``."""
    df = hunked.withColumn("files", F.array_distinct(F.col("hunks.path")))
    df = df.withColumn("added", F.flatten(F.col("hunks.added"))).withColumn(
        "removed", F.flatten(F.col("hunks.removed"))
    )
    df = settle(df)

    def paths(pattern: str) -> Column:
        regex = tx.spark_regex(pattern, True)
        return F.filter("files", lambda f: f.rlike(regex))

    return settle(
        df.select(
            "*",
            F.size("files").alias("n_files"),
            F.size("hunks").alias("n_hunks"),
            F.size("added").alias("n_added"),
            F.size("removed").alias("n_removed"),
            F.size(paths(fx.CODE_FILE)).alias("n_code"),
            F.size(paths(fx.TEST_FILE)).alias("n_test"),
            paths(fx.MIGRATION_FILE).alias("migrations"),
            paths(fx.SECURITY_FILE).alias("securities"),
            *[_hits(F.col("added"), p, ci).alias(f"risk_{rid}") for rid, _, p, ci in fx.DIFF_RISK_RULES],
            _hits(F.col("removed"), fx.REMOVED_ASSERTION, False).alias("n_assertions"),
            changed_names(F.col("added")).alias("names"),
            tx.matches(F.col("norm"), fx.MIGRATION_WORD).alias("has_migration_text"),
        )
    )


def signal_list(max_paths: int | None = None, max_names: int | None = None) -> Column:
    """Array of (text, warning) signals from the columns of ``diff_stats``."""
    c = F.col
    none = F.lit(None).cast("string")

    def signal(when: Column | None, text: Column, warning: Column = none) -> Column:
        s = F.struct(text.alias("text"), warning.alias("warning"))
        return s if when is None else F.when(when, s)

    def listed(name: str, n: int | None) -> Column:
        return F.array_join(tx.first_items(name, n), ", ")

    total = c("n_added") + c("n_removed")
    items = [
        signal(
            None,
            F.format_string(
                "PR統計: files=%d, hunks=%d, added=%d, removed=%d", "n_files", "n_hunks", "n_added", "n_removed"
            ),
        ),
        signal(
            None,
            F.format_string("テスト信号: code_files=%d, test_files=%d", "n_code", "n_test"),
            F.when((c("n_code") > 0) & (c("n_test") == 0), fx.MSG["pr_no_tests"]),
        ),
        signal(
            F.size("securities") > 0,
            F.concat(F.lit("セキュリティ関連ファイル変更: "), listed("securities", max_paths)),
            F.lit(fx.MSG["pr_security"]),
        ),
        signal(
            F.size("migrations") > 0,
            F.concat(F.lit("スキーマ変更ファイル: "), listed("migrations", max_paths)),
            F.when(~c("has_migration_text"), fx.MSG["pr_migration"]),
        ),
        signal(
            total >= fx.LARGE_DIFF_LINES,
            F.format_string("大規模差分: total_lines=%d", total),
            F.lit(fx.MSG["pr_large"]),
        ),
    ]
    for rid, label, _, _ in fx.DIFF_RISK_RULES:
        n = c(f"risk_{rid}")
        items.append(
            signal(
                n > 0,
                F.format_string(f"リスク信号({rid}): {label} (count=%d)", n),
                F.lit(label + fx.MSG["pr_risk_suffix"]),
            )
        )
    items.append(
        signal(
            c("n_assertions") > 0,
            F.format_string("検証削除信号: assertion-like lines removed count=%d", "n_assertions"),
            F.lit(fx.MSG["pr_assertions"]),
        )
    )
    items.append(
        signal(
            F.size("names") > 0,
            F.concat(F.lit("変更関数候補: "), listed("names", max_names)),
        )
    )
    return F.array_compact(F.array(*items))


def pr_signals(docs: DataFrame) -> DataFrame:
    """(doc_id, ord, text, warning) signals of each PR text with hunks."""
    norm = tx.js_trim(tx.newlines(F.col("text")))
    df = settle(docs.select("doc_id", norm.alias("norm")))
    df = settle(df.withColumn("hunks", hunk_list(F.col("norm")))).where(F.size("hunks") > 0)
    df = diff_stats(df).select("doc_id", F.posexplode(signal_list()).alias("pos", "s"))
    return df.select("doc_id", (F.col("pos") + 1).alias("ord"), "s.text", "s.warning")


def hunk_table(docs: DataFrame) -> DataFrame:
    """(doc_id, ord, path, header, added, removed, context, summary)."""
    norm = tx.js_trim(tx.newlines(F.col("text")))
    df = docs.select("doc_id", F.posexplode(hunk_list(norm)).alias("pos", "h"))
    number = F.col("pos") + 1
    return df.select(
        "doc_id", number.alias("ord"), "h.*", hunk_summary(F.col("h"), number).alias("summary")
    )


def pr_extract(docs: DataFrame) -> DataFrame:
    """PR artifacts (doc_id, text) -> extract rows."""
    df = pr_blocks(docs).withColumn("hunks", hunk_list(F.col("norm")))
    df = diff_stats(settle(df))
    some_hunks = F.size("hunks") > 0
    no_sections = F.array().cast("array<struct<title:string,level:int>>")
    no_paras = F.array().cast("array<struct<text:string,title:string>>")
    signals = F.when(some_hunks, signal_list()).otherwise(
        F.array().cast("array<struct<text:string,warning:string>>")
    )
    df = settle(df.withColumn("signals", signals))
    heads = F.transform("parsed", lambda p: p["h"])
    body = F.flatten(F.transform("parsed", lambda p: st._paras(p["texts"], p["h"]["title"])))
    summaries = F.transform("hunks", lambda h, i: hunk_summary(h, i + 1))
    sections = F.concat(
        heads,
        F.when(some_hunks, F.array(st._section(F.lit(fx.PR_DIFF_TITLE), F.lit(2)))).otherwise(no_sections),
        F.when(F.size("signals") > 0, F.array(st._section(F.lit(fx.PR_SIGNALS_TITLE), F.lit(2)))).otherwise(
            no_sections
        ),
    )
    paras = F.concat(
        body,
        F.when(some_hunks, st._paras(summaries, F.lit(fx.PR_DIFF_TITLE))).otherwise(no_paras),
        st._paras(F.col("signals.text"), F.lit(fx.PR_SIGNALS_TITLE)),
    )
    warnings = F.concat(
        F.array_compact(F.array(F.when(~some_hunks, fx.MSG["pr_no_diff"]))),
        F.array_compact(F.col("signals.warning")),
    )
    df = settle(
        df.select(
            "doc_id",
            sections.alias("sections"),
            paras.alias("paras"),
            warnings.alias("warnings"),
        )
    )
    trimmed = F.transform("paras", lambda p: p.withField("text", tx.js_trim(p["text"])))
    df = df.withColumn(
        "paras",
        aa.first_of_each(F.filter(trimmed, lambda p: p["text"] != ""), lambda p: F.lower(p["text"])),
    ).withColumn("sections", aa.first_of_each(F.col("sections"), lambda s: F.lower(s["title"])))
    return st.finish_extract(df, "PR")
