"""Archive screening over a member manifest, safe paths, file names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docaudit import fixed as fx


def safe_path(path: Column) -> Column:
    """Forward slashes, no leading slash; null if empty, with NUL or with a ``..`` segment."""
    p = F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), "^/+", "")
    bad = (p == "") | p.contains("\x00") | F.array_contains(F.split(p, "/"), "..")
    return F.when(~bad, p)


def extension(path: Column) -> Column:
    """Lower-case extension with its dot; empty if the name has none."""
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]*)$", 1))


RULES = [
    "symlink", "unsafe_path", "disallowed_extension",
    "too_many_files", "file_too_large", "archive_too_large",
]


def screen_archives(members: DataFrame, max_files: int = fx.ARCHIVE_MAX_FILES) -> DataFrame:
    """First rule broken in member order per archive; null rule means accepted.

    Manifest columns: archive_id, ordinal, path, size, unix_mode, is_dir. Rules of a single
    member are a plain minimum over all members. The file after the ``max_files``-th breaks the
    rule on their number, so the running sums, which only find rules broken before that, stop
    with it; the rank limit is applied before the shuffle, so a huge archive does not land in
    one task.
    """
    is_file = ~F.col("is_dir")
    link = F.col("unix_mode").bitwiseAND(F.lit(fx.MODE_MASK)) == fx.SYMLINK_MODE
    clean = safe_path(F.col("path"))
    own = (
        F.when(link, 0)
        .when(clean.isNull(), 1)
        .when(is_file & ~extension(clean).isin(fx.ARCHIVE_EXTENSIONS), 2)
        .when(is_file & (F.col("size") > fx.ARCHIVE_MAX_FILE_BYTES), 4)
    )
    hit = F.struct("ordinal", F.col("rule").alias("rule"), "path")
    single = members.withColumn("rule", own)
    by_member = single.groupBy("archive_id").agg(
        F.count("*").alias("members"), F.min(F.when(F.col("rule").isNotNull(), hit)).alias("first")
    )
    order = Window.partitionBy("archive_id").orderBy("ordinal")
    files = members.where(is_file).withColumn("n", F.row_number().over(order))
    files = files.where(F.col("n") <= max_files + 1).withColumn(
        "bytes", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0))
    )
    running = F.when(F.col("n") > max_files, 3).when(
        F.col("bytes") > fx.ARCHIVE_MAX_TOTAL_BYTES, 5
    )
    by_run = files.withColumn("rule", running).where("rule is not null").groupBy("archive_id").agg(
        F.min(hit).alias("later")
    )
    df = by_member.join(by_run, "archive_id", "left").withColumn("hit", F.least("first", "later"))
    return df.select(
        "archive_id",
        "members",
        F.get(F.array(*[F.lit(r) for r in RULES]), F.col("hit.rule")).alias("rule"),
        F.col("hit.path").alias("path"),
        F.col("hit").isNull().alias("accepted"),
    )


def file_name(path: Column) -> Column:
    """Text after the first underscore of the last path segment."""
    last = F.element_at(F.split(F.regexp_replace(path, "^gs://[^/]+/", ""), "/"), -1)
    rest = F.regexp_replace(last, "^[^_]*_", "")
    return F.when(last == "", "uploaded-file").otherwise(rest)


def title_of(name: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_replace(name, r"\.[^/.]+$", ""), F.lit("")), F.lit("Untitled"))


def detect_input_type(name: Column) -> Column:
    low = F.lower(name)
    return F.when(low.endswith(".zip"), "LATEX_ZIP").when(low.endswith(".pdf"), "PDF")


def input_type_of(artifact_type: Column) -> Column:
    return (
        F.when(artifact_type == "PR", "PR_TEXT").when(artifact_type == "DOC", "DOC_TEXT").otherwise("SHEET_TEXT")
    )


def content_type_of(fmt: Column) -> Column:
    return (
        F.when(fmt == "markdown", "text/markdown; charset=utf-8")
        .when(fmt == "diff", "text/x-diff; charset=utf-8")
        .when(fmt == "json", "application/json")
        .otherwise("text/plain; charset=utf-8")
    )


def suffix_of(fmt: Column) -> Column:
    return F.when(fmt == "markdown", ".md").when(fmt == "diff", ".diff").when(fmt == "json", ".json").otherwise(".txt")


def is_pdf(content: Column) -> Column:
    """Magic-byte check of binary content."""
    return F.decode(F.substring(content, 1, len(fx.PDF_MAGIC)), "ISO-8859-1") == fx.PDF_MAGIC
