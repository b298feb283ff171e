"""Integrity check of figures, references and citations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docaudit import fixed as fx
from docaudit.functions import arrays as aa
from docaudit.functions import text as tx
from docaudit.functions.plan import settle

NONE = "array<string>"


def _finding(kind: str, value: Column, **refs: Column) -> Column:
    level, template, _ = fx.PREFLIGHT_KINDS[kind]
    name = "UNKNOWN_FIGURE_REFERENCE" if kind == "UNKNOWN_FIGURE_NUMBER" else kind
    none = F.lit(None).cast(NONE)
    return F.struct(
        F.lit(name).alias("kind"),
        F.lit(level).alias("severity"),
        F.replace(F.lit(template), F.lit("{x}"), value).alias("message"),
        value.alias("subject"),
        *[refs.get(n, none).alias(n) for n in ("figure_ids", "paragraph_ids", "citation_keys")],
    )


def _by_subject(refs: Column, field: str, keep) -> Column:
    """(k, xs) of the references that ``keep`` accepts, with their paragraphs, in first-seen order."""
    pairs = F.flatten(
        F.transform(refs, lambda r: F.transform(F.array_distinct(r[field]), lambda x: F.struct(x.alias("k"), r["para_id"].alias("v"))))
    )
    return F.filter(aa.groups(pairs, lambda p: p["k"]), lambda g: keep(g["k"]))


def _ids(group: Column) -> Column:
    return F.transform(group["xs"], lambda p: p["v"])


CHILDREN = ("figures", "refs", "cites", "bib")


def preflight_rows(extracts: DataFrame) -> DataFrame:
    """Add ``findings`` to extract rows that carry figures, refs, cites and bib; map-only.

    Only total functions are used, so an odd document cannot fail the job. One whose lists are
    missing has no findings, and ``preflight_warnings`` says which.

    Order: unmentioned figures, unknown labels, unknown numbers, missing bibliography
    entries, uncited entries; each in first-seen order.
    """
    missing = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in CHILDREN]))
    failed = F.concat(F.lit("preflight failed: missing "), F.array_join(missing, ", "))
    df = extracts.withColumn(
        "preflight_warnings",
        F.when(F.size(missing) > 0, F.array(failed)).otherwise(F.array().cast(NONE)),
    )
    broken = F.size("preflight_warnings") > 0
    df = settle(df.withColumns({c: F.when(broken, F.slice(F.col(c), 1, 0)).otherwise(F.col(c)) for c in CHILDREN}))
    for c in CHILDREN:
        df = df.withColumn(c, F.coalesce(c, F.array().cast(df.schema[c].dataType)))
    figures, refs, cites, bib = (F.col(c) for c in CHILDREN)
    labels = F.filter(F.transform(figures, lambda f: f["label"]), lambda x: x.isNotNull())

    def in_range(number: Column) -> Column:
        value = number.try_cast("decimal(38,0)")
        return tx.let(value, lambda v: F.coalesce((v >= 1) & (v <= F.size("figures")), F.lit(False)))

    lonely = F.filter(figures, lambda f: f["label"].isNotNull() & (F.size(f["mentioned_in"]) == 0))
    uncited = F.array_except(bib, F.flatten(F.transform(cites, lambda c: c["keys"])))
    found = F.concat(
        F.transform(
            lonely,
            lambda f: _finding("MISSING_FIGURE_REFERENCE", f["label"], figure_ids=F.array(f["figure_id"])),
        ),
        F.transform(
            tx.let(labels, lambda known: _by_subject(refs, "labels", lambda x: ~F.array_contains(known, x))),
            lambda g: _finding("UNKNOWN_FIGURE_REFERENCE", g["k"], paragraph_ids=_ids(g)),
        ),
        F.transform(
            _by_subject(refs, "numbers", lambda x: ~in_range(x)),
            lambda g: _finding("UNKNOWN_FIGURE_NUMBER", g["k"], paragraph_ids=_ids(g)),
        ),
        F.transform(
            _by_subject(cites, "keys", lambda x: ~F.array_contains("bib", x)),
            lambda g: _finding("MISSING_BIB_ENTRY", g["k"], paragraph_ids=_ids(g), citation_keys=F.array(g["k"])),
        ),
        F.transform(uncited, lambda x: _finding("UNCITED_BIB_ENTRY", x, citation_keys=F.array(x))),
    )
    df = df.withColumn("findings", found)
    return settle(df)


def finding_table(checked: DataFrame) -> DataFrame:
    """(doc_id, ord, finding_id, kind, severity, message, subject, ids...)."""
    df = checked.select("doc_id", F.posexplode("findings").alias("pos", "f"))
    number = F.col("pos") + 1
    return df.select("doc_id", number.alias("ord"), tx.seq_id("pf", number).alias("finding_id"), "f.*")


def finding_summary(checked: DataFrame) -> DataFrame:
    """Errors and warnings per document, zero included."""
    errors = F.size(F.filter("findings", lambda f: f["severity"] == "error"))
    return checked.select(
        "doc_id",
        errors.alias("error_count"),
        (F.size("findings") - errors).alias("warning_count"),
    )


# ---- the same checks for child tables ---------------------------------------------------


def _grouped(rows: DataFrame, key: str) -> DataFrame:
    """Paragraph ids per key in paragraph order."""
    entry = F.struct("ord", "para_id")
    return rows.groupBy("doc_id", key).agg(
        F.min("ord").alias("first_ord"),
        F.array_sort(F.collect_set(entry))["para_id"].alias("para_ids"),
    )


def missing_citations(cites: DataFrame, bib: DataFrame) -> DataFrame:
    """Cited keys (doc_id, ord, para_id, key) without a bibliography entry."""
    return _grouped(cites.join(bib.select("doc_id", "key"), ["doc_id", "key"], "left_anti"), "key")


def uncited_entries(cites: DataFrame, bib: DataFrame) -> DataFrame:
    """Bibliography entries that no paragraph cites."""
    return bib.join(cites.select("doc_id", "key"), ["doc_id", "key"], "left_anti")


def unknown_labels(refs: DataFrame, figures: DataFrame) -> DataFrame:
    """Label references (doc_id, ord, para_id, label) to undefined figures; case-sensitive."""
    known = figures.where(F.col("label").isNotNull()).select("doc_id", "label")
    return _grouped(refs.join(known, ["doc_id", "label"], "left_anti"), "label")


def unknown_numbers(refs: DataFrame, figures: DataFrame) -> DataFrame:
    """Numbered references (doc_id, ord, para_id, number) beyond the figure count."""
    counts = figures.groupBy("doc_id").agg(F.count("*").alias("n"))
    joined = refs.join(counts, "doc_id", "left")
    value = F.col("number").try_cast("decimal(38,0)")
    inside = F.coalesce((value >= 1) & (value <= F.coalesce("n", F.lit(0))), F.lit(False))
    return _grouped(joined.where(~inside), "number")
