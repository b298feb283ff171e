"""Quality gate, metrics and the ranked risk list."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docaudit import fixed as fx
from docaudit.functions import arrays as aa
from docaudit.functions import text as tx
from docaudit.functions.plan import settle
from docaudit.operators.evidence import evidence_reason

def by_type(value_of, type_col: str = "artifact_type") -> Column:
    """Value per artifact type; unknown types count as PAPER."""
    out = F
    for kind in ("PR", "DOC", "SHEET"):
        out = out.when(F.col(type_col) == kind, value_of(kind))
    return out.otherwise(value_of("PAPER"))


def quality_gate(extracts: DataFrame) -> DataFrame:
    """Paragraph count, characters, mean, thresholds and ``passed`` per artifact."""
    chars = F.aggregate("paragraphs", F.lit(0), lambda a, p: a + F.length(p["text"]))
    df = extracts.select(
        "doc_id", "artifact_type", F.size("paragraphs").alias("paragraphs"), chars.alias("chars")
    )
    mean = F.floor(F.col("chars") / F.col("paragraphs") + 0.5)
    need = [by_type(lambda k, i=i: F.lit(fx.QUALITY_GATE[k][i])) for i in (0, 1)]
    return df.select(
        "*",
        F.when(F.col("paragraphs") > 0, mean).otherwise(0).alias("mean_chars"),
        need[0].alias("min_paragraphs"),
        need[1].alias("min_chars"),
    ).withColumn(
        "passed",
        (F.col("paragraphs") >= F.col("min_paragraphs")) & (F.col("chars") >= F.col("min_chars")),
    )


def split_by_gate(extracts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted extract rows, rejects with a reason); the gate reads the row itself."""
    chars = F.aggregate("paragraphs", F.lit(0), lambda a, p: a + F.length(p["text"]))
    need = [by_type(lambda k, i=i: F.lit(fx.QUALITY_GATE[k][i])) for i in (0, 1)]
    passed = (F.size("paragraphs") >= need[0]) & (chars >= need[1])
    rejects = extracts.where(~passed).select(
        "doc_id", "artifact_type", F.lit("extracted text is too sparse for reliable analysis").alias("reason")
    )
    return extracts.where(passed), rejects


def _refs(**arrays: Column) -> Column:
    names = ("claim_ids", "paragraph_ids", "figure_ids", "citation_keys")
    none = F.lit(None).cast("array<string>")
    return F.struct(*[arrays.get(n, none).alias(n) for n in names])


def ranked_risks(evidence: Column, logic: Column, findings: Column | None) -> Column:
    """(rank, severity, title, reason, refs) of all risks of a document.

    Severity first, then source order; equal (severity, title, reason) are kept once.
    """

    def risk(src: int, pos: Column, severity: Column, title: Column, reason: Column, refs: Column) -> Column:
        return F.struct(
            (-tx.severity_rank(severity)).alias("neg"), F.lit(src).alias("src"), pos.cast("int").alias("pos"), severity.alias("severity"),
            title.alias("title"), reason.alias("reason"), refs.alias("refs"),
        )

    def titled(prefix: str, r: Column) -> Column:
        return F.concat(F.lit(fx.MSG[prefix]), F.coalesce(F.nullif(tx.headline(r["text"]), F.lit("")), r["claim_id"]))

    parts = [
        F.transform(
            evidence,
            lambda r: risk(
                0, r["ord"], r["severity"], titled("evidence_title", r),
                evidence_reason(r["code"], r["best_score"], r["avg_score"], r["coverage"]),
                _refs(claim_ids=F.array(r["claim_id"]), paragraph_ids=r["para_ids"]),
            ),
        ),
        F.transform(
            logic,
            lambda r: risk(1, r["ord"], r["severity"], titled("logic_title", r), r["reason"], _refs(claim_ids=F.array(r["claim_id"]))),
        ),
    ]
    if findings is not None:
        titles = {k: v[2] for k, v in fx.PREFLIGHT_KINDS.items() if k != "UNKNOWN_FIGURE_NUMBER"}

        def found(f: Column, i: Column) -> Column:
            title = reduce(lambda c, kv: c.when(f["kind"] == kv[0], kv[1]), titles.items(), F).otherwise(f["kind"])
            level = F.when(f["severity"] == "error", "HIGH").otherwise("MEDIUM")
            refs = _refs(paragraph_ids=f["paragraph_ids"], figure_ids=f["figure_ids"], citation_keys=f["citation_keys"])
            return risk(2, i + 1, level, title, f["message"], refs)

        parts.append(F.transform(findings, found))
    some = F.sort_array(F.filter(F.concat(*parts), lambda r: ~tx.is_blank(r["title"])))
    unique = aa.first_of_each(some, lambda r: F.struct(r["severity"], r["title"], r["reason"]))
    return F.transform(
        unique,
        lambda r, i: F.struct((i + 1).alias("rank"), *[r[n].alias(n) for n in ("severity", "title", "reason", "refs")]),
    )


def signal_metrics(evidence: Column, logic: Column) -> Column:
    """Counts of risk rows by kind (rows, not distinct claims)."""
    none = F.size(F.filter(evidence, lambda r: F.size(r["para_ids"]) == 0))
    lack = F.size(F.filter(logic, lambda r: r["severity"].isin("HIGH", "MEDIUM")))
    return F.struct(
        none.alias("no_evidence_claims"),
        (F.size(evidence) - none + F.size(logic) - lack).alias("weak_evidence_claims"),
        lack.alias("specificity_lack"),
    )


def risk_rows(rows: DataFrame, findings: bool = True) -> DataFrame:
    """Add ``evidence`` (risks of the audit), ``risks`` (ranked) and ``metrics`` to audited rows; map-only."""
    df = settle(rows.withColumn("evidence", F.filter("audit", lambda a: a["code"].isNotNull())))
    found = F.col("findings") if findings else None
    ranked = ranked_risks(F.col("evidence"), F.col("logic"), found)
    return settle(df.withColumns({"risks": ranked, "metrics": signal_metrics(F.col("evidence"), F.col("logic"))}))


def risk_table(rows: DataFrame, limit: int | None = None) -> DataFrame:
    """(doc_id, rank, severity, title, reason, refs); with ``limit`` only so many per document, and left_out."""
    if limit is None:
        return rows.select("doc_id", F.inline("risks"))
    left = tx.left_out(F.size("risks"), limit).alias("left_out")
    return rows.select("doc_id", left, F.inline(F.slice("risks", 1, limit)))


def signal_counts(rows: DataFrame) -> DataFrame:
    """Risk rows per document by kind, zero included."""
    return rows.select("doc_id", "metrics.*")


def severity_histogram(rows: DataFrame) -> DataFrame:
    """high / medium / low counts of the ranked risks per document, zero included."""
    count = lambda level: F.size(F.filter("risks", lambda r: r["severity"] == level))
    high, medium = count("HIGH"), count("MEDIUM")
    return rows.select("doc_id", high.alias("high"), medium.alias("medium"), (F.size("risks") - high - medium).alias("low"))


def risk_split(risks: DataFrame, first: int = 3, following: int = 5) -> DataFrame:
    """Marks the first three risks and the next five of each document."""
    return risks.where(F.col("rank") <= first + following).withColumn(
        "part", F.when(F.col("rank") <= first, f"top{first}").otherwise(f"next{following}")
    )


def ref_counts(risks: DataFrame) -> DataFrame:
    """Number of referenced claims, paragraphs and citations; missing lists count as 0."""
    empty = F.array().cast("array<string>")

    def count(name: str) -> Column:
        return F.size(F.coalesce(F.col(f"refs.{name}"), empty))

    return risks.select(
        "*",
        count("claim_ids").alias("n_claims"),
        count("paragraph_ids").alias("n_paragraphs"),
        count("citation_keys").alias("n_citations"),
    )
