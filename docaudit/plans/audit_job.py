"""The whole audit: route artifacts, gate, mine, challenge, synthesise, summarise."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docaudit import fixed as fx
from docaudit.functions import text as tx
from docaudit.functions.plan import settle
from docaudit.operators import candidates as cd
from docaudit.operators import claims as cl
from docaudit.operators import diffs as dd
from docaudit.operators import evidence as ev
from docaudit.operators import latex as lx
from docaudit.operators import logic as lo
from docaudit.operators import preflight as pf
from docaudit.operators import records as rc
from docaudit.operators import risks as rk
from docaudit.operators import structure as st

# An adapter turns (doc_id, text) rows of one artifact type into extract rows.
Adapter = Callable[[DataFrame], DataFrame]
ADAPTERS: dict[str, Adapter] = {
    "PAPER": lx.paper_extract,
    "SHEET": st.sheet_extract,
    "DOC": st.doc_extract,
    "PR": dd.pr_extract,
}
INPUT_TYPES = {"PAPER": "LATEX_ZIP", "PR": "PR_TEXT", "DOC": "DOC_TEXT", "SHEET": "SHEET_TEXT"}

FIGURES = "array<struct<figure_id:string,label:string,caption:string,mentioned_in:array<string>>>"
CITES = "array<struct<para_id:string,keys:array<string>>>"
COMMON = ["doc_id", "artifact_type", "sections", "paragraphs", "figures", "refs", "cites", "bib", "warnings"]


def register_adapter(artifact_type: str, adapter: Adapter) -> None:
    ADAPTERS[artifact_type] = adapter


def common_rows(extracts: DataFrame, *more: str) -> DataFrame:
    """The shared extract shape: missing child lists are empty, references read from the text."""
    df = extracts
    for name, kind in (("figures", FIGURES), ("cites", CITES), ("bib", "array<string>")):
        if name not in df.columns:
            df = df.withColumn(name, F.array().cast(kind))
    if "refs" not in df.columns:
        df = df.withColumn(
            "refs",
            F.transform(
                "paragraphs",
                lambda p: F.struct(
                    p["para_id"].alias("para_id"),
                    lx.label_refs(p["text"]).alias("labels"),
                    lx.number_refs(p["text"]).alias("numbers"),
                ),
            ),
        )
    sections = F.transform(
        "sections",
        lambda s: F.struct(s["section_id"].alias("section_id"), s["title"].alias("title"), s["level"].alias("level")),
    )
    return settle(df.withColumn("sections", sections).select(*COMMON, *more))


def resolved_type(c: Column) -> Column:
    """Unknown or missing artifact types count as PAPER."""
    return F.when(c.isin(fx.ARTIFACT_TYPES), c).otherwise("PAPER")


def route(artifacts: DataFrame, papers: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Artifacts (doc_id, artifact_type, input_type, text) -> (extract rows, rejects).

    Every artifact ends in one of the two. A paper is extracted from its expanded LaTeX source in
    ``text``, or has an extract row of its own in ``papers`` (of the source ensemble, say). Unknown
    types count as papers. Blank texts and mismatched input types become rejects, not failures.
    """
    kind = resolved_type(F.col("artifact_type"))
    wanted = reduce(lambda c, kv: c.when(kind == kv[0], kv[1]), INPUT_TYPES.items(), F)
    df = artifacts.withColumn("kind", kind).withColumn("own", F.lit(False))
    if papers is not None:
        given = papers.select("doc_id", F.lit(True).alias("given")).distinct()
        df = df.drop("own").join(given, "doc_id", "left").withColumn("own", F.coalesce("given", F.lit(False)) & (F.col("kind") == "PAPER")).drop("given")
    matches = F.coalesce(F.col("input_type") == wanted, F.lit(False))
    reason = (
        F.when(F.col("own"), F.lit(None).cast("string"))
        .when((kind == "PAPER") & F.coalesce(F.col("input_type") == "PDF", F.lit(False)), "no extract row for the paper")
        .when(~matches, "inputType does not match artifactType")
        .when(tx.is_blank(F.coalesce("text", F.lit(""))), "artifact text is empty")
    )
    df = df.withColumn("reason", reason)
    rejects = df.where(F.col("reason").isNotNull()).select(
        "doc_id", F.col("kind").alias("artifact_type"), "reason"
    )
    good = df.where(F.col("reason").isNull() & ~F.col("own"))
    parts = [
        common_rows(adapter(good.where(F.col("kind") == name).select("doc_id", "text")))
        for name, adapter in ADAPTERS.items()
    ]
    if papers is not None:
        used = df.where("own").select("doc_id")
        parts.append(common_rows(papers.join(used, "doc_id", "left_semi")))
    return reduce(DataFrame.unionByName, parts), rejects


@dataclass
class Audit:
    """Rows of one run, one per document, and what was rejected; the child tables are cut from the rows."""

    rows: DataFrame
    rejects: DataFrame

    @property
    def result(self) -> DataFrame:
        """One nested result row per document."""
        return result_rows(self.rows)

    @property
    def claims(self) -> DataFrame:
        return cl.claim_table(self.rows)

    @property
    def evidence(self) -> DataFrame:
        return self.rows.select("doc_id", F.inline("evidence"))

    @property
    def logic(self) -> DataFrame:
        return self.rows.select("doc_id", F.inline("logic"))

    @property
    def prior_art(self) -> DataFrame:
        return self.rows.select("doc_id", F.inline("prior_art"))

    @property
    def findings(self) -> DataFrame:
        return pf.finding_table(self.rows)

    @property
    def top_risks(self) -> DataFrame:
        return rk.risk_table(self.rows)

    @property
    def metrics(self) -> DataFrame:
        return rk.signal_counts(self.rows)

    @property
    def warnings(self) -> DataFrame:
        """Warnings of the claims and the integrity check, as the result row has them."""
        listed = self.rows.select("doc_id", F.posexplode(pipeline_warnings()).alias("pos", "warning"))
        return listed.select("doc_id", (F.col("pos") + 1).alias("ord"), "warning")

    @property
    def trace(self) -> DataFrame:
        return trace_table(self.rows)


TIMES = "stamps"  # column of a timed run: when a row began, and when each step after the planner was through with it


def stamped(rows: DataFrame) -> DataFrame:
    """Notes the time at which a row comes by, in milliseconds, once what was worked out before is there."""
    now = F.reflect(F.lit("java.lang.System"), F.lit("currentTimeMillis")).cast("long")
    before = F.col(TIMES) if TIMES in rows.columns else F.array().cast("array<long>")
    rest = [c for c in rows.columns if c != TIMES]
    return settle(settle(rows).select(*rest, F.concat(before, F.array(now)).alias(TIMES)))


def analyse(extracts: DataFrame, model_outputs: DataFrame | None = None, domain: str | None = None, timed: bool = False) -> Audit:
    """Gate, mine and refine claims, check them, rank the risks.

    Everything happens in the row of a document: without model answers nothing is shuffled, with
    them they are grouped by document and joined once. ``domain`` names a column with a domain tag.
    ``timed`` notes when each step was through with a document, for the trace; the steps of a batch
    that Python scores together include the wait for it.
    """
    note = stamped if timed else (lambda rows: rows)
    more = ([] if domain is None else [domain]) + ([TIMES] if timed else [])
    passed, rejects = rk.split_by_gate(note(common_rows(note(extracts), *more)))
    rows = note(cd.mine_with_model(cl.mine_claims(passed), model_outputs))
    rows = note(ev.audit_rows(note(pf.preflight_rows(rows))))
    rows = note(lo.prior_art_rows(note(lo.logic_rows(rows)), domain))
    return Audit(note(rk.risk_rows(rows)), rejects)


def pipeline_warnings() -> Column:
    return F.concat("claim_warnings", "preflight_warnings")


def _errors() -> Column:
    return F.size(F.filter("findings", lambda f: f["severity"] == "error"))


def trace_of_rows() -> Column:
    """Trace entries (agent_id, role, status, summary, highlights) of a document's steps."""
    minimum = [rk.by_type(lambda k, i=i: F.lit(fx.QUALITY_GATE[k][i])) for i in (0, 1)]
    size, text = F.size, lambda c: c.cast("string")
    n_warnings = size("claim_warnings")
    errors = _errors()
    high = lambda name: size(F.filter(name, lambda r: r["severity"] == "HIGH"))
    some = lambda name, of: F.slice(F.transform(name, of), 1, 3)

    def entry(role: str, warn: Column | None, summary: Column, highlights: Column) -> Column:
        status = F.lit("DONE") if warn is None else F.when(warn, "WARN").otherwise("DONE")
        return F.struct(
            F.lit(role.lower()).alias("agent_id"), F.lit(role).alias("role"), status.alias("status"),
            summary.alias("summary"), highlights.alias("highlights"),
        )

    parts = lambda *xs: F.concat(*[F.lit(x) if isinstance(x, str) else text(x) for x in xs])
    none = F.array().cast("array<string>")
    cited = size("cites")
    kept = F.array(parts("refinedReplacements=", F.col("refine.replacements")), parts("weakAfterRefine=", F.col("refine.weak_claims")))
    return F.array(
        entry("PLANNER", None, parts("artifact=", F.col("artifact_type"), ", thresholds=", minimum[0], "/", minimum[1]), none),
        entry(
            "EXTRACTOR", size("warnings") > 0, parts("paragraphs=", size("paragraphs"), ", sections=", size("sections")),
            F.array(parts("figures=", size("figures")), parts("citations=", cited, "/", size("bib"))),
        ),
        entry(
            "CLAIM_MINER", n_warnings > 0,
            parts("claims=", size("claims"), ", llmWarnings=", n_warnings, ", refineIter=", F.col("refine.iterations")),
            F.when(n_warnings > 0, F.slice("claim_warnings", 1, 3)).otherwise(kept),
        ),
        entry(
            "PREFLIGHT_GUARDIAN", (size("preflight_warnings") > 0) | (errors > 0),
            parts("errors=", errors, ", warnings=", size("findings") - errors), F.slice("preflight_warnings", 1, 3),
        ),
        entry(
            "EVIDENCE_AUDITOR", high("evidence") > 0, parts("risks=", size("evidence"), ", high=", high("evidence")),
            some("evidence", lambda r: F.concat(r["claim_id"], F.lit(":"), r["severity"])),
        ),
        entry(
            "LOGIC_SENTINEL", high("logic") > 0, parts("logicRisks=", size("logic"), ", high=", high("logic")),
            some("logic", lambda r: F.concat(r["claim_id"], F.lit(":"), r["severity"])),
        ),
        entry("PRIOR_ART_COACH", size("prior_art") == 0, parts("queries=", size("prior_art")), some("prior_art", lambda r: r["query"])),
        entry(
            "SYNTHESIZER", size(pipeline_warnings()) > 0, parts("topRisks=", size("risks"), ", warnings=", size(pipeline_warnings())),
            F.array(
                parts("noEvidence=", F.col("metrics.no_evidence_claims")), parts("weakEvidence=", F.col("metrics.weak_evidence_claims")),
                parts("specificityLack=", F.col("metrics.specificity_lack")),
            ),
        ),
    )


def trace_table(rows: DataFrame) -> DataFrame:
    """(doc_id, seq, agent_id, role, status, summary, highlights), one row per step.

    Rows of a timed run also have started_at, ended_at and duration_ms, at least 1. The planner, which
    only looks up its thresholds, takes no time of its own; each other step starts where the one before ended.
    """
    held = [TIMES] if TIMES in rows.columns else []
    df = rows.select("doc_id", *held, F.posexplode(trace_of_rows()).alias("pos", "t"))
    if held:
        start, end = (F.timestamp_millis(F.get(TIMES, at)) for at in (F.greatest(F.col("pos") - 1, F.lit(0)), F.col("pos")))
        df = rc.trace_entries(df.select("doc_id", "pos", "t.*", start.alias("started_at"), end.alias("ended_at")))
        return df.select("doc_id", (F.col("pos") + 1).alias("seq"), *[c for c in df.columns if c not in ("doc_id", "pos")])
    return df.select("doc_id", (F.col("pos") + 1).alias("seq"), "t.*")


def result_rows(rows: DataFrame, extract_path: str | None = None) -> DataFrame:
    """One nested result row per document.

    ``extract_path`` is the folder that holds the extracts; the steps have no time of their own in
    a job over many documents, so only ``generated_at`` is stated.
    """
    path = F.lit(None).cast("string") if extract_path is None else F.concat(F.lit(extract_path.rstrip("/") + "/"), F.col("doc_id").cast("string"))
    cut = lambda name, fields: F.transform(name, lambda x: F.struct(*[x[f].alias(f) for f in fields])).alias

    reason = lambda r: ev.evidence_reason(r["code"], r["best_score"], r["avg_score"], r["coverage"])
    evidence = F.transform(
        "evidence",
        lambda r: F.struct(
            r["claim_id"].alias("claim_id"), r["severity"].alias("severity"), r["para_ids"].alias("para_ids"), reason(r).alias("reason")
        ),
    )
    return rows.select(
        "doc_id",
        F.lit("v1").alias("schema_version"),
        cut("claims", ["claim_id", "text", "para_ids"])("claims"),
        evidence.alias("evidence_risks"),
        cut("logic", ["claim_id", "severity", "reason"])("logic_risks"),
        cut("prior_art", ["claim_id", "query", "rationale"])("prior_art_queries"),
        cut("risks", ["severity", "title", "reason", "refs"])("top_risks"),
        "metrics.*",
        "findings",
        _errors().alias("error_count"),
        (F.size("findings") - _errors()).alias("warning_count"),
        pipeline_warnings().alias("warnings"),
        trace_of_rows().alias("agent_trace"),
        path.alias("extract_path"),
        F.current_timestamp().alias("generated_at"),
    )


def summary_view(result: DataFrame) -> DataFrame:
    """Reader summary of result rows: first three risks, all risks, claim evidence, counts."""
    by_claim = F.map_from_entries(
        F.transform("evidence_risks", lambda r: F.struct(r["claim_id"], r))
    )

    def evidence_of(claim: Column, risks: Column) -> Column:
        r = F.try_element_at(risks, claim["claim_id"])
        return F.struct(
            claim["claim_id"].alias("claim_id"),
            claim["text"].alias("claim_text"),
            F.coalesce(r["para_ids"], claim["para_ids"]).alias("paragraph_ids"),
            F.coalesce(r["severity"], F.lit("LOW")).alias("severity"),
            F.coalesce(r["reason"], F.lit(fx.MSG["no_evidence_risk"])).alias("reason"),
        )

    return result.select(
        "doc_id",
        F.transform(F.slice("top_risks", 1, 3), lambda r: F.struct(r["title"], r["refs"])).alias("top3_risks"),
        "top_risks",
        tx.let(by_claim, lambda m: F.transform("claims", lambda c: evidence_of(c, m))).alias("claim_evidence"),
        "logic_risks",
        F.struct("error_count", "warning_count").alias("preflight_summary"),
        F.struct("no_evidence_claims", "weak_evidence_claims", "specificity_lack").alias("metrics"),
    )
