"""Registered queries: one per operator family, each over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docaudit import fixed as fx
from docaudit.functions import text as tx
from docaudit.functions.times import millis
from docaudit.operators import archive as ar
from docaudit.operators import candidates as cd
from docaudit.operators import claims as cl
from docaudit.operators import diffs as dd
from docaudit.operators import ensemble as en
from docaudit.operators import evidence as ev
from docaudit.operators import ingest as ig
from docaudit.operators import large as lg
from docaudit.operators import latex as lx
from docaudit.operators import layout as ly
from docaudit.operators import logic as lo
from docaudit.operators import markup as mk
from docaudit.operators import preflight as pf
from docaudit.operators import ratelimit as rl
from docaudit.operators import records as rc
from docaudit.operators import risks as rk
from docaudit.operators import structure as st
from docaudit.operators import views as vw
from docaudit.plans import inputs as src
from docaudit.plans.audit_job import analyse, route, summary_view
from docaudit.sources import storage as so
from docaudit.streaming import live
from docaudit.sources.tables import read_table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def joined(c: str | Column, sep: str = ",") -> Column:
    return F.array_join(c, sep)


# ---- claims and evidence inside documents ---------------------------------------------------


@query
def evidence_audit(spark, sf):
    """K3 with J1, A1-A3, U1, J12: risk rows of every claim against its own document."""
    audit = ev.audit_documents(src.mined_sheets(spark, sf))
    return ev.evidence_risks(audit).select(
        "doc_id", "claim_id", "severity", "code", "best_score", "coverage", joined("para_ids").alias("para_ids")
    )


@query
def evidence_scores(spark, sf):
    """A1, A3: best and mean score, strong and support counts of every claim."""
    audit = ev.audit_documents(src.mined_sheets(spark, sf))
    return audit.select("doc_id", "claim_id", "best_score", "avg_score", "strong_count", "support_count")


@query
def top_support(spark, sf):
    """Up to three support paragraphs per claim."""
    audit = ev.audit_documents(src.mined_sheets(spark, sf))
    both = F.arrays_zip("support_ids", "support_scores")
    return audit.select("doc_id", "claim_id", F.posexplode(both).alias("pos", "s")).select(
        "doc_id", "claim_id", (F.col("pos") + 1).alias("rank"),
        F.col("s.support_ids").alias("para_id"), F.col("s.support_scores").alias("score"),
    )


@query
def token_coverage(spark, sf):
    """A2: share of claim tokens covered by the support paragraphs."""
    audit = ev.audit_documents(src.mined_sheets(spark, sf))
    return audit.select("doc_id", "claim_id", "coverage")


@query
def evidence_audit_corpus(spark, sf):
    """J1 across the corpus: benchmark passages as claims against all document paragraphs."""
    items = read_table(spark, sf, "benchmark")
    claims = items.select("item_id", tx.claim_text(F.col("text")).alias("text"))
    paras = st.paragraph_table(src.sheet_rows(spark, sf))
    audit = ev.audit_tables(claims, paras, key="item_id")
    ids = F.transform("support", lambda x: F.concat_ws(":", x["doc_id"].cast("string"), x["para_id"]))
    return audit.select(
        "item_id", "best_score", "coverage", "strong_count", "support_count",
        joined(ids).alias("support"), F.coalesce("severity", F.lit("NONE")).alias("severity"),
    )


@query
def claims_rule_based(spark, sf):
    """K1 with F6, X1, X3, U9, U4: rule-based claims."""
    return src.sheet_claims(spark, sf).select("doc_id", "ord", "claim_id", "text", joined("para_ids").alias("para_ids"))


@query
def claim_headlines(spark, sf):
    """Headline and claim-likeness of each claim."""
    c = F.col("text")
    return src.sheet_claims(spark, sf).select(
        "doc_id", "claim_id", tx.headline(c).alias("headline"), tx.looks_like_claim(c).alias("claim_like")
    )


def _mined(spark, sf):
    """Rows with the claims and paragraphs of each document."""
    return src.mined_sheets(spark, sf).select("doc_id", "paragraphs", "claims")


def _resolved(spark, sf):
    """Paragraphs as stand-in model candidates; every second reference does not exist."""
    own = lambda p: F.when(p["text"].rlike("[0-9]"), F.lit("par_none")).otherwise(p["para_id"])
    stand_ins = F.transform(
        "paragraphs",
        lambda p, i: F.struct(
            (F.floor(i / 100) + 1).cast("int").alias("segment"), (i + 1).alias("ord"), p["text"].alias("text"),
            F.array(own(p), F.lit("par_missing"), F.lit("par_0001")).alias("para_ids"), F.lit(None).cast("string").alias("first_para"),
        ),
    )
    return cd.resolve_candidates(_mined(spark, sf).withColumn("candidates", stand_ins))


@query
def claim_scores(spark, sf):
    """Candidate score after dropping unknown paragraph references."""
    rows = _resolved(spark, sf).select("doc_id", F.inline("candidates"))
    return rows.select("doc_id", "ord", "text", joined("para_ids").alias("para_ids"), "score")


@query
def claim_dedupe_best(spark, sf):
    """Best candidate per normalised text, ranked."""
    ranked = cd.rank_candidates(cd.dedupe_best(_resolved(spark, sf)))
    rows = ranked.select("doc_id", F.posexplode("candidates").alias("pos", "c"))
    return rows.select("doc_id", (F.col("pos") + 1).alias("ord"), "c.text", "c.score")


@query
def claim_merge_fallback(spark, sf):
    """The candidates of each document, completed with rule-based claims."""
    merged = cd.merge_with_fallback(cd.rank_candidates(cd.dedupe_best(_resolved(spark, sf))))
    rows = merged.select("doc_id", F.posexplode("merged").alias("pos", "c"))
    return rows.select("doc_id", (F.col("pos") + 1).alias("ord"), "c.text")


@query
def claim_quality(spark, sf):
    """Quality score and issue list."""
    judged = _mined(spark, sf).select("doc_id", F.posexplode(cd.quality_of(F.col("claims"), F.col("paragraphs"))).alias("pos", "c"))
    return judged.select("doc_id", F.format_string("claim_%d", F.col("pos") + 1).alias("claim_id"), "c.quality", joined("c.issues").alias("issues"))


@query
def claim_duplicates(spark, sf):
    """Duplicate claims by normalised text within a document."""
    df = src.sheet_claims(spark, sf).withColumn("key", tx.claim_key(F.col("text")))
    groups = df.groupBy("doc_id", "key").agg(F.count("*").alias("n"), F.min("ord").alias("first_ord"))
    return groups.where("n > 1")


@query
def claim_refine(spark, sf):
    """U15 with U13, U14: two rounds of replacing weak and duplicate claims."""
    rows = cd.refine_claims(_mined(spark, sf)).select("doc_id", F.posexplode("claims").alias("pos", "c"))
    return rows.select("doc_id", (F.col("pos") + 1).alias("ord"), "c.text", "c.quality", F.size("c.issues").alias("issues"))


@query
def refine_report(spark, sf):
    """Iterations, replacements, weak claims left and warnings of the refinement."""
    rows = cd.refine_claims(_mined(spark, sf)).select("doc_id", "refine.*")
    return rows.withColumn("warnings", joined("warnings", "|"))


@query
def segments_overlap(spark, sf):
    """Overlapping paragraph segments (size 12, overlap 3)."""
    df = cd.segments(src.sheet_rows(spark, sf), size=12, overlap=3)
    rows = cd.segment_table(df)
    return rows.select("doc_id", "segment", "ord", "para_id")


@query
def claim_prompts(spark, sf):
    """Prompt text per segment."""
    df = cd.claim_prompts(cd.segments(src.sheet_rows(spark, sf)))
    return df.select(
        "doc_id", "segment", "max_claims", F.length("prompt").alias("chars"), F.md5("prompt").alias("digest")
    )


@query
def model_output_check(spark, sf):
    """Clean-up and schema check of answers, plain, fenced, wrapped or broken."""
    docs = src.documents(spark, sf)
    body = F.to_json(
        F.struct(
            F.array(
                F.struct(
                    F.concat(F.lit("c"), "doc_id").alias("claimId"),
                    F.col("text").alias("text"),
                    F.array(F.lit("par_0001")).alias("paragraphIds"),
                    F.when(F.col("lang") == "de", "sure").otherwise("high").alias("confidence"),
                )
            ).alias("claims")
        )
    )
    raw = (
        F.when(F.col("lang") == "fr", F.concat(F.lit("```json\n"), body, F.lit("\n```")))
        .when(F.col("lang") == "es", F.concat(F.lit("Answer: "), body, F.lit(" done")))
        .when(F.col("source") == "src3", F.call_function("substring", body, F.lit(1), F.length(body) - 1))
        .otherwise(body)
    )
    outputs = docs.select(
        "doc_id", F.lit(1).alias("segment"), F.lit(14).alias("max_claims"), raw.alias("raw_json")
    )
    return cd.check_output(outputs, "claims").select("doc_id", "valid")


@query
def claims_with_model(spark, sf):
    """K2 with X23, X24, J11, X4, U2, U5, U10, U15: answers merged with rule-based claims, refined.

    The answers are made from the rows of each document, some fenced, some broken.
    """
    mined = so.stored(_mined(spark, sf), "mined")
    items = F.transform(
        "paragraphs",
        lambda p: F.struct(
            p["para_id"].alias("claimId"), p["text"].alias("text"), F.array(p["para_id"]).alias("paragraphIds")
        ),
    )
    body = F.to_json(F.struct(items.alias("claims")))
    fenced = F.concat(F.lit("```json\n"), body, F.lit("\n```"))
    broken = F.size("paragraphs") < 4
    outputs = mined.select(
        "doc_id",
        F.lit(1).alias("segment"),
        cd.claims_per_segment(F.lit(1)).alias("max_claims"),
        F.when(broken, F.concat(F.lit("x"), F.substring(body, 2, 1 << 30))).otherwise(fenced).alias("raw_json"),
    )
    rows = cd.mine_with_model(mined, outputs).select("doc_id", F.posexplode("claims").alias("pos", "c"))
    return rows.select("doc_id", (F.col("pos") + 1).alias("ord"), "c.text", "c.quality")


# ---- logic, prior art, risks ---------------------------------------------------------------


@query
def logic_risks(spark, sf):
    """K4 with X11, X12: logic rules and severity."""
    return lo.inspect_logic(src.sheet_claims(spark, sf)).select("doc_id", "claim_id", "rules", "severity")


@query
def prior_art(spark, sf):
    """K5 with X8: prior-art search query per claim."""
    return lo.prior_art_queries(src.sheet_claims(spark, sf)).select("doc_id", "claim_id", "query")


@query
def quality_gate(spark, sf):
    """Paragraph and character thresholds of SHEET artifacts."""
    return rk.quality_gate(src.sheet_rows(spark, sf)).select(
        "doc_id", "paragraphs", "chars", "mean_chars", "passed"
    )


def _audited(spark, sf):
    """Rows with evidence, logic and ranked risks."""
    return rk.risk_rows(lo.logic_rows(ev.audit_rows(_mined(spark, sf))), findings=False)


@query
def signal_counts(spark, sf):
    """A4: risk rows per document by kind."""
    return rk.signal_counts(_audited(spark, sf))


@query
def top_risks(spark, sf):
    """U7 with J4, O4: ranked risks of evidence and logic."""
    risks = rk.risk_table(_audited(spark, sf))
    return risks.select("doc_id", "rank", "severity", "title", "reason", joined("refs.claim_ids").alias("claim_ids"))


@query
def severity_histogram(spark, sf):
    """Risks per severity."""
    return rk.severity_histogram(_audited(spark, sf))


@query
def risk_split(spark, sf):
    """First three and next five risks with their reference counts."""
    risks = rk.ref_counts(rk.risk_split(rk.risk_table(_audited(spark, sf))))
    return risks.select("doc_id", "rank", "part", "n_claims", "n_paragraphs", "n_citations")


@query
def claim_evidence_view(spark, sf):
    """Each claim with its evidence risk, defaults and strength."""
    view = vw.claim_strength(vw.claim_evidence_view(ev.audit_rows(_mined(spark, sf))))
    return view.select("doc_id", "claim_id", "severity", "strength", joined("para_ids").alias("para_ids"), "reason")


@query
def claims_with_logic(spark, sf):
    """Claims with their logic severity."""
    df = vw.claims_with_logic(_mined(spark, sf))
    return df.select("doc_id", "claim_id", F.coalesce("logic_severity", F.lit("NONE")).alias("logic_severity"))


@query
def audit_by_label(spark, sf):
    """Audit severities by quality label of the document."""
    audit = ev.audit_documents(src.mined_sheets(spark, sf)).select("doc_id", "severity")
    labels = read_table(spark, sf, "labels")
    sev = F.coalesce("severity", F.lit("NONE"))
    return audit.join(labels, "doc_id").groupBy("quality", sev.alias("severity")).agg(F.count("*").alias("claims"))


@query
def vague_points(spark, sf):
    """Points to make concrete."""
    return vw.vague_points(_audited(spark, sf)).select("doc_id", "point_id", "text", "type")


@query
def todos(spark, sf):
    """Todos from the ranked risks, else from the claims."""
    rows = vw.todos_from_analysis(_audited(spark, sf))
    return rows.select("doc_id", "todo_id", "title", "impact", "effort", "status")


@query
def heatmap_text(spark, sf):
    """Claim texts of a document, one per line."""
    return vw.heatmap_text(src.sheet_claims(spark, sf))


@query
def claim_context(spark, sf):
    """Claims as context and the default focus claim."""
    return vw.claim_context(src.sheet_claims(spark, sf))


@query
def vague_counts(spark, sf):
    """Vague points per type."""
    return vw.vague_counts(vw.vague_points(_audited(spark, sf))).withColumnRenamed("count", "n")


@query
def strength_from_risks(spark, sf):
    """Claim strength derived from ranked risks alone."""
    return vw.strength_from_risks(rk.risk_table(_audited(spark, sf))).select("doc_id", "claim_id", "text", "strength")


@query
def focus_claims(spark, sf):
    """Focus claim of a question, by id or the first one."""
    focus = F.when(F.col("lang") == "en", "claim_2").when(F.col("lang") == "de", "claim_99")
    asked = src.documents(spark, sf).select("doc_id", F.lit("t1").alias("turn_id"), focus.alias("focus_claim_id"))
    df = vw.focus_claims(asked, cl.claim_table(_mined(spark, sf)))
    return df.select("doc_id", F.coalesce("focus_text", F.lit("")).alias("focus_text"))


@query
def oral_prompts(spark, sf):
    """Oral-question prompt of each document's first claim."""
    ctx = vw.claim_context(src.sheet_claims(spark, sf))
    prompt = cd.oral_prompt(F.col("context"), F.lit("claim_1"), F.col("first_claim"))
    return ctx.select("doc_id", F.md5(prompt).alias("digest"))


@query
def evidence_prompts(spark, sf):
    """Evidence prompt of each segment with all claims of its document."""
    df = cd.segments(src.mined_sheets(spark, sf)).select("doc_id", "claims", F.posexplode("segments").alias("pos", "ps"))
    prompt = cd.evidence_prompt(cd.segment_text(F.col("ps")), F.col("claims"))
    return df.select("doc_id", (F.col("pos") + 1).alias("segment"), F.md5(prompt).alias("digest"))


# ---- structure -------------------------------------------------------------------------------


@query
def sheet_paragraphs(spark, sf):
    """SHEET rows and signals as paragraphs."""
    return st.paragraph_table(src.sheet_rows(spark, sf)).select("doc_id", "ord", "para_id", "section_id", "text")


@query
def sheet_signals(spark, sf):
    """Row, numeric-row and formula-row counts, source words."""
    df = st.sheet_signal_counts(st.with_fallback_split(st.sheet_blocks(src.documents(spark, sf).select("doc_id", "text"))))
    return df.select("doc_id", "n_rows", "n_numeric", "n_formula", "has_source")


@query
def doc_sections(spark, sf):
    """Headings of DOC artifacts with first-wins dedupe."""
    return st.section_table(src.doc_rows(spark, sf))


@query
def markdown_sections(spark, sf):
    """Paragraphs of DOC artifacts with their section."""
    return st.paragraph_table(src.doc_rows(spark, sf)).select("doc_id", "ord", "section_id", "text")


@query
def doc_signals(spark, sf):
    """Section and paragraph counts and the four word signals."""
    return src.doc_rows(spark, sf).select(
        "doc_id", "n_sections", "n_paras", "has_evidence", "has_decision", "has_risk", "has_assumption"
    )


@query
def paragraph_offsets(spark, sf):
    """T4, T5: blank-line paragraphs with start and end offsets."""
    docs = src.latex_sources(spark, sf)
    df = docs.select("doc_id", F.posexplode(lx.chunk_list(F.col("source"))).alias("pos", "c"))
    return df.select(
        "doc_id", (F.col("pos") + 1).alias("ord"), F.col("c.start").alias("start"),
        (F.col("c.start") + F.length("c.text")).alias("end"), F.md5("c.text").alias("digest"),
    )


@query
def block_paragraph_offsets(spark, sf):
    """T4, T5 of texts larger than a row: the same paragraphs from blocks of eight lines."""
    blocks = lg.line_blocks(src.latex_sources(spark, sf), "doc_id", "source", 8)
    df = lg.chunk_table(blocks)
    return df.select("doc_id", "ord", "start", (F.col("start") + F.length("text")).alias("end"), F.md5("text").alias("digest"))


@query
def latex_sections(spark, sf):
    """Sections of LaTeX sources with level and offset."""
    df = src.latex_sources(spark, sf).select("doc_id", F.inline(lx.section_list(F.col("source"))))
    return df.select("doc_id", "section_id", "title", "level", "start")


@query
def section_asof(spark, sf):
    """Last section at or before each paragraph offset (bucketed as-of join)."""
    docs = src.latex_sources(spark, sf)
    paras = docs.select("doc_id", F.inline(lx.chunk_list(F.col("source")))).select("doc_id", "start")
    secs = docs.select("doc_id", F.inline(lx.section_list(F.col("source")))).select("doc_id", "start", "section_id")
    return lx.asof_section(paras, secs).select("doc_id", "start", F.coalesce("section_id", F.lit("-")).alias("section_id"))


@query
def latex_paragraphs(spark, sf):
    """Paragraphs of LaTeX sources with masked figures and headings."""
    return st.paragraph_table(src.latex_rows(spark, sf)).select("doc_id", "para_id", "section_id", "text")


@query
def figure_mentions(spark, sf):
    """Figures with the paragraphs that mention them."""
    df = lx.figure_table(src.latex_rows(spark, sf))
    return df.select("doc_id", "figure_id", "label", "caption", joined("mentioned_in").alias("mentioned_in"))


@query
def figure_mentions_joined(spark, sf):
    """Figure mentions by equi-join of labels and references."""
    rows = _paper_children(spark, sf, "figures", "paragraphs")
    df = lx.attach_mentions(lx.figure_table(rows), st.paragraph_table(rows))
    return df.select("doc_id", "figure_id", joined("mentioned_in").alias("mentioned_in"))


@query
def latex_citations(spark, sf):
    """Citation keys per paragraph."""
    return lx.cite_table(src.latex_rows(spark, sf)).select("doc_id", "para_id", "key")


@query
def preflight_findings(spark, sf):
    """K6: integrity findings in order."""
    df = pf.finding_table(pf.preflight_rows(src.latex_rows(spark, sf)))
    return df.select("doc_id", "finding_id", "kind", "severity", "message", F.coalesce(joined("paragraph_ids"), F.lit("")).alias("paragraph_ids"))


@query
def preflight_summary(spark, sf):
    """A5: errors and warnings per document."""
    return pf.finding_summary(pf.preflight_rows(src.latex_rows(spark, sf)))


@query
def preflight_todos(spark, sf):
    """Todos from integrity findings."""
    rows = vw.todos_from_findings(pf.finding_table(pf.preflight_rows(src.latex_rows(spark, sf))))
    return rows.select("doc_id", "todo_id", "title", "description", "impact", "effort")


def _paper_children(spark, sf, *names):
    """Child lists of the papers, worked out once for all that is joined."""
    return so.stored(src.latex_rows(spark, sf).select("doc_id", *names), "children")


@query
def missing_citations(spark, sf):
    """Cited keys without a bibliography entry (anti-join)."""
    rows = _paper_children(spark, sf, "cites", "bib")
    df = pf.missing_citations(lx.cite_table(rows), lx.bib_table(rows))
    return df.select("doc_id", "key", joined("para_ids").alias("para_ids"))


@query
def uncited_bib(spark, sf):
    """Bibliography entries never cited (anti-join)."""
    rows = _paper_children(spark, sf, "cites", "bib")
    return pf.uncited_entries(lx.cite_table(rows), lx.bib_table(rows)).select("doc_id", "ord", "key")


def _refs(rows: DataFrame, field: str, name: str) -> DataFrame:
    df = rows.select("doc_id", F.posexplode("refs").alias("pos", "r"))
    return df.select(
        "doc_id", (F.col("pos") + 1).alias("ord"), "r.para_id", F.explode(f"r.{field}").alias(name)
    )


@query
def unknown_figure_refs(spark, sf):
    """References to undefined labels and to numbers beyond the figure count."""
    rows = _paper_children(spark, sf, "figures", "refs")
    figures = lx.figure_table(rows)
    a = pf.unknown_labels(_refs(rows, "labels", "label"), figures).select("doc_id", F.col("label").alias("ref"), "para_ids")
    b = pf.unknown_numbers(_refs(rows, "numbers", "number"), figures).select("doc_id", F.col("number").alias("ref"), "para_ids")
    return a.unionByName(b).select("doc_id", "ref", joined("para_ids").alias("para_ids"))


@query
def diff_hunks(spark, sf):
    """Hunks of unified diffs with their summary line."""
    df = dd.hunk_table(src.pr_texts(spark, sf))
    return df.select(
        "doc_id", "ord", "path", "header", F.size("added").alias("added"), F.size("removed").alias("removed"),
        F.size("context").alias("context"), "summary",
    )


@query
def pr_signals(spark, sf):
    """K8 with A9-A13: review signals of each pull request."""
    return dd.pr_signals(src.pr_texts(spark, sf)).select(
        "doc_id", "ord", "text", F.coalesce("warning", F.lit("")).alias("warning")
    )


@query
def pr_sections(spark, sf):
    """Sections of pull-request texts."""
    return st.section_table(dd.pr_extract(src.pr_texts(spark, sf)))


@query
def pr_paragraphs(spark, sf):
    """Paragraphs of pull requests, hunks and signals included."""
    df = st.paragraph_table(dd.pr_extract(src.pr_texts(spark, sf)))
    return df.select("doc_id", "ord", "section_id", "text")


# ---- markup and extraction sources --------------------------------------------------------------


@query
def html_contents(spark, sf):
    """Texts of all <p> elements."""
    return mk.tag_table(read_table(spark, sf, "pages", "page_id"), "page_id", "html", "p")


@query
def html_headings(spark, sf):
    """Cleaned titles of <h1> elements and links."""
    pages = read_table(spark, sf, "pages", "page_id")
    rows = mk.tag_table(pages, "page_id", "html", "a")
    return rows.select("page_id", "ord", en.clean_title(F.col("text")).alias("title"))


@query
def html_escaped(spark, sf):
    """Escaped page source."""
    pages = read_table(spark, sf, "pages", "page_id")
    return pages.select("page_id", F.md5(tx.html_escape(F.col("html"))).alias("digest"))


@query
def anchored_slices(spark, sf):
    """Text-anchor slices of the page source."""
    pages = read_table(spark, sf, "pages", "page_id")
    seg = lambda a, b: F.struct(a.cast("int").alias("start"), b.cast("int").alias("end"))
    n = F.length("html")
    segments = F.array(
        seg(F.lit(0), F.floor(n / 3)), seg(F.lit(9), F.lit(4)), seg(F.floor(n / 2), n)
    )
    return pages.select("page_id", F.md5(mk.anchored_text(F.col("html"), segments)).alias("digest"))


def _payloads(spark, sf):
    docs = src.documents(spark, sf)
    t = F.col("text")
    body = (
        F.when(F.col("lang") == "fr", F.to_json(F.struct(F.split(t, "\n").alias("paragraphs"))))
        .when(F.col("lang") == "de", F.to_json(F.struct(F.replace(t, F.lit("\n"), F.lit("\n\n")).alias("markdown"))))
        .when(F.col("lang") == "es", F.to_json(F.struct(F.array(F.struct(t.alias("content"))).alias("chunks"))))
        .otherwise(F.to_json(F.struct(F.replace(t, F.lit("\n"), F.lit("\n\n")).alias("text"))))
    )
    return docs.select("doc_id", body.alias("raw"))


@query
def payload_paragraphs(spark, sf):
    """Paragraphs of polymorphic extraction payloads."""
    df = _payloads(spark, sf).select("doc_id", F.posexplode(mk.payload_paragraphs(F.col("raw"))).alias("pos", "text"))
    return df.select("doc_id", (F.col("pos") + 1).alias("ord"), "text")


def _candidate_sources(spark, sf):
    """Three extraction sources per document: whole text, sentences, and text with headings."""
    docs = src.documents(spark, sf)
    t = F.col("text")
    none = "array<string>"
    sections = "array<struct<title:string,level:int>>"
    bibs = "array<struct<key:string,raw:string>>"
    cut = F.replace(t, F.lit("\n"), F.lit("\n\n"))
    source = lambda ord_, name, paras, secs, bib, warn: F.struct(
        F.lit(ord_).alias("ord"), F.lit(name).alias("source"), paras.alias("paragraphs"),
        secs.cast(sections).alias("sections"), bib.cast(bibs).alias("bib"), warn.cast(none).alias("warnings"),
    )
    heads = F.transform(F.split(t, "\n"), lambda x: F.struct(F.concat(F.lit("1. "), x).alias("title"), F.lit(9).alias("level")))
    keys = F.array(F.struct(F.col("lang").alias("key"), F.lit("raw").alias("raw")), F.struct(F.col("source").alias("key"), F.lit("").alias("raw")))
    rows = F.array(
        source(1, "local", F.array(cut), F.array(), F.array(), F.when(F.col("lang") == "en", F.array(F.lit("a"), F.lit("b"))).otherwise(F.array())),
        source(2, "sentences", F.split(t, "\\. "), F.array(), keys, F.array()),
        source(3, "headings", F.array(F.concat(cut, F.lit(" [1, 2]"))), heads, F.array(), F.array(F.lit("slow"))),
    )
    return docs.select("doc_id", F.inline(rows))


@query
def source_ensemble(spark, sf):
    """K9 with T34, A7, A8, X13, U16: primary source and donors per document."""
    return en.pick_sources(_candidate_sources(spark, sf)).select("doc_id", "primary", "section_donor", "bib_donor")


@query
def source_scores(spark, sf):
    """Statistics and score of each extraction source."""
    df = en.candidate_score(en.candidate_stats(en.normalise_candidates(_candidate_sources(spark, sf))))
    return df.select("doc_id", "source", "n_paragraphs", "n_chars", "n_cited", "n_sections", "n_bib", "n_warnings", "score")


@query
def pdf_citations(spark, sf):
    """Bracketed and author-year citation keys of a text with citations."""
    docs = src.documents(spark, sf)
    t = F.concat("text", F.lit(" [3, 12] as in (Smith et al., 2020a) and "), "source", F.lit(" [7] (Lee, 1999)"))
    df = docs.select("doc_id", F.posexplode(en.pdf_citation_keys(t)).alias("pos", "key"))
    return df.select("doc_id", (F.col("pos") + 1).alias("ord"), "key")


@query
def page_layout(spark, sf):
    """Positioned words of each document line rendered back to page text."""
    docs = src.documents(spark, sf)
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "t"))
    words = lines.select("doc_id", "line", F.posexplode(F.split("t", " ")).alias("pos", "text"))
    height = 10.0
    items = words.select(
        "doc_id",
        (F.floor(F.col("line") / 40) + 1).alias("page"),
        (F.col("line") * 100_000 + F.col("pos")).cast("int").alias("seq"),
        "text",
        (F.col("pos") * 30.0).alias("x"),
        (800.0 - (F.col("line") % 40) * 14.0 - (F.col("pos") % 2) * 1.0).alias("y"),
        F.lit(height).alias("height"),
        F.lit(False).alias("has_eol"),
    )
    return ly.page_text(items).select("doc_id", "page", F.md5("text").alias("digest"))


# ---- ingest, archives -----------------------------------------------------------------------------


def _requests(spark, sf):
    return src.documents(spark, sf).select(
        "doc_id",
        F.when(F.col("source") == "src1", "BOOK").when(F.col("source").isin("src2", "src3"), "PR")
        .when(F.col("source").isin("src4", "src5"), "SHEET").otherwise("DOC").alias("artifact_type"),
        F.col("text").alias("content"),
        F.when(F.col("lang") == "de", F.repeat(F.lit("t"), 121)).otherwise(F.col("source")).alias("title"),
        F.when(F.col("lang") == "fr", "diff").when(F.col("lang") == "es", "pdf")
        .when(F.col("source") == "src6", "markdown").alias("content_format"),
        F.when(F.col("source") == "src8", F.repeat(F.lit("r"), 241)).alias("source_ref"),
        F.when(F.col("source") == "src9", "KEEP").when(F.col("source") == "src10", "SAVE").alias("mode"),
        F.when(F.col("source") == "src10", "soon").when(F.col("source") == "src11", "24").alias("ttl_hours"),
    )


@query
def artifact_validation(spark, sf):
    """first failing rule of each artifact request."""
    return ig.validate_artifacts(_requests(spark, sf)).select("doc_id", F.coalesce("error", F.lit("")).alias("error"))


@query
def artifact_objects(spark, sf):
    """Input type, content type and file name of accepted artifacts."""
    valid, _ = ig.accept(ig.validate_artifacts(_requests(spark, sf)))
    return ig.artifact_objects(valid).select("doc_id", "input_type", "content_type", "file_name")


@query
def upload_metadata(spark, sf):
    """upload metadata checks over event properties and made-up defects."""
    ev_ = read_table(spark, sf, "events")
    t = F.col("event_type")
    meta = (
        F.when(t == "click", F.concat(F.lit(","), "props"))
        .when(t == "view", F.lit("[1]"))
        .when(t == "error", F.concat(F.lit('{"artifactType": "'), F.when(F.col("value") > 10, "PR").otherwise("X"), F.lit('"}')))
        .when(t == "purchase", F.concat(F.lit('{"language": '), F.when(F.col("value") > 20, F.lit('"en"')).otherwise(F.lit("5")), F.lit(', "retentionPolicy": {"mode": "SAVE", "ttlHours": "x"}}')))
        .otherwise(F.col("props"))
    )
    df = ig.validate_metadata(ev_.select("event_id", meta.alias("metadata")))
    return df.select("event_id", F.coalesce("error", F.lit("")).alias("error"))


def _members(spark, sf):
    """Archive manifests: the lines of an order are the members of its archive."""
    ext = F.element_at(
        F.create_map(
            F.lit("A"), F.lit("tex"), F.lit("N"), F.lit("bib"), F.lit("R"), F.lit("PNG")
        ),
        F.col("l_returnflag"),
    )
    path = (
        F.when(F.col("l_discount") >= 0.1, F.concat(F.lit("../x."), ext))
        .when(F.col("l_tax") >= 0.08, F.lit("run.exe"))
        .otherwise(F.concat(F.lit("/dir\\f"), F.col("l_linenumber").cast("string"), F.lit("."), ext))
    )
    return read_table(spark, sf, "lineitem", "l_orderkey").select(
        F.col("l_orderkey").alias("archive_id"),
        (
            F.col("l_linenumber") * 10**12 + F.col("l_partkey") * 10**6 + F.col("l_suppkey")
        ).alias("ordinal"),
        path.alias("path"),
        (F.col("l_extendedprice") * 300).cast("long").alias("size"),
        F.when(F.col("l_quantity") >= 50, fx.SYMLINK_MODE + 0o777).otherwise(0o100644).alias("unix_mode"),
        (F.col("l_quantity") == 1).alias("is_dir"),
    )


@query
def archive_screening(spark, sf):
    """First broken rule per archive in member order."""
    df = ar.screen_archives(_members(spark, sf))
    return df.select("archive_id", "members", F.coalesce("rule", F.lit("")).alias("rule"), F.coalesce("path", F.lit("")).alias("path"), "accepted")


def _latex_members(spark, sf):
    """Two archive members per document: a main file that includes a body file."""
    docs = src.documents(spark, sf)
    main = F.concat(
        F.lit("\\section{"), F.col("source"), F.lit("}\n\\input{parts/../body}\nmiddle \\include{"), F.col("lang"),
        F.lit("} end % note\n"),
    )
    member = lambda n, path, text: F.struct(F.lit(n).alias("ordinal"), path.alias("path"), text.alias("text"))
    folder = F.when(F.col("lang") == "en", "paper/").otherwise("")
    rows = F.array(
        member(1, F.concat(folder, F.lit("body.tex")), F.col("text")),
        member(2, F.concat(folder, F.lit("main.tex")), main),
        member(3, F.lit("refs.bib"), F.concat(F.lit("@article{ "), F.col("lang"), F.lit(" ,x}\n@book{k2,}\n@misc{"), F.col("lang"), F.lit(",}"))),
    )
    return docs.select(F.col("doc_id").alias("archive_id"), F.inline(rows))


@query
def main_files(spark, sf):
    """Main .tex file per archive."""
    return lx.main_tex(_latex_members(spark, sf))


@query
def latex_includes(spark, sf):
    """Source with includes resolved."""
    source, _ = lx.expand_includes(_latex_members(spark, sf))
    return source.select("archive_id", F.md5("source").alias("digest"), F.length("source").alias("chars"))


@query
def include_warnings(spark, sf):
    """Warnings of missing include files."""
    _, warnings = lx.expand_includes(_latex_members(spark, sf))
    return warnings.select("archive_id", "warning")


@query
def bib_keys(spark, sf):
    """Bibliography keys of archives, first wins."""
    return lx.bib_keys(_latex_members(spark, sf))


# ---- records and views ------------------------------------------------------------------------------


@query
def latest_per_session(spark, sf):
    """Newest submission per session, invalid dates last."""
    df = rc.latest_per_session(src.submissions(spark, sf), "created_at", "ord")
    return df.select("session_id", "submission_id", "created_at")


@query
def session_view(spark, sf):
    """Session with latest analysis and submission."""
    df = rc.session_view(src.sessions(spark, sf), src.analyses(spark, sf), src.submissions(spark, sf))
    text = ["analysis_id", "submission_id", "upload_id", "filename", "title", "file_type", "artifact_type"]
    return df.select("session_id", *[F.coalesce(c, F.lit("")).alias(c) for c in text], "status", "save_enabled", "retention_days", "language")


@query
def recent_sessions(spark, sf):
    """Last ten sessions (orders by date), newest first, three shown."""
    o = read_table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("session_id"), F.col("o_orderdate").alias("created_at")
    )
    df = rc.recent_sessions(o)
    return df.select("rank", "session_id", "shown")


@query
def merge_updates(spark, sf):
    """Newest non-null value of each pointer."""
    df = rc.merge_updates(src.status_updates(spark, sf), "analysis_id", ["extract_pointer", "report_pointer"], ["ts", "seq"])
    return df.select("analysis_id", *[F.coalesce(c, F.lit("")).alias(c) for c in ("extract_pointer", "report_pointer")])


@query
def latest_status(spark, sf):
    """Last status; a missing error removes an older one."""
    df = rc.latest_status(src.status_updates(spark, sf), "analysis_id", ["ts", "seq"])
    return df.select("analysis_id", "status", "progress", F.coalesce("step", F.lit("")).alias("step"), F.coalesce("error", F.lit("")).alias("error"), "terminal")


@query
def progress_view(spark, sf):
    """Normalised progress and message of every update."""
    u = src.status_updates(spark, sf)
    msg = rc.progress_message(F.col("error"), F.col("status"), F.col("step"))
    return u.select("seq", rc.normal_progress(F.col("progress")).alias("progress"), F.coalesce(msg, F.lit("")).alias("message"))


@query
def latest_turns(spark, sf):
    """Same turn id overwrites; the latest content of each (conversation, role)."""
    turns = read_table(spark, sf, "conversations").select(
        "conv_id", F.col("role").alias("turn_id"), F.col("turn").alias("seq"), F.md5("text").alias("digest")
    )
    return rc.latest_row(turns, ["conv_id", "turn_id"], ["seq"])


def _trace(spark, sf):
    """Agent trace from events: the role of a step, and its status."""
    e = read_table(spark, sf, "events")
    roles = F.array(*[F.lit(r) for r in fx.AGENT_ROLES])
    at = (F.floor("value") % 11).cast("int")
    return e.select(
        F.col("user_id").alias("analysis_id"),
        F.col("event_id").alias("seq"),
        F.coalesce(F.get(roles, at), F.lit("OTHER")).alias("role"),
        F.when(F.col("event_type") == "error", "WARN").when(F.col("event_type") == "signup", "SKIPPED").otherwise("DONE").alias("status"),
        F.col("ts").alias("started_at"),
        (F.col("ts") + F.expr("make_interval(0, 0, 0, 0, 0, 0, value)")).alias("ended_at"),
        F.date_trunc("day", "ts").alias("day"),
    )


@query
def trace_progress(spark, sf):
    """Roles seen per user and day, percent, first missing step."""
    t = _trace(spark, sf).withColumn("run", F.concat_ws("|", "analysis_id", F.date_format("day", "yyyy-MM-dd")))
    df = rc.trace_progress(t, "run")
    return df.select("run", "done", "percent", F.coalesce("first_missing", F.lit("")).alias("first_missing"))


@query
def trace_durations(spark, sf):
    """Duration of trace entries, at least 1 ms."""
    t = _trace(spark, sf).withColumn("highlights", F.array(F.lit("h")))
    return rc.trace_entries(t).select("seq", "duration_ms", "status")


@query
def step_states(spark, sf):
    """State of each of the eight steps."""
    t = _trace(spark, sf)
    run = rc.latest_status(src.status_updates(spark, sf), "analysis_id", ["ts", "seq"])
    return rc.step_states(t, run, "analysis_id")


@query
def lease_status(spark, sf):
    """Q5: finished, locked or free at a fixed time."""
    u = src.status_updates(spark, sf)
    now = F.lit("2024-01-10T00:00:00Z").cast("timestamp")
    owner = F.when(F.col("progress") > 5, F.lit("w1")).otherwise(F.lit(""))
    expires = F.date_format(F.col("ts"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return u.select("seq", rc.lease_status(F.col("status"), owner, expires, now).alias("lease"))


@query
def rate_limit(spark, sf):
    """Q1, Q2: anchored fixed windows per user, two requests per twelve hours."""
    req = read_table(spark, sf, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("request_id"), "ts")
    df = rl.rate_limit(req, 2, 12 * 3600 * 1000)
    return df.select("key", "request_id", "allowed", F.coalesce("retry_after_ms", F.lit(0)).alias("retry_after_ms"), "window_start")


@query
def rate_limit_analyze(spark, sf):
    """Q2: the analyze limit (60 per 60 s) with all events under one key."""
    req = read_table(spark, sf, "events").select(F.lit("all").alias("key"), F.col("event_id").alias("request_id"), "ts")
    df = rl.rate_limit(req, *rl.limit_for("analyze"))
    return df.select("request_id", "allowed", "window_start")


# ---- answers, patches, reports ------------------------------------------------------------------------


def _answers(spark, sf):
    return read_table(spark, sf, "conversations").where(F.col("role") == "user")


@query
def answer_evaluation(spark, sf):
    """Evaluation of user turns."""
    df = vw.evaluate_answers(_answers(spark, sf))
    return df.select("conv_id", "turn", "pass", "follow_up", "reason", "draft", F.coalesce("todo_title", F.lit("")).alias("todo_title"))


@query
def turn_expansion(spark, sf):
    """Stored rows of evaluated turns of sessions that keep data."""
    df = vw.evaluate_answers(_answers(spark, sf)).withColumn("session_id", F.concat(F.lit("s"), "conv_id"))
    rows = vw.expand_turns(df, src.sessions(spark, sf), ["conv_id", "turn"])
    return rows.select("conv_id", "turn", "seq", "role", "type", "content")


@query
def oral_todos(spark, sf):
    """Draft todos by text hash, newest arrival last_seq."""
    c = read_table(spark, sf, "conversations")
    drafts = c.select(
        F.lit("a").alias("analysis_id"),
        (F.col("conv_id") * 1000 + F.col("turn")).alias("seq"),
        F.lower("text").alias("sentence"),
        (F.col("role") == "assistant").alias("auto_accept"),
    )
    df = vw.oral_draft_todos(drafts)
    return df.select("todo_id", "title", "status", "last_seq")


@query
def text_hash(spark, sf):
    """Rolling hash and SHA-256 of each turn."""
    c = read_table(spark, sf, "conversations", "conv_id")
    return c.select("conv_id", "turn", tx.rolling_hash(F.col("text")).alias("hash"), rc.token_hash(F.col("text")).alias("sha"))


@query
def patch_text(spark, sf):
    """Unified diff per conversation from accepted (assistant) titles."""
    c = read_table(spark, sf, "conversations")
    t = c.select(
        F.col("conv_id").alias("analysis_id"), F.col("turn").alias("ord"),
        tx.collapse(F.col("text")).alias("title"),
        F.when((F.col("role") == "assistant") & (F.length("text") > 400), "accepted").otherwise("pending").alias("status"),
    )
    df = vw.patch_text(t)
    files, hunks = vw.diff_summary(F.col("diff_text"))
    return df.select("analysis_id", "diff_text", files.alias("files"), hunks.alias("hunks"))


def _overlaid(spark, sf):
    """Todos of a conversation: those of users over those of others, with ids accepted that users gave twice."""
    c = read_table(spark, sf, "conversations").select(
        F.col("conv_id").alias("doc_id"), F.concat(F.lit("t"), "text").alias("todo_id"),
        F.col("turn").alias("ord"), F.lit("pending").alias("status"), F.col("role"),
    )
    extra = c.where("role = 'user'").drop("role")
    computed = c.where("role <> 'user'").drop("role")
    over = extra.groupBy("doc_id", "todo_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id", "todo_id", F.lit("accepted").alias("status"))
    return vw.overlay_todos(extra, computed, over)


@query
def todo_overlay(spark, sf):
    """Extra todos first, status overrides, counts by status."""
    return vw.todo_counts(_overlaid(spark, sf))


@query
def todo_rows(spark, sf):
    """Each todo with the source and place it is taken from, and its status."""
    return _overlaid(spark, sf).select("doc_id", F.md5("todo_id").alias("todo"), "ord", "src", "status")


@query
def report_html(spark, sf):
    """HTML report per analysis."""
    o = read_table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("analysis_id"), F.concat(F.lit("<s&"), "o_custkey", F.lit(">")).alias("session_id"),
        F.concat(F.lit('"'), "o_orderpriority", F.lit("'")).alias("submission_id"), F.col("o_orderstatus").alias("status"),
        F.lit(100).alias("progress"), F.when(F.col("o_orderstatus") == "F", "finalize").alias("step"),
    )
    return vw.report_html(o).select("analysis_id", F.md5("html").alias("digest"))


@query
def pr_composed(spark, sf):
    """One PR document from its parts."""
    t = F.col("text")
    parts = {
        "summary": F.col("source"), "background": F.lit(" "), "changes": t, "test_plan": F.col("lang"),
        "risks": F.lit(""), "rollback": F.lit("revert"), "diff": F.concat("source", F.lit("\n"), t),
    }
    return src.documents(spark, sf).select("doc_id", vw.compose_pr(parts).alias("body"))


# ---- the whole job -----------------------------------------------------------------------------------


def _mixed_artifacts(spark, sf):
    """Documents as SHEET, DOC, PR and PAPER artifacts by language, some of an unknown type or with a wrong input type."""
    return src.documents(spark, sf).selectExpr(
        "doc_id",
        "case lang when 'fr' then 'DOC' when 'de' then 'PR' when 'es' then case when source = 'src14' then 'BOOK' when source <> 'src15' then 'PAPER' end "
        "else 'SHEET' end as artifact_type",
        "case when source = 'src13' then 'PDF' when lang = 'fr' then 'DOC_TEXT' when lang = 'de' then 'PR_TEXT' when lang = 'es' then 'LATEX_ZIP' "
        "else 'SHEET_TEXT' end as input_type",
        f"case lang when 'fr' then {src.DOC_TEXT} when 'de' then {src.PR_TEXT} when 'es' then {src.LATEX_SOURCE} else text end as text",
    )


@query
def artifact_rejects(spark, sf):
    """Artifacts that cannot be routed, with the reason."""
    _, rejects = route(_mixed_artifacts(spark, sf))
    return rejects


@query
def routed_artifacts(spark, sf):
    """Extract rows of all artifact types in one shape."""
    rows, _ = route(_mixed_artifacts(spark, sf))
    texts = F.transform("paragraphs", lambda p: F.concat_ws("|", p["para_id"], p["text"]))
    return rows.select("doc_id", "artifact_type", F.size("paragraphs").alias("paragraphs"), F.md5(joined(texts, "\n")).alias("digest"))


def _lines(name: str, *fields) -> Column:
    """An array of structs as text: fields by a bar, entries by line."""
    return joined(F.transform(name, lambda x: F.concat_ws("|", *[f(x) if callable(f) else x[f] for f in fields])), "\n")


@query
def analysis_result(spark, sf):
    """Result row per gated SHEET document."""
    view = analyse(src.sheet_rows(spark, sf)).result
    ids = lambda name: lambda x: joined(F.coalesce(x["refs"][name], F.array().cast("array<string>")), "+")
    paras = lambda x: joined(x["para_ids"], "+")
    return view.select(
        "doc_id",
        _lines("claims", "claim_id", "text", paras).alias("claims"),
        _lines("evidence_risks", "claim_id", "severity", "reason", paras).alias("evidence_risks"),
        _lines("logic_risks", "claim_id", "severity", "reason").alias("logic_risks"),
        _lines("prior_art_queries", "claim_id", "query").alias("prior_art_queries"),
        _lines("top_risks", "severity", "title", "reason", ids("claim_ids"), ids("paragraph_ids")).alias("top_risks"),
        "no_evidence_claims",
        "weak_evidence_claims",
        "specificity_lack",
        "error_count",
        "warning_count",
        joined("warnings", "|").alias("warnings"),
    )


@query
def analysis_summary(spark, sf):
    """Summary view of the result rows of LaTeX papers."""
    view = summary_view(analyse(src.latex_rows(spark, sf)).result)
    paras = lambda x: joined(x["paragraph_ids"], "+")
    return view.select(
        "doc_id",
        joined(F.transform("top3_risks", lambda r: r["title"]), "|").alias("top3"),
        _lines("claim_evidence", "claim_id", "claim_text", "severity", "reason", paras).alias("claims"),
        F.col("preflight_summary.error_count").alias("error_count"),
    )


@query
def job_trace(spark, sf):
    """Trace rows of the job over SHEET documents, one per step, each with its own time after the one before."""
    trace = analyse(src.sheet_rows(spark, sf), timed=True).trace
    timed = (F.col("duration_ms") >= 1) & (F.col("ended_at") >= F.col("started_at")) & (F.col("started_at") > "2020-01-01")
    return trace.select("doc_id", "seq", "agent_id", "role", "status", "summary", joined("highlights", "|").alias("highlights"), timed.alias("timed"))


# ---- storage and streams: written to the shared folder and read back ----------------------------------


@query
def stored_artifacts(spark, sf):
    """Artifacts by id written as objects, read back as bytes and decoded."""
    folder = so.new_folder(spark, "artifacts")
    so.write_texts(src.documents(spark, sf), folder, "text", "doc_id")
    files = so.read_texts(spark, folder).withColumn("content", F.encode("text", "UTF-8"))
    return files.select(
        "doc_id", F.length("content").alias("bytes"), F.md5(tx.decode_bytes(F.col("content"))).alias("digest"),
        ar.is_pdf(F.col("content")).alias("is_pdf"),
    )


@query
def pdf_headers(spark, sf):
    """Magic bytes and decoding of raw objects, some with a PDF header."""
    head = F.when(F.col("source") == "src3", F.lit("%PDF-1.4 ")).otherwise("")
    raw = src.documents(spark, sf).select("doc_id", F.encode(F.concat(head, "text"), "UTF-8").alias("content"))
    return raw.select("doc_id", ar.is_pdf(F.col("content")).alias("is_pdf"), F.md5(tx.decode_bytes(F.col("content"))).alias("digest"))


@query
def artifact_files(spark, sf):
    """Raw files of a folder with their sizes; the pages of each site are written as files first."""
    folder = so.new_folder(spark, "pages")
    pages = read_table(spark, sf, "pages").select("page_id", F.base64(F.encode("html", "UTF-8")).alias("line"))
    pages.select(F.concat_ws(" ", F.col("page_id").cast("string"), F.regexp_replace("line", "\\s", "")).alias("value")).write.text(folder)
    files = so.decode_artifacts(so.read_artifacts(spark, folder, "part-*"))
    lines = files.select(F.explode(F.split("text", "\n")).alias("line")).where("line <> ''")
    html = F.decode(F.unbase64(F.substring_index("line", " ", -1)), "UTF-8")
    return lines.select(F.substring_index("line", " ", 1).cast("long").alias("page_id"), F.md5(html).alias("digest"))


@query
def stored_results(spark, sf):
    """Claims of each document written as JSON, one object per document, and read back."""
    folder = so.new_folder(spark, "results")
    rows = _mined(spark, sf).select("doc_id", F.transform("claims", lambda c: c["text"]).alias("claims"))
    so.write_documents(rows, folder, "doc_id")
    back = so.read_documents(spark, folder, "doc_id long, claims array<string>")
    return back.select("doc_id", F.size("claims").alias("claims"), F.md5(joined("claims", "\n")).alias("digest"))


@query
def new_records(spark, sf):
    """Records appended with their defaults and read back, those of one session by id."""
    folder = so.new_folder(spark, "records")
    given = src.submissions(spark, sf).select("session_id", "submission_id", "artifact_type", F.when(F.col("ord") % 3 == 0, "READY").alias("status"))
    so.append_records(rc.with_defaults(given, "submission"), folder)
    back = spark.read.parquet(folder)
    one = so.lookup(back, "session_id", "s1").select("submission_id", F.lit(True).alias("first"))
    found = back.join(one, "submission_id", "left")
    return found.select("submission_id", "artifact_type", "status", F.coalesce("first", F.lit(False)).alias("of_first_session"))


@query
def record_lookup(spark, sf):
    """The submissions of one session from records indexed by it; one folder and file is read."""
    given = src.submissions(spark, sf).select("session_id", "submission_id", "artifact_type")
    folder = so.new_folder(spark, "indexed")
    so.write_indexed(given, folder, "session_id")
    wanted = given.agg(F.min("session_id")).first()[0]
    found = so.lookup(spark.read.parquet(folder), "session_id", wanted, so.BUCKETS)
    return found.select("session_id", "submission_id", F.coalesce("artifact_type", F.lit("")).alias("artifact_type"))


@query
def repeated_writes(spark, sf):
    """Texts, results and records of a run written twice are there once; another run adds its own."""
    folders = [so.new_folder(spark, n) for n in ("texts", "results", "records")]
    docs = src.documents(spark, sf).select("doc_id", "text")
    given = src.submissions(spark, sf).select("session_id", "submission_id")
    for run, some in (("a", docs), ("a", docs), ("b", docs.where("doc_id % 2 = 0"))):
        so.write_texts(some, folders[0], "text", "doc_id", run=run)
        so.write_documents(some.select("doc_id", F.md5("text").alias("digest")), folders[1], "doc_id", run=run)
        so.append_records(given, folders[2], run=run)
    texts = so.read_texts(spark, folders[0]).select(F.lit("text").alias("kind"), F.col("doc_id").cast("string").alias("id"), F.md5("text").alias("digest"))
    results = so.read_documents(spark, folders[1], "doc_id long, digest string").select(F.lit("result"), F.col("doc_id").cast("string"), "digest")
    records = spark.read.parquet(folders[2]).select(F.lit("record"), "submission_id", F.md5("session_id"))
    return texts.union(results).union(records).groupBy("kind", "id", "digest").agg(F.count("*").alias("rows"))


def _snapshot_and_log(spark, sf):
    """Updates up to the middle of the time, and those after it."""
    updates = src.status_updates(spark, sf)
    at = millis(updates, "ts")
    middle = updates.agg(F.percentile_approx(at, 0.5)).first()[0]
    return updates.where(at <= middle), updates.where(at > middle)


@query
def snapshot_merge(spark, sf):
    """Merged pointers and last status from a bucketed snapshot and the log since; only the log is exchanged."""
    older, newer = _snapshot_and_log(spark, sf)

    def current(updates):
        pointers = rc.merge_updates(updates, "analysis_id", ["extract_pointer", "report_pointer"], ["ts", "seq"])
        return rc.latest_status(updates, "analysis_id", ["ts", "seq"]).drop("terminal").join(pointers, "analysis_id")

    folder = so.new_folder(spark, "snapshot")
    snapshot = so.write_snapshot(current(older), folder, "snapshot_" + folder[-32:], "analysis_id")
    kept = ["step", "extract_pointer", "report_pointer"]
    df = rc.with_changes(snapshot, current(newer), "analysis_id", so.BUCKETS, kept)
    text = [F.coalesce(c, F.lit("")).alias(c) for c in ("step", "error", "extract_pointer", "report_pointer")]
    return df.select("analysis_id", "status", "progress", *text)


@query
def latest_trace(spark, sf):
    """The whole trace array of each user, the last snapshot wins."""
    t = _trace(spark, sf).select("analysis_id", "day", F.struct("seq", "role", "status").alias("entry"))
    snapshots = t.groupBy("analysis_id", "day").agg(F.array_sort(F.collect_list("entry")).alias("trace"))
    df = rc.latest_row(snapshots, ["analysis_id"], ["day"])
    entries = F.transform("trace", lambda e: F.concat_ws(":", e["seq"].cast("string"), e["role"], e["status"]))
    return df.select("analysis_id", F.size("trace").alias("entries"), joined(entries, "|").alias("trace"))


@query
def sparse_sources(spark, sf):
    """extractions so thin that another source should be tried."""
    paras = F.size(tx.paragraph_list(F.col("text")))
    words = F.size(F.split("text", " "))
    return src.documents(spark, sf).select("doc_id", en.is_sparse(paras, words).alias("sparse"))


@query
def tei_bibliography(spark, sf):
    """biblStruct entries of tagged markup, one per line of a document."""
    lines = F.split("text", "\n")
    entry = lambda x, i: F.concat(
        F.when(i % 2 == 0, F.concat(F.lit('<biblStruct xml:id="k'), i.cast("string"), F.lit('">'))).otherwise("<biblStruct>"),
        F.lit("<title>"), F.regexp_replace(x, "[<>&]", " "), F.lit("</title></biblStruct>"),
    )
    docs = src.documents(spark, sf).select("doc_id", joined(F.transform(lines, entry), "").alias("xml"))
    df = docs.select("doc_id", F.posexplode(mk.bibliography(F.col("xml"))).alias("pos", "b"))
    return df.select("doc_id", (F.col("pos") + 1).alias("ord"), "b.key", F.coalesce("b.raw", F.lit("")).alias("raw"))


@query
def model_answers(spark, sf):
    """H1: prompts of all segments through a user function that answers from the prompt."""
    prompts = cd.claim_prompts(cd.segments(src.sheet_rows(spark, sf))).select("doc_id", "segment", "prompt")

    def transport(batch):
        return [f"{len(p)} {p.count(chr(10))}" for p in batch]

    return cd.run_model(prompts, transport).select("doc_id", "segment", "raw_json")


@query
def model_once(spark, sf):
    """H1: repeated prompts are sent once, a failing call ends nothing, a second run sends what failed."""
    prompts = cd.claim_prompts(cd.segments(src.sheet_rows(spark, sf))).select("doc_id", "segment", "prompt")
    folder = so.new_folder(spark, "answers")

    def transport(batch):
        return [f"{len(p)} {p.count(chr(10))}" for p in batch]

    def failing(batch):
        if any(len(p) % 7 == 0 for p in batch):
            raise RuntimeError("no answer")
        return transport(batch)

    first = so.stored(cd.ask_once(prompts, failing, folder).select("doc_id", "segment", F.col("raw_json").alias("first"), "model_error"), "first")
    second = cd.ask_once(prompts, transport, folder).select("doc_id", "segment", "raw_json", "calls")
    both = first.join(second, ["doc_id", "segment"])
    return both.select("doc_id", "segment", *[F.coalesce(c, F.lit("")).alias(c) for c in ("first", "model_error")], "raw_json", "calls")


@query
def ensemble_extract(spark, sf):
    """K9: assembled extract of each document from its sources."""
    rows = en.ensemble_extract(_candidate_sources(spark, sf))
    return rows.select(
        "doc_id", F.size("paragraphs").alias("paragraphs"), F.size("sections").alias("sections"), joined("bib", "|").alias("bib"),
        F.md5(joined(F.transform("paragraphs", lambda p: p["text"]), "\n")).alias("digest"),
    )


@query
def model_paragraphs(spark, sf):
    """Deduped paragraphs of model payloads."""
    docs = src.documents(spark, sf)
    raw = F.to_json(F.struct(F.split("text", "\n").alias("paragraphs")))
    df = docs.select("doc_id", F.posexplode(mk.model_paragraphs(raw)).alias("pos", "text"))
    return df.select("doc_id", (F.col("pos") + 1).alias("ord"), "text")


def _streamed(spark, rows: DataFrame, parts: int, order: str):
    """Rows as a stream of files, dealt by a column and read in two batches, however many files there are."""
    folder = so.new_folder(spark, "stream")
    rows.withColumn("part", F.pmod(F.col(order), F.lit(parts))).write.partitionBy("part").parquet(folder)
    files = len(spark.read.schema(rows.schema).option("recursiveFileLookup", "true").parquet(folder).inputFiles())
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", max(2, -(-files // 2)))
    return stream.option("recursiveFileLookup", "true").parquet(folder)


@query
def status_stream(spark, sf):
    """Current status of each user from a stream of updates, written and read back."""
    updates = src.status_updates(spark, sf).select("analysis_id", "seq", "status", "progress", "step", "error")
    out = so.new_folder(spark, "status")
    stream = live.latest_status_stream(_streamed(spark, updates, 4, "seq"))
    live.write_latest(stream, out, so.new_folder(spark, "progress")).trigger(availableNow=True).start().awaitTermination()
    df = live.read_latest(spark, out)
    return df.select("analysis_id", "status", "progress", F.coalesce("step", F.lit("")).alias("step"), F.coalesce("error", F.lit("")).alias("error"))


@query
def trace_stream(spark, sf):
    """Q4: trace entries appended from a stream, read back."""
    out = so.new_folder(spark, "trace")
    entries = _trace(spark, sf).select("analysis_id", "seq", "role", "status")
    live.append_trace(_streamed(spark, entries, 4, "seq"), out, so.new_folder(spark, "progress")).trigger(availableNow=True).start().awaitTermination()
    back = spark.read.option("basePath", out).parquet(f"{out}/batch=*")
    return back.select("analysis_id", "seq", "role", "status")


@query
def progress_stream(spark, sf):
    """Roles seen of each run and its first missing step, from a stream of trace entries."""
    run = F.concat_ws("|", "analysis_id", F.date_format("day", "yyyy-MM-dd")).alias("run")
    entries = _trace(spark, sf).select(run, "seq", "role")
    out = so.new_folder(spark, "progress-rows")
    stream = live.trace_progress_stream(_streamed(spark, entries, 4, "seq"), "run")
    live.write_latest(stream, out, so.new_folder(spark, "progress"), "run").trigger(availableNow=True).start().awaitTermination()
    df = live.read_latest(spark, out, "run")
    return df.select("run", "done", "percent", F.coalesce("first_missing", F.lit("")).alias("first_missing"))


@query
def limit_stream(spark, sf):
    """Q1 as a stream: three runs over requests in parts, so that many come late; each decision and its batch."""
    req = read_table(spark, sf, "events").select(F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("request_id"), "ts")
    folder, out, progress = (so.new_folder(spark, n) for n in ("stream", "limits", "progress"))
    for part in range(3):
        req.where(F.pmod("request_id", F.lit(3)) == part).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(req.schema).parquet(folder)
        live.write_limited(stream, out, progress, 2, 12 * 3600 * 1000).trigger(availableNow=True).start().awaitTermination()
    df = live.read_limited(spark, out)
    return df.select("key", "request_id", "batch", "allowed", F.coalesce("retry_after_ms", F.lit(0)).alias("retry_after_ms"), "window_start")
