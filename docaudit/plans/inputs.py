"""Artifact inputs derived from the given tables.

The tables hold no LaTeX, pull requests or archives; these are concatenated from their
columns. Each text is one SQL expression that Spark and DuckDB read alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docaudit.operators import claims as cl
from docaudit.operators import latex as lx
from docaudit.operators import structure as st
from docaudit.sources.tables import read_table


def _cat(*parts: str) -> str:
    return " || ".join(parts)


NL, BS = "chr(10)", "chr(92)"

# A paper: lines of the text as paragraphs, one figure per language, references and citations.
LATEX_SOURCE = _cat(
    BS, "'section{'", "source", "'}'", NL, NL,
    f"replace(text, {NL}, {NL} || {NL})", NL, NL,
    BS, "'begin{figure}'", NL, BS, "'caption{Chart  of '", "lang", "'}'", NL,
    BS, "'label{fig:'", "lang", "'}'", NL, BS, "'end{figure}'", NL, NL,
    "'As shown in '", BS, "'ref{fig:'", "source", "'} and Figure 2 we cite '",
    BS, "'cite{'", "lang", "', '", "source", "'}.'", NL, NL,
    BS, "'subsection{Notes '", "lang", "'}'", NL, "'Words before '", BS, "'subsubsection{}'", NL,
    "case when lang in ('en', 'de') then 'See ' || chr(92) || 'autoref{FIG:' || lang || '} and Fig. 1 ' else 'Nothing ' end",
    BS, "'citep{key_'", "lang", "'} % a remark'", NL,
)
LATEX_BIB = ["lang", "'key_' || source", "'unused_' || source"]

# A document with markdown and numbered headings.
DOC_TEXT = _cat(
    "'# Overview of '", "source", NL,
    f"replace(text, '. ', '.' || {NL})", NL, NL,
    "'1.2 Data and '", "lang", NL, "'The evidence is '", "source", "'.'", NL, "'  '", NL,
    "case when lang = 'en' then 'A decision and its risk.' else 'Plain words.' end", NL,
    "'## overview of '", "source", NL, "'Last block'",
)

# A pull request: description, then a diff made of the text lines.
PR_TEXT = _cat(
    "'# Summary'", NL, "'Change for '", "source", NL, NL, "'second paragraph'", NL,
    "'Test Plan:'", NL, "'run '", "lang", "' migrate'", NL,
    "'diff --git a/src/'", "source", "'.ts b/src/'", "source", "'.ts'", NL,
    "'--- a/src/x.ts'", NL, "'@@ -1,2 +1,3 @@ fn'", NL, "' context line'", NL,
    f"'+' || replace(text, {NL}, {NL} || '+')", NL,
    "case when lang = 'en' then '+// TODO later' || chr(10) || '+function run_' || source || '(a) {' "
    "else '+class ' || lang || 'Box {' end", NL,
    "case when lang = 'fr' then '-  expect(value).toBe(1)' else '-old line' end", NL,
    "'@@ -9 +9 @@'", NL, "'-removed only'", NL,
    "'diff --git a/db/'", "lang", "'.sql b/db/'", "lang", "'.sql'", NL, "'@@ -0,0 +1 @@'", NL,
    "'+create table t'", NL, "case when lang = 'de' then '+it.skip(1)' else '+x' end",
)


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "documents", "doc_id")


def sheet_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as SHEET artifacts: extract rows."""
    return st.sheet_extract(documents(spark, sf).select("doc_id", "text"))


def mined_sheets(spark: SparkSession, sf: str) -> DataFrame:
    return cl.mine_claims(sheet_rows(spark, sf))


def sheet_claims(spark: SparkSession, sf: str) -> DataFrame:
    return cl.claim_table(mined_sheets(spark, sf))


def doc_rows(spark: SparkSession, sf: str) -> DataFrame:
    docs = documents(spark, sf).selectExpr("doc_id", f"{DOC_TEXT} as text")
    return st.doc_extract(docs)


def pr_texts(spark: SparkSession, sf: str) -> DataFrame:
    return documents(spark, sf).selectExpr("doc_id", f"{PR_TEXT} as text")


def latex_sources(spark: SparkSession, sf: str) -> DataFrame:
    from docaudit.functions.text import strip_latex_comments

    docs = documents(spark, sf).selectExpr(
        "doc_id", f"{LATEX_SOURCE} as source", f"array({', '.join(LATEX_BIB)}) as bib"
    )
    return docs.withColumn("source", strip_latex_comments(F.col("source")))


def latex_rows(spark: SparkSession, sf: str) -> DataFrame:
    return lx.latex_extract(latex_sources(spark, sf))


# Requests, sessions and records from the event and order tables.
SESSION_OF = "concat('s', cast(o_custkey as string))"


def sessions(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "customer").selectExpr(
        "concat('s', cast(c_custkey as string)) as session_id",
        "case when c_acctbal > 0 then 'SAVE' else 'NO_SAVE' end as mode",
        "case c_mktsegment when 'BUILDING' then 0.0 when 'MACHINERY' then 36.0 "
        "when 'AUTOMOBILE' then 1.0 end as ttl_hours",
        "case when c_nationkey < 5 then 'en' else 'fr' end as language",
    )


def submissions(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "orders").selectExpr(
        f"{SESSION_OF} as session_id",
        "concat('sub', cast(o_orderkey as string)) as submission_id",
        "case o_orderpriority when '1-URGENT' then 'PR' when '2-HIGH' then 'DOC' when '5-LOW' then null else 'PAPER' end as artifact_type",
        "case o_orderstatus when 'F' then 'PDF' else 'LATEX_ZIP' end as input_type",
        "concat('gs://bucket/raw/', o_orderstatus, '_my_file_', o_orderpriority, '.', lower(o_orderstatus)) as path",
        "case when o_orderstatus = 'P' then 'no date' else concat(cast(o_orderdate as date), 'T00:00:00Z') end as created_at",
        "o_orderkey as ord",
    )


def analyses(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "orders").selectExpr(
        f"{SESSION_OF} as session_id",
        "concat('an', cast(o_orderkey as string)) as analysis_id",
        "case o_orderstatus when 'F' then 'READY' when 'P' then 'FAILED' else 'ANALYZING' end as status",
        "concat(cast(o_orderdate as date), 'T00:00:00Z') as updated_at",
        "o_orderkey as ord",
    )


def status_updates(spark: SparkSession, sf: str) -> DataFrame:
    """Update log per user: status, progress, and a step or an error in some rows."""
    return read_table(spark, sf, "events").selectExpr(
        "user_id as analysis_id",
        "event_id as seq",
        "ts",
        "case event_type when 'signup' then 'QUEUED' when 'view' then 'EXTRACTING' when 'click' then 'ANALYZING' "
        "when 'purchase' then 'READY' else 'FAILED' end as status",
        "value as progress",
        "case event_type when 'view' then 'extract' when 'click' then 'evidence' end as step",
        "case event_type when 'error' then concat('failed with ', props) end as error",
        "case event_type when 'signup' then concat('x', cast(event_id as string)) end as extract_pointer",
        "case event_type when 'purchase' then cast(event_id as string) end as report_pointer",
    )
