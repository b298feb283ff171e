"""Reader views over analysis results: claim evidence, todos, patches, answers, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docaudit import fixed as fx
from docaudit.functions import text as tx
from docaudit.operators.evidence import evidence_reason
from docaudit.operators.logic import logic_of
from docaudit.operators.risks import risk_table

# ---- claims ------------------------------------------------------------------------------


def claim_views() -> Column:
    """Every claim of an audited row with its evidence risk, or the defaults of a claim without one."""

    def entry(a: Column, i: Column, claims: Column) -> Column:
        risk = a["code"].isNotNull()
        reason = evidence_reason(a["code"], a["best_score"], a["avg_score"], a["coverage"])
        return F.struct(
            a["ord"].alias("ord"), a["claim_id"].alias("claim_id"), a["text"].alias("text"),
            F.when(risk, a["para_ids"]).otherwise(F.get(claims, i)["para_ids"]).alias("para_ids"),
            F.coalesce(a["severity"], F.lit("LOW")).alias("severity"),
            F.coalesce(reason, F.lit(fx.MSG["no_evidence_risk"])).alias("reason"),
        )

    return tx.let(F.col("claims"), lambda claims: F.transform("audit", lambda a, i: entry(a, i, claims)))


def claim_evidence_view(rows: DataFrame) -> DataFrame:
    """The claims of audited rows with their evidence risk, as a table."""
    return rows.select("doc_id", F.inline(claim_views()))


def claim_strength(view: DataFrame) -> DataFrame:
    """Strength word and evidence references of each claim of the view."""
    strength = (
        F.when(F.col("severity") == "HIGH", "none").when(F.col("severity") == "MEDIUM", "weak").otherwise("moderate")
    )
    refs = F.transform("para_ids", lambda i: F.struct(F.lit("citation").alias("type"), i.alias("ref_id")))
    return view.withColumn("strength", strength).withColumn("evidence", refs)


def strength_from_risks(risks: DataFrame) -> DataFrame:
    """The same view for documents without claims, from their ranked risks."""
    ids = F.coalesce(F.col("refs.paragraph_ids"), F.array().cast("array<string>"))
    own = F.get(F.col("refs.claim_ids"), F.lit(0))
    return risks.select(
        "doc_id",
        F.coalesce(own, F.format_string("claim_%d", "rank")).alias("claim_id"),
        F.col("title").alias("text"),
        F.coalesce(F.nullif("reason", F.lit("")), F.col("title")).alias("snippet"),
        F.when(F.size(ids) > 0, "moderate").otherwise("none").alias("strength"),
    )


def claims_with_logic(rows: DataFrame) -> DataFrame:
    """Claims with the severity and reason of their logic risk, if any."""

    def entry(c: Column, i: Column) -> Column:
        told = lambda l: F.struct(
            (i + 1).alias("ord"), c["claim_id"].alias("claim_id"), c["text"].alias("text"), c["para_ids"].alias("para_ids"),
            l["severity"].alias("logic_severity"), F.when(l["severity"].isNotNull(), l["reason"]).alias("logic_reason"),
        )
        return tx.let(logic_of(c["text"]), told)

    return rows.select("doc_id", F.inline(F.transform("claims", entry)))


def vague_points(rows: DataFrame) -> DataFrame:
    """Points to make concrete: from logic risks, else from the ranked risks of the document."""

    def point(name: str, n: Column, text: Column, suggestion: str) -> Column:
        return F.struct(
            n.cast("int").alias("n"), F.format_string(name + "_%d", n).alias("point_id"), text.alias("text"), F.lit(fx.MSG[suggestion]).alias("suggestion")
        )

    logic = F.transform(
        "logic", lambda l, i: point("logic_risk", i + 1, F.concat(l["claim_id"], F.lit(": "), l["reason"]), "vague_suggestion")
    )
    reason = lambda r: F.coalesce(F.nullif(r["reason"], F.lit("")), F.lit(fx.MSG["vague_default"]))
    risks = F.transform(
        "risks", lambda r: point("risk_vague", r["rank"], F.concat(r["title"], F.lit(": "), reason(r)), "risk_vague_suggestion")
    )
    points = F.when(F.size("logic") > 0, logic).otherwise(risks)
    return rows.select("doc_id", F.inline(points)).withColumn("type", F.lit("no_condition"))


def vague_counts(points: DataFrame) -> DataFrame:
    return points.groupBy("type").count()


def heatmap_text(claims: DataFrame) -> DataFrame:
    """Claim texts of a document, one per line."""
    return claims.groupBy("doc_id").agg(
        F.array_join(F.array_sort(F.collect_list(F.struct("ord", "text")))["text"], "\n").alias("text")
    )


def claim_context(claims: DataFrame, limit: int | None = None) -> DataFrame:
    """Claims as prompt text, and the first claim as default focus; with ``limit`` also left_out."""
    line = F.concat(F.lit("["), "claim_id", F.lit("] "), "text")
    entry = F.struct("ord", line.alias("line"))
    held = entry if limit is None else F.when(F.col("ord") <= limit, entry)
    counted = [] if limit is None else [F.count_if(F.col("ord") > limit).alias("left_out")]
    return claims.groupBy("doc_id").agg(
        F.array_join(F.array_sort(F.collect_list(held))["line"], "\n").alias("context"),
        F.min_by("text", "ord").alias("first_claim"),
        *counted,
    )


def focus_claims(requests: DataFrame, claims: DataFrame) -> DataFrame:
    """Requests (doc_id, turn_id, focus_claim_id) with the focus text, by default the first claim."""
    by_id = claims.select("doc_id", F.col("claim_id").alias("focus_claim_id"), F.col("text").alias("by_id"))
    ctx = claim_context(claims)
    df = requests.join(by_id, ["doc_id", "focus_claim_id"], "left").join(ctx, "doc_id", "left")
    focus = F.when(F.col("focus_claim_id").isNull(), F.col("first_claim")).otherwise(F.col("by_id"))
    return df.withColumn("focus_text", focus).drop("by_id", "first_claim")


# ---- todos ---------------------------------------------------------------------------------


def _impact(severity: Column) -> Column:
    return F.when(severity == "HIGH", 5).when(severity == "MEDIUM", 4).otherwise(3)


def _todo(todo_id: Column, title: Column, text: Column, impact: Column, source: str) -> list[Column]:
    return [
        todo_id.alias("todo_id"),
        title.alias("title"),
        text.alias("description"),
        impact.alias("impact"),
        F.lit(2).alias("effort"),
        F.lit("pending").alias("status"),
        F.lit(source).alias("source"),
    ]


def todos_from_findings(findings: DataFrame) -> DataFrame:
    todo_id = F.coalesce(F.nullif("finding_id", F.lit("")), F.format_string("todo_pf_%d", "ord"))
    impact = F.when(F.col("severity") == "error", 5).otherwise(3)
    return findings.select(
        "doc_id", "ord", *_todo(todo_id, F.col("kind"), F.col("message"), impact, "preflight")
    )


def todos_from_analysis(rows: DataFrame, fallback: int | None = None) -> DataFrame:
    """One todo per ranked risk; documents without risks get their claims, or the first ``fallback``.

    Both are chosen in the row, so that the rows are worked out once.
    """
    default = F.lit(fx.MSG["todo_risk_default"])

    def of_risk(r: Column) -> Column:
        text = F.coalesce(F.nullif(r["reason"], F.lit("")), default)
        todo = _todo(F.format_string("todo_risk_%d", r["rank"]), r["title"], text, _impact(r["severity"]), "evidence")
        return F.struct(r["rank"].alias("ord"), *todo)

    def of_claim(c: Column) -> Column:
        title = F.format_string("Claim %d の根拠を補強", c["ord"])
        return F.struct(c["ord"].alias("ord"), *_todo(F.format_string("todo_claim_%d", c["ord"]), title, c["reason"], _impact(c["severity"]), "evidence"))

    views = claim_views() if fallback is None else F.filter(claim_views(), lambda c: c["ord"] <= fallback)
    todos = F.when(F.size("risks") == 0, F.transform(views, of_claim)).otherwise(F.transform("risks", of_risk))
    return rows.select("doc_id", F.inline(todos))


def overlay_todos(extra: DataFrame, computed: DataFrame, overrides: DataFrame) -> DataFrame:
    """Extra todos before computed ones, first id wins, then status overrides."""
    both = extra.withColumn("src", F.lit(0)).unionByName(computed.withColumn("src", F.lit(1)))
    rest = [c for c in both.columns if c not in ("doc_id", "todo_id")]
    first = both.groupBy("doc_id", "todo_id").agg(
        F.min_by(F.struct(*rest), F.struct("src", "ord")).alias("t")
    ).select("doc_id", "todo_id", "t.*")
    df = first.join(overrides.select("doc_id", "todo_id", F.col("status").alias("new_status")), ["doc_id", "todo_id"], "left")
    return df.withColumn("status", F.coalesce("new_status", "status")).drop("new_status")


def todo_counts(todos: DataFrame) -> DataFrame:
    return todos.groupBy("doc_id").agg(
        F.count_if(F.col("status") == "accepted").alias("accepted"),
        F.count_if(F.col("status") == "pending").alias("pending"),
    )


def oral_draft_todos(drafts: DataFrame, key: str = "analysis_id", title_chars: int | None = None) -> DataFrame:
    """Drafts (key, seq, sentence, auto_accept) -> todos by text hash, newest first.

    A repeated sentence updates its todo in place; once accepted it stays accepted.
    """
    sentence = tx.js_trim(F.col("sentence"))
    df = drafts.withColumn("sentence", sentence).where(F.col("sentence") != "")
    df = df.withColumn("todo_id", F.concat(F.lit("todo_oral_"), tx.rolling_hash(F.col("sentence"))))
    merged = df.groupBy(key, "todo_id").agg(
        F.min_by(tx.first_chars(F.col("sentence"), title_chars), "seq").alias("title"),
        F.max_by("sentence", "seq").alias("description"),
        F.max("auto_accept").alias("accepted"),
        F.max("seq").alias("last_seq"),
    )
    return merged.select(
        key,
        "todo_id",
        "title",
        "description",
        F.lit(4).alias("impact"),
        F.lit(2).alias("effort"),
        F.when(F.col("accepted"), "accepted").otherwise("pending").alias("status"),
        F.lit("oral").alias("source"),
        "last_seq",
    )


# ---- patches ---------------------------------------------------------------------------------


def patch_text(todos: DataFrame, key: str = "analysis_id") -> DataFrame:
    """Unified diff per analysis from accepted todo titles (key, ord, title, status).

    The diff is one text per analysis, so its lines are gathered per analysis by nature.
    """
    title = tx.js_trim(F.col("title"))
    line = F.when((F.col("status") == "accepted") & (title != ""), F.struct("ord", title.alias("t")))
    df = todos.groupBy(F.col(key).cast("string").alias(key)).agg(
        F.array_sort(F.collect_list(line))["t"].alias("titles")
    )
    body = F.when(
        F.size("titles") > 0, F.transform("titles", lambda t: F.concat(F.lit("+- [ ] "), t))
    ).otherwise(F.array(F.lit("+<!-- no accepted todos -->")))
    df = df.withColumn("body", body)
    path = F.concat(F.lit("docs/analysis_"), F.col(key), F.lit(".md"))
    diff = F.concat(
        F.lit("diff --git a/"), path, F.lit(" b/"), path, F.lit("\nindex 0000000..1111111 100644\n--- a/"),
        path, F.lit("\n+++ b/"), path, F.lit("\n@@ -0,0 +1,"), F.size("body").cast("string"), F.lit(" @@\n"),
        F.array_join("body", "\n"), F.lit("\n"),
    )
    return df.select(key, diff.alias("diff_text"))


def diff_summary(diff: Column) -> tuple[Column, Column]:
    """(files, hunks) of a diff text."""
    lines = F.split(diff, "\n", -1)
    files = F.size(F.filter(lines, lambda x: x.startswith("diff --git ")))
    hunks = F.size(F.filter(lines, lambda x: x.startswith("@@ ")))
    return files, hunks


def compose_pr(parts: dict[str, Column]) -> Column:
    """One PR text from summary, background, changes, test plan, risks, rollback and diff."""
    heads = [
        ("# Summary", "summary"), ("## Background", "background"), ("## Changes", "changes"),
        ("## Test Plan", "test_plan"), ("## Risks", "risks"), ("## Rollback", "rollback"), ("## Diff", "diff"),
    ]
    lines: list[Column] = []
    for head, name in heads:
        body = tx.js_trim(F.coalesce(parts[name], F.lit("")))
        lines += [F.lit(head), F.nullif(body, F.lit(""))]
    return F.concat_ws("\n", *lines)


# ---- oral answers -----------------------------------------------------------------------------


def evaluate_answers(turns: DataFrame, answer: str = "text", focus: str | None = None) -> DataFrame:
    """Evaluation of each user answer: pass from 80 characters, else follow-up and todo."""
    trimmed = tx.js_trim(F.col(answer))
    given = trimmed != ""
    passed = F.when(given, F.length(trimmed) >= fx.ANSWER_PASS_CHARS)
    question = F.lit(fx.MSG["oral_fallback"])
    if focus is not None:
        named = F.replace(F.lit(fx.MSG["oral_focus_fallback"]), F.lit("{claim}"), F.col(focus))
        question = F.when(F.col(focus).isNotNull(), named).otherwise(question)
    pick = lambda yes, no: F.when(passed, fx.MSG[yes]).when(~passed, fx.MSG[no])
    return turns.select(
        "*",
        question.alias("question"),
        passed.alias("pass"),
        F.coalesce(~passed, F.lit(False)).alias("follow_up"),
        pick("oral_pass", "oral_revise").alias("reason"),
        pick("oral_draft_pass", "oral_draft_revise").alias("draft"),
        F.when(~passed, fx.MSG["oral_todo"]).alias("todo_title"),
    )


def expand_turns(evaluated: DataFrame, sessions: DataFrame, keys: list[str], answer: str = "text") -> DataFrame:
    """ANSWER, QUESTION, EVAL and DRAFT rows of evaluated turns whose session keeps data.

    ``sessions`` (session_id, mode); only SAVE sessions keep turns.
    """
    save = sessions.where(F.col("mode") == "SAVE").select("session_id")
    df = evaluated.join(save, "session_id", "left_semi")
    row = lambda role, kind, text: F.struct(
        F.lit(role).alias("role"), F.lit(kind).alias("type"), text.alias("content")
    )
    verdict = F.when(F.col("pass"), "PASS: ").otherwise("REVISE: ")
    some = F.col("pass").isNotNull()
    rows = F.array_compact(
        F.array(
            F.when(~tx.is_blank(F.col(answer)), row("USER", "ANSWER", F.col(answer))),
            row("AI", "QUESTION", F.col("question")),
            F.when(some, row("AI", "EVAL", F.concat(verdict, F.col("reason")))),
            F.when(some, row("AI", "DRAFT", F.col("draft"))),
        )
    )
    df = df.select(*keys, F.posexplode(rows).alias("pos", "r"))
    return df.select(*keys, (F.col("pos") + 1).alias("seq"), "r.role", "r.type", "r.content")


# ---- report --------------------------------------------------------------------------------------


def report_html(analyses: DataFrame) -> DataFrame:
    """HTML report of each analysis row."""
    names = [
        ("analysisId", "analysis_id"), ("sessionId", "session_id"), ("submissionId", "submission_id"),
        ("status", "status"), ("progress", "progress"), ("step", "step"),
    ]

    def cell(col: str) -> Column:
        value = F.col(col).cast("string")
        return tx.html_escape(F.coalesce(value, F.lit("-")) if col == "step" else value)

    rows = [
        F.concat(F.lit(f"    <tr><th>{label}</th><td>"), cell(col), F.lit("</td></tr>"))
        for label, col in names
    ]
    title = F.concat(F.lit("  <title>Analysis Report - "), cell("analysis_id"), F.lit("</title>"))
    head = [
        "<!doctype html>", '<html lang="en">', "<head>", '  <meta charset="utf-8" />',
        '  <meta name="viewport" content="width=device-width, initial-scale=1" />',
    ]
    body = ["</head>", "<body>", "  <h1>Analysis Report</h1>",
            '  <table border="1" cellpadding="8" cellspacing="0">']
    lines = [*map(F.lit, head), title, *map(F.lit, body), *rows,
             *map(F.lit, ["  </table>", "</body>", "</html>", ""])]
    return analyses.select("analysis_id", F.concat_ws("\n", *lines).alias("html"))
