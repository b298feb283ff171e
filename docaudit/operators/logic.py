"""Logic inspection and prior-art queries: row-wise rules over a claim table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docaudit import fixed as fx
from docaudit.functions import text as tx
from docaudit.functions.marks import marked, marks
from docaudit.functions.plan import settle

LOGIC_RULES = [
    ("absolute_without_condition", "HIGH"),
    ("vague_without_number", "MEDIUM"),
    ("comparison_without_baseline", "MEDIUM"),
    ("no_number_condition_comparator", "LOW"),
    ("short_without_number", "LOW"),
]


def logic_flags(text: Column) -> Column:
    """The six word predicates of a claim."""
    return tx.let(
        F.lower(text),
        lambda low: F.struct(
            tx.has_digit(text).alias("number"),
            tx.matches_any(low, fx.VAGUE, lowered=True).alias("vague"),
            tx.matches_any(low, fx.ABSOLUTE, lowered=True).alias("absolute"),
            tx.matches_any(low, fx.COMPARATIVE, lowered=True).alias("comparative"),
            tx.matches_any(low, fx.COMPARATOR, lowered=True).alias("comparator"),
            tx.matches_any(low, fx.CONDITION, lowered=True).alias("condition"),
            (F.length(tx.js_trim(text)) < fx.LOGIC_SHORT_CHARS).alias("short"),
        ),
    )


def logic_of(text: Column) -> Column:
    """Rule names, reason and severity of the rules that a claim breaks; a null severity if none."""
    return broken_rules(logic_flags(text))


def broken_rules(flags: Column) -> Column:
    """The same from the word predicates."""

    def judged(f: Column) -> Column:
        hits = F.array(
            f["absolute"] & ~f["condition"],
            f["vague"] & ~f["number"],
            f["comparative"] & ~f["comparator"],
            ~f["number"] & ~f["condition"] & ~f["comparator"],
            f["short"] & ~f["number"],
        )
        names = [n for n, _ in LOGIC_RULES]
        hit = lambda held, n: F.get(held, F.lit(n))

        def told(held: Column) -> Column:
            severity = F
            for level in reversed(fx.SEVERITIES):
                broken = [hit(held, n) for n, (_, s) in enumerate(LOGIC_RULES) if s == level]
                test = broken[0]
                for other in broken[1:]:
                    test = test | other
                severity = severity.when(test, level)
            return F.struct(
                F.concat_ws(",", *[tx.either(hit(held, i), F.lit(n), F.lit(None)) for i, n in enumerate(names)]).alias("rules"),
                F.concat_ws("; ", *[tx.either(hit(held, i), F.lit(fx.MSG[n]), F.lit(None)) for i, n in enumerate(names)]).alias("reason"),
                severity.alias("severity"),
            )

        return tx.let(hits, told)

    return tx.let(flags, judged)


def inspect_logic(claims: DataFrame) -> DataFrame:
    """Claims (doc_id, ord, claim_id, text) that break a rule: rule names, severity, reason."""
    df = claims.withColumn("__logic", F.array(logic_of(F.col("text"))))
    return df.select(*claims.columns, F.inline("__logic")).where(F.col("severity").isNotNull())


def logic_rows(rows: DataFrame) -> DataFrame:
    """Add ``logic``: (ord, claim_id, text, rules, reason, severity) of the claims that break a rule."""
    words = {"number": ["[0-9]"], "vague": fx.VAGUE, "absolute": fx.ABSOLUTE, "comparative": fx.COMPARATIVE, "comparator": fx.COMPARATOR, "condition": fx.CONDITION}
    found = marks(F.transform("claims", lambda c: c["text"]), list(words.values()), folded=True)
    rows = settle(rows.withColumn("__marks", found))

    def flags(text: Column, mark: Column) -> Column:
        short = F.length(tx.js_trim(text)) < fx.LOGIC_SHORT_CHARS
        return F.struct(*[marked(mark, n).alias(name) for n, name in enumerate(words)], short.alias("short"))

    every = F.transform(
        "claims",
        lambda c, i: tx.let(
            broken_rules(flags(c["text"], F.get("__marks", i))),
            lambda l: F.struct(
                (i + 1).alias("ord"), c["claim_id"].alias("claim_id"), c["text"].alias("text"),
                l["rules"].alias("rules"), l["reason"].alias("reason"), l["severity"].alias("severity"),
            ),
        ),
    )
    return settle(rows.withColumn("logic", F.filter(every, lambda l: l["severity"].isNotNull())).drop("__marks"))


def query_of(text: Column, domain: Column | None = None, max_keywords: int | None = None) -> Column:
    words = F.array_join(tx.keywords(text, max_keywords), " ")
    return tx.js_trim(words if domain is None else F.concat_ws(" ", F.nullif(domain, F.lit("")), words))


def prior_art_rows(rows: DataFrame, domain: str | None = None) -> DataFrame:
    """Add ``prior_art``: (ord, claim_id, query, rationale) of every claim."""
    tag = None if domain is None else F.col(domain)
    found = F.transform(
        "claims",
        lambda c, i: F.struct(
            (i + 1).alias("ord"), c["claim_id"].alias("claim_id"), query_of(c["text"], tag).alias("query"), F.lit(fx.MSG["prior_art"]).alias("rationale")
        ),
    )
    return settle(rows.withColumn("prior_art", found))


def prior_art_queries(claims: DataFrame, domain: str | None = None, max_keywords: int | None = None) -> DataFrame:
    """One search query per claim: optional domain column, then the keywords."""
    tag = None if domain is None else F.col(domain)
    return claims.withColumn("query", query_of(F.col("text"), tag, max_keywords)).withColumn(
        "rationale", F.lit(fx.MSG["prior_art"])
    )
