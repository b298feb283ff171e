"""Secret scans over a trigram inverted index, with DataFrame functions only.

From each rule's regular expression follows a Boolean query on trigrams that any match must hold.
The index has a posting for each document and trigram of some query; intersecting postings leaves
candidates, and only these are searched with the expression itself. Rules without a mandatory
trigram search every document. All positions are code points.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docaudit.functions.arrays import running
from docaudit.functions.text import let
from docaudit.llm.common import row_hash, stored


@dataclass(frozen=True)
class Rule:
    """A kind of secret. Matches are leftmost and don't overlap; those whose group is shorter than `least` are dropped."""

    kind: str
    pattern: str
    any_case: bool = False
    group: int = 0
    least: int = 1


# fixed values: the first three give the base result. Of `access` and `hex` the least length stands in the pattern:
# their runs end where no shorter or later match could begin.
RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", True, 2, 6),
    Rule("access", "AKIA[A-Z0-9]{16,}"),
    Rule("hex", "[0-9a-f]{24,}"),
    Rule("private_key", "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("forge", "gh[opsu]_[A-Za-z0-9]{36,}"),
    Rule("chat", "xox[abpr]-[A-Za-z0-9-]{10,}"),
    Rule("maps", "AIza[A-Za-z0-9_-]{35}"),
)
BASE = ("assign", "access", "hex")

MOST = 64  # literal forms of an expression that are told apart
GAP = None


def _forms(parsed) -> list[tuple]:
    """What a match can look like: sequences of literal strings and gaps."""
    out: list[tuple] = [()]
    for op, value in parsed:
        name = str(op)
        if name == "LITERAL":
            one = [(chr(value).lower(),)]
        elif name == "IN" and len(value) <= 8 and all(str(o) == "LITERAL" for o, _ in value):
            one = sorted({(chr(c).lower(),) for _, c in value})
        elif name == "SUBPATTERN":
            one = _forms(value[-1])
        elif name == "BRANCH":
            one = [form for part in value[1] for form in _forms(part)]
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
            low, high, part = value
            inner = _forms(part)
            one = [()] + inner if (low, str(high)) == (0, "1") else [form + (GAP,) for form in inner] if low else [(GAP,)]
        elif name in ("AT", "ASSERT", "ASSERT_NOT"):
            one = [()]
        else:
            one = [(GAP,)]
        out = [a + b for a, b in product(out, one)] if len(out) * len(one) <= MOST else [a + (GAP,) for a in out]
    return out


def trigram_query(pattern: str) -> list[frozenset[str]]:
    """Alternatives, each a set of lower-case trigrams that a text must hold together; empty if nothing is mandatory."""
    found = set()
    for form in _forms(re._parser.parse(pattern)):
        literals = "".join("\0" if part is GAP else part for part in form).split("\0")
        found.add(frozenset(text[n : n + 3] for text in literals for n in range(len(text) - 2)))
    if frozenset() in found:
        return []
    return sorted((f for f in found if not any(other < f for other in found)), key=sorted)


def indexed(rules: tuple[Rule, ...]) -> list[str]:
    """The trigrams that the index of some rules holds."""
    return sorted({gram for rule in rules for form in trigram_query(rule.pattern) for gram in form})


def row_key(df: DataFrame) -> Column:
    """A key of the row. Equal rows share one, and so would a collision; candidates are verified in either case."""
    return row_hash(df)


def postings(df: DataFrame, grams: list[str], text: str = "text") -> DataFrame:
    """The inverted index: gram (its place in `grams`) and row, for each row whose text holds the trigram in any case."""
    lower = F.lower(F.coalesce(F.col(text), F.lit("")))
    held = let(lower, lambda t: F.filter(F.array(*(F.when(F.contains(t, F.lit(g)), F.lit(n)) for n, g in enumerate(grams))), lambda n: n.isNotNull()))
    return df.select(row_key(df).alias("row"), F.explode(held).alias("gram"))


def candidates(index: DataFrame, rules: tuple[Rule, ...], grams: list[str]) -> DataFrame:
    """row and rules, the set of rules (a bit for each) whose trigram query holds after intersecting the postings."""
    place = {gram: n for n, gram in enumerate(grams)}
    words = range(-(-len(grams) // 62))
    together = index.groupBy("row").agg(*(F.coalesce(F.bit_or(F.when(F.floor(F.col("gram") / 62) == w, F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("gram") - 62 * w).cast("int")))), F.lit(0).cast("long")).alias(f"w{w}") for w in words))
    bits = F.lit(0).cast("long")
    for n, rule in enumerate(rules):
        holds = F.lit(False)
        for form in trigram_query(rule.pattern):
            masks = [sum(1 << (place[g] - 62 * w) for g in form if place[g] // 62 == w) for w in words]
            all_held = F.lit(True)
            for w, mask in enumerate(masks):
                all_held = all_held & (F.col(f"w{w}").bitwiseAND(F.lit(mask).cast("long")) == mask)
            holds = holds | all_held
        bits = bits.bitwiseOR(F.when(holds, F.lit(1 << n).cast("long")).otherwise(F.lit(0).cast("long")))
    return together.select("row", bits.alias("rules")).where("rules <> 0")


def _span(kind: int, start: Column, end: Column) -> Column:
    return F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"))


SPANS = "array<struct<start:bigint,kind:int,end:bigint>>"


def matches(text: Column, rule: Rule, kind: int) -> Column:
    """Spans of a rule in a text. Texts are split at the matches only where there are any."""
    pattern = ("(?i)" if rule.any_case else "") + rule.pattern

    def spans(hits: Column) -> Column:
        def placed(pieces: Column) -> Column:
            steps = F.transform(hits, lambda hit, n: (F.length(F.get(pieces, n)) + F.length(hit)).cast("long"))
            ends = running(steps, lambda a, b: a + b, F.lit(0).cast("long"))
            found = let(ends, lambda end: F.transform(hits, lambda hit, n: F.struct(_span(kind, F.get(end, n) - F.length(hit), F.get(end, n)).alias("span"), hit.alias("hit"))))
            fit = F.filter(found, lambda f: F.length(F.regexp_extract(f["hit"], pattern, rule.group)) >= rule.least)
            return F.transform(fit, lambda f: f["span"])

        return F.when(F.size(hits) > 0, let(F.split(text, pattern, -1), placed)).otherwise(F.array().cast(SPANS))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), spans)


def find_secrets(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Adds `spans` to every row: start, kind (place in `rules`) and end of each match, by start, then kind.

    Null texts are empty and have no spans; equal rows have equal spans. A column called spans is
    replaced, others stay; an empty table stays empty. Rules without mandatory trigrams search all
    texts; the others only those that the index leaves, whose set is stored and joined by row. Texts
    move at most once for that, and not at all where the set is small enough to be broadcast.
    """
    grams = indexed(rules)
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = df.drop("spans")
    if grams:
        left = stored(candidates(postings(rows, grams, text), rules, grams), "candidates", rows.count()).withColumnsRenamed({"row": "__row", "rules": "__rules"})
        rows = rows.withColumn("__row", row_key(rows)).join(left, "__row", "left")
    else:
        rows = rows.withColumns({"__row": F.lit(0), "__rules": F.lit(None).cast("long")})
    none = F.array().cast(SPANS)
    found = []
    for n, rule in enumerate(rules):
        spans = matches(whole, rule, n)
        asked = F.coalesce(F.col("__rules").bitwiseAND(F.lit(1 << n).cast("long")), F.lit(0).cast("long")) != 0
        found.append(F.when(asked, spans).otherwise(none) if trigram_query(rule.pattern) else spans)
    return rows.withColumn("spans", F.array_sort(F.concat(*found))).drop("__row", "__rules")


def of_kind(kind: int, span: Column) -> Column:
    return span["kind"] == kind


def described(spans: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """kind:start:end of each span, joined by commas."""
    kinds = F.array(*(F.lit(rule.kind) for rule in rules))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column, mask: str = "[SECRET]") -> Column:
    """The text with each run of overlapping spans replaced by the mask. Null stays null."""

    def rebuilt(seen: Column) -> Column:
        before = F.transform(spans, lambda s, n: F.when(n == 0, F.lit(0).cast("long")).otherwise(F.get(seen, n - 1)))
        parts = F.transform(F.arrays_zip(spans.alias("span"), before.alias("done")), lambda z: F.when(z["span"]["start"] >= z["done"], F.concat(F.substring(text, (z["done"] + 1).cast("int"), (z["span"]["start"] - z["done"]).cast("int")), F.lit(mask))).otherwise(F.lit("")))
        rest = F.substring(text, (F.element_at(seen, -1) + 1).cast("int"), F.length(text))
        return F.concat(F.array_join(parts, ""), rest)

    ends = F.transform(spans, lambda s: s["end"])
    return F.when(F.size(spans) > 0, let(running(ends, lambda a, b: F.greatest(a, b), F.lit(0).cast("long")), rebuilt)).otherwise(text)
