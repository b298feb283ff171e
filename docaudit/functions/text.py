"""Text functions as native column expressions (no Python UDF)."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from docaudit import fixed as fx

# Class bodies of JavaScript white space for each regex engine.
_WS_JAVA = r"\t\n\x0B\f\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
_WS_RE2 = (
    r"\t\n\x0B\f\r \x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}"
)
WS = f"[{_WS_JAVA}]"
WS_IN_LINE = "[" + _WS_JAVA.replace(r"\n", "") + "]"
NOT_WS = f"[^{_WS_JAVA}]"
# Java's \b knows Unicode letters; the rules need ASCII word boundaries.
BOUNDARY = "(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"


def spark_regex(pattern: str, ignore_case: bool = False) -> str:
    """JavaScript pattern -> Java pattern (``\\s``, ``\\b`` and a closing ``$``)."""
    out = re.sub(r"\\(.)", lambda m: {"s": WS, "b": BOUNDARY}.get(m[1], m[0]), pattern)
    out = re.sub(r"(?<!\\)\$", r"\\z", out)
    return ("(?i)" if ignore_case else "") + out


def duck_regex(pattern: str, ignore_case: bool = False) -> str:
    """JavaScript pattern -> RE2 pattern, for the SQL used in checks."""
    out = re.sub(r"\\(.)", lambda m: f"[{_WS_RE2}]" if m[1] == "s" else m[0], pattern)
    return ("(?i)" if ignore_case else "") + out


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once.

    The optimizer may move a computed column into the lambda that uses it, where it would
    run once per element; bound to a lambda variable it runs once per row.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def either(test: Column, yes: Column, no: Column) -> Column:
    """``yes`` where the test holds, else ``no``; inside lambdas faster than a ``when`` with one branch."""
    return F.call_function("if", test, yes, no)


def literal_cores(pattern: str) -> list[str] | None:
    """One literal per alternative that any match must contain, or None if there is none.

    Only for flat alternations such as ``\\b(a|b c)\\b``: the leading literal of each.
    """
    body = re.fullmatch(r"(?:\\b)?\((?:\?:)?((?:[^()\\]|\\.)*)\)(?:\\b)?", pattern)
    if not body:
        return None
    heads = [re.match(r"(?:[^\\\[.?*+{$^|]|\\[^A-Za-z])*", part)[0] for part in body[1].split("|")]
    # A quantifier after the literal may make its last character optional.
    cores = []
    for part, head in zip(body[1].split("|"), heads):
        rest = part[len(head):]
        head = head[:-1] if rest[:1] in ("?", "*", "{") else head
        cores.append(head.replace("\\", "").lower())
    return cores if all(cores) else None


# From rare to frequent; a byte search compares a word wherever its first letter occurs.
_RARE_FIRST = "zqxjkvbpygfwmucldrhsnioate "


def rare_tail(word: str) -> str:
    """The end of a word, of four or more letters, that starts with its rarest letter."""
    tails = [word[n:] for n in range(max(1, len(word) - 3))]
    return min(tails, key=lambda t: _RARE_FIRST.find(t[0])) if word.isascii() else word


def has_wide(c: Column) -> Column:
    """Is there a character beyond ASCII?"""
    return F.octet_length(c) > F.length(c)


def _contains_any(lowered: Column, words: list[str]) -> Column:
    """Is any word in the text? Words beyond ASCII are looked for only in texts with such characters."""

    def some(sought: list[str]) -> Column:
        out = lowered.contains(sought[0])
        for w in sought[1:]:
            out = out | lowered.contains(w)
        return out

    narrow, wide = [w for w in words if w.isascii()], [w for w in words if not w.isascii()]
    if not wide:
        return some(narrow)
    beyond = has_wide(lowered) & some(wide)
    return some(narrow) | beyond if narrow else beyond


def matches(c: Column, pattern: str, ignore_case: bool = True) -> Column:
    return matches_any(c, [pattern], ignore_case)


def matches_any(c: Column, patterns: list[str], ignore_case: bool = True, lowered: bool = False) -> Column:
    """Does any pattern occur? One alternation over the text, behind a substring test.

    Byte search for the literals (a rare part of each) is far cheaper than a regex with boundary
    assertions at every position, and most texts hold none of them. ``lowered`` says that the text
    is in lower case already.
    """
    regex = "|".join(spark_regex(p) for p in patterns)
    found = c.rlike(("(?i)" if ignore_case else "") + f"(?:{regex})")
    cores = [literal_cores(p) for p in patterns]
    if not all(cores):
        return found
    words = list(dict.fromkeys(rare_tail(w) for ws in cores for w in ws))
    return (_contains_any(c, words) if lowered else let(F.lower(c), lambda low: _contains_any(low, words))) & found


def first_items(arr: Column | str, limit: int | None) -> Column:
    """The first items of an array, or all of them without a limit."""
    return (F.col(arr) if isinstance(arr, str) else arr) if limit is None else F.slice(arr, 1, limit)


def first_chars(c: Column, limit: int | None) -> Column:
    return c if limit is None else F.substring(c, 1, limit)


def left_out(size: Column, limit: int) -> Column:
    """How many items a limit leaves out."""
    return F.greatest(size - limit, F.lit(0))


def js_trim(c: Column) -> Column:
    """White space taken off both ends.

    Trimming a set of characters walks over the whole text, so texts whose first and last bytes are
    visible ASCII are left as they are.
    """
    visible = lambda t, at: F.substring(t.cast("binary"), at, 1).between(F.lit(b"!"), F.lit(b"~"))
    return let(c, lambda t: either(visible(t, 1) & visible(t, -1), t, F.btrim(t, F.lit(fx.WS_CHARS))))


def is_blank(c: Column) -> Column:
    return js_trim(c) == ""


def newlines(c: Column) -> Column:
    """CRLF and lone CR become LF."""
    plain = F.replace(F.replace(c, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    return F.when(c.contains("\r"), plain).otherwise(c)


def spaces(c: Column) -> Column:
    """Runs of blanks and tabs become one blank; ends trimmed."""
    return js_trim(F.regexp_replace(F.replace(c, F.lit("\t"), F.lit(" ")), " {2,}", " "))


def collapse(c: Column) -> Column:
    """Any run of white space becomes one blank; ends trimmed.

    Mapping single characters first leaves only real runs to the regex. Both are slow, and plain
    text needs neither.
    """
    blanks = lambda t: either(t.rlike("[^ -~]"), F.translate(t, fx.WS_CHARS, " " * len(fx.WS_CHARS)), t)
    single = lambda b: either(b.contains("  "), F.regexp_replace(b, " {2,}", " "), b)
    return let(c, lambda t: let(blanks(t), lambda b: F.btrim(single(b))))


def extracted_text(c: Column) -> Column:
    """Newlines normalised, blanks before a line end removed, ends trimmed."""
    return js_trim(F.regexp_replace(newlines(c), "[ \t]+\n", "\n"))


def decode_bytes(c: Column) -> Column:
    """UTF-8 text with invalid bytes replaced; read as Latin-1 instead if it holds a NUL.

    (``decode`` as UTF-8 would fail the job on the first invalid byte.)
    """
    raw = c.cast("string")
    latin = F.decode(c, "ISO-8859-1")
    return F.when(F.instr(raw, "\x00") > 0, latin).otherwise(F.make_valid_utf8(raw))


def seq_id(prefix: str, n: Column) -> Column:
    """``prefix_0001``; numbers above 9999 keep all digits (lpad alone would cut them)."""
    digits = n.cast("string")
    padded = F.when(F.length(digits) < 4, F.lpad(digits, 4, "0")).otherwise(digits)
    return F.concat(F.lit(prefix + "_"), padded)


def paragraph_list(c: Column) -> Column:
    """Blank-line split of a text, pieces trimmed, only pieces longer than two characters."""
    return F.filter(
        F.transform(F.split(newlines(c), "\n{2,}", -1), js_trim), lambda p: F.length(p) > 2
    )


def strip_latex_comments(c: Column) -> Column:
    """Cut every line at its first ``%`` that has no backslash before it."""
    return F.regexp_replace(newlines(c), r"(?<!\\)%[^\n]*", "")


# ---- claims ---------------------------------------------------------------------


def claim_text(c: Column, max_chars: int | None = None) -> Column:
    """First sentence with visible text.

    Sentences end at ``。 . ! ?``, so a decimal point ends one too. Only the sentence is collapsed,
    not all of the text.
    """

    def pick(trimmed: Column) -> Column:
        first = F.regexp_extract(trimmed, f"^[。.!?{_WS_JAVA}]*([^。.!?]+)", 1)
        return let(first, lambda f: either(f != "", f, trimmed))

    return first_chars(collapse(let(js_trim(c), pick)), max_chars)


def headline(c: Column, max_chars: int | None = None) -> Column:
    """The claim text; beyond ``max_chars`` it ends in three dots."""
    if max_chars is None:
        return claim_text(c)
    return let(
        claim_text(c),
        lambda t: F.when(F.length(t) <= max_chars, t).otherwise(
            F.concat(F.substring(t, 1, max_chars - 3), F.lit("..."))
        ),
    )


def looks_like_claim(c: Column) -> Column:
    return matches_any(c, fx.CLAIM_PATTERNS)


def has_digit(c: Column) -> Column:
    return c.rlike("[0-9]")


def has_quantity(c: Column) -> Column:
    return has_digit(c) | let(F.lower(c), lambda low: _contains_any(low, fx.QUANTITATIVE_WORDS))


def claim_key(c: Column) -> Column:
    """Comparison key: lower case, runs of letters, digits, kana and kanji joined by blanks."""
    return F.array_join(regexp_all(F.lower(c), fx.TOKEN_CLASS + "+"), " ")


def tokens(c: Column, stop_words: list[str] | None = None) -> Column:
    """Tokens of two or more characters in text order, repeats kept.

    Extracting the runs is several times faster than blanking out everything else.
    """
    words = regexp_all(F.lower(c), f"{fx.TOKEN_CLASS}{{{fx.MIN_TOKEN_CHARS},}}")
    return F.filter(words, lambda t: ~t.isin(stop_words)) if stop_words else words


def evidence_tokens(c: Column) -> Column:
    return tokens(c, fx.EVIDENCE_STOP_WORDS)


def keywords(c: Column, limit: int | None = None) -> Column:
    default = F.array(*[F.lit(k) for k in fx.DEFAULT_KEYWORDS])
    return let(
        first_items(F.array_distinct(tokens(c, fx.KEYWORD_STOP_WORDS)), limit),
        lambda picked: F.when(F.size(picked) > 0, picked).otherwise(default),
    )


# ---- numbers and formats ------------------------------------------------------------


def two_decimals(c: Column) -> Column:
    return F.floor(c * 100 + 0.5) / 100


def percent(c: Column) -> Column:
    return F.concat(F.floor(F.greatest(F.lit(0.0), c) * 100 + 0.5).cast("string"), F.lit("%"))


def rolling_hash(c: Column) -> Column:
    """``h * 31 + code`` modulo 2**32 over the characters, in base 36."""
    codes = F.transform(F.filter(F.split(c, ""), lambda x: x != ""), lambda x: F.ascii(x).cast("long"))
    total = F.aggregate(codes, F.lit(0).cast("long"), lambda h, x: (h * 31 + x) % F.lit(1 << 32))
    return F.lower(F.conv(total.cast("string"), 10, 36))


def html_escape(c: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c


def regexp_all(c: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(group))


def first_match(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract(text, pattern, group)


def severity_rank(c: Column) -> Column:
    """Place in the list of severities, 0 if it is another one; null for null."""
    place = F.lit(0).cast("long")
    for n, severity in enumerate(fx.SEVERITIES, 1):
        place = either(c == severity, F.lit(n).cast("long"), place)
    return either(c.isNull(), F.lit(None).cast("long"), place)
