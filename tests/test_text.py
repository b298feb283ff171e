import re

from hypothesis import given, settings
from hypothesis import strategies as hs
from pyspark.sql import functions as F

from docaudit import fixed as fx
from docaudit.functions import text as tx
from docaudit.operators import candidates as cd


def test_trim_and_spaces(value):
    assert value(tx.js_trim, [" \u00a0a b\u3000\ufeff\n", "\t", "x"]) == ["a b", "", "x"]
    assert value(tx.collapse, ["a \t\r\n b\u3000\u3000c", " \u2028 "]) == ["a b c", ""]
    assert value(tx.spaces, ["a\t\t b \n c "]) == ["a b \n c"]
    assert value(tx.newlines, ["a\r\nb\rc\n"]) == ["a\nb\nc\n"]


def test_paragraph_list(value):
    got = value(tx.paragraph_list, ["one two\r\n\r\n\r\nab\n\n \n\nabc\n \nd\u00a0\u3000"])
    assert got == [["one two", "abc\n \nd"]]


def test_comments(value):
    assert value(tx.strip_latex_comments, ["a%b\n\\% c % d\n%%x\ne"]) == ["a\n\\% c \n\ne"]


def test_claim_text(value):
    got = value(
        tx.claim_text,
        ["Speed is 3.5 times. More", " . ! 。 next one? x", "...", "a" * 300, "線。次", ""],
    )
    assert got == ["Speed is 3", "next one", "...", "a" * 300, "線", ""]
    assert value(lambda c: tx.claim_text(c, fx.CLAIM_MAX_CHARS), ["a" * 300]) == ["a" * 280]


def test_headline(value):
    assert value(tx.headline, ["x" * 64, "x" * 65]) == ["x" * 64, "x" * 65]
    cut = lambda c: tx.headline(c, fx.HEADLINE_CHARS)
    assert value(cut, ["x" * 64, "x" * 65]) == ["x" * 64, "x" * 61 + "..."]


def test_boundaries_are_ascii(value):
    has = lambda c: tx.matches_any(c, fx.ABSOLUTE)
    assert value(has, ["éall", "tall", "all_", "ALL.", "必ず", "every1"]) == [
        True, False, False, True, True, False,
    ]
    doc = lambda c: tx.matches(c, fx.DOC_EVIDENCE_WORD)
    assert value(doc, ["根拠", "a根拠b", "data", "metadata"]) == [False, True, True, False]


def test_prefilter_never_hides_a_match():
    for patterns in (fx.CLAIM_PATTERNS, fx.VAGUE, fx.ABSOLUTE, fx.COMPARATIVE, fx.COMPARATOR, fx.CONDITION):
        for p in patterns:
            for word in tx.literal_cores(p):
                assert word == word.lower() and word
    assert tx.literal_cores(fx.COMPARATOR[0]) == ["than", "versus", "vs", "compared to", "baseline", "prior"]
    assert tx.literal_cores(fx.DOC_DECISION_WORD)[1] == "trade"
    assert tx.literal_cores(fx.QUANTITATIVE) is None
    assert tx.literal_cores(r"\b(?:print\(|a\.b|should\b)\b") == ["print(", "a.b", "should"]
    rules = {rid: tx.literal_cores(p) for rid, _, p, _ in fx.DIFF_RISK_RULES}
    assert rules["debug"] == ["console.log", "print(", "fmt.print", "logger.debug", "system.out.println"]


def test_quantity_equals_pattern(value):
    texts = ["no", "7%", "５", "systems", "F1 score", "BLEU", "p値", "倍", "比", "ＭＳ", "acc"]
    want = [bool(re.search(fx.QUANTITATIVE.replace(r"\d", "[0-9]"), t, re.I | re.A)) for t in texts]
    assert value(tx.has_quantity, texts) == want


def test_tokens(value):
    got = value(tx.evidence_tokens, ["The the a model-based 研究 X9 x9 ため あ", "", "a b c"])
    assert got == [["model", "based", "研究", "x9", "x9"], [], []]
    assert value(tx.claim_key, ["  A-b  研究! c"]) == ["a b 研究 c"]
    assert value(tx.keywords, ["the of"]) == [["of"]]
    assert value(tx.keywords, ["a the"]) == [fx.DEFAULT_KEYWORDS]


def test_ids_and_numbers(spark):
    row = spark.range(1).select(
        tx.seq_id("p", F.lit(7)), tx.seq_id("p", F.lit(12345)), tx.percent(F.lit(0.125)), tx.percent(F.lit(-1.0))
    ).first()
    assert list(row) == ["p_0007", "p_12345", "13%", "0%"]


def test_rolling_hash(value):
    assert value(tx.rolling_hash, ["abc", "本研究", ""]) == ["22ci", "fp4b2", "0"]


@settings(max_examples=8, deadline=None)
@given(hs.lists(hs.text(alphabet="abÄ研 .9\n", max_size=20), min_size=1, max_size=20))
def test_rolling_hash_matches_loop(value, texts):
    def loop(t):
        h = 0
        for ch in t:
            h = (h * 31 + ord(ch)) % 2**32
        out = ""
        while True:
            h, r = divmod(h, 36)
            out = "0123456789abcdefghijklmnopqrstuvwxyz"[r] + out
            if h == 0:
                return out

    assert value(tx.rolling_hash, texts) == [loop(t) for t in texts]


def test_html_escape(value):
    assert value(tx.html_escape, ["<a href=\"x\">&'"]) == ["&lt;a href=&quot;x&quot;&gt;&amp;&#39;"]


def test_json_candidate(value):
    got = value(
        cd.json_candidate,
        ['```json\n{"a":1}\n```', 'text {"a":{}} end', "list [1] end", "plain", "```\n[1]\n```"],
    )
    assert got == ['{"a":1}', '{"a":{}}', "[1]", "plain", "[1]"]


def test_model_schemas(spark):
    claim = '{"claims":[{"claimId":"c","text":"t","paragraphIds":["p"]%s}]}'
    rows = [
        (1, claim % "", True),
        (2, claim % ',"confidence":"high"', True),
        (3, claim % ',"confidence":"sure"', False),
        (4, claim.replace('"t"', '""') % "", False),
        (5, claim.replace('["p"]', '["p",""]') % "", False),
        (6, claim.replace('["p"]', '"p"') % "", False),
        (7, '{"claims":{}}', False),
        (8, '{"claims":[]}', True),
        (9, "nothing", False),
    ]
    df = spark.createDataFrame([(i, r) for i, r, _ in rows], "i int, raw_json string")
    got = {r["i"]: r["valid"] for r in cd.check_output(df, "claims").collect()}
    assert got == {i: ok for i, _, ok in rows}
    ev = '{"evidence":[{"claimId":"c","paragraphIds":[]%s}]}'
    rows = [(1, ev % "", True), (2, ev % ',"figureIds":["f"],"reason":""', True),
            (3, ev % ',"figureIds":null', False), (4, ev % ',"reason":1', False)]
    df = spark.createDataFrame([(i, r) for i, r, _ in rows], "i int, raw_json string")
    got = {r["i"]: r["valid"] for r in cd.check_output(df, "evidence").collect()}
    assert got == {i: ok for i, _, ok in rows}
    oral = '{"question":"q","expectedAnswer":"a","claimId":"c","paragraphIds":[]}'
    df = spark.createDataFrame([(1, oral), (2, oral.replace('"q"', '""'))], "i int, raw_json string")
    assert [r["valid"] for r in cd.check_output(df, "oral").orderBy("i").collect()] == [True, False]
