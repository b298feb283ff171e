"""Words and tokens compared over Arrow batches give what the column functions give."""

import random
import time

import pyarrow as pa
from pyspark.sql import functions as F

from docaudit import fixed as fx
from docaudit.functions import arrays as aa
from docaudit.functions import marks as mk
from docaudit.functions import text as tx
from docaudit.operators import candidates as cd
from docaudit.operators import evidence as ev
from docaudit.operators import logic as lo

PIECES = [
    "a", "B7", "I", "x", "the", "We Show", "always", "all\u0130", "all\u212a", "if", "if\u017f", "f\u0130x", "FIX", "fix_", "éall", "vs.", "THAN", "3", "\u0663",
    "従来", "比較", "の", "漢字", "ーー", "\u303f", "\u3040", "龯龰", "😀ab", "Ωmega", " ", "  ", "\t", "\u00a0", "\u3000", "\n", "\r\n", ".", "!", "\u3002", "_", "-",
]
LISTS = pa.list_(pa.string())


def texts(seed, n):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(PIECES) for _ in range(rnd.choice([0, 1, 2, 5, 12]))) for _ in range(n)] + ["".join(PIECES), " " * 9, "\u3000x"]


def test_text_tokens_equal_the_column_function(spark, value):
    given = texts(1, 1500)
    tokens, place = ev.text_tokens(pa.array(["before", *given, None], pa.string()).slice(1))
    got = [[] for _ in given]
    for token, n in zip(tokens.to_pylist(), place):
        got[n].append(token.decode())
    assert got == value(tx.tokens, given)


def test_marks_equal_the_column_function(value, spark):
    given = texts(2, 1500)
    groups = [fx.CLAIM_PATTERNS, fx.VAGUE, fx.ABSOLUTE, fx.COMPARATIVE, fx.COMPARATOR, fx.CONDITION, [fx.CONDITION_CUE], ["[0-9]"]]
    df = spark.createDataFrame([(0, given), (1, None), (2, [None, "always"])], "i int, t array<string>")
    for folded in (False, True):
        rows = df.orderBy("i").select(mk.marks(F.col("t"), groups, folded)).collect()
        assert rows[1][0] is None and rows[2][0] == [None, 4]
        for n, group in enumerate(groups):
            want = value(lambda c: tx.matches_any(F.lower(c) if folded else c, group), given)  # noqa: B023
            assert [bool(m >> n & 1) for m in rows[0][0]] == want, (folded, group)


def test_logic_rows_equal_the_claim_table(spark):
    given = texts(3, 300)
    claims = spark.createDataFrame([(1, i + 1, f"claim_{i + 1}", t) for i, t in enumerate(given)], "doc_id int, ord int, claim_id string, text string")
    rows = spark.createDataFrame([(1, [(f"claim_{i + 1}", t) for i, t in enumerate(given)])], "doc_id int, claims array<struct<claim_id:string,text:string>>")
    names = ["ord", "claim_id", "text", "rules", "reason", "severity"]
    got = lo.logic_rows(rows).select("*", F.inline("logic")).select(names).collect()
    assert got == lo.inspect_logic(claims).select(names).orderBy("ord").collect() and len(got) > 100


def test_quality_in_batches_equals_the_column_function(spark):
    rnd, given = random.Random(4), texts(4, 400)
    ids = ["p1", "p2", "p2", "p3", None]
    data = [
        (d, [(rnd.choice(ids), None, rnd.choice([*given, None])) for _ in range(rnd.randrange(5))], [(rnd.choice(given), rnd.choice([[], ["p2"], ["p3", "p1"], ["none"]])) for _ in range(rnd.randrange(5))])
        for d in range(150)
    ]
    df = spark.createDataFrame(data, "doc_id int, paragraphs array<struct<para_id:string,section_id:string,text:string>>, claims array<struct<text:string,para_ids:array<string>>>")
    plain = df.withColumn("q", cd.quality_of(F.col("claims"), F.col("paragraphs")))
    assert cd.with_quality(df, "claims", "q").orderBy("doc_id").select("q").collect() == plain.orderBy("doc_id").select("q").collect()


def test_runs_of_rows_give_the_same_scores(monkeypatch):
    rnd, given = random.Random(5), texts(5, 60)
    claims, paras = ([[rnd.choice(given) for _ in range(rnd.randrange(4))] for _ in range(40)] + [None] for _ in range(2))
    arrays = [pa.array(x, LISTS) for x in (claims, paras)]
    whole = ev.score_texts(*arrays).to_pylist()
    assert [len(x) for x in whole] == [len(c or []) for c in claims] and ev.score_texts(*(a.slice(0, 0) for a in arrays)).to_pylist() == []
    for at_once in (0, 200):
        monkeypatch.setattr(ev, "TEXT_AT_ONCE", at_once)
        assert ev.score_texts(*arrays).to_pylist() == whole
        sizes = []
        ev.in_runs(lambda a, b: sizes.append(len(a)) or a, arrays)
        assert sum(sizes) == 41 and max(sizes) < 41


def test_sentence_of_a_text_with_odd_white_space(value):
    given = texts(6, 800)
    whole = lambda c: F.btrim(F.regexp_replace(F.translate(c, fx.WS_CHARS, " " * len(fx.WS_CHARS)), " {2,}", " "))
    assert value(tx.collapse, given) == value(whole, given)
    assert value(tx.js_trim, given) == value(lambda c: F.btrim(c, F.lit(fx.WS_CHARS)), given)

    def sentence(c):
        first = F.regexp_extract(whole(c), "^[。.!? ]*([^。.!?]+)", 1)
        return F.btrim(F.when(first != "", first).otherwise(whole(c)), F.lit(fx.WS_CHARS))

    assert value(tx.claim_text, given) == value(sentence, given)


def test_distinct_structs_of_a_long_array_are_not_compared_in_pairs(spark):
    df = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(60_000)), lambda i: F.struct(i.cast("string").alias("a"), F.lit("b").alias("b"))).alias("x"))
    started = time.time()
    assert df.select(F.size(aa.first_of_each(F.col("x"), lambda r: r))).first()[0] == 60_000
    assert time.time() - started < 20


def test_severity_rank(value):
    assert value(tx.severity_rank, ["LOW", "MEDIUM", "HIGH", "high", None]) == [1, 2, 3, 0, None]
