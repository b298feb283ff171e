import random
import re

import pytest
from pyspark.sql import functions as F

from docaudit import fixed as fx
from docaudit.operators import candidates as cd
from docaudit.operators import claims as cl
from docaudit.operators import evidence as ev
from docaudit.operators import logic as lo
from docaudit.operators import risks as rk

PARAS = "array<struct<para_id:string,section_id:string,text:string>>"
CLAIMS = "array<struct<claim_id:string,text:string,para_ids:array<string>>>"


def rows(spark, docs):
    """docs: {doc_id: (paragraph texts, claim texts)} -> rows with paragraphs and claims."""
    data = [
        (
            d,
            [(f"par_{i + 1:04d}", None, t) for i, t in enumerate(ps)],
            [(f"claim_{i + 1}", t, ["par_0001"]) for i, t in enumerate(cs)],
        )
        for d, (ps, cs) in docs.items()
    ]
    return spark.createDataFrame(data, f"doc_id long, paragraphs {PARAS}, claims {CLAIMS}")


def words(t):
    found = re.findall(fx.TOKEN_CLASS + "{2,}", t.lower())
    return [w for w in found if w not in fx.EVIDENCE_STOP_WORDS]


def quantity(t):
    return bool(re.search("[0-9]", t)) or any(w in t.lower() for w in fx.QUANTITATIVE_WORDS)


def brute(paras, claim):
    toks = words(claim)
    score = [
        sum(t in set(words(p)) for t in toks) / len(toks) if toks and words(p) else 0.0 for p in paras
    ]
    top = [i for i in sorted(range(len(paras)), key=lambda i: -score[i]) if score[i] >= 0.18][:3]
    best = max(score, default=0.0)
    seen = {t for i in top for t in words(paras[i])}
    cover = sum(t in seen for t in toks) / len(toks) if toks and top else 0.0
    strong = sum(s >= 0.35 for s in score)
    if not top or best < 0.22:
        code = "no_evidence"
    elif cover < 0.3 or strong == 0:
        code = "narrow_evidence"
    elif quantity(claim) and not any(quantity(paras[i]) for i in top):
        code = "numbers_unsupported"
    elif best < 0.58 or len(top) < 2:
        code = "thin_evidence"
    else:
        code = None
    return (
        best, strong, sum(s >= 0.18 for s in score), round(cover, 12), code, [f"par_{i + 1:04d}" for i in top],
    )


@pytest.fixture(scope="module")
def corpus():
    rnd = random.Random(5)
    vocab = [f"w{i:02d}x" for i in range(30)] + ["the", "ab", "研究", "12", "x7"]
    text = lambda n: " ".join(rnd.choice(vocab) for _ in range(n))
    docs = {d: ([text(rnd.randint(1, 14)) for _ in range(rnd.randint(0, 12))],
                [text(rnd.randint(1, 25)) for _ in range(rnd.randint(1, 8))]) for d in range(1, 16)}
    docs[20] = ([], ["claim without any paragraph"])
    docs[21] = (["some text"], ["the . a", "ab ab ab zz"])
    docs[22] = (["alpha beta gamma delta", "alpha beta"], [" ".join(["alpha"] + ["qq%02d" % i for i in range(90)])])
    docs[23] = (["only two words here"] * 4, ["only two words here 55%"])
    # One document with most of all rows.
    docs[24] = ([text(9) for _ in range(120)], [text(12) for _ in range(36)])
    return docs


def test_audit_documents_equals_loop(spark, corpus):
    got = ev.audit_documents(rows(spark, corpus)).collect()
    assert len(got) == sum(len(c) for _, c in corpus.values())
    codes = set()
    for r in got:
        paras, claims = corpus[r["doc_id"]]
        want = brute(paras, claims[r["ord"] - 1])
        have = (r["best_score"], r["strong_count"], r["support_count"], round(r["coverage"], 12), r["code"], r["support_ids"])
        assert have == want, (r["doc_id"], r["claim_id"])
        assert 0 <= r["best_score"] <= 1 and len(r["support_ids"]) <= 3
        codes.add(r["code"])
    assert codes == {None, "no_evidence", "narrow_evidence", "numbers_unsupported", "thin_evidence"}


def test_audit_tables_equals_loop(spark, corpus):
    base = rows(spark, corpus)
    claims = cl.claim_table(base)
    paras = base.select("doc_id", F.posexplode("paragraphs").alias("pos", "p")).select(
        "doc_id", (F.col("pos") + 1).alias("ord"), "p.para_id", "p.text"
    )
    inside = ev.audit_tables(claims, paras, by=["doc_id"]).collect()
    assert len(inside) == sum(len(c) for _, c in corpus.values())
    for r in inside:
        ps, cs = corpus[r["doc_id"]]
        want = brute(ps, cs[r["ord"] - 1])
        ids = [s["para_id"] for s in r["support"]]
        assert (r["best_score"], r["strong_count"], r["support_count"], round(r["coverage"], 12), r["code"], ids) == want

    every = [p for d in sorted(corpus) for p in corpus[d][0]]
    some = claims.where("doc_id in (3, 21)").select((F.col("doc_id") * 100 + F.col("ord")).alias("item"), "text")
    for r in ev.audit_tables(some, paras, key="item").collect():
        want = brute(every, r["text"])
        assert (r["best_score"], r["strong_count"], r["support_count"], r["code"]) == (want[0], want[1], want[2], want[4])


@pytest.mark.parametrize(
    "best,cover,strong,n,cq,pq,want",
    [
        (0.5, 0.5, 1, 0, False, False, "no_evidence"), (0.219, 0.5, 1, 1, False, False, "no_evidence"),
        (0.22, 0.5, 0, 1, False, False, "narrow_evidence"), (0.5, 0.299, 1, 2, False, False, "narrow_evidence"),
        (0.5, 0.3, 1, 2, True, False, "numbers_unsupported"), (0.579, 0.3, 1, 2, True, True, "thin_evidence"),
        (0.58, 0.3, 1, 1, False, False, "thin_evidence"), (0.58, 0.3, 1, 2, False, False, None),
    ],
)
def test_ladder(spark, best, cover, strong, n, cq, pq, want):
    code = ev.finding_code(*[F.lit(v) for v in (best, cover, strong, n, cq, pq)])
    assert spark.range(1).select(code).first()[0] == want


def test_reasons(spark):
    cols = [F.lit("narrow_evidence"), F.lit(0.5), F.lit(0.255), F.lit(0.1)]
    got = spark.range(1).select(ev.evidence_reason(*cols)).first()[0]
    assert "26%" in got and "10%" in got and "{" not in got


def mined(spark, docs, **kw):
    data = [(d, [(f"par_{i + 1:04d}", None, t) for i, t in enumerate(ps)]) for d, ps in docs.items()]
    return cl.mine_claims(spark.createDataFrame(data, f"doc_id long, paragraphs {PARAS}"), **kw)


def test_mining_order_and_caps(spark):
    docs = {
        1: ["plain words only here", "short", "we show a result", "x" * 11, "y" * 12],
        2: ["tiny", "", "a b"],
        3: [f"paragraph number {i}" for i in range(50)],
        4: ["12.5 is cut at the dot but first part is short"],
        5: [],
    }
    got = {d: [] for d in docs}
    for r in cl.claim_table(mined(spark, docs)).orderBy("doc_id", "ord").collect():
        got[r["doc_id"]].append((r["claim_id"], r["text"], r["para_ids"]))
    assert got[1] == [
        ("claim_1", "we show a result", ["par_0003"]), ("claim_2", "plain words only here", ["par_0001"]),
        ("claim_3", "y" * 12, ["par_0005"]),
    ]
    assert [t for _, t, _ in got[2]] == ["tiny", "a b"]
    assert len(got[3]) == 50 and got[4][0][1] == "12" and got[5] == []
    cut = cl.mine_claims(mined(spark, docs).drop("claims"), max_claims=36, min_claims=1).select("doc_id", F.size("claims"), "claims_left_out")
    assert {r[0]: (r[1], r[2]) for r in cut.collect()} == {1: (3, 0), 2: (2, 0), 3: (36, 14), 4: (1, 0), 5: (0, 0)}


def test_nothing_is_cut_by_default(spark):
    """2000 lines, 200 claims and long sentences: every line is a paragraph, every sentence a claim, every pair scored."""
    from docaudit.operators import structure as st

    lines = [f"we show that method number {i} reaches {i} points on set {i % 7} " + "with many more words " * (40 if i == 9 else 1) for i in range(2000)]
    text = "\n".join(lines)
    rows = st.sheet_extract(spark.createDataFrame([(1, text)], "doc_id long, text string"))
    mined_ = cl.mine_claims(rows)
    row = mined_.first()
    body = [p["text"] for p in row["paragraphs"] if p["section_id"] == "sec_0001"]
    assert body == [x.strip() for x in lines] and len(row["claims"]) == len(row["paragraphs"])
    assert max(len(c["text"]) for c in row["claims"]) > 280
    audit = ev.audit_documents(mined_).where("ord <= 200").collect()
    assert len(audit) == 200 and all(r["best_score"] == 1.0 for r in audit)
    segments = cd.segments(rows, size=12, overlap=3).first()["segments"]
    assert {p["para_id"] for s in segments for p in s} == {p["para_id"] for p in row["paragraphs"]}
    merged = cd.segments(rows, size=12, overlap=3, limit=6).first()["segments"]
    assert len(merged) <= 6 and {p["para_id"] for s in merged for p in s} == {p["para_id"] for p in row["paragraphs"]}
    left = st.sheet_extract(spark.createDataFrame([(1, text)], "doc_id long, text string"), max_rows=500).first()
    assert left["rows_left_out"] == 1500


def test_claims_beyond_124_tokens(spark):
    """A claim of 150 distinct tokens with an equal paragraph is fully supported."""
    text = " ".join(f"token{i}" for i in range(150))
    row = ev.audit_documents(rows(spark, {1: ([text], [text])})).first()
    assert (row["best_score"], row["coverage"], row["avg_score"]) == (1.0, 1.0, 1.0)


def test_one_token_in_every_paragraph(spark):
    """A token that all paragraphs share carries no candidate where the claim has rarer ones."""
    paras = spark.range(3000).select((F.col("id") % 50).alias("doc_id"), F.col("id").alias("ord"), F.concat(F.lit("p"), "id").alias("para_id"), F.concat(F.lit("common filler"), "id", F.lit(" word"), (F.col("id") % 9)).alias("text"))
    claims = spark.createDataFrame([(1, "common filler7 alpha beta gamma delta"), (2, "common"), (3, "nothing shared here"), (4, "common alpha beta gamma delta epsilon zeta eta")], "claim_id long, text string")
    tokens = ev.claim_token_table(claims, "claim_id", [])
    places = paras.select(F.explode(F.split("text", " ")).alias("token"))
    ranked = ev.split_by_rarity(tokens, places.groupBy("token").agg(F.count("*").alias("df")), ["claim_id"])
    last = {(r["claim_id"], r["token"]) for r in ranked.where("last").collect()}
    assert last == {(1, "common"), (4, "common")}
    got = {r["claim_id"]: r for r in ev.audit_tables(claims, paras).collect()}
    assert got[1]["best_score"] == 2 / 6 and got[1]["support_count"] == 1
    assert got[2]["support_count"] == 3000 and got[2]["strong_count"] == 3000
    assert got[3]["best_score"] == 0.0 and got[4]["best_score"] == 1 / 8 and got[4]["support_count"] == 0


def test_logic_rules(spark):
    texts = {
        1: ("The method always works under all conditions when tested with a longer text", None),
        2: ("The method always works", "HIGH"),
        3: ("A significant effect if the weather is fine and the road is dry enough", "MEDIUM"),
        4: ("It is better in 10 cases", "MEDIUM"),
        5: ("It is better than 10 cases", None),
        6: ("short if text", "LOW"),
        7: ("x" * 45 + " versus", None),
        8: ("éall of it is fine for me and it has 3 numbers", "HIGH"),
    }
    df = spark.createDataFrame([(1, i, f"c{i}", t) for i, (t, _) in texts.items()], "doc_id int, ord int, claim_id string, text string")
    got = {r["ord"]: r["severity"] for r in lo.inspect_logic(df).collect()}
    want = {i: s for i, (_, s) in texts.items() if s}
    want.pop(8)  # "for" is a condition
    assert got == want
    with_domain = df.withColumn("domain", F.when(F.col("ord") == 2, "nlp"))
    q = {r["ord"]: r["query"] for r in lo.prior_art_queries(with_domain, "domain").collect()}
    assert q[2] == "nlp method always works" and q[6] == "short if text"


def test_top_risks(spark):
    evidence = "array<struct<ord:int,claim_id:string,text:string,severity:string,code:string,best_score:double,avg_score:double,coverage:double,para_ids:array<string>>>"
    logic = "array<struct<ord:int,claim_id:string,text:string,rules:string,reason:string,severity:string>>"
    findings = "array<struct<kind:string,severity:string,message:string,figure_ids:array<string>,paragraph_ids:array<string>,citation_keys:array<string>>>"
    rows_ = spark.createDataFrame(
        [
            (
                1,
                [(1, "claim_1", "same text here", "LOW", "thin_evidence", 0.5, 0.4, 0.9, ["p"]), (2, "claim_2", "same text here", "LOW", "thin_evidence", 0.5, 0.4, 0.9, ["q"]),
                 (3, "claim_3", "", "HIGH", "no_evidence", 0.0, 0.0, 0.0, []), (4, "claim_4", "fine", None, None, 1.0, 1.0, 1.0, ["r"])],
                [(2, "claim_2", "same text here", "x", "r", "MEDIUM")],
                [("UNCITED_BIB_ENTRY", "warning", "m", None, None, ["k"]), ("MISSING_BIB_ENTRY", "error", "m2", None, ["p"], ["k"])],
            ),
            (2, [], [], []),
        ],
        f"doc_id int, audit {evidence}, logic {logic}, findings {findings}",
    )
    full = rk.risk_rows(rows_)
    top = rk.risk_table(full)
    assert [(r["severity"], r["title"]) for r in top.orderBy("rank").collect()] == [
        ("HIGH", "根拠不足: claim_3"), ("HIGH", "参考文献エントリ欠落"), ("MEDIUM", "論理の曖昧さ: same text here"),
        ("MEDIUM", "未引用の参考文献"), ("LOW", "根拠不足: same text here"),
    ]
    assert [(r["rank"], r["left_out"]) for r in rk.risk_table(full, 2).collect()] == [(1, 3), (2, 3)]
    counts = rk.ref_counts(top).orderBy("rank").select("n_claims", "n_paragraphs", "n_citations").collect()
    assert [tuple(c) for c in counts][:2] == [(1, 0, 0), (0, 1, 1)]
    # Documents without any risk have zeros, not no row.
    assert [tuple(r) for r in rk.severity_histogram(full).orderBy("doc_id").collect()] == [(1, 2, 2, 1), (2, 0, 0, 0)]
    # LOW logic risks count as weak evidence; rows are counted, not claims.
    low = rows_.withColumn("logic", F.transform("logic", lambda x: x.withField("severity", F.lit("LOW"))))
    assert [tuple(r) for r in rk.signal_counts(rk.risk_rows(low)).orderBy("doc_id").collect()] == [(1, 1, 3, 0), (2, 0, 0, 0)]


def test_quality_gate_needs_both(spark):
    data = [("PR", 6, 150), ("PR", 6, 149), ("PR", 5, 300), ("odd", 8, 313), ("odd", 8, 312), ("DOC", 6, 200)]
    df = spark.createDataFrame(
        [(i, k, [("p", None, "x" * size)] * n) for i, (k, n, size) in enumerate(data)],
        f"doc_id long, artifact_type string, paragraphs {PARAS}",
    )
    got = [r["passed"] for r in rk.quality_gate(df).orderBy("doc_id").collect()]
    assert got == [True, False, False, True, False, True]
    good, bad = rk.split_by_gate(df)
    assert {r["doc_id"] for r in good.collect()} == {0, 3, 5} and bad.count() == 3


# ---- candidates and refinement -------------------------------------------------------------


def test_segments(spark):
    docs = [(1, [(f"par_{i:04d}", "s1" if i < 25 else None, f"paragraph text {i}") for i in range(40)])]
    base = spark.createDataFrame(docs, f"doc_id long, paragraphs {PARAS}")

    def seg(size, overlap, limit=6):
        out = {}
        for r in cd.segment_table(cd.segments(base, size, overlap, limit)).orderBy("segment", "ord").collect():
            out.setdefault(r["segment"], []).append(int(r["para_id"][4:]))
        return list(out.values())

    assert seg(120, 24) == [list(range(25)), list(range(25, 40))]
    assert seg(10, 2) == [list(range(0, 10)), list(range(8, 18)), list(range(16, 25)), list(range(25, 35)), list(range(33, 40))]
    merged = seg(10, 2, 2)
    assert len(merged) == 2 and sorted({i for m in merged for i in m}) == list(range(40)) and merged[0] == list(range(25))


def test_candidates(spark):
    base = mined(spark, {1: ["first paragraph text", "second paragraph text"]})
    raw = (
        '{"claims":[{"claimId":"a","text":"We show a 5 percent gain. More","paragraphIds":["par_0002","nope"]},'
        '{"claimId":"b","text":"tiny","paragraphIds":[]},'
        '{"claimId":"c","text":"we show a 5 PERCENT gain!","paragraphIds":["nope"],"confidence":"low"}]}'
    )
    outputs = spark.createDataFrame(
        [(1, 1, 14, raw), (1, 2, 14, "broken")], "doc_id long, segment int, max_claims int, raw_json string"
    )
    rows_, warnings = cd.output_claims(outputs)
    assert rows_.count() == 3 and [r["warning"] for r in warnings.collect()] == ["claim extraction segment 2 failed"]
    resolved = cd.resolve_candidates(cd.with_answers(base, outputs))
    assert [(r["text"], r["para_ids"], r["score"]) for r in resolved.first()["candidates"]] == [
        ("We show a 5 percent gain", ["par_0002"], 3.7), ("we show a 5 PERCENT gain", ["par_0001"], 3.7),
    ]
    best = cd.rank_candidates(cd.dedupe_best(resolved)).first()["candidates"]
    assert [r["text"] for r in best] == ["We show a 5 percent gain"]
    row = cd.mine_with_model(base, outputs).first()
    assert row["claims"][0]["text"] == "We show a 5 percent gain" and row["claim_warnings"][0] == "claim extraction segment 2 failed"
    one = spark.createDataFrame([(1, 1, 1, raw)], outputs.schema)
    assert cd.output_claims(one)[0].count() == 3 and cd.output_claims(one, enforce=True)[0].count() == 1
    assert [r["warning"] for r in cd.output_claims(one, enforce=True)[1].collect()] == ["claim extraction segment 1: 2 claims left out"]
    # a document without an answer keeps its rule-based claims
    two = mined(spark, {1: ["first paragraph text"], 2: ["second paragraph text"], 3: []})
    got = {r["doc_id"]: r for r in cd.mine_with_model(two, outputs).collect()}
    assert [c["text"] for c in got[2]["claims"]] == ["second paragraph text"] and got[3]["claims"] == []
    assert got[3]["claim_warnings"] == [fx.MSG["no_claims"]] and got[3]["refine"]["iterations"] == 0


def brute_refine(initial, fallback, paras, quality):
    """Two rounds on plain lists; quality(claim) -> (score, number of issues)."""
    key = lambda c: " ".join(re.findall(fx.TOKEN_CLASS + "+", c[0].lower()))
    pool, seen = [], set()
    for c in initial + fallback:
        if key(c) and key(c) not in seen:
            seen.add(key(c))
            pool.append(c)
    now, done, replaced, told = list(initial), 0, 0, []
    for number in (1, 2):
        done = number
        q = [quality(c) for c in now]
        bad = {i for i, (s, n) in enumerate(q) if s < 2.2 or n >= 2}
        groups = {}
        for i, c in enumerate(now):
            groups.setdefault(key(c), []).append(i)
        for g in groups.values():
            bad |= set(sorted(g, key=lambda i: -q[i][0])[1:])
        if not bad:
            break
        kept = [c for i, c in enumerate(now) if i not in bad]
        used = {key(c) for c in kept}
        ranked = sorted((c for c in pool if key(c) not in used), key=lambda c: -quality(c)[0])[: len(bad)]
        if not ranked:
            told.append(fx.MSG["refiner_empty"].replace("{n}", str(number)))
            break
        replaced += len(ranked)
        now = kept + ranked
    weak = sum(s < 2.2 or n >= 2 for s, n in map(quality, now))
    return [c[0] for c in now], (done, replaced, weak, told)


def test_refine_equals_loop(spark):
    rnd = random.Random(3)
    starts = ["we show", "plain", "because of", "retry if", "", "1"]
    docs, init = {}, []
    for d in range(1, 13):
        paras = [f"{rnd.choice(starts)} {rnd.choice(['alpha beta gamma delta', 'omega', 'long words here too'])} {rnd.choice(['', '7', 'x'])}" for _ in range(9)]
        docs[d] = paras
        for i in range(rnd.randint(1, 9)):
            t = rnd.choice(paras + ["own claim text 9 if better", "Own claim TEXT 9 if better", "!!"])
            init.append((d, i + 1, t, [f"par_{rnd.randint(1, 9):04d}"]))
    base = mined(spark, docs)
    entries = {}
    for d, _, t, p in init:
        entries.setdefault(d, []).append((t, p))
    own = spark.createDataFrame(list(entries.items()), "doc_id long, initial array<struct<text:string,para_ids:array<string>>>")
    rows_ = base.join(own, "doc_id")
    q = {}
    for name in ("initial", "claims"):
        for r in rows_.select("doc_id", F.inline(cd.quality_of(F.col(name), F.col("paragraphs")))).collect():
            q[(r["doc_id"], r["text"], tuple(r["para_ids"]))] = (r["quality"], len(r["issues"]))
    for r in cd.refine_claims(rows_, "initial").collect():
        d = r["doc_id"]
        fallback = [(c["text"], tuple(c["para_ids"])) for c in base.where(F.col("doc_id") == d).first()["claims"]]
        want, report = brute_refine([(t, tuple(p)) for t, p in entries[d]], fallback, docs[d], lambda c, d=d: q[(d, c[0], c[1])])
        assert [c["text"] for c in r["claims"]] == want, d
        assert tuple(r["refine"]) == report, d


def test_refinement_without_any_replacement(spark):
    good = "we show that 5 of 7 methods are faster than others if tested"
    base = mined(spark, {1: [good, good.upper()], 2: [good], 3: []})
    got = {r["doc_id"]: (r["refine"], [c["text"] for c in r["claims"]]) for r in cd.refine_claims(base).collect()}
    told = fx.MSG["refiner_empty"].replace("{n}", "1")
    assert tuple(got[1][0])[:2] == (1, 0) and got[1][0]["warnings"] == [told] and len(got[1][1]) == 2
    assert tuple(got[2][0]) == (1, 0, 0, []) and got[2][1] == [good]
    assert tuple(got[3][0]) == (0, 0, 0, [fx.MSG["no_claims"]])


def test_quality_points(spark):
    base = mined(spark, {1: ["we show that 5 cars are faster if tested well", "other"]})
    rows_ = [
        (1, "we show that 5 cars are faster if tested", ["par_0001"]), (1, "hm", []), (1, "cars and boats and trains go", ["par_0002"]),
        (1, "we show that 5 cars are", ["par_0099"]),
    ]
    given = spark.createDataFrame([(1, [r[1:] for r in rows_])], "doc_id long, given array<struct<text:string,para_ids:array<string>>>")
    judged = base.join(given, "doc_id").select(F.inline(cd.quality_of(F.col("given"), F.col("paragraphs"))))
    got = {r["text"]: (r["quality"], r["issues"]) for r in judged.collect()}
    assert got[rows_[0][1]] == (5.1, [])
    assert got["hm"] == (0.0, ["too_short", "not_claim_like", "no_number", "no_condition_or_comparator", "no_paragraph_ref"])
    assert got[rows_[2][1]] == (1.6, ["not_claim_like", "no_number", "no_condition_or_comparator", "low_source_overlap"])
    assert got[rows_[3][1]][0] == 3.4


def test_model_hook(spark):
    base = mined(spark, {1: ["first paragraph text", "second paragraph text"]})
    prompts = cd.claim_prompts(cd.segments(base))
    answer = '{"claims":[{"claimId":"a","text":"We show that it works","paragraphIds":["par_0001"]}]}'

    def transport(batch):
        return [answer if "[par_0001] first paragraph text" in p else None for p in batch]

    row = cd.mine_with_model(base, cd.run_model(prompts, transport)).first()
    assert row["claims"][0]["text"] == "We show that it works" and row["claim_warnings"] == []


def test_best_of_claims_without_support(spark):
    """Long claims of which no paragraph holds enough: the best count is exact, hot tokens aren't met in vain."""
    import random

    rnd = random.Random(8)
    common = [f"common{i}" for i in range(6)]
    paras = [(n % 40, n, f"p{n}", " ".join(["everywhere"] + rnd.sample(common, 3) + rnd.sample([f"rare{i}" for i in range(300)], 3))) for n in range(600)]
    claims = [(n, " ".join(["everywhere"] + rnd.sample(common, 4) + rnd.sample([f"rare{i}" for i in range(300)], 2) + [f"own{n}x{i}" for i in range(40)])) for n in range(30)]
    claims += [(100, "everywhere " + " ".join(f"absent{i}" for i in range(20))), (101, " ".join(common + [f"none{i}" for i in range(60)])), (102, "everywhere everywhere everywhere " + " ".join(f"gone{i}" for i in range(30)))]
    table = spark.createDataFrame(paras, "doc_id long, ord long, para_id string, text string")
    asked = spark.createDataFrame(claims, "claim_id long, text string")
    got = {r["claim_id"]: r for r in ev.audit_tables(asked, table).collect()}
    held = [set(t.split()) for *_, t in paras]
    for claim, text in claims:
        tokens = text.split()
        counts = [sum(t in h for t in tokens) for h in held]
        assert got[claim]["best_score"] == max(counts) / len(tokens), claim
        assert got[claim]["support_count"] == sum(c / len(tokens) >= 0.18 for c in counts)


def test_unbeaten_leaves_out_what_cannot_beat(spark):
    columns = "claim_id long, token string, cnt long, n int, df long, needed int, sum long, last boolean"
    rows = [(1, "every", 1, 20, 900, 4, 1, True), (1, "many", 1, 20, 500, 4, 2, True), (1, "some", 1, 20, 90, 4, 3, True), (1, "rare", 1, 20, 2, 4, 4, False)]
    ranked = spark.createDataFrame(rows, columns)
    for low, want in ((0, {"every", "many", "some"}), (1, {"many", "some"}), (2, {"some"}), (3, set())):
        known = spark.createDataFrame([(1, low)], "claim_id long, low long")
        assert {r["token"] for r in ev.unbeaten(ranked, known, ["claim_id"]).collect()} == want


def test_score_batch_equals_loop(monkeypatch):
    import random

    import pyarrow as pa

    rnd = random.Random(2)
    words = [f"w{i}" for i in range(12)]
    rows = [([[rnd.choice(words) for _ in range(rnd.randrange(9))] for _ in range(rnd.randrange(5))], [list({rnd.choice(words) for _ in range(rnd.randrange(6))}) for _ in range(rnd.randrange(6))]) for _ in range(60)]
    rows += [(None, [["w1"]]), ([["w1"]], None), ([], []), ([["w1", "none"]], [["w1"], ["w1"], ["w2"], ["w1"], ["w1"]])]
    kind = pa.list_(pa.list_(pa.string()))
    for at_once in (1, 50, 10**6):
        monkeypatch.setattr(ev, "PAIRS_AT_ONCE", at_once)
        found = ev.score_batch(pa.array([r[0] for r in rows], kind), pa.array([r[1] for r in rows], kind)).to_pylist()
        for (claims, paras), scores in zip(rows, found):
            assert len(scores) == len(claims or [])
            for tokens, got in zip(claims or [], scores):
                each = [sum(t in p for t in tokens) / len(tokens) if tokens else 0.0 for p in paras or []]
                top = sorted((i for i, x in enumerate(each) if x >= 0.18), key=lambda i: -each[i])
                assert got["places"] == top[:3] and got["support_scores"] == [each[i] for i in top[:3]]
                total = 0.0
                for i in top[:3]:
                    total += each[i]
                held = set().union(*((paras or [])[i] for i in top[:3]))
                cover = sum(t in held for t in tokens) / len(tokens) if top else 0.0
                assert (got["best_score"], got["support_count"], got["strong_count"]) == (max(each, default=0.0), len(top), sum(x >= 0.35 for x in each))
                assert (got["avg_score"], got["coverage"]) == (total / len(top[:3]) if top else 0.0, cover)


def test_failing_calls_end_nothing(spark):
    df = spark.createDataFrame([(n, f"prompt {n}") for n in range(9)], "doc_id long, prompt string")

    def transport(batch):
        if any(p.endswith(("3", "7")) for p in batch):
            raise RuntimeError("down")
        return [p.upper() for p in batch]

    got = {r["doc_id"]: (r["raw_json"], r["model_error"]) for r in cd.run_model(df, transport).collect()}
    assert got == {n: (None, "RuntimeError: down") if n in (3, 7) else (f"PROMPT {n}", None) for n in range(9)}
    short = cd.run_model(df.coalesce(1), lambda batch: ["one"]).collect()
    assert all(r["raw_json"] == "one" for r in short)  # sent one by one, each has its answer
    warned = cd.run_model(df.coalesce(1), lambda batch: []).collect()
    assert all(r["raw_json"] is None and r["model_error"].startswith("ValueError") for r in warned)


def test_few_claims_meet_hot_tokens_where_they_are(spark, monkeypatch):
    """With few claim tokens none is dealt in parts; with many, hot ones are. Both give the same rows."""
    claims = spark.createDataFrame([(1, "alpha beta gamma delta"), (2, "beta epsilon 5 ms"), (3, "nothing shared")], "item_id long, text string")
    rows = [(d, 1, "par_0001", f"alpha beta {'gamma' if d % 2 else 'epsilon'} word{d}") for d in range(20)]
    paras = spark.createDataFrame(rows, "doc_id long, ord int, para_id string, text string")
    monkeypatch.setattr(ev, "HOT_ROWS", 3)
    found = []
    for few in (0, 1000):
        monkeypatch.setattr(ev, "FEW_TOKENS", few)
        found.append(sorted(map(tuple, ev.audit_tables(claims, paras, "item_id").collect())))
    assert found[0] == found[1] and len(found[0]) == 3


def test_prompts_go_in_bounded_batches(spark):
    """Long prompts in one partition: each call gets a bounded number of bytes, a longer prompt goes alone."""
    sizes = [100_000] * 120 + [5_000_000, 10, 0]
    df = spark.createDataFrame([(n, "p" * size) for n, size in enumerate(sizes)] + [(-1, None)], "doc_id long, prompt string").coalesce(1)

    def transport(batch):
        return [f"{len(batch)} {sum(len(p or '') for p in batch)}" for _ in batch]

    rows = cd.run_model(df, transport, ["doc_id"])
    assert rows.columns == ["doc_id", "raw_json", "model_error"]
    got = {r["doc_id"]: [int(n) for n in r["raw_json"].split()] for r in rows.collect()}
    assert set(got) == {-1, *range(len(sizes))}
    assert all(held <= cd.PROMPT_BYTES or count == 1 for count, held in got.values())
    assert got[120] == [1, 5_000_000] and max(count for count, _ in got.values()) > 1


def test_prompts_are_sent_once(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, "bad"), (5, None)], "doc_id long, prompt string")
    path, log = str(tmp_path / "answers"), str(tmp_path / "log")

    def noting(fail):
        def transport(batch):
            if fail and "bad" in batch:
                raise OSError("no line")
            with open(log, "a") as file:
                file.writelines(p + "\n" for p in batch)
            return [p * 2 for p in batch]

        return transport

    first = {r["doc_id"]: tuple(r)[2:] for r in cd.ask_once(df, noting(True), path).collect()}
    assert first == {1: ("aa", None, 1), 2: ("bb", None, 1), 3: ("aa", None, 1), 4: (None, "OSError: no line", 1), 5: (None, None, None)}
    more = df.union(spark.createDataFrame([(6, "new")], df.schema))
    second = {r["doc_id"]: tuple(r)[2:] for r in cd.ask_once(more, noting(False), path).collect()}
    assert second[4] == ("badbad", None, 2) and second[6] == ("newnew", None, 1) and second[1] == ("aa", None, 1)
    assert sorted(open(log).read().split()) == ["a", "b", "bad", "new"]


def test_model_claims_are_mined_once(spark, tmp_path):
    """Answers and rule-based claims come from the same stored rows."""
    from docaudit.plans.queries import QUERIES

    lines = "\n".join(f"Our method improves accuracy by {n} percent on the benchmark" for n in range(6))
    rows = [(1, lines, "en", "src1", 10), (2, None, "fr", "src2", None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    df = QUERIES["claims_with_model"](spark, str(tmp_path))
    assert df.where("doc_id = 1").count() >= 6
    assert all("mined-" in path for path in df.inputFiles())
