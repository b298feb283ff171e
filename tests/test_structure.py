from pyspark.sql import functions as F

from docaudit import fixed as fx
from docaudit.operators import diffs as dd
from docaudit.operators import structure as st


def texts(spark, *rows):
    return spark.createDataFrame(list(enumerate(rows, 1)), "doc_id long, text string")


def paras(df):
    return [
        (r["doc_id"], r["section_id"], r["text"])
        for r in st.paragraph_table(df).orderBy("doc_id", "ord").collect()
    ]


def test_sheet_rows_and_json(spark):
    many = "\n".join(f"row {i}" for i in range(501))
    df = st.sheet_extract(
        texts(spark, " a,1 \r\n\n=SUM(A1)\nsource x", '{"b": [1, 2.0], "a": {}}', "0", '["x"] tail', many)
    )
    got = paras(df)
    by_doc = {d: [t for dd_, _, t in got if dd_ == d] for d in range(1, 6)}
    assert by_doc[1] == ["a,1", "=SUM(A1)", "source x", "SHEET統計: rows=3, paragraphs=3, numeric_rows=1"]
    assert by_doc[2][0] == '{\n  "b": [\n    1,\n    2\n  ],\n  "a": {}\n}'
    assert by_doc[3][0] == "0" and by_doc[4][0] == '["x"] tail'
    assert len([t for t in by_doc[5] if t.startswith("row ")]) == 501
    assert by_doc[5][501].startswith("SHEET統計: rows=501, paragraphs=501, numeric_rows=501")
    first = {d: s for d, s, _ in reversed(got)}
    assert set(first.values()) == {"sec_0001"}
    titles = {(r["doc_id"], r["title"]) for r in st.section_table(df).collect()}
    assert (2, "Sheet JSON") in titles and (1, "Sheet Rows") in titles and (1, "Artifact Signals") in titles
    warnings = {r["doc_id"]: r["warnings"] for r in df.collect()}
    assert warnings[1] == [] and fx.MSG["sheet_no_numbers_warning"] in warnings[4]


def test_doc_headings(spark):
    text = "intro\nmore\n \n# One #\nbody a\n\nbody b\n1.2.3 Deep data\nx\n12  \nafter\n####### no\n# one #\nlast"
    df = st.doc_extract(texts(spark, text, "", "ab"))
    secs = [(r["title"], r["level"]) for r in st.section_table(df).where("doc_id = 1").orderBy("ord").collect()]
    assert secs == [("One #", 1), ("Deep data", 3), ("Artifact Signals", 2)]
    got = [(s, t) for d, s, t in paras(df) if d == 1]
    assert got[:6] == [
        (None, "intro\nmore"), ("sec_0001", "body a"), ("sec_0001", "body b"), ("sec_0002", "x"),
        (None, "after\n####### no"), (None, "last"),
    ]
    # The duplicate heading "one #" was dropped, so its title has no section.
    assert got[6][1] == "DOC統計: sections=2, paragraphs=6"
    assert [t for d, _, t in paras(df) if d == 3][0] == "ab"
    warn = {r["doc_id"]: r["warnings"] for r in df.collect()}
    assert warn[2][0] == fx.MSG["fallback_split"]


DIFF = """# Summary
Text one

Label here:
labelled
diff --git a/src/a.ts b/src/a.ts
--- a/src/a.ts
+++ b/src/a.ts
@@ -1,2 +1,3 @@ head
 ctx
+const f = (x) => x
+// TODO
++++ odd
-expect(x)y

@@ -9 +9 @@
-gone
diff --git a/db/schema.sql b/db/schema.sql
@@ -0,0 +1 @@
+print(a)"""


def test_hunks(spark):
    rows = dd.hunk_table(texts(spark, DIFF, "no diff")).orderBy("ord").collect()
    assert [(r["path"], r["header"]) for r in rows] == [
        ("src/a.ts", "@@ -1,2 +1,3 @@ head"), ("src/a.ts", "@@ -9 +9 @@"), ("db/schema.sql", "@@ -0,0 +1 @@"),
    ]
    assert rows[0]["added"] == ["const f = (x) => x", "// TODO"]
    assert rows[0]["removed"] == ["expect(x)y"] and rows[0]["context"] == ["ctx", "++++ odd"]
    assert rows[1]["summary"] == (
        "Diff Hunk 2: file=src/a.ts | header=@@ -9 +9 @@ | added(0)=(none) | removed(1)=gone | context=(none)"
    )


def test_pr_signals(spark):
    rows = dd.pr_signals(texts(spark, DIFF, "no diff")).orderBy("ord").collect()
    got = [r["text"] for r in rows]
    assert got[0] == "PR統計: files=2, hunks=3, added=3, removed=2"
    assert got[1] == "テスト信号: code_files=1, test_files=0" and rows[1]["warning"] == fx.MSG["pr_no_tests"]
    assert "スキーマ変更ファイル: db/schema.sql" in got
    assert any(t.startswith("リスク信号(todo)") and t.endswith("(count=1)") for t in got)
    # print( needs a word character after the bracket, as does expect(.
    assert any(t.startswith("リスク信号(debug)") for t in got)
    assert "検証削除信号: assertion-like lines removed count=1" in got
    assert got[-1] == "変更関数候補: f"
    assert {r["doc_id"] for r in rows} == {1}


def test_large_diff_threshold(spark):
    def diff(n):
        return "diff --git a/x.md b/x.md\n@@ -1 +1 @@\n" + "\n".join(["+l"] * n)

    rows = dd.pr_signals(texts(spark, diff(1199), diff(1200))).where(F.col("text").startswith("大規模")).collect()
    assert [(r["doc_id"], r["text"]) for r in rows] == [(2, "大規模差分: total_lines=1200")]


def test_pr_extract(spark):
    df = dd.pr_extract(texts(spark, DIFF, "just words here"))
    secs = [r["title"] for r in st.section_table(df).where("doc_id = 1").orderBy("ord").collect()]
    assert secs == ["Summary", "Label here", "Diff Changes", "PR Review Signals"]
    got = [(s, t) for d, s, t in paras(df) if d == 1]
    assert got[0] == ("sec_0001", "Text one") and got[1] == ("sec_0002", "labelled")
    # Added and removed lines after a flushed header still become paragraphs.
    assert got[2][1].startswith("--- a/src/a.ts")
    two = {r["doc_id"]: r for r in df.collect()}[2]
    assert two["warnings"] == [fx.MSG["pr_no_diff"]]
    assert two["sections"][0]["title"] == "PR Overview"


def test_risk_rules_need_ascii_boundaries(spark):
    lines = ["// @ts-ignore", "x@ts-ignore", "it.skip(1)", "xskip(", "TODOS", "AKIA" + "A" * 16, "any thing", "type:  ignore"]
    for rid, _, pattern, ci in fx.DIFF_RISK_RULES:
        df = spark.createDataFrame([(x,) for x in lines], "x string")
        from docaudit.functions import text as tx

        got = [r["x"] for r in df.where(tx.matches(F.col("x"), pattern, ci)).collect()]
        want = {
            "todo": [], "debug": [], "suppress": ["x@ts-ignore", "any thing", "type:  ignore"],
            "skip_test": ["it.skip(1)"], "secret": ["AKIA" + "A" * 16],
        }[rid]
        assert got == want, rid


def test_control_characters_are_plain_text(spark):
    text = "# Head\nfirst \x01 part\nsecond \x02 line\n\nother\x01block"
    row = st.doc_extract(spark.createDataFrame([(1, text)], "doc_id int, text string")).first()
    assert [s["title"] for s in row["sections"]][0] == "Head" and len(row["sections"]) == 2
    assert [p["text"] for p in row["paragraphs"]][:2] == ["first \x01 part\nsecond \x02 line", "other\x01block"]
    diff = "diff --git a/x b/x\n@@ -1 +1 @@\n+a\x02b\n-c\x01d\n"
    hunks = dd.hunk_table(spark.createDataFrame([(1, diff)], "doc_id int, text string")).collect()
    assert [(h["added"], h["removed"]) for h in hunks] == [(["a\x02b"], ["c\x01d"])]


def test_a_heading_at_the_very_start(spark):
    texts = {1: "# A\nx", 2: "x\n# A", 3: "1.2 Num\n\ntext", 4: ""}
    got = {}
    for r in st.doc_blocks(spark.createDataFrame(list(texts.items()), "doc_id int, text string")).collect():
        got[r["doc_id"]] = ([s["title"] for s in r["sections"]], [p["text"] for p in r["paras"]])
    assert got == {1: (["A"], ["x"]), 2: (["A"], ["x"]), 3: (["Num"], ["text"]), 4: ([], [])}


def test_groups_and_running(spark):
    import random

    from docaudit.functions import arrays as aa

    pick = random.Random(3)
    rows = [(i, [pick.choice(["a", "b", None, "dd"]) for _ in range(n)]) for i, n in enumerate([0, 1, 2, 7, 101])]
    df = spark.createDataFrame(rows, "i int, a array<string>")
    sums = aa.running(F.transform("a", lambda x, i: i + 1), lambda p, q: p + q, F.lit(0))
    for r in df.select("a", aa.groups(F.col("a"), lambda x: x).alias("g"), aa.first_of_each(F.col("a"), lambda x: x).alias("f"), sums.alias("s")).collect():
        assert [g["k"] for g in r["g"]] == r["f"] == list(dict.fromkeys(r["a"]))
        assert [len(g["xs"]) for g in r["g"]] == [r["a"].count(k) for k in r["f"]]
        assert r["s"] == [sum(range(i + 2)) for i in range(len(r["a"]))]
