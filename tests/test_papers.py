import random
from pyspark.sql import functions as F

from docaudit.operators import archive as ar
from docaudit.operators import latex as lx
from docaudit.operators import preflight as pf
from docaudit.operators import structure as st

SOURCE = r"""Before any section.

\section{ Intro  duction }
First text \cite{a,b} and \citep{a}.
Second line.

\begin{figure}
\caption{A  chart}
\label{fig:One}
\end{figure}

Text with \ref{ FIG:one } and Figure 2, fig. 1.

\begin{figure}\end{figure}
\subsection{}
\subsection{Deep}
See \autoref{fig:none} \cite{c}.
\begin{figure*}x\end{figure*}"""


def extract(spark, *sources, bib=("a", "zz", "a")):
    rows = [(i, s, list(bib)) for i, s in enumerate(sources, 1)]
    return lx.latex_extract(spark.createDataFrame(rows, "doc_id long, source string, bib array<string>"))


def test_latex_extract(spark):
    row = extract(spark, SOURCE).first()
    assert [(s["title"], s["level"]) for s in row["sections"]] == [("Intro duction", 1), ("Deep", 2)]
    got = [(p["para_id"], p["section_id"], p["text"]) for p in row["paragraphs"]]
    assert got[0] == ("p_0001", None, "Before any section.")
    assert got[1] == ("p_0002", "sec_0001", "First text \\cite{a,b} and \\citep{a}. Second line.")
    assert got[2][1] == "sec_0001" and got[3][1] == "sec_0002"
    assert [(c["para_id"], c["keys"]) for c in row["cites"]] == [("p_0002", ["a", "b"]), ("p_0004", ["c"])]
    assert [(f["figure_id"], f["label"], f["caption"], f["mentioned_in"]) for f in row["figures"]] == [
        ("fig_0001", "fig:One", "A chart", ["p_0003"]), ("fig_0002", None, None, []),
    ]
    assert row["bib"] == ["a", "zz"]


def test_no_section(spark):
    row = extract(spark, "only text\n\nmore").first()
    assert row["sections"] == [] and [p["section_id"] for p in row["paragraphs"]] == [None, None]


def test_preflight(spark):
    rows = extract(spark, SOURCE, "plain text only")
    checked = pf.preflight_rows(rows)
    got = [
        (r["kind"], r["severity"], r["subject"])
        for r in pf.finding_table(checked).where("doc_id = 1").orderBy("ord").collect()
    ]
    # The mention check ignores case, the definition check does not.
    assert got == [
        ("UNKNOWN_FIGURE_REFERENCE", "error", "FIG:one"),
        ("UNKNOWN_FIGURE_REFERENCE", "error", "fig:none"),
        ("MISSING_BIB_ENTRY", "error", "b"),
        ("MISSING_BIB_ENTRY", "error", "c"),
        ("UNCITED_BIB_ENTRY", "warning", "zz"),
    ]
    counts = {r["doc_id"]: (r["error_count"], r["warning_count"]) for r in pf.finding_summary(checked).collect()}
    assert counts == {1: (4, 1), 2: (0, 2)}


def test_child_table_checks_agree(spark):
    rows = extract(spark, SOURCE, SOURCE.replace("fig:One", "fig:Two") + " Figure 9 and Fig 0")
    found = pf.finding_table(pf.preflight_rows(rows))
    want = {
        (r["doc_id"], r["subject"], tuple(r["paragraph_ids"]))
        for r in found.where("kind in ('MISSING_BIB_ENTRY', 'UNKNOWN_FIGURE_REFERENCE')").collect()
    }
    figures = lx.figure_table(rows)
    refs = rows.select("doc_id", F.posexplode("refs").alias("ord", "r"))
    pick = lambda f, n: refs.select("doc_id", "ord", "r.para_id", F.explode(f"r.{f}").alias(n))
    parts = [
        (pf.missing_citations(lx.cite_table(rows), lx.bib_table(rows)), "key"),
        (pf.unknown_labels(pick("labels", "label"), figures), "label"),
        (pf.unknown_numbers(pick("numbers", "number"), figures), "number"),
    ]
    got = {(r["doc_id"], r[k], tuple(r["para_ids"])) for df, k in parts for r in df.collect()}
    assert got == want
    mentions = lx.attach_mentions(figures, st.paragraph_table(rows))
    a = {(r["doc_id"], r["figure_id"]): r["mentioned_in"] for r in mentions.collect()}
    b = {(r["doc_id"], r["figure_id"]): r["mentioned_in"] for r in figures.collect()}
    assert a == b


def test_asof_over_buckets(spark):
    paras = [(d, p) for d in (1, 2) for p in range(0, 100, 7)]
    secs = [(1, 3, "a"), (1, 21, "b"), (1, 60, "c"), (2, 90, "z")]
    got = lx.asof_section(
        spark.createDataFrame(paras, "doc_id long, start int"),
        spark.createDataFrame(secs, "doc_id long, start int, section_id string"),
        bucket=10,
    ).collect()
    for r in got:
        want = [s for d, at, s in secs if d == r["doc_id"] and at <= r["start"]]
        assert r["section_id"] == (want[-1] if want else None)
    assert len(got) == len(paras)


def members(spark, rows):
    return spark.createDataFrame(
        rows, "archive_id string, ordinal int, path string, size long, unix_mode int, is_dir boolean"
    )


def test_screening(spark):
    f, mb = 0o100644, 1024 * 1024
    rows = [
        ("ok", 1, "a/main.TEX", 1, f, False), ("ok", 2, "a/", 0, 0o40755, True),
        ("link", 1, "x.tex", 1, 0o120777, False),
        ("up", 1, "..\\evil.tex", 1, f, False), ("empty", 1, "///", 1, f, True),
        ("exe", 1, "a.tex", 1, f, False), ("exe", 2, "run.exe", 1, f, False), ("exe", 3, "../x", 1, f, False),
        ("big", 1, "a.tex", 20 * mb + 1, f, False), ("edge", 1, "a.tex", 20 * mb, f, False),
    ]
    rows += [("total", i, f"{i}.png", 20 * mb, f, False) for i in range(11)]
    rows += [("many", i, f"{i}.png", 1, f, False) for i in range(2001)]
    rows += [("most", i, f"{i}.png", 1, f, False) for i in range(2000)]
    got = {r["archive_id"]: (r["rule"], r["path"]) for r in ar.screen_archives(members(spark, rows)).collect()}
    assert got == {
        "ok": (None, None), "edge": (None, None), "most": (None, None),
        "link": ("symlink", "x.tex"), "up": ("unsafe_path", "..\\evil.tex"), "empty": ("unsafe_path", "///"),
        "exe": ("disallowed_extension", "run.exe"), "big": ("file_too_large", "a.tex"),
        "total": ("archive_too_large", "10.png"), "many": ("too_many_files", "2000.png"),
    }


def test_includes(spark):
    rows = [
        ("a", 1, "body.tex", "BODY % c"), ("a", 2, "sub/main.tex", "x \\input{../body} \\include{nope}\\input{part.txt} \\input{../../up} z"),
        ("a", 3, "sub/part.txt", "PART"), ("a", 4, "refs.BIB", "@a{ k1 ,} @b{k2,} @c{k1,}"),
        ("b", 1, "first.tex", "one"), ("b", 2, "main.tex", "two"), ("c", 1, "x.tex", "three"),
    ]
    df = spark.createDataFrame(rows, "archive_id string, ordinal int, path string, text string")
    main = {r["archive_id"]: r["main_path"] for r in lx.main_tex(df).collect()}
    assert main == {"a": "sub/main.tex", "b": "main.tex", "c": "x.tex"}
    source, warnings = lx.expand_includes(df)
    got = {r["archive_id"]: r["source"] for r in source.collect()}
    assert got["a"] == "x \nBODY \n \n\nPART\n \n z" and got["b"] == "two"
    assert sorted(r["warning"] for r in warnings.collect()) == [
        "Included file not found: ../../up", "Included file not found: nope",
    ]
    assert [(r["ord"], r["key"]) for r in lx.bib_keys(df).orderBy("ord").collect()] == [(1, "k1"), (2, "k2")]


def test_file_names(spark):
    df = spark.createDataFrame(
        [("gs://b/raw/s1_my_paper.v2.tex",), ("gs://b/raw/",), ("plain",), ("x/_.pdf",)], "p string"
    )
    name = ar.file_name(F.col("p"))
    got = [tuple(r) for r in df.select(name, ar.title_of(name)).collect()]
    assert got == [
        ("my_paper.v2.tex", "my_paper.v2"), ("uploaded-file", "uploaded-file"), ("plain", "plain"), (".pdf", "Untitled"),
    ]


def test_repeated_and_odd_member_paths(spark):
    rows = [
        (1, 1, "main.tex", "A \\input{body} B \\input{sec/one} C"), (1, 2, "body.tex", "OLD"), (1, 3, "body.tex", "NEW"), (1, 4, "/sec\\one.tex", "ONE"),
        (1, 5, "../x.tex", "never"), (2, 1, "a.bib", "@book{k,}"), (2, 2, "fig.png", None),
        (3, 1, "\\paper\\main.tex", "\\input{two}"), (3, 2, "paper/two.tex", "TWO"),
    ]
    df = spark.createDataFrame(rows, "archive_id int, ordinal int, path string, text string")
    source, warnings = lx.expand_includes(df)
    assert {r["archive_id"]: r["source"].split() for r in source.collect()} == {1: ["A", "NEW", "B", "ONE", "C"], 2: [], 3: ["TWO"]}
    assert [(r["archive_id"], r["warning"]) for r in warnings.collect()] == [(2, "No .tex file found in archive.")]
    assert {r["archive_id"]: r["main_path"] for r in lx.main_tex(df).collect()} == {1: "main.tex", 2: None, 3: "paper/main.tex"}


def test_twenty_thousand_paragraphs(spark):
    """Offsets, sections, mentions and findings of one huge paper stay near linear."""
    import time

    parts = []
    for i in range(20_000):
        if i % 20 == 0:
            parts.append(f"\\section{{S{i}}}")
        parts.append(f"paragraph {i} \\ref{{fig:{i % 900}}} \\cite{{k{i % 700}}}")
        if i % 100 == 0:
            parts.append(f"\\begin{{figure}}\\label{{fig:{i // 100}}}\\end{{figure}}")
    df = spark.createDataFrame([(1, "\n\n".join(parts), ["k1", "none"])], "doc_id int, source string, bib array<string>")
    begin = time.time()
    row = pf.preflight_rows(lx.latex_extract(df)).first()
    assert time.time() - begin < 60
    body = [p for p in row["paragraphs"] if p["text"].startswith("paragraph")]
    assert len(body) == 20_000 and body[-1]["section_id"] == "sec_1000" and body[39]["section_id"] == "sec_0002"
    assert len(row["figures"][0]["mentioned_in"]) == 23 and len(row["figures"]) == 200
    kinds = [f["kind"] for f in row["findings"]]
    assert kinds.count("UNKNOWN_FIGURE_REFERENCE") == 700 and kinds.count("MISSING_BIB_ENTRY") == 699 and kinds.count("UNCITED_BIB_ENTRY") == 1


def test_chunks_of_line_blocks_equal_those_of_rows(spark):
    """A text in 1 000 blocks, blocks that end within and between paragraphs, white space in odd places."""
    from docaudit.operators import large as lg

    pick = random.Random(6)
    texts = ["", "\n", "a", "\n\na\n\n\nb\n", "  \n x\n\n \t\n\ny  ", "a\n \nb\n\n\n\n  c"]
    texts += ["\n".join(pick.choice(["", "", "word", "  two words ", " ", "\tx"]) for _ in range(pick.randrange(40))) for _ in range(40)]
    texts.append("\n".join(pick.choice(["", "some line of a long text", "and more of it ", "  "]) for _ in range(3000)))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = df.select("doc_id", F.posexplode(lx.chunk_list(F.col("text"))).alias("pos", "c")).select("doc_id", "pos", "c.start", "c.text")
    want = sorted((r["doc_id"], r["pos"] + 1, r["start"], r["text"]) for r in rows.collect())
    for lines in (1, 3):
        got = lg.chunk_table(lg.line_blocks(df, "doc_id", "text", lines).repartition(5)).collect()
        assert sorted((r["doc_id"], r["ord"], r["start"], r["text"]) for r in got) == want


def test_paper_joins_work_out_the_papers_once(spark, tmp_path):
    """The joins read the stored child lists; no paper is taken apart again for their other side."""
    from docaudit.plans.queries import QUERIES

    rows = [(1, "One line\nwith \\cite{x}", "en", "src1", 10), (2, None, "fr", "src2", None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    for name in ("missing_citations", "uncited_bib", "unknown_figure_refs", "figure_mentions_joined"):
        df = QUERIES[name](spark, str(tmp_path))
        assert df.count() > 0
        assert all("children-" in path for path in df.inputFiles()), name
