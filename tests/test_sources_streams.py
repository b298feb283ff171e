import json
import os
import random
import time

from pyspark.sql import functions as F

from docaudit import fixed as fx
from docaudit.operators import ensemble as en
from docaudit.operators import layout as ly
from docaudit.operators import markup as mk
from docaudit.operators import records as rc
from docaudit.plans import audit_job as job
from docaudit.sources import storage
from docaudit.streaming import live
from test_records_views import brute_limit


def test_markup(value):
    xml = '<P class="a">One <b>bold</b>&amp;lt;</P><pre>no</pre><p> </p><p>two\n x</p>'
    assert value(lambda c: mk.tag_contents(c, "p"), [xml]) == [["One bold &lt;", "two\n x"]]
    tei = '<biblStruct xml:id=" k1 "><t>A</t></biblStruct><biblStruct n="1"></biblStruct>'
    assert value(mk.bibliography, [tei])[0] == [("k1", "A"), ("bib_2", None)]


def test_anchors(spark):
    df = spark.createDataFrame([("abcdef", [(0, 2), (3, 3), (4, 9)]), ("  ", [(0, 1)])], "t string, s array<struct<start:int,end:int>>")
    assert [r[0] for r in df.select(mk.anchored_text(F.col("t"), F.col("s"))).collect()] == ["ab\nef", ""]
    ps = F.array(F.col("s"))
    assert [r[0] for r in df.select(mk.anchored_paragraphs(F.col("t"), ps)).collect()] == [["ab\nef"], []]


def test_payloads(value):
    texts = [
        {"paragraphs": ["one\n\ntwo x", 5, "ab"], "text": "no"}, {"text": "long text \n\nnext"}, {"markdown": "# head"},
        {"chunks": [{"text": "aaa"}, {"content": "bbb"}, {"content": 1}, 7]}, {"paragraphs": "x", "chunks": []}, {"text": 1}, [1],
    ]
    got = value(mk.payload_paragraphs, [json.dumps(t) for t in texts] + ["broken"])
    assert got == [["one", "two x"], ["long text", "next"], ["# head"], ["aaa", "bbb"], [], [], [], []]
    got = value(mk.model_paragraphs, [json.dumps(t) for t in ({"paragraphs": ["A  b", "a b", "xy"]}, {"pages": [{"text": "page one"}, {}, {"text": "two two"}]}, {"x": 1})])
    assert got == [["A b"], ["page one", "two two"], None]


def test_ensemble(spark):
    rows = [
        (1, 1, "local", [], [], [], ["w"]),
        (1, 2, "alpha", ["x" * 70 + " [1, 2]\n\n" + "x" * 70 + " [1, 2]"], [("1. Intro", 9), ("intro", 1), ("a", 1)], [("k ", "r"), ("k", "z"), ("", "")], []),
        (1, 3, "beta", ["y" * 70 + " (Lee, 1999)", "ab"], [], [("b1", "")], ["slow  x"]),
        (1, 4, "empty", [], [("Sec", 1), ("Two", 2)], [], []),
        (2, 1, "local", ["short one"], [], [], []),
        (2, 2, "same", ["short two"], [], [], []),
    ]
    schema = "doc_id long, ord int, source string, paragraphs array<string>, sections array<struct<title:string,level:int>>, bib array<struct<key:string,raw:string>>, warnings array<string>"
    df = spark.createDataFrame(rows, schema)
    stats = {(r["doc_id"], r["source"]): r for r in en.candidate_score(en.candidate_stats(en.normalise_candidates(df))).collect()}
    a = stats[(1, "alpha")]
    assert (a["n_paragraphs"], a["n_cited"], a["n_sections"], a["n_bib"]) == (1, 1, 1, 1)
    assert [(s["title"], s["level"]) for s in a["sections"]] == [("Intro", 6)]
    assert a["score"] == round(1.6 + 77 / 240 + 12 + 3 + 0.8 + 16, 2) and stats[(1, "local")]["score"] == -9.2
    got = {r["doc_id"]: (r["primary"], r["section_donor"], r["bib_donor"]) for r in en.pick_sources(df).collect()}
    assert got == {1: ("alpha", "alpha", "alpha"), 2: ("local", "local", "local")}
    row = {r["doc_id"]: r for r in en.ensemble_extract(df).collect()}[1]
    assert row["cites"][0]["keys"] == ["num:1", "num:2"] and row["bib"] == ["k"]
    assert row["warnings"][-2].startswith("extractor_selection primary=alpha") and "beta:score=" in row["warnings"][-1]


def test_ensemble_cleans_each_candidate_once(spark):
    """One pass over the candidates: no join of the cleaned candidates with a choice made from a second cleaning."""
    schema = "doc_id long, ord int, source string, paragraphs array<string>, sections array<struct<title:string,level:int>>, bib array<struct<key:string,raw:string>>, warnings array<string>"
    rows = [
        (1, 1, "local", ["short one"], [], [], None), (1, 2, "a", ["x" * 70 + " [3]"], [], [("k", "")], ["w"]), (1, 3, None, ["y" * 70], [], [], []),
        (2, 1, "other", [], [("Sec", 1)], [], []), (None, 1, "local", ["text " * 20], [], [], []),
    ]
    got = en.ensemble_extract(spark.createDataFrame(rows, schema))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
    (row,) = got.collect()
    assert (row["doc_id"], row["bib"], [p["text"] for p in row["paragraphs"]]) == (1, ["k"], ["x" * 70 + " [3]"])
    assert row["warnings"][0] == "w" and row["cites"][0]["keys"] == ["num:3"]


def test_citation_keys(value):
    got = value(en.pdf_citation_keys, ["x [1,  2] [2] (Lee-Ann et al., 2020a) (lee, 1999) (A, 99)"])
    assert got == [["num:1", "num:2", "ay:Lee-Ann_et_al.,_2020a"]]


def items(spark, rows):
    return spark.createDataFrame(
        [(1, 1, i, *r) for i, r in enumerate(rows)],
        "doc_id long, page int, seq int, text string, x double, y double, height double, has_eol boolean",
    )


def test_page_layout(spark):
    rows = [
        ("world", 50.0, 699.0, 10.0, False), ("Hello", 10.0, 700.0, 10.0, False), (" ", 0.0, 700.0, 10.0, False),
        ("(", 10.0, 680.0, 10.0, False), ("a", 20.0, 680.0, 10.0, False), (")", 30.0, 680.0, 10.0, False), ("研", 40.0, 680.0, 10.0, False), ("b", 50.0, 680.0, 10.0, False),
        ("near", 10.0, 668.0, 10.0, False),
    ]
    assert ly.page_text(items(spark, rows)).first()["text"] == "Hello world\n\n(a)研b\nnear"
    # End of line on a merged item opens a new line one line height below.
    eol = [("a", 1.0, 100.0, 10.0, False), ("b", 2.0, 100.0, 10.0, True), ("c", 3.0, 100.0, 10.0, False), ("d", 1.0, 90.0, 10.0, False)]
    assert ly.page_text(items(spark, eol)).first()["text"] == "a b\nc\nd"
    under = [("a", 1.0, 100.0, 10.0, False), ("b", 2.0, 100.0, 10.0, True), ("d", 1.0, 89.0, 10.0, False)]
    assert ly.page_text(items(spark, under)).first()["text"] == "a b\nd"


def test_words_that_bind(value):
    """What binds a word to its neighbours is worked out on the word's own row, before pages are gathered."""
    words = ["a(", "b研", "c", "-", "。x", "):", "ぁ", "é,"]
    assert value(ly.binds_after, words) == [True, True, False, True, False, False, True, False]
    assert value(ly.binds_before, words) == [False, False, False, False, False, True, True, False]


def test_page_layout_against_plain_python(spark):
    """Random pages with close lines, ends of lines and repeated places, in the order of lines, then x, then seq."""
    rng, pages, rows = random.Random(5), {}, []
    for page in range(60):
        some = [(n, f"w{n}", float(rng.randint(0, 9)), float(rng.randint(0, 40)) / 2, rng.choice([4.0, 10.0, 0.1]), rng.random() < 0.2) for n in range(rng.randint(1, 25))]
        pages[page] = some
        rows += [(1, page, *r) for r in some]
    schema = "doc_id long, page int, seq int, text string, x double, y double, height double, has_eol boolean"
    got = {r["page"]: r["text"] for r in ly.page_text(spark.createDataFrame(rows, schema)).collect()}
    for page, some in pages.items():
        placed = sorted((-y, x, seq, max(1.0, h), text, eol) for seq, text, x, y, h, eol in some)
        group, anchor, number = [], None, -1
        for down, *_ in placed:
            if anchor is None or abs(anchor + down) > fx.LINE_MERGE_TOLERANCE:
                anchor, number = -down, number + 1
            group.append(number)
        lines = []  # y, mean height, words
        for i in sorted(range(len(placed)), key=lambda i: (group[i], placed[i][1])):
            down, x, seq, h, text, eol = placed[i]
            if not lines or abs(lines[-1][0] + down) > fx.LINE_MERGE_TOLERANCE:
                lines.append([-down, h, [(x, seq, text)]])
                continue
            line = lines[-1]
            before, n = line[1], len(line[2])
            line[1] = (before * n + h) / (n + 1)
            line[2].append((x, seq, text))
            if eol:
                lines.append([-down - before, h, []])
        lines = [line for line in lines if line[2]]
        want = ""
        for n, (y, h, words) in enumerate(lines):
            if n:
                want += "\n\n" if lines[n - 1][0] - y > max(6.0, max(lines[n - 1][1], h) * 1.25) else "\n"
            want += " ".join(t for _, _, t in sorted(words))
        assert got[page] == want


def test_sparse(spark):
    got = [spark.range(1).select(en.is_sparse(F.lit(p), F.lit(t))).first()[0] for p, t in ((0, 0), (3, 99), (4, 39), (4, 40))]
    assert got == [True, True, True, False]


# ---- streams ------------------------------------------------------------------------------------


def test_rate_limit_stream(spark, tmp_path):
    data = [("k%d" % (i % 3), i, 1_700_000_000_000 + i * 700 + (i * i) % 300) for i in range(60)]
    df = spark.createDataFrame(data, "key string, request_id long, ms long")
    df = df.withColumn("ts", F.timestamp_millis("ms")).drop("ms").orderBy("request_id")
    for part in range(3):
        df.where(f"request_id div 20 = {part}").coalesce(1).write.parquet(str(tmp_path / "in" / f"b{part}"))
    stream = spark.readStream.schema("key string, request_id long, ts timestamp").option("maxFilesPerTrigger", 1)
    stream = stream.parquet(str(tmp_path / "in" / "*"))
    q = (
        live.rate_limit_stream(stream, 2, 5000).writeStream.format("memory").queryName("limited")
        .option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").start()
    )
    q.processAllAvailable()
    q.stop()
    got = {r["request_id"]: (r["allowed"], r["retry_after_ms"], r["window_start"]) for r in spark.table("limited").collect()}
    want = {}
    for key in ("k0", "k1", "k2"):
        want |= brute_limit(sorted((ms, i) for k, i, ms in data if k == key), 2, 5000)
    assert got == want


def test_status_stream_equals_batch(spark, tmp_path):
    schema = "analysis_id string, seq long, status string, progress double, step string, error string"
    rows = [(f"a{i % 4}", i, ["QUEUED", "ANALYZING", "FAILED", "READY"][i * 7 % 4], i / 30, "logic" if i % 5 == 0 else None, "e" if i % 3 == 0 else None) for i in range(30)]
    df = spark.createDataFrame(rows, schema)
    for part in range(3):
        df.where(f"seq div 10 = {part}").coalesce(1).write.parquet(str(tmp_path / "in" / f"b{part}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    q = live.write_latest(live.latest_status_stream(stream), str(tmp_path / "out"), str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = {tuple(r) for r in live.read_latest(spark, str(tmp_path / "out")).select("analysis_id", "status", "progress", "step", "error", "terminal").collect()}
    want = {tuple(r) for r in rc.latest_status(df, "analysis_id", ["seq"]).select("analysis_id", "status", "progress", "step", "error", "terminal").collect()}
    assert got == want


def test_late_requests_are_decided(spark, tmp_path):
    """A request of an hour ago in the third batch gets a decision like any other."""
    batches = [[("k", 1, 10_000_000), ("k", 2, 10_001_000)], [("k", 3, 20_000_000)], [("k", 4, 6_400_000), ("j", 5, 1), ("k", 6, 20_000_001)]]
    for n, rows in enumerate(batches):
        df = spark.createDataFrame(rows, "key string, request_id long, ms long").withColumn("ts", F.timestamp_millis("ms")).drop("ms")
        df.coalesce(1).write.parquet(str(tmp_path / "in" / f"b{n}"))
    stream = spark.readStream.schema("key string, request_id long, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    q = live.rate_limit_stream(stream, 2, 5000).writeStream.format("memory").queryName("late").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = {r["request_id"]: (r["allowed"], r["window_start"]) for r in spark.table("late").collect()}
    assert got == {1: (True, 10_000_000), 2: (True, 10_000_000), 3: (True, 20_000_000), 4: (True, 20_000_000), 5: (True, 1), 6: (False, 20_000_000)}


def test_repeated_batches_give_the_same_table(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, "QUEUED"), ("b", 1, "READY")], "analysis_id string, seq int, status string")
    more = spark.createDataFrame([("a", 2, "READY")], df.schema)

    class Sink:
        def __getattr__(self, name):
            return lambda *args: setattr(self, "write", args[0]) or self if name == "foreachBatch" else self

    class Stream:
        writeStream = Sink()

    write = live.write_latest(Stream(), str(tmp_path / "out"), str(tmp_path / "cp")).write
    for batch, number in ((df, 0), (more, 1), (more, 1)):
        write(batch, number)
    want = {("a", 2, "READY"), ("b", 1, "READY")}
    assert {tuple(r) for r in live.read_latest(spark, str(tmp_path / "out")).select("analysis_id", "seq", "status").collect()} == want
    live.compact_latest(spark, str(tmp_path / "out"), str(tmp_path / "base"))
    assert {tuple(r) for r in live.read_latest(spark, str(tmp_path / "base")).select("analysis_id", "seq", "status").collect()} == want


def test_trace_append(spark, tmp_path):
    schema = "analysis_id string, seq int, role string, status string"
    for n in range(2):
        spark.createDataFrame([("a", n, f"R{n}", "DONE")], schema).write.parquet(str(tmp_path / "in" / f"b{n}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    q = live.append_trace(stream, str(tmp_path / "out"), str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


# ---- whole job --------------------------------------------------------------------------------------


def test_job(spark):
    para = "we show that the method is better in case %d of the long series of tests, see Figure 3 and more words"
    sheet = "\n".join(para % i for i in range(14))
    rows = [
        (1, "SHEET", "SHEET_TEXT", sheet), (2, "DOC", "PDF", "text"), (3, "PR", "PR_TEXT", " \n"), (4, "DOC", "DOC_TEXT", "too short"),
        (5, "DOC", "DOC_TEXT", "# T\n" + sheet.replace("\n", "\n\n")),
    ]
    arts = spark.createDataFrame(rows, "doc_id long, artifact_type string, input_type string, text string")
    extracts, rejects = job.route(arts)
    assert {r["doc_id"]: r["reason"] for r in rejects.collect()} == {2: "inputType does not match artifactType", 3: "artifact text is empty"}
    assert extracts.count() + rejects.count() == len(rows)
    audit = job.analyse(extracts)
    assert {r["doc_id"] for r in audit.rejects.collect()} == {4}
    result = {r["doc_id"]: r for r in audit.result.collect()}
    assert set(result) == {1, 5}
    one = result[1]
    assert [c["claim_id"] for c in one["claims"]] == [f"claim_{i + 1}" for i in range(len(one["claims"]))]
    # No artifact but a paper has figures, so the numbered reference is a warning.
    assert (one["error_count"], one["warning_count"]) == (0, 1)
    assert one["top_risks"][0]["severity"] in ("HIGH", "MEDIUM")
    assert one["warnings"] == [w["warning"] for w in audit.warnings.where("doc_id = 1").orderBy("ord").collect()]
    trace = audit.trace.where("doc_id = 1").orderBy("seq").collect()
    assert [t["role"] for t in trace] == fx.AGENT_ROLES and [t["role"] for t in one["agent_trace"]] == fx.AGENT_ROLES
    assert trace[2]["summary"].startswith(f"claims={len(one['claims'])}, llmWarnings={len(one['warnings'])}, refineIter=")
    assert one["generated_at"] is not None and one["extract_path"] is None
    view = {r["doc_id"]: r for r in job.summary_view(audit.result).collect()}
    assert len(view[1]["top3_risks"]) == 3 and len(view[1]["claim_evidence"]) == len(one["claims"])
    # Without model answers the job is map-only; with them rows and answers are shuffled once each.
    assert "Exchange" not in audit.result._jdf.queryExecution().executedPlan().toString()
    answer = '{"claims":[{"claimId":"a","text":"We show that 7 methods are better than 5 others if tested","paragraphIds":["par_0002"]}]}'
    outputs = spark.createDataFrame([(1, 1, 14, answer), (5, 1, 14, "no")], "doc_id int, segment int, max_claims int, raw_json string")
    asked = {r["doc_id"]: r for r in job.analyse(extracts, outputs).result.collect()}
    assert any(c["text"].startswith("We show that 7 methods") for c in asked[1]["claims"])
    assert asked[5]["warnings"][0] == "claim extraction segment 1 failed"


def test_every_artifact_is_extracted_or_rejected(spark):
    tex = "\\section{One}\nwords of a paper " + "and more " * 30
    rows = [
        (1, "PAPER", "LATEX_ZIP", tex), (2, "BOOK", "LATEX_ZIP", tex), (3, None, "LATEX_ZIP", tex), (4, "SHEET", "SHEET_TEXT", "a,1"),
        (5, "PAPER", "PDF", None), (6, "PAPER", "PDF", None), (7, None, None, None), (8, "PAPER", "LATEX_ZIP", " "),
    ]
    arts = spark.createDataFrame(rows, "doc_id int, artifact_type string, input_type string, text string")
    papers = job.lx.paper_extract(spark.createDataFrame([(6, tex), (99, tex)], "doc_id int, text string"))
    for given in (None, papers):
        extracts, rejects = job.route(arts, given)
        got = {r["doc_id"]: r["artifact_type"] for r in extracts.collect()}
        out = {r["doc_id"]: r["reason"] for r in rejects.collect()}
        assert sorted([*got, *out]) == [r[0] for r in rows]
        assert got[1] == got[2] == got[3] == "PAPER" and got[4] == "SHEET"
        assert out[5] == "no extract row for the paper" and out[7] == "inputType does not match artifactType" and out[8] == "artifact text is empty"
        assert (6 in got) == (given is not None)


def test_missing_lists_are_told(spark):
    base = job.common_rows(job.lx.paper_extract(spark.createDataFrame([(1, "\\section{A}\ntext"), (2, "\\section{A}\ntext")], "doc_id int, text string")))
    broken = base.withColumn("bib", F.when(F.col("doc_id") == 1, F.col("bib")))
    got = {r["doc_id"]: r["preflight_warnings"] for r in job.pf.preflight_rows(broken).collect()}
    assert got == {1: [], 2: ["preflight failed: missing bib"]}


def test_adapter_hook(spark):
    base = dict(job.ADAPTERS)
    job.register_adapter("SHEET", lambda df: job.st.doc_extract(df))
    try:
        arts = spark.createDataFrame([(1, "SHEET", "SHEET_TEXT", "# Head\nbody")], "doc_id long, artifact_type string, input_type string, text string")
        rows, _ = job.route(arts)
        assert rows.first()["sections"][0]["title"] == "Head"
    finally:
        job.ADAPTERS.clear()
        job.ADAPTERS.update(base)


def test_limited_stream_decides_in_time_order(spark, tmp_path, monkeypatch):
    """Late requests, null keys, a key with most requests, and more batches than are kept as changes."""
    monkeypatch.setattr(live, "FOLD_EVERY", 2)
    rnd = random.Random(4)
    data = [(rnd.choice(["hot", "hot", "hot", "b", None]), i, 1_700_000_000_000 + rnd.randrange(60_000)) for i in range(400)]
    df = spark.createDataFrame(data, "key string, request_id long, ms long").withColumn("ts", F.timestamp_millis("ms")).drop("ms")
    for part in range(5):
        df.where(F.pmod("request_id", F.lit(5)) == part).repartition(2).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
        live.write_limited(stream, str(tmp_path / "out"), str(tmp_path / "cp"), 3, 5000).trigger(availableNow=True).start().awaitTermination()
    got = {r["request_id"]: (r["allowed"], r["window_start"]) for r in live.read_limited(spark, str(tmp_path / "out")).collect()}
    want, state = {}, {}
    for part in range(5):
        for key, i, ms in sorted((d for d in data if d[1] % 5 == part), key=lambda d: (d[2], d[1])):
            start, count = state.get(key, (None, 0))
            if start is None or ms - start >= 5000:
                start, count = ms, 0
            want[i] = (count < 3, start)
            state[key] = (start, min(3, count + 1))
    assert got == want
    assert not list(tmp_path.glob("requests-*"))


def test_scratch_folders_go(spark):
    with storage.scratch(spark):
        kept = storage.stored(spark.range(3), "numbers")
        path = kept.inputFiles()[0].removeprefix("file://").removeprefix("file:")
        assert os.path.exists(path) and kept.count() == 3
    assert not os.path.exists(path)


def test_live_progress_equals_batch(spark, tmp_path):
    roles = [*fx.AGENT_ROLES, "OTHER", None]
    rows = [(f"r{i % 7}", i, roles[(i * i + i // 7) % len(roles)]) for i in range(60)]
    df = spark.createDataFrame(rows, "run string, seq long, role string")
    for part in range(3):
        df.where(f"seq % 3 = {part}").coalesce(1).write.parquet(str(tmp_path / "in" / f"b{part}"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    live.write_latest(live.trace_progress_stream(stream, "run"), str(tmp_path / "out"), str(tmp_path / "cp"), "run").trigger(availableNow=True).start().awaitTermination()
    got = sorted(tuple(r) for r in live.read_latest(spark, str(tmp_path / "out"), "run").select("run", "done", "percent", "first_missing").collect())
    assert got == sorted(tuple(r) for r in rc.trace_progress(df, "run").collect())


def test_steps_have_times_in_order(spark):
    from docaudit.operators.structure import sheet_extract

    docs = spark.createDataFrame([(n, "The method always works better in 12 of 30 cases.\n\nIt is significant if tested on 40 inputs.\n\n" * 9) for n in range(5)], "doc_id long, text string")
    before = time.time()
    trace = job.analyse(sheet_extract(docs), timed=True).trace.orderBy("doc_id", "seq").collect()
    assert len(trace) == 40
    for doc in range(5):
        steps = [r for r in trace if r["doc_id"] == doc]
        assert [r["role"] for r in steps] == list(fx.AGENT_ROLES)
        assert all(r["duration_ms"] >= 1 and r["ended_at"] >= r["started_at"] for r in steps)
        assert all(b["started_at"] == a["ended_at"] for a, b in zip(steps, steps[1:]))
        assert before - 1 < steps[0]["started_at"].timestamp() <= steps[-1]["ended_at"].timestamp() < time.time() + 1


def scanned(df, name):
    """Rows of a frame and a metric of its only scan."""
    rows = df.collect()
    scan = df._jdf.queryExecution().executedPlan().collectLeaves().head()
    return rows, scan.metrics().apply(name).value()


def test_lookup_reads_one_file(spark, tmp_path):
    path = str(tmp_path / "records")
    df = spark.range(20_000).select(F.concat(F.lit("s"), F.pmod(F.xxhash64("id"), F.lit(500)).cast("string")).alias("session_id"), "id")
    storage.write_indexed(df, path, "session_id", buckets=8)
    found = storage.lookup(spark.read.parquet(path), "session_id", "s77", 8)
    rows, files = scanned(found, "numFiles")
    assert files == 1 and len(rows) == df.where("session_id = 's77'").count() > 0
    none = storage.lookup(spark.read.parquet(path), "session_id", "s77x", 8)
    rows, read = scanned(none, "numOutputRows")
    assert rows == [] and read == 0  # the filter of the row group says that the id isn't there


def test_repeated_runs_leave_the_same_rows(spark, tmp_path):
    df = spark.createDataFrame([(n, f"t{n}") for n in range(30)], "id long, text string")
    for write in (
        lambda path, run: storage.write_texts(df, path, "text", "id", 4, run),
        lambda path, run: storage.append_records(df, path, run),
        lambda path, run: storage.write_indexed(df, path, "id", 4, run),
    ):
        path = str(tmp_path / f"w{len(list(tmp_path.iterdir()))}")
        for run in ("a", "a", "b", "a"):
            write(path, run)
        assert spark.read.parquet(path).count() == 60


def test_snapshot_is_read_as_it_lies(spark, tmp_path):
    old = spark.createDataFrame([(n, "old", n * 1.0, "kept" if n % 2 else None) for n in range(50)], "id long, status string, progress double, step string")
    new = spark.createDataFrame([(n, None if n == 40 else "new", -1.0, "fresh" if n % 3 == 0 else None) for n in range(40, 60)], old.schema)
    snapshot = storage.write_snapshot(old, str(tmp_path / "snap"), "snapshot_for_test", "id", 4)
    try:
        merged = rc.with_changes(snapshot, new, "id", 4, ["step"])
        plan = merged._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and "REPARTITION_BY_NUM" in plan
        got = {r["id"]: tuple(r)[1:] for r in merged.collect()}
        assert len(got) == 60 and got[7] == ("old", 7.0, "kept") and got[41] == ("new", -1.0, "kept")
        assert got[40] == (None, -1.0, None) and got[42] == ("new", -1.0, "fresh") and got[57] == ("new", -1.0, "fresh")
    finally:
        spark.sql("drop table snapshot_for_test")


def test_readers_fold_a_bounded_number_of_changes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(live, "FOLD_EVERY", 2)
    schema = "analysis_id string, seq long, status string, progress double, step string, error string"
    rows = [(f"a{i % 3}", i, f"S{i}", i / 10, None, None) for i in range(10)] + [("only once", 0, "FIRST", 0.0, "x", None)]
    df = spark.createDataFrame(rows, schema)
    for part in range(5):
        df.where(f"seq div 2 = {part}").write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        live.write_latest(live.latest_status_stream(stream), str(tmp_path / "out"), str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    got = {r["analysis_id"]: r["status"] for r in live.read_latest(spark, str(tmp_path / "out")).collect()}
    assert got == {"a0": "S9", "a1": "S7", "a2": "S8", "only once": "FIRST"}
    assert {p.name for p in (tmp_path / "out").iterdir() if p.name.startswith("whole")} == {"whole=2", "whole=4"}
    read = live.read_latest(spark, str(tmp_path / "out")).inputFiles()
    assert all("whole=4" in f or "batch=4" in f for f in read)


def test_bibliography_of_many_entries_is_matched_once(spark):
    """The bodies are found once a text, not again for each entry."""
    text = "".join(f'<biblStruct xml:id="k{i}"><title>Title {i}</title></biblStruct>' for i in range(12_000))
    df = spark.createDataFrame([(text,)], "t string").select(F.explode(mk.bibliography(F.col("t"))).alias("b")).select("b.*")
    began = time.monotonic()
    rows = df.collect()
    assert time.monotonic() - began < 20
    assert rows[0] == ("k0", "Title 0") and rows[-1] == ("k11999", "Title 11999") and len(rows) == 12_000


def test_stream_of_many_files_takes_few_batches(spark, tmp_path):
    """Files grow with the input; batches don't, and each batch has a file a bucket."""
    from docaudit.plans import queries

    rows = spark.range(0, 400, 1, 12).selectExpr("concat('a', id % 50) as analysis_id", "id as seq", "'READY' as status", "0.5D as progress", "cast(null as string) as step", "cast(null as string) as error")
    out = tmp_path / "out"
    stream = live.latest_status_stream(queries._streamed(spark, rows, 4, "seq"))
    live.write_latest(stream, str(out), str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    batches = list(out.glob("batch=*"))
    assert 1 <= len(batches) <= 2
    assert all(len(list(b.glob("*.parquet"))) == 1 for folder in batches for b in folder.glob("bucket=*"))
    assert live.read_latest(spark, str(out)).count() == 50
