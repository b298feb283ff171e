import random

from pyspark.sql import functions as F

from docaudit import fixed as fx
from docaudit.operators import ingest as ig
from docaudit.operators import ratelimit as rl
from docaudit.operators import records as rc
from docaudit.operators import views as vw
from docaudit.sources import storage


def brute_limit(times, limit, window):
    """times: sorted [(ms, id)] -> {id: (allowed, retry, start)}."""
    out, start, count = {}, None, 0
    for ms, rid in times:
        if start is None or ms - start >= window:
            start, count = ms, 1
            out[rid] = (True, None, start)
        elif count >= limit:
            out[rid] = (False, window - (ms - start), start)
        else:
            count += 1
            out[rid] = (True, None, start)
    return out


def limited(spark, data, limit, window):
    df = spark.createDataFrame(data, "key string, request_id long, ms long").withColumn("ts", F.timestamp_millis("ms")).drop("ms")
    return {
        (r["key"], r["request_id"]): (r["allowed"], r["retry_after_ms"], r["window_start"])
        for r in rl.rate_limit(df, limit, window).collect()
    }


def test_rate_limit_equals_loop(spark):
    rnd = random.Random(1)
    data, rid = [], 0
    for key, n, span in (("hot", 3000, 40_000), ("slow", 60, 900_000), ("burst", 200, 300), ("one", 1, 5)):
        for _ in range(n):
            rid += 1
            data.append((key, rid, rnd.randint(0, span)))
    # One request in (almost) every millisecond over several blocks.
    for ms in range(0, 30_000):
        if ms % 4001:
            rid += 1
            data.append(("dense", rid, ms))
    # The hot key runs through many blocks (64 windows of 100 ms) without a pause.
    for limit, window in ((2, 100), (20, 1000), (1, 7)):
        got = limited(spark, data, limit, window)
        for key in ("hot", "slow", "burst", "one", "dense"):
            times = sorted((ms, i) for k, i, ms in data if k == key)
            want = brute_limit(times, limit, window)
            assert {i: got[(key, i)] for _, i in times} == want, (key, limit, window)


def test_rate_limit_edges(spark):
    data = [("k", i, ms) for i, ms in enumerate([1, 2, 3, 11, 12, 13, 30])]
    got = [v[0] for _, v in sorted(limited(spark, data, 2, 10).items())]
    assert got == [True, True, False, True, True, False, True]
    assert rl.limit_for("analyze") == (60, 60_000)


def test_merge_and_status(spark):
    rows = [
        ("a", 1, "QUEUED", 0.0, None, None, "x", None), ("a", 2, "ANALYZING", 0.4, "extract", "boom", None, None),
        ("a", 3, "READY", 1.0, None, None, None, "r"), ("b", 1, "FAILED", 0.1, "logic", "bad", None, None),
    ]
    df = spark.createDataFrame(rows, "id string, seq int, status string, progress double, step string, error string, p1 string, p2 string")
    got = {r["id"]: tuple(r)[1:] for r in rc.latest_status(df, "id", ["seq"]).collect()}
    assert got == {"a": ("READY", 1.0, "extract", None, True), "b": ("FAILED", 0.1, "logic", "bad", True)}
    m = {r["id"]: (r["p1"], r["p2"]) for r in rc.merge_updates(df, "id", ["p1", "p2"], ["seq"]).collect()}
    assert m == {"a": ("x", "r"), "b": (None, None)}
    t = rc.latest_row(df, ["id"], ["seq"]).where("id = 'a'").first()
    assert t["seq"] == 3 and t["p2"] == "r"


def test_defaults(spark):
    df = spark.createDataFrame([("s", None, None), ("t", "PR", "2024-01-01T00:00:00Z")], "submission_id string, artifact_type string, created_at string")
    got = {r["submission_id"]: r for r in rc.with_defaults(df, "submission").collect()}
    assert got["s"]["artifact_type"] == "PAPER" and got["s"]["status"] == "UPLOADED" and got["s"]["created_at"]
    assert got["t"]["created_at"] == "2024-01-01T00:00:00Z"
    a = rc.with_defaults(spark.createDataFrame([("x",)], "analysis_id string"), "analysis").first()
    assert (a["status"], a["progress"]) == ("QUEUED", 0.0)


def test_latest_per_session(spark):
    rows = [("s", 1, "a", "2024-01-02T00:00:00Z"), ("s", 2, "b", "2024-01-02T00:00:00.000Z"), ("s", 3, "c", "no date"), ("t", 1, "d", None)]
    df = spark.createDataFrame(rows, "session_id string, ord int, name string, created_at string")
    assert {r["session_id"]: r["name"] for r in rc.latest_per_session(df, "created_at", "ord").collect()} == {"s": "a", "t": "d"}


def test_scalars(spark):
    def one(c):
        return spark.range(1).select(c).first()[0]

    L = F.lit
    null = F.lit(None).cast("string")
    days = [one(rc.retention_days(L(m), L(t).cast("double"))) for m, t in (("SAVE", 0), ("NO_SAVE", 0), ("SAVE", 1), ("SAVE", 36), ("SAVE", None), ("NO_SAVE", None))]
    assert days == [30, 1, 1, 2, 30, 1]
    assert [one(rc.session_status(c)) for c in (null, L("READY"), L("FAILED"), L("QUEUED"))] == ["active", "completed", "error", "analyzing"]
    assert [one(rc.normal_progress(L(p))) for p in (0.5, 1.0, 50.0, 150.0, -3.0)] == [50.0, 100.0, 50.0, 100.0, 0.0]
    assert one(rc.progress_message(null, L("QUEUED"), null)) == fx.PROGRESS_QUEUED
    assert one(rc.progress_message(L("e"), L("READY"), null)) == "e"
    assert one(rc.progress_message(null, L("ANALYZING"), null)) is None
    now = L("2024-01-01T00:00:00Z").cast("timestamp")
    lease = lambda s, o, e: one(rc.lease_status(L(s), o, e, now))
    assert lease("READY", L("w"), L("2025-01-01T00:00:00Z")) == "finished"
    assert lease("QUEUED", L("w"), L("2025-01-01T00:00:00Z")) == "locked"
    assert lease("QUEUED", L("w"), L("2023-01-01T00:00:00Z")) == "free"
    assert lease("QUEUED", L("w"), L("bad")) == "free" and lease("QUEUED", null, L("2025-01-01T00:00:00Z")) == "free"
    import hashlib

    assert one(rc.token_hash(L("  "))) == hashlib.sha256(b"anonymous").hexdigest()
    assert one(rc.token_hash(L(" t "))) == hashlib.sha256(b"t").hexdigest()


def test_steps(spark):
    roles = fx.AGENT_ROLES
    trace = spark.createDataFrame([("a", 1, roles[0], "DONE"), ("a", 2, roles[2], "WARN"), ("a", 3, "OTHER", "DONE")], "analysis_id string, seq int, role string, status string")
    p = rc.trace_progress(trace, "analysis_id").first()
    assert (p["done"], p["percent"], p["first_missing"]) == (2, 25, roles[1])
    runs = spark.createDataFrame([("a", "ANALYZING"), ("b", "READY")], "analysis_id string, status string")
    got = {(r["analysis_id"], r["step"]): r["state"] for r in rc.step_states(trace, runs).collect()}
    assert [got[("a", i)] for i in range(1, 9)] == ["done", "active", "warn"] + ["pending"] * 5
    assert {got[("b", i)] for i in range(1, 9)} == {"pending"}


def test_answers(spark):
    rows = [("s1", 1, "x" * 80), ("s1", 2, " " + "x" * 79 + " "), ("s1", 3, "  "), ("s2", 4, "y")]
    df = vw.evaluate_answers(spark.createDataFrame(rows, "session_id string, turn int, text string"))
    got = {r["turn"]: (r["pass"], r["follow_up"], r["todo_title"]) for r in df.collect()}
    assert got == {1: (True, False, None), 2: (False, True, fx.MSG["oral_todo"]), 3: (None, False, None), 4: (False, True, fx.MSG["oral_todo"])}
    sessions = spark.createDataFrame([("s1", "SAVE"), ("s2", "NO_SAVE")], "session_id string, mode string")
    kinds = {}
    for r in vw.expand_turns(df, sessions, ["turn"]).orderBy("turn", "seq").collect():
        kinds.setdefault(r["turn"], []).append(r["type"])
    assert kinds == {1: ["ANSWER", "QUESTION", "EVAL", "DRAFT"], 2: ["ANSWER", "QUESTION", "EVAL", "DRAFT"], 3: ["QUESTION"]}


def test_patch_and_todos(spark):
    rows = [(1, 2, " b ", "accepted"), (1, 1, "a", "accepted"), (1, 3, "c", "pending"), (2, 1, "  ", "accepted")]
    df = vw.patch_text(spark.createDataFrame(rows, "analysis_id int, ord int, title string, status string"))
    got = {r["analysis_id"]: r["diff_text"] for r in df.collect()}
    assert got["1"].endswith("@@ -0,0 +1,2 @@\n+- [ ] a\n+- [ ] b\n") and got["1"].startswith("diff --git a/docs/analysis_1.md b/")
    assert "+1,1 @@\n+<!-- no accepted todos -->\n" in got["2"]
    drafts = spark.createDataFrame(
        [("a", 1, "abc", False), ("a", 2, " abc ", True), ("a", 3, "new", False), ("a", 4, "abc", False), ("a", 5, " ", True)],
        "analysis_id string, seq int, sentence string, auto_accept boolean",
    )
    todos = vw.oral_draft_todos(drafts).orderBy(F.desc("last_seq")).collect()
    assert [(t["todo_id"], t["status"], t["last_seq"]) for t in todos] == [("todo_oral_22ci", "accepted", 4), (todos[1]["todo_id"], "pending", 3)]
    extra = spark.createDataFrame([(1, "t1", 1, "pending")], "doc_id int, todo_id string, ord int, status string")
    computed = spark.createDataFrame([(1, "t1", 1, "done"), (1, "t2", 2, "pending")], "doc_id int, todo_id string, ord int, status string")
    over = spark.createDataFrame([(1, "t2", "accepted")], "doc_id int, todo_id string, status string")
    merged = {r["todo_id"]: r["status"] for r in vw.overlay_todos(extra, computed, over).collect()}
    assert merged == {"t1": "pending", "t2": "accepted"}


def test_focus(spark):
    claims = spark.createDataFrame([(1, 1, "claim_1", "one"), (1, 2, "claim_2", "two")], "doc_id int, ord int, claim_id string, text string")
    req = spark.createDataFrame([(1, "t1", "claim_2"), (1, "t2", None), (1, "t3", "claim_9")], "doc_id int, turn_id string, focus_claim_id string")
    got = {r["turn_id"]: (r["focus_text"], r["context"]) for r in vw.focus_claims(req, claims).collect()}
    ctx = "[claim_1] one\n[claim_2] two"
    assert got == {"t1": ("two", ctx), "t2": ("one", ctx), "t3": (None, ctx)}


def test_compose_pr(spark):
    parts = {k: F.lit(v) for k, v in dict(summary=" s ", background="", changes="c", test_plan="t", risks=" ", rollback="r", diff="d").items()}
    got = spark.range(1).select(vw.compose_pr(parts)).first()[0]
    assert got == "# Summary\ns\n## Background\n## Changes\nc\n## Test Plan\nt\n## Risks\n## Rollback\nr\n## Diff\nd"


def test_artifact_rules(spark):
    ok = "x" * 40
    base = ("DOC", ok, "t", None, None, None, None)
    rows = [
        (base, None), (("BOOK",) + base[1:], "artifact_type must be PAPER|PR|DOC|SHEET"),
        ((None,) + base[1:], "artifact_type must be PAPER|PR|DOC|SHEET"),
        (("DOC", " 　") + base[2:], "content must be a non-empty string"), (("DOC", None) + base[2:], "content must be a non-empty string"),
        (("DOC", " " + "x" * 39) + base[2:], "content is too short (min 40 chars required)"),
        (("DOC", "x" * 200_001) + base[2:], "content is too long (max 200000 chars)"),
        (("DOC", ok, "t" * 121) + base[3:], "title is too long (max 120 chars)"),
        (("DOC", ok, "t", "pdf") + base[4:], "content_format must be plain|markdown|diff|json"),
        (("DOC", ok, "t", "diff") + base[4:], "content_format diff is not allowed for DOC"),
        (("PAPER", ok, "t", "plain") + base[4:], None),
        (("DOC", ok, "t", "plain", "r" * 241, None, None), "source_ref is too long (max 240 chars)"),
        (("DOC", ok, "t", "plain", "r", "KEEP", None), "retentionPolicy.mode must be NO_SAVE or SAVE"),
        (("DOC", ok, "t", "plain", "r", "SAVE", "soon"), "retentionPolicy.ttlHours must be number"),
        (("DOC", ok, "t", "plain", "r", "SAVE", "1.5"), None),
    ]
    schema = "i int, artifact_type string, content string, title string, content_format string, source_ref string, mode string, ttl_hours string"
    df = spark.createDataFrame([(i, *r) for i, (r, _) in enumerate(rows)], schema)
    got = [r["error"] for r in ig.validate_artifacts(df).orderBy("i").collect()]
    assert got == [e for _, e in rows]
    valid, rejects = ig.accept(ig.validate_artifacts(df))
    names = {r["i"]: (r["input_type"], r["content_type"], r["file_name"]) for r in ig.artifact_objects(valid).collect()}
    assert names[0] == ("DOC_TEXT", "text/plain; charset=utf-8", "t.txt") and rejects.count() == 12


def test_metadata_rules(spark):
    rows = [
        (None, None), ("{", "metadata is not valid JSON"), ("[]", "metadata must be a JSON object"), ("null", "metadata must be a JSON object"),
        ("{}", None), ('{"artifactType":"PR","language":"en","retentionPolicy":{"mode":"SAVE","ttlHours":1.5}}', None),
        ('{"artifactType":"X"}', "metadata.artifactType must be PAPER|PR|DOC|SHEET"), ('{"language":1}', "metadata.language must be string"),
        ('{"domainTag":[]}', "metadata.domainTag must be string"), ('{"retentionPolicy":1}', "metadata.retentionPolicy must be object"),
        ('{"retentionPolicy":{}}', "metadata.retentionPolicy.mode must be NO_SAVE or SAVE"),
        ('{"retentionPolicy":{"mode":"SAVE","ttlHours":"1"}}', "metadata.retentionPolicy.ttlHours must be number"),
    ]
    df = spark.createDataFrame([(i, m) for i, (m, _) in enumerate(rows)], "i int, metadata string")
    assert [r["error"] for r in ig.validate_metadata(df).orderBy("i").collect()] == [e for _, e in rows]


def test_storage(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_bytes("é\r\nx".encode())
    (tmp_path / "in" / "b.bin").write_bytes(b"\x00\xe9")
    (tmp_path / "in" / "d.txt").write_bytes(b"a\xffb")
    (tmp_path / "in" / "c.pdf").write_bytes(b"%PDF-1.4 x")
    files = storage.read_artifacts(spark, str(tmp_path / "in"))
    got = {r["path"][-5:]: r["text"] for r in storage.decode_artifacts(files).collect()}
    assert got["a.txt"] == "é\r\nx" and got["b.bin"] == "\x00é" and got["d.txt"] == "a\ufffdb"
    good, bad = storage.split_pdfs(files)
    assert good.count() == 1 and bad.count() == 3
    df = spark.createDataFrame([("x1", [1, 2]), ("x2", [])], "analysis_id string, v array<int>")
    storage.write_documents(df, str(tmp_path / "json"), "analysis_id")
    back = storage.read_documents(spark, str(tmp_path / "json"), "analysis_id string, v array<int>")
    assert {r["analysis_id"]: r["v"] for r in back.collect()} == {"x1": [1, 2], "x2": []}
    storage.append_records(df, str(tmp_path / "pq"))
    found = storage.lookup(spark.read.parquet(str(tmp_path / "pq")), "analysis_id", "x2")
    assert found.count() == 1 and "PushedFilters: [IsNotNull(analysis_id), EqualTo(analysis_id,x2)]" in found._jdf.queryExecution().toString()
    bodies = "line one\nline two"
    many = spark.range(500).select(F.concat(F.lit("x"), "id").alias("analysis_id"), F.lit(bodies).alias("t"))
    storage.write_texts(many, str(tmp_path / "txt"), "t", "analysis_id")
    back = storage.read_texts(spark, str(tmp_path / "txt"))
    assert back.count() == 500 and back.where("analysis_id = 'x7'").first()["text"] == bodies
    folders = [p for p in (tmp_path / "txt").iterdir() if p.name.startswith("bucket=")]
    assert len(folders) <= storage.BUCKETS
    one = storage.lookup(spark.read.parquet(str(tmp_path / "txt")), "analysis_id", "x7", storage.BUCKETS)
    assert one.count() == 1 and "PartitionFilters: [isnotnull(bucket" in one._jdf.queryExecution().executedPlan().toString()


def test_a_table_is_spread_or_read_as_it_is(spark, tmp_path):
    """Few and many splits give the same rows."""
    from docaudit.sources.tables import read_table

    df = spark.range(1000).select("id", (F.col("id") % 7).alias("v"))
    df.coalesce(1).write.parquet(str(tmp_path / "few.parquet"))
    df.repartition(40).write.parquet(str(tmp_path / "many.parquet"))
    rows = [sorted(map(tuple, read_table(spark, str(tmp_path), n, "id").collect())) for n in ("few", "many")]
    assert rows[0] == rows[1] == sorted(map(tuple, df.collect()))


def test_limiter_over_long_windows_and_sparse_keys(spark):
    """Windows far wider than a block, blocks without any request, and one key with most requests."""
    import random

    rnd = random.Random(9)
    data = [("hot", i, rnd.randrange(40 * 3_600_000)) for i in range(1500)] + [("few", 5000 + i, ms) for i, ms in enumerate([0, 7 * 3_600_000, 30 * 3_600_000])]
    for limit, window in ((3, 12 * 3_600_000), (2, 3_600_000), (5, 90_000)):
        got = limited(spark, data, limit, window)
        for key in ("hot", "few"):
            want = brute_limit(sorted((ms, i) for k, i, ms in data if k == key), limit, window)
            assert {i: got[(k, i)] for k, i, _ in data if k == key} == want


def test_limiter_keeps_null_keys_and_times(spark):
    data = [(None, i, ms) for i, ms in enumerate([0, 5, 9, 10, 11, 19, 40])] + [("a", 100, 3), ("a", 101, None), (None, 102, None)]
    got = limited(spark, data, 2, 10)
    assert len(got) == len(data)
    want = brute_limit([(ms, i) for k, i, ms in data if k is None and ms is not None], 2, 10)
    assert {i: got[(None, i)] for i in want} == want
    assert got[("a", 101)] == got[(None, 102)] == (None, None, None) and got[("a", 100)][0]


def test_limiter_tree(spark, monkeypatch):
    """Every key through hours, days and months."""
    monkeypatch.setattr(rl, "FEW", 5)
    rnd = random.Random(3)
    hour = rl.HOUR_MS
    data = [("long", i, rnd.randrange(400 * 24 * hour)) for i in range(900)] + [("near", 2000 + i, 10 * hour + rnd.randrange(3 * hour)) for i in range(500)]
    data += [(None, 4000 + i, -5 * hour + rnd.randrange(10 * hour)) for i in range(200)] + [("even", 5000 + i, i * hour // 4) for i in range(400)]
    for limit, window in ((2, 5 * 24 * hour), (3, 90 * 60_000), (2, hour), (7, 45 * 24 * hour)):
        got = limited(spark, data, limit, window)
        for key in ("long", "near", None, "even"):
            want = brute_limit(sorted((ms, i) for k, i, ms in data if k == key), limit, window)
            assert {i: got[(key, i)] for i in want} == want, (key, limit, window)


def test_exit_functions_compose():
    import numpy as np

    rnd = random.Random(5)
    for _ in range(50):
        window = rnd.randrange(1, 60)
        at = np.array(sorted(rnd.sample(range(300), 40)))
        cuts = [at[at // 60 == n] for n in range(5) if (at // 60 == n).any()]
        whole = rl.composed([rl.exit_of(part, window) for part in cuts])
        for entry in (rl.FIRST, -1, *range(0, 320, 7)):
            opens = entry
            for ms in at.tolist():
                if ms >= opens:
                    opens = ms + window
            assert rl.through(whole, np.array([entry]))[0] == opens


def test_todos_are_chosen_in_the_row(spark):
    """Risks, else claims, without working the rows out for either."""
    risk = "struct<rank:int,severity:string,title:string,reason:string>"
    audit = "struct<ord:int,claim_id:string,text:string,best_score:double,avg_score:double,coverage:double,severity:string,code:string,para_ids:array<string>>"
    claim = "struct<claim_id:string,text:string,para_ids:array<string>>"
    entry = lambda n: (n, f"claim_{n}", "t", 0.9, 0.9, 0.9, None, None, [])
    data = [
        (1, [(1, "HIGH", "T", ""), (2, "LOW", "U", "why")], [entry(1)], [("claim_1", "t", ["p"])]),
        (2, [], [entry(1), entry(2)], [("claim_1", "t", ["p"]), ("claim_2", "t", ["p"])]),
        (3, [], [], []),
        (4, None, [entry(1)], [("claim_1", "t", ["p"])]),
    ]
    rows = spark.createDataFrame(data, f"doc_id long, risks array<{risk}>, audit array<{audit}>, claims array<{claim}>")
    df = vw.todos_from_analysis(rows)
    assert [(r["doc_id"], r["ord"], r["todo_id"], r["impact"]) for r in df.orderBy("doc_id", "ord").collect()] == [
        (1, 1, "todo_risk_1", 5), (1, 2, "todo_risk_2", 3), (2, 1, "todo_claim_1", 3), (2, 2, "todo_claim_2", 3),
    ]
    assert "Union" not in df._jdf.queryExecution().optimizedPlan().toString()
    assert vw.todos_from_analysis(rows, 1).where("doc_id = 2").count() == 1
