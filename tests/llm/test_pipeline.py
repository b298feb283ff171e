"""Each stage against a plain computation, the whole run on the smallest tables, and messy rows through all stages."""

import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as pipeline
from docaudit.llm import quality, simhash
from docaudit.llm.token_counts import default_tokenizer
from test_secrets_topk import plain_redacted

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


@pytest.fixture(scope="module")
def messy(spark, documents):
    """Messy rows with columns that clash with the stages' own."""
    return documents.withColumns({"keep": F.lit("x"), "spans": F.lit(1), "fp": F.lit(2), "__row": F.lit(3), "score": F.lit(None)})


def texts(df):
    return sorted((repr(r["doc_id"]), repr(r["text"])) for r in df.collect())


def test_names_and_columns(spark, docs):
    assert len(pipeline.STAGES) == 5 and pipeline.ORACLE_SQL is None
    for _, stage in pipeline.STAGES[:-1]:
        assert stage(spark, docs, FOLDER).dtypes == docs.dtypes


def test_quality_stage(spark, docs):
    classifier = quality.train(docs, spark.read.parquet(f"{FOLDER}/labels.parquet"))
    scored = quality.score_quality(docs, classifier, F.col("source"), F.col("lang"))
    kept = {r["doc_id"] for r in pipeline.quality_stage(spark, docs, FOLDER).collect()}
    assert kept == {r["doc_id"] for r in scored.where("score >= 0.5").collect()} and 0 < len(kept) < docs.count()


def test_dedup_stage(spark, docs):
    values = {r["doc_id"]: simhash.fingerprint(r["text"] or "") for r in docs.collect()}
    left, want = set(values), set()
    while left:
        group, new = set(), {min(left)}
        want.add(min(left))
        while new:
            group |= new
            new = {i for i in left - group for j in new if (values[i] ^ values[j]).bit_count() <= 4}
        left -= group
    got = [r["doc_id"] for r in pipeline.dedup_stage(spark, docs, FOLDER).collect()]
    assert sorted(got) == sorted(want) and len(got) < len(values)


def test_dedup_stage_broadcasts_no_exploded_table(spark, docs, monkeypatch):
    plans, stored = {}, simhash.stored

    def seen(df, name, rows=None):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return stored(df, name, rows)

    monkeypatch.setattr(simhash, "stored", seen)
    assert 0 < pipeline.dedup_stage(spark, docs, FOLDER).count() < docs.count()
    assert "SortMergeJoin" in plans["links"] and "Broadcast" not in plans["links"]


def test_decontamination_stage(spark, docs):
    leak = spark.read.parquet(f"{FOLDER}/benchmark.parquet").where("item_id = 0").first()["text"]
    planted = docs.union(spark.createDataFrame([(9_999_999, f"Before it. {leak} After it.", "en", "s", 1)], docs.schema))
    left = {r["doc_id"] for r in pipeline.decontamination_stage(spark, planted, FOLDER).collect()}
    words = lambda t: " ".join(re.findall(r"[^\W\d_]+|\d+", (t or "").lower()))
    items = [words(r["text"]) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    whole = {r["doc_id"] for r in planted.collect() if any(f" {i} " in f" {words(r['text'])} " for i in items)}
    assert 9_999_999 in whole and left == {r["doc_id"] for r in planted.collect()} - whole


def test_secrets_stage(spark, docs):
    got = {r["doc_id"]: r for r in pipeline.secrets_stage(spark, docs, FOLDER).collect()}
    for r in docs.collect():
        clean = plain_redacted(r["text"])
        assert got[r["doc_id"]]["text"] == clean
        assert got[r["doc_id"]]["n_chars"] == (r["n_chars"] if clean == r["text"] else len(clean))


def test_packing_stage(spark, docs):
    library = Tokenizer.from_file(default_tokenizer())
    rows, sequences = defaultdict(list), defaultdict(list)
    for r in pipeline.packing_stage(spark, docs, FOLDER).collect():
        rows[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for d in docs.collect():
        ids = np.array(library.encode(d["text"] or "", add_special_tokens=False).ids + [1], "<u4")
        at = 0
        for r in sorted(rows[d["doc_id"]], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            at += r["length"]
            assert r["ids_crc32"] == zlib.crc32(ids[r["start"] : at].tobytes())
        assert at == len(ids)
    for held in sequences.values():
        end = 0
        for offset, n in sorted(held):
            assert offset == end
            end += n
        assert end <= 2048


def test_run_is_the_stages_in_order(spark, docs):
    now = docs
    for _, stage in pipeline.STAGES[:-1]:
        now = stage(spark, now, FOLDER)
    want = {(r["doc_id"], r["start"], r["ids_crc32"]) for r in pipeline.packing_stage(spark, now, FOLDER).where("start = 0").select("doc_id", "start", "ids_crc32").collect()}
    got = pipeline.run(spark, FOLDER)
    assert got.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert {r["doc_id"] for r in got.collect()} == {i for i, _, _ in want}


def test_messy_rows_through_all_stages(spark, messy, nothing):
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, messy, FOLDER)
        assert out.columns == list(pipeline.COLUMNS), name
        assert out.count() <= messy.count()
        assert stage(spark, nothing, FOLDER).count() == 0, name
    assert pipeline.packing_stage(spark, nothing, FOLDER).count() == 0
    assert texts(pipeline.secrets_stage(spark, messy, FOLDER)) == texts(messy)
    assert texts(pipeline.decontamination_stage(spark, messy, FOLDER)) == texts(messy)
    kept = [(r["doc_id"], (r["text"] or "")[:4]) for r in pipeline.dedup_stage(spark, messy, FOLDER).collect()]
    # of the repeated row one stays; empty and null texts are one group, whose smallest doc_id is 3
    assert sorted(kept, key=repr) == sorted([(1, "The "), (3, ""), (None, "The "), (5, "word"), (7, "Ünïc")], key=repr)
