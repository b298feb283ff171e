import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from docaudit.llm.packing import Limits, Packer, pack_texts
from docaudit.llm.pretokens import Counter, Encoder, frequent
from docaudit.llm.token_counts import count_tokens, default_tokenizer


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(default_tokenizer())


def test_encoder_and_counter_match_the_library(library):
    tables = frequent(default_tokenizer())
    encoder, counter = Encoder(tables), Counter(tables, held=200)
    pick = random.Random(3)
    signs = " \n\t'stredmlvSTé\x1c\x85²½՘٣  \U0001f600漢ß0189$<|endoftext|>_-.́"
    for n in range(4000):
        text = "".join(pick.choice(signs) for _ in range(pick.randrange(40))) + ("<|endoftext|>a" if n % 7 == 0 else "")
        ids = library.encode(text, add_special_tokens=False).ids
        assert encoder.ids(text).tolist() == ids and counter.count(text) == len(ids), repr(text)


def test_long_runs(library):
    encoder = Encoder(frequent(default_tokenizer()))
    for text in (" " * 200_000 + "a", "\n" * 600_000 + "a", "z" * 100_000):
        assert encoder.ids(text).tolist() == library.encode(text, add_special_tokens=False).ids


def test_count_tokens(spark, documents, nothing, library):
    rows = count_tokens(documents.withColumn("n_tokens", F.lit("clash")).withColumn("extra", F.lit(1))).collect()
    assert len(rows) == documents.count() and all(r["extra"] == 1 for r in rows)
    for r in rows:
        n = len(library.encode(r["text"] or "", add_special_tokens=False).ids)
        assert (r["n_tokens"], r["n_bytes"], r["over_limit"]) == (n, len((r["text"] or "").encode()), n > 1024)
    assert count_tokens(nothing).count() == 0


def test_other_tokenizers(spark):
    import public_tokenizers
    import sentencepiece

    texts = ["Hello wide  world", "", "don't <|endoftext|> stop"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    path = public_tokenizers.path("word_bpe_49k.json")
    words = Tokenizer.from_file(path)
    assert [r["n_tokens"] for r in count_tokens(df, path=path).collect()] == [len(words.encode(t, add_special_tokens=False).ids) for t in texts]
    path = public_tokenizers.path("piece_bpe_32k.model")
    pieces = sentencepiece.SentencePieceProcessor(model_file=path)
    assert [r["n_tokens"] for r in count_tokens(df, path=path).collect()] == [len(pieces.encode(t)) for t in texts]


def check_places(places, sizes, limits, bears):
    """Every token lies in one piece; sequences are gapless and within all limits."""
    parts, sequences = defaultdict(list), defaultdict(list)
    for row, start, n, sequence, offset in places:
        parts[row].append((start, n))
        sequences[sequence].append((offset, n, row))
    for row, size in enumerate(sizes):
        at = 0
        for start, n in sorted(parts[row]):
            assert start == at and n > 0
            at += n
        assert at == size
    for held in sequences.values():
        at = 0
        for offset, n, _ in sorted(held):
            assert offset == at
            at += n
        assert at <= limits.tokens and len(held) <= limits.segments
        assert sum(n for _, n, row in held if bears[row]) <= limits.loss_tokens
    return [sum(n for _, n, _ in held) for held in sequences.values()]


@pytest.mark.parametrize("cut", [True, False])
@pytest.mark.parametrize("limits", [Limits(64, 4, 20), Limits(64, 64, 64), Limits(1, 1, 1)])
def test_packer_keeps_all_limits(cut, limits):
    pick = random.Random(5)
    sizes = [pick.choice([1, 2, 7, 30, 63, 64, 65, 200]) for _ in range(300)]
    bears = [pick.random() < 0.4 for _ in sizes]
    packer = Packer(limits, cut, waiting=32)
    places = [p for n, size in enumerate(sizes) for p in packer.add(n, size, bears[n])] + list(packer.finish())
    check_places(places, sizes, limits, bears)
    if not cut:
        most = [min(limits.tokens, limits.loss_tokens if b else limits.tokens) for b in bears]
        assert all(sum(p[0] == n for p in places) == -(-size // m) for n, (size, m) in enumerate(zip(sizes, most)))


def test_packing_without_padding():
    sizes = [random.Random(1).randrange(1, 900) for _ in range(500)]
    packer = Packer(Limits(256, 256, 256), True)
    places = [p for n, size in enumerate(sizes) for p in packer.add(n, size, True)] + list(packer.finish())
    lengths = check_places(places, sizes, Limits(256, 256, 256), [True] * len(sizes))
    assert all(n & (n - 1) == 0 for n in lengths)


def test_pack_texts(spark, documents, nothing, library):
    packed = pack_texts(documents.withColumn("ids", F.lit(0)).withColumn("start", F.lit("clash")), "doc_id").collect()
    want = sorted(np.array(library.encode(t or "", add_special_tokens=False).ids + [1], "<u4").tobytes() for (t,) in documents.select("text").collect())
    whole, runs = [], defaultdict(list)
    for r in packed:
        assert len(r["ids"]) == 4 * r["length"] == 4 * r["loss_tokens"]
        runs[r["sequence_id"]].append((r["offset"], r["length"]))
    # rows with equal keys are told apart by the pieces following each other
    by_key = defaultdict(list)
    for r in packed:
        by_key[(r["doc_id"], r["doc_tokens"])].append(r)
    for (_, tokens), rows in by_key.items():
        at = defaultdict(list)
        for r in rows:
            at[r["start"]].append(r)
        while at.get(0):
            start, text = 0, b""
            while start < tokens:
                r = at[start].pop()
                text, start = text + r["ids"], start + r["length"]
            whole.append(text)
    assert sorted(whole) == want
    for held in runs.values():
        end = 0
        for offset, n in sorted(held):
            assert offset == end
            end += n
        assert end <= 2048
    assert pack_texts(nothing, "doc_id").count() == 0


def test_loss_bearing_turns(spark):
    turns = spark.createDataFrame([(n, role, "some words here " * 9) for n in range(40) for role in ("user", "assistant", None)], "conv_id long, role string, text string").coalesce(1)
    packed = pack_texts(turns, "conv_id", loss=F.col("role") == "assistant", limits=Limits(128, 8, 40), cut=False)
    held = packed.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.sum("loss_tokens").alias("loss"), F.count("*").alias("parts")).collect()
    assert all(r["n"] <= 128 and r["loss"] <= 40 and r["parts"] <= 8 for r in held)
    assert packed.agg(F.sum("loss_tokens")).first()[0] == 40 * (len(frequent_ids("some words here " * 9)) + 1)


def frequent_ids(text):
    return Encoder(frequent(default_tokenizer())).ids(text)


def test_checksum_of_ids(spark, documents):
    row = pack_texts(documents.where("doc_id = 2"), "doc_id").withColumn("crc", F.crc32("ids")).first()
    assert row["crc"] == zlib.crc32(row["ids"])


@pytest.mark.parametrize("size", [1, 3, 5, 7])
def test_tiny_examples_need_little_padding(size):
    """A sequence that the limit of segments closes short is cut into powers of two as well."""
    sizes = [size] * 6000
    packer = Packer(Limits(), True)
    places = [p for n, tokens in enumerate(sizes) for p in packer.add(n, tokens, True)] + list(packer.finish())
    lengths = check_places(places, sizes, Limits(), [True] * len(sizes))
    assert all(n & (n - 1) == 0 for n in lengths)


def test_a_binding_loss_limit_leaves_no_padding():
    pick = random.Random(3)
    sizes, limits = [pick.randrange(1, 90) for _ in range(800)], Limits(256, 16, 64)
    bears = [pick.random() < 0.7 for _ in sizes]
    packer = Packer(limits, True, waiting=64)
    places = [p for n, tokens in enumerate(sizes) for p in packer.add(n, tokens, bears[n])] + list(packer.finish())
    assert all(n & (n - 1) == 0 for n in check_places(places, sizes, limits, bears))
