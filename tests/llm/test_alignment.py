"""Cross-tokenizer alignment against a brute-force version."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from docaudit.llm.alignment import Aligned, Aligner, cross_alignment, piece_bytes, tokenizers
from docaudit.llm.pretokens import _bytes_of

NONE = dict(n_a=0, n_b=0, n_groups=0, n_links=0, groups_sha256="")


@pytest.fixture(scope="module")
def libraries():
    first = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    first.encode_special_tokens = True
    return first, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def spans(parts):
    out, at = [], 0
    for ident, size in parts:
        out.append((ident, at, at + size))
        at += size
    return out


def plain(libraries, text):
    """Links by comparing byte ranges, groups by common ends; straight from the definition."""
    first, second = libraries
    if not text:
        return NONE, []
    byte_of, whole = _bytes_of(), (" " + text).encode()
    encoded = first.encode(" " + text, add_special_tokens=False)
    a = [(n, b"".join(byte_of[c] for c in first.id_to_token(n))) for n in encoded.ids]
    b = [(n, piece_bytes(second.id_to_piece(n))) for n in second.encode(text)]
    if b"".join(x for _, x in a) != whole or b"".join(x for _, x in b) != whole:
        return NONE, []
    a, b = spans([(n, len(x)) for n, x in a]), spans([(n, len(x)) for n, x in b])
    links, start = [], 0
    for i, low, high in a:
        while b[start][2] <= low:
            start += 1
        at = start
        while at < len(b) and b[at][1] < high:
            links.append((i, b[at][0]))
            at += 1
    common = sorted({e for _, _, e in a} & {e for _, _, e in b})
    groups, i, j = [], 0, 0
    for end in common:
        k, m = i, j
        while k < len(a) and a[k][2] <= end:
            k += 1
        while m < len(b) and b[m][2] <= end:
            m += 1
        groups.append(",".join(str(x[0]) for x in a[i:k]) + "|" + ",".join(str(x[0]) for x in b[j:m]))
        i, j = k, m
    return dict(n_a=len(a), n_b=len(b), n_groups=len(common), n_links=len(links), groups_sha256=hashlib.sha256(";".join(groups).encode()).hexdigest()), links


def expected(libraries, texts):
    found = [plain(libraries, t) for t in texts]
    counts = Counter(pair for _, links in found for pair in set(links))
    highest = defaultdict(int)
    for (a, _), n in counts.items():
        highest[a] = max(highest[a], n)
    return [row | dict(n_best=sum(counts[p] == highest[p[0]] for p in links), count_sum=sum(counts[p] for p in links)) for row, links in found]


HARD = [
    None, "", " ", "a", "  two  spaces ", "line\none\n\n two\t\ttabs\r\nreturn;\r\n", "<|endoftext|> and <s> <unk> <0x41>", "▁ piece sign", "Ünïcödé 漢字 😀 ² \x1c end　wide",
    "x" * 3000, " " * 500 + "far", "don't we'll I'm 12,345.67 $5 €9", "tail \n ", "\n", "​zero sep", "naïve café—dash “quoted”", "a\x00b",
]


def rows(frame):
    names = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    return {r["doc_id"]: {n: r[n] for n in names} for r in frame.collect()}


@pytest.mark.parametrize("most", [500_000, 3, 0])
def test_hard_texts(spark, libraries, most):
    texts = HARD + ["A plain text that comes twice."] * 2
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("pairs", F.lit(1)).withColumn("row", F.lit("x"))
    want = expected(libraries, texts)
    got = rows(cross_alignment(df, most=most))
    assert [got[n] for n in range(len(texts))] == want
    assert want[6]["n_a"] and not want[7]["n_a"]  # special strings are text; a sign read as a space isn't


def test_real_texts(spark, libraries):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in df.collect()}
    want = dict(zip(texts, expected(libraries, list(texts.values()))))
    assert rows(cross_alignment(df, most=1000)) == want


def test_null_and_repeated_keys(spark):
    df = spark.createDataFrame([(None, "one text"), (None, "one text"), (5, "one text"), (5, None)], "doc_id long, text string")
    found = cross_alignment(df).orderBy("doc_id", "n_a").collect()
    assert [(r["doc_id"], r["n_a"] > 0) for r in found] == [(None, True), (None, True), (5, False), (5, True)]
    assert found[0]["count_sum"] == 3 * found[0]["n_links"] == 3 * found[0]["n_best"]


def test_empty_table(spark):
    assert cross_alignment(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 4), min_size=1, max_size=40), st.lists(st.integers(1, 4), min_size=1, max_size=40))
def test_pointer_jumping(first, second):
    short = sum(first) - sum(second)
    (second if short > 0 else first).extend([1] * abs(short))
    a, b = np.cumsum(first), np.cumsum(second)
    found = Aligned(a, b)
    common = sorted(set(a.tolist()) & set(b.tolist()))
    assert b[found.last].tolist() == common
    assert found.of_first.tolist() == np.searchsorted(common, a).tolist() and found.of_second.tolist() == np.searchsorted(common, b).tolist()
    low = lambda ends, n: 0 if n == 0 else ends[n - 1]
    links = [(i, j) for i in range(len(a)) for j in range(len(b)) if max(low(a, i), low(b, j)) < min(a[i], b[j])]
    assert list(zip(found.link_first.tolist(), found.link_second.tolist())) == links


def test_units_and_whole_texts_agree():
    aligner = Aligner(tokenizers())
    for text in HARD:
        if text:
            by_unit = aligner.align([text])[0]
            aligner.units, units = lambda t: [t], aligner.units
            whole = aligner.align([text])[0]
            aligner.units = units
            assert by_unit[:5] == whole[:5] and by_unit[5].tolist() == whole[5].tolist() and by_unit[6].tolist() == whole[6].tolist()


def test_cache_starts_anew(monkeypatch):
    monkeypatch.setattr("docaudit.llm.alignment.HELD_UNITS", 3)
    aligner = Aligner(tokenizers())
    texts = ["one two three four five", "six seven one two", "five six"]
    assert [aligner.align([t])[0][:5] for t in texts] == [Aligner(tokenizers()).align([t])[0][:5] for t in texts]
    assert len(aligner.place) < 6
