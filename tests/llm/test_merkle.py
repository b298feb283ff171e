"""Merkle manifest against a tree built and walked in one process."""

import hashlib
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docaudit.llm.merkle import FAN, Appender, manifest
from docaudit.llm.queries import op11_merkle

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row, text):
    def one(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"

    return sha(*(one(text if f == "text" else row[f]) for f in FIELDS))


def tree(nodes):
    """The levels of a tree, from the leaves to the root."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha(*levels[-1][n : n + 3]) for n in range(0, len(levels[-1]), 3)])
    return levels


def path(levels, at):
    """Left and right siblings from a leaf up."""
    out = []
    for level in levels[:-1]:
        start = at // 3 * 3
        out.append(("".join(level[start:at]), "".join(level[at + 1 : start + 3])))
        at //= 3
    return out


def plain(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r["source"], []).append((r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(r, r["text"]), r))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        groups[s].sort(key=lambda x: x[:3])
        trees[s] = tree([x[2] for x in groups[s]])
    top = tree([trees[s][-1][0] for s in order])
    out = []
    for at_top, s in enumerate(order):
        for at, (_, _, leaf, r) in enumerate(groups[s]):
            steps = path(trees[s], at) + path(top, at_top)
            node = leaf
            if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0:
                node = leaf_of(r, r["text"] and r["text"].replace("\n", ""))
            for a, b in steps:
                node = sha(a, node, b)
            out.append((r["doc_id"], leaf, trees[s][-1][0], top[-1][0], sha(*(a + b for a, b in steps)), node, node == top[-1][0]))
    return sorted(out, key=repr)


def run(df, levels=7):
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    found = manifest(df, FIELDS, "doc_id", "source", (tampered, {"text": F.replace("text", F.lit("\n"), F.lit(""))}), levels)
    assert found.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted(map(tuple, found.collect()), key=repr)


def test_hard_rows(spark, documents):
    df = documents.withColumns({"group": F.lit("x"), "node": F.lit(1), "pos": F.create_map(F.lit(1), F.lit(2)), "total": F.lit(0)})
    rows = [r.asDict() for r in documents.collect()]
    assert run(df) == plain(rows)


@pytest.mark.parametrize("levels", [1, 2, 7])
def test_block_sizes(spark, levels):
    sizes = {None: 5, "": 1, "a": 28, "ä": 9, "b": 3, "z": 10}
    rows = [{"doc_id": 100 * n + m, "source": s, "lang": "en", "n_chars": m, "text": f"line {m}\nof {s}"} for n, (s, size) in enumerate(sizes.items()) for m in range(size)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(5)
    assert run(df, levels) == plain(rows)


def test_a_third_equal_rows(spark):
    rows = [{"doc_id": 7, "source": "hot", "lang": "en", "n_chars": 1, "text": "same\n"}] * 50 + [{"doc_id": n, "source": "hot", "lang": None, "n_chars": None, "text": None} for n in range(60)] + [{"doc_id": None, "source": "hot", "lang": None, "n_chars": None, "text": ""}] * 2
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    assert run(df, 2) == plain(rows)


def test_one_row(spark):
    rows = [{"doc_id": 1, "source": None, "lang": None, "n_chars": None, "text": None}]
    found = run(spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string"))
    assert found == plain(rows) and found[0][1] == found[0][3] and found[0][4] == sha()


def test_empty_table(spark, nothing):
    assert run(nothing) == []


def test_query(spark):
    rows = [r.asDict() for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    found = sorted(map(tuple, op11_merkle(spark, "/root/testdata/sf0.001").collect()), key=repr)
    assert found == plain(rows)
    assert {r[-1] for r in found} == {True, False}


@settings(max_examples=100, deadline=None)
@given(st.integers(1, FAN**4))
def test_appender(size):
    nodes, one = [sha(str(n)) for n in range(size)], Appender()
    for node in nodes:
        one.append(node)
    levels = tree(nodes)
    assert one.close(True) == levels[-1][0] and one.steps == [path(levels, n) for n in range(size)]
