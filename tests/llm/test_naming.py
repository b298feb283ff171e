"""Exact duplicates by block naming against plain grouping."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from docaudit.llm import naming
from docaudit.llm.naming import exact_duplicates


def plain(rows):
    """The same by a dictionary of normalised texts."""
    groups = {}
    for n, (key, text) in enumerate(rows):
        text = text or ""
        short = re.sub(r"[\x20\x09-\x0D]", "", text)
        groups.setdefault(short, []).append((-len(text), key is None, key or 0, n, key))
    out = []
    for short, held in groups.items():
        held.sort()
        out += [(m[4], held[0][4], len(held), n == 0, hashlib.sha256(short.encode()).hexdigest()) for n, m in enumerate(held)]
    return sorted(out, key=repr)


def run(spark, rows, **options):
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"name": F.lit("x"), "row": F.lit(1), "marks": F.create_map(F.lit("a"), F.lit(1))}).repartition(3)
    found = exact_duplicates(df, **options)
    assert found.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    return sorted(map(tuple, found.collect()), key=repr)


HARD = [
    (1, "a b c"), (2, "abc"), (3, "a\tb\nc  "), (3, "a\tb\nc  "), (4, None), (5, ""), (6, " \n\t\x0b\x0c\r"), (None, "abc"), (None, "xyz"), (7, "xyz"),
    (8, "abcd" * 5), (9, "abcd " * 5), (10, "abcd" * 4), (11, "abcd" * 5 + "a"), (12, "abcd" * 5 + "b"), (13, "abcdabcX" * 2), (14, "Xbcdabcd" * 2), (15, "é" * 9), (16, " é" * 9),
    (17, "é" * 9 + " "), (18, "a c"), (19, "漢字 " * 30), (20, "漢字" * 30), (21, "\x85a\xa0"), (22, "a"), (23, "abcdefgh"), (24, "efghabcd"),
]


@pytest.mark.parametrize("size", [1, 4, 1024])
def test_hard_texts(spark, size):
    assert run(spark, HARD, size=size) == plain(HARD)


def test_random_texts(spark):
    draw = random.Random(7)
    rows = [(n, "".join(draw.choice(["ab", "ba", " ", "a"]) for _ in range(draw.randrange(12)))) for n in range(400)]
    assert run(spark, rows, size=2) == plain(rows)


def test_long_and_hot_texts(spark):
    long = "".join(chr(97 + n * n % 26) for n in range(300_000))
    rows = [(n, "hot copy " * 40) for n in range(300)] + [(900, long), (901, " " + long), (902, long[:-1]), (903, long[1:])] + [(1000 + n, f"own {n}") for n in range(300)]
    assert run(spark, rows, size=64) == plain(rows)


def test_shared_marks_are_drawn_again(spark, monkeypatch):
    true, drawn = naming.mark, []

    def weak(block, draw):
        drawn.append(draw)
        return true(block, draw) if draw == 2 else [m % 2 for m in true(block, draw)]

    monkeypatch.setattr(naming, "mark", weak)
    assert run(spark, HARD, size=4) == plain(HARD)
    assert set(drawn) == {0, 1, 2}


def test_real_texts(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    assert sorted(map(tuple, exact_duplicates(df).collect()), key=repr) == plain(rows)


def test_empty_table(spark):
    assert exact_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_no_python_on_the_way(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = exact_duplicates(df)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
