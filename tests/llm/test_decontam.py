import re
from collections import defaultdict

from pyspark.sql import functions as F

from docaudit.llm import decontam
from docaudit.llm.queries import QUERIES

ITEMS = [
    (0, "Alice Miller walked 12 km in 3 hours. How many km per hour did Alice Miller walk on that day?"),
    (1, "The train from Paris leaves at 9 and reaches Lyon at 11, so how long does the whole journey take?"),
    (2, "too short"),
    (3, None),
    (4, "12 13 14 15 16 17 18 19 20 21"),
    (None, "An item without any key is never matched by a document at all."),
]
FILLER = "Some other sentence goes here and then another one follows after it. "


def run(spark, texts, items=ITEMS):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    return sorted((r["key"], r["item_id"]) for r in decontam.contaminated(docs, bench).collect())


def test_copies_and_other_parameters(spark):
    texts = [
        FILLER * 3 + ITEMS[0][1] + FILLER,  # as it is
        ITEMS[0][1].upper(),  # other case
        re.sub(" ", "\n ", ITEMS[0][1].replace(",", "")),  # other layout: names start lines
        "Bob Jones walked 45 km in 9 hours. How many km per hour did Bob Jones walk on that day?",  # other values throughout
        "Bob Jones walked 45 miles in 9 hours. How many miles per hour did Bob Jones walk on that day?",
        "The train from Rome leaves at 7 and reaches Milan at 10, so how long does the whole journey take?",
        "Bob Jones walked 45 km in 9 hours.",  # a part only
        FILLER * 50,
        "",
        None,
        "12 13 14 15 16 17 18 19 20 21",  # only placeholders
        "too short",
        ITEMS[5][1],
    ]
    assert run(spark, texts) == [(0, 0), (1, 0), (2, 0), (3, 0), (4, 0), (5, 1), (10, 4), (11, 2)]


def test_items_without_a_window_are_looked_up_whole(spark):
    items = [(0, "What is twelve?"), (1, "7 + 8 = 15"), (2, "Paris"), (3, "Why? Who knows."), (4, "..."), (5, "1 2 3 4 5 6 7")]
    texts = [
        FILLER + "What is twelve? " + FILLER,  # a sentence of its own
        "so WHAT is twelve and more",  # within another sentence
        FILLER + "7 + 8 = 15.\n\n" + FILLER,
        "7 + 8 = 16",  # other values
        "She went to Paris yesterday. It rained.",
        "The capital of France:\n\nParis\n\nNext question.",
        "He asked: why? Who knows. " + FILLER,
        "... !!!",
        "1 2 3 4 5 6 7",
        "1 2 3 4 5 6 8",
    ]
    assert run(spark, texts, items) == [(0, 0), (2, 1), (5, 2), (6, 3), (8, 5)]


def test_filter_follows_the_benchmark(spark, monkeypatch):
    items = spark.range(5000).select(F.xxhash64("id").alias("hash"))
    assert len(decontam._filter(items)) == 1 << 16
    monkeypatch.setattr(decontam, "FILTER_WORDS", (64, 1024))
    bits = decontam._filter(items)
    assert len(bits) == 1024
    for r in items.limit(50).collect():
        low = r["hash"] % (1024 * 64)
        assert int(bits[low >> 6]) >> (low & 63) & 1


def test_values_must_agree():
    windows = [{"place": n, "held": [f"16:{v}"], "seen": [f"16:{w}"]} for n, (v, w) in enumerate([("1", "5"), ("1", "5"), ("2", "6"), ("1", "7")])]
    assert decontam._agreeing(windows) == 3
    assert decontam._agreeing([]) == 0
    assert decontam._agreeing([{"place": 4, "held": [], "seen": []}] * 3) == 1


def test_inconsistent_values_are_no_match(spark):
    item = [(0, "There are 5 red boxes and 5 blue boxes with 5 green balls in each of the 5 large bags")]
    same = "There are 8 red boxes and 8 blue boxes with 8 green balls in each of the 8 large bags"
    mixed = "There are 1 red boxes and 2 blue boxes with 3 green balls in each of the 4 large bags"
    assert run(spark, [same, mixed], item) == [(0, 0)]


def test_messy_rows(spark, documents, nothing):
    bench = spark.createDataFrame([(1, "The quick brown fox jumps over the lazy dog"), (1, "The quick brown fox jumps over the lazy dog"), (None, None)], "item_id long, text string").withColumn("hash", F.lit(1))
    clash = documents.withColumn("row_hash", F.lit("x")).withColumn("item", F.lit(1)).withColumn("hash", F.lit(2)).withColumn("key", F.lit(3))
    rows = decontam.contaminated(clash, bench).collect()
    # equal rows give one pair
    assert sorted((r["key"] is None, r["key"] or 0) for r in rows) == [(False, 1), (False, 2), (True, 0)]
    assert decontam.contaminated(nothing, bench).count() == 0
    assert decontam.contaminated(documents, bench.where("false")).count() == 0


def test_query_against_plain_windows(spark):
    """Five-word windows in any case, four fifths of an item: what is found by plain search."""
    folder = "/root/testdata/sf0.01"
    tokens = lambda t: [w.lower() for w in re.findall(r"\d+(?:[.,]\d+)*|[^\W\d_]+|[$€£%]", t or "")]
    cut = lambda w: {tuple(w[n : n + 5]) for n in range(len(w) - 4)}
    items = {r["item_id"]: cut(tokens(r["text"])) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()}
    held = defaultdict(set)
    for item, windows in items.items():
        for w in windows:
            held[w].add(item)
    want = set()
    for r in spark.read.parquet(f"{folder}/documents.parquet").collect():
        counts = defaultdict(int)
        for w in cut(tokens(r["text"])):
            for item in held.get(w, ()):
                counts[item] += 1
        want |= {(r["doc_id"], item) for item, n in counts.items() if n >= 0.8 * len(items[item])}
    got = {(r["doc_id"], r["item_id"]) for r in QUERIES["op9_decontamination"](spark, folder).collect()}
    assert want and got == want


WALLS = "If {} workers build {} walls in {} shifts, how many walls do {} workers build in {} shifts when {} helps {}?"


def test_each_occurrence_has_its_own_values(spark):
    item = WALLS.format(12, 30, 5, 44, 18, "Anna", "Paul")
    variants = [WALLS.format(31, 21, 9, 20, 62, "Rosa", "Kurt"), WALLS.format(3, 77, 15, 8, 12, "Emma", "Otto")]
    crossed = WALLS.replace("workers build {} shifts", "workers build in {} shifts").format(12, 30, 5, 44, 18, "Anna", "Paul")
    texts = [
        f"{item} {variants[0]}",  # an exact copy and a variant
        f"{variants[0]} {FILLER * 2} {item}",
        f"{variants[0]} {variants[1]}",
        FILLER * 40 + f"{variants[0]} {variants[1]} {item} " + FILLER * 40,
        f"{variants[0]} {item.replace(' when ', ' in the same old town when ')}",  # words put in
        crossed,
        "If 3 workers build 4 walls in 5 shifts. How many walls do some people raise in 6 shifts? Then Rosa helps Kurt.",  # a part only
    ]
    assert run(spark, texts, [(0, item)]) == [(n, 0) for n in range(6)]


def test_best_occurrence_of_scattered_values(spark):
    """Two occurrences of which neither has values that agree."""
    item = [(0, "There are 5 red boxes and 5 blue boxes with 5 green balls in each of the 5 large bags")]
    mixed = "There are {} red boxes and {} blue boxes with {} green balls in each of the {} large bags. "
    assert run(spark, [mixed.format(1, 2, 3, 4) + mixed.format(6, 7, 8, 9), mixed.format(1, 2, 3, 4) + mixed.format(6, 6, 6, 6)], item) == [(1, 0)]


def test_names_at_starts_and_runs_of_other_length(spark):
    items = [
        (0, "Natalia sold clips to 48 of her friends in April. Natalia then sold half as many clips in May. Natalia gave 5 clips to her sister."),
        (1, "Last week Bob bought 7 apples and gave Bob's mother 3 of them. How many apples does Bob still have if 7 were bought?"),
        (2, "a shop sells 7 pens and 30 books on each day, so how many pens and how many books are sold in 7 days of work there"),
    ]
    texts = [
        items[0][1].replace("Natalia", "Brenda"),
        items[0][1].replace("Natalia", "Brenda", 1).replace("Natalia", "Carla", 1).replace("Natalia", "Doris"),  # three names for one
        items[0][1].replace("Natalia", "Ann Lee").replace("48", "seventy two"),
        FILLER + items[1][1].replace("Bob", "Ann Lee").replace("7", "twenty five") + FILLER,
        items[2][1].replace("7", "twenty-five").upper(),
        f"{items[0][1].replace('Natalia', 'Ann Lee')} {items[0][1].replace('Natalia', 'Brenda')}",
    ]
    found = run(spark, texts, items)
    assert found == [(0, 0), (2, 0), (3, 1), (4, 2), (5, 0)]
