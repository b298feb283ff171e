import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from docaudit.llm import simhash
from docaudit.llm.components import components
from docaudit.llm.queries import QUERIES


def plain_fingerprint(text):
    """The contract word for word."""
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    if not words:
        return 0
    shingles = [" ".join(words[n : n + 4]) for n in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprint():
    pick = random.Random(2)
    for n in range(300):
        text = "".join(pick.choice(["a", "B", "c ", " ", "\t", "\x0b", "\xa0", "É", "\x1c", " ", "word "]) for _ in range(pick.randrange(60)))
        assert simhash.fingerprint(text) == plain_fingerprint(text), repr(text)
    assert simhash.fingerprint("x y " * 9000) == plain_fingerprint("x y " * 9000)


def roots(values, limit):
    parent = {v: v for v in values}

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a in values:
        for b in values:
            if a < b and (a ^ b).bit_count() <= limit:
                low, high = sorted((find(a), find(b)))
                parent[high] = low
    return {v: find(v) for v in values}


def groups(found):
    out = {}
    for v, root in found.items():
        out.setdefault(root, set()).add(v)
    return sorted(map(sorted, out.values()))


def test_links_connect_all_within_the_limit(spark):
    pick = random.Random(7)
    values = {0, (1 << 64) - 1, 1 << 63}
    for _ in range(25):
        base = pick.getrandbits(64)
        for _ in range(pick.choice([2, 5, 40])):
            flips = pick.sample(range(64), pick.choice([0, 1, 2, 3, 4, 5, 6]))
            values.add(base ^ sum(1 << b for b in flips))
    # a chain, and a dense group of which not all pairs link
    base = pick.getrandbits(64)
    values |= {base ^ ((1 << 4 * n) - 1) for n in range(9)} | {base ^ 1 << a ^ 1 << b ^ 1 << c for a in range(3) for b in range(20, 28) for c in range(40, 46)}
    signed = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "fp long")
    for limit in (1, 3, 4, 7):
        links = simhash.links(signed, limit).collect()
        assert all(((r["a"] ^ r["b"]) & (1 << 64) - 1).bit_count() <= limit for r in links)
        found = {v: v for v in values}
        got = components(spark.createDataFrame([(r["a"], r["b"]) for r in links], "a long, b long")).collect()
        assert len({r["node"] for r in got}) == len(got)
        found |= {r["node"] % (1 << 64): r["root"] % (1 << 64) for r in got}
        assert groups(found) == groups(roots(values, limit))


def test_dense_groups_give_few_links(spark):
    """All members are within two bits of a common fingerprint, so all pairs link; rows stay in proportion to members."""
    base, members = 0x0F1E2D3C4B5A6978, set()
    for a in range(64):
        for b in range(a):
            members.add(base ^ 1 << a ^ 1 << b)
    df = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in members], "fp long")
    links = simhash.links(df)
    # two pivots for each of the 69 probes of a member, and no other pairs
    assert links.count() <= 2 * 69 * len(members) < len(members) ** 2 / 7
    assert components(links).select("root").distinct().count() == 1


def test_exploded_tables_are_not_broadcast(spark):
    """The planner doesn't count the rows that an explosion adds: probes and index are merged, however small they look."""
    found = simhash.links(spark.range(3000).select(F.xxhash64("id").alias("fp")))
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_components_of_plain_shapes(spark):
    path = [(n, n + 1) for n in range(60)]
    star = [(1000, 1000 + n) for n in range(1, 300)]
    rows = path + star + [(5000, 5000), (7, 7), (3, 2), (3, 2)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(rows, "a long, b long")).collect()}
    assert got == {n: 0 for n in range(61)} | {1000 + n: 1000 for n in range(300)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_messy_rows(spark, documents, nothing):
    clash = documents.withColumn("fp", F.lit("x")).withColumn("component", F.lit(1)).withColumn("key", F.lit(2))
    rows = simhash.near_duplicates(clash).collect()
    assert len(rows) == documents.count()
    prints = {(r["doc_id"], plain_fingerprint(r["text"] or "")) for r in documents.collect()}
    assert {(r["key"], r["fp"] % (1 << 64)) for r in rows} == prints
    at = {r["key"]: r["component"] for r in rows if r["key"] is not None}
    assert at[1] == at[2] == 1 and at[3] == at[4] == at[6] == 3 and at[5] == 5
    assert all(r["component"] == 3 for r in rows if r["fp"] == 0)
    assert simhash.near_duplicates(nothing).count() == 0


def test_query_against_all_pairs(spark):
    folder = "/root/testdata/sf0.01"
    rows = QUERIES["op3_simhash"](spark, folder).collect()
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    assert len(rows) == len(texts)
    values = {i: simhash.fingerprint(t) for i, t in texts.items()}
    assert all(r["fingerprint"] == f"{values[r['doc_id']]:016x}" for r in rows)
    prints = np.array(sorted(set(values.values())), "u8")
    parent = np.arange(len(prints))

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for n, row in enumerate(np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 4):
        for m in np.flatnonzero(row):
            low, high = sorted((find(n), find(m)))
            parent[high] = low
    root = {int(v): find(n) for n, v in enumerate(prints)}
    least = {}
    for i, v in values.items():
        least[root[v]] = min(i, least.get(root[v], i))
    assert all(r["component_id"] == least[root[values[r["doc_id"]]]] for r in rows)
