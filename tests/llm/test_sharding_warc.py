import gzip
import hashlib
import uuid
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from docaudit.llm import warc
from docaudit.llm.common import new_folder, shared_folder
from docaudit.llm.sharding import shard, write_shards


def check_shards(rows, shards):
    slots, sizes = defaultdict(list), defaultdict(int)
    for r in rows:
        assert r["size"] == len((r["text"] or "").encode()) + 8 and r["law"] == "bytes" and 0 <= r["shard"] < shards
        slots[r["shard"]].append(r["slot"])
        sizes[r["shard"]] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return sizes


def test_shard_messy_rows(spark, documents, nothing):
    rows = shard(documents.withColumn("size", F.lit("clash")).withColumn("shard", F.lit(None)), 4).collect()
    check_shards(rows, 4)
    assert sorted(repr(r["text"]) for r in rows) == sorted(repr(r["text"]) for r in documents.collect())
    assert shard(nothing, 4).count() == 0


@pytest.mark.parametrize("range_bytes", [1 << 26, 2000])
def test_shards_are_even_with_a_hot_text(spark, range_bytes):
    rows = [(n, "the same text in a third of the rows " if n % 3 == 0 else f"text {n} " * (n % 7 + 1)) for n in range(6000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    sizes = check_shards(shard(df, 24, range_bytes=range_bytes).collect(), 24)
    mean = sum(sizes.values()) / 24
    assert len(sizes) == 24 and all(abs(s - mean) < 0.02 * mean for s in sizes.values())


def test_shards_with_a_row_larger_than_a_shard(spark):
    df = spark.createDataFrame([(n, "x" * (100_000 if n == 5 else 20)) for n in range(200)], "doc_id long, text string")
    check_shards(shard(df, 8).collect(), 8)


def test_write_shards(spark, documents):
    path = new_folder(spark, "shards")
    write_shards(shard(documents, 3), path)
    assert spark.read.parquet(path).count() == documents.count()


def test_shared_folder_is_a_setting_of_the_cluster():
    class Session:
        def __init__(self, **settings):
            self.conf = type("Conf", (), {"get": staticmethod(lambda key, default=None: settings.get(key, default))})()

    both = {"spark.checkpoint.dir": "hdfs://a/b/", "spark.sql.warehouse.dir": "hdfs://w/"}
    assert shared_folder(Session(**both)) == "hdfs://a/b"
    del both["spark.checkpoint.dir"]
    assert shared_folder(Session(**both)) == "hdfs://w/intermediate"


PAGES = "page_id long, url string, html string, extra string"


def archived(spark, pages, **sizes):
    folder = new_folder(spark, "archives")
    warc.write_archives(pages, folder, **sizes)
    return folder, warc.reassembled(warc.read_records(spark, folder))


def expected(rows):
    groups = defaultdict(list)
    for page_id, _, html, _ in rows:
        body = (html or "").encode()
        if len(body) >= 1000:
            groups[body].append(page_id)
    out = []
    for page_id, _, html, _ in rows:
        body = (html or "").encode()
        ids = [i for i in groups[body] if i is not None] if len(groups[body]) > 1 else []
        kept = max(ids) if ids and max(ids) != page_id else None
        out.append((page_id, len(body), hashlib.sha1(body).hexdigest(), "revisit" if kept is not None else "response", kept))
    return sorted(out, key=repr)


def test_round_trip(spark):
    long = "<p>é" * 900
    rows = [
        (1, "http://a/ b\r\nX: y", "<html>one</html>\r\n\r\nWARC/1.1\r\n", "x"), (2, None, None, None), (3, "http://c", "", None),
        (4, "u", long, None), (9, "u", long, None), (5, "u", long, None), (None, "u", long, None), (9, "u", long, None),
        (6, "u", "short twice", None), (7, "u", "short twice", None), (8, "u", "0\r\n\r\n" * 50_000, None), (8, "u", "0\r\n\r\n" * 50_000, None),
        (None, "u", "q" * 2000, None), (None, "u", "q" * 2000, None), (-3, "u", "漢" * 100_000, None),
    ]
    pages = spark.createDataFrame(rows, PAGES).withColumn("digest", F.lit("clash"))
    for sizes in ({}, {"segment": 700, "chunk": 33}):
        _, found = archived(spark, pages, **sizes)
        got = found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload", "problem").collect()
        assert all(r["problem"] is None for r in got)
        assert sorted((tuple(r)[:5] for r in got), key=repr) == expected(rows)
        for r in got:
            assert (r["payload"] is None) == (r["record_type"] == "revisit")
            assert r["payload"] is None or hashlib.sha1(r["payload"]).hexdigest() == r["payload_digest"]


def test_no_pages(spark):
    folder, _ = archived(spark, spark.createDataFrame([], PAGES))
    assert warc.reassembled(warc.read_records(spark, folder)).count() == 0


def test_records_of_a_page_parse_in_order():
    page = {"page_id": 3, "uid": 8, "url": "http://x", "body": "hello " * 100, "digest": "d", "is_revisit": False, "refers_to": None, "refers_uid": None}
    made = list(warc.records(page, segment=100, chunk=50))
    found = list(warc.parse(gzip.compress(b"\r\n\r\n".join(made) + b"\r\n\r\n")))
    assert [f["warc-type"] for f, _ in found] == ["response"] + ["continuation"] * (len(found) - 1)
    assert [int(f["warc-segment-number"]) for f, _ in found] == list(range(1, len(found) + 1))
    block = b"".join(b for _, b in found)
    assert int(found[-1][0]["warc-segment-total-length"]) == len(block) and warc.payload_of(block) == page["body"].encode()


def test_broken_records_are_told(spark):
    rows = [
        ("o1", 1, "response", None, None, 1, None, b"HTTP/1.1 200 OK\r\n\r\nab"),
        ("o1", 1, "continuation", None, None, 3, 30, b"cd"),
        ("o2", 2, "response", None, None, 1, None, b"HTTP/1.1 200 OK\r\n\r\nab"),
        ("o2", 2, "continuation", None, None, 2, 99, b"cd"),
        ("o3", 3, "response", None, None, 0, None, b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n5\r\nab"),
        ("o4", 4, "response", None, "beef", 0, None, b"HTTP/1.1 200 OK\r\n\r\nab"),
        ("o5", 5, "response", None, None, 0, None, b"HTTP/1.1 200 OK\r\ntransfer-encoding: CHUNKED\r\n\r\n2;x=y\r\nab\r\n0\r\nTrailer: 1\r\n\r\n"),
    ]
    found = {r["page_id"]: r for r in warc.reassembled(spark.createDataFrame(rows, warc.FIELDS)).collect()}
    assert all(found[n]["problem"] and found[n]["payload"] is None for n in (1, 2, 3, 4))
    assert found[5]["payload"] == b"ab" and found[5]["problem"] is None


def test_unique_folders(spark):
    assert new_folder(spark, "x") != new_folder(spark, "x") and uuid.UUID(new_folder(spark, "x").rsplit("-", 1)[1])


def test_equal_rows_are_divided(spark):
    rows = [(7, "one row that comes again and again")] * 2000 + [(100 + n, f"text {n} " * 4) for n in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    sizes = check_shards(shard(df, 24, range_bytes=3000).collect(), 24)
    mean = sum(sizes.values()) / 24
    assert len(sizes) == 24 and all(abs(s - mean) < 0.02 * mean for s in sizes.values())


def test_the_driver_looks_for_borders_alone(spark, monkeypatch):
    from docaudit.llm import sharding

    asked, true = [], sharding.splitters
    monkeypatch.setattr(sharding, "splitters", lambda sized, targets, *rest: asked.append(len(targets)) or true(sized, targets, *rest))
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.repeat(F.col("id").cast("string"), 9).alias("text"))
    check_shards(shard(df, 24, range_bytes=100).collect(), 24)
    assert asked == [23]


def test_columns_with_maps(spark, documents):
    """Spark doesn't hash maps: the operators that tell rows apart by all columns still take them."""
    from docaudit.llm.decontam import contaminated
    from docaudit.llm.secrets import find_secrets
    from docaudit.llm.simhash import near_duplicates

    df = documents.withColumn("extra", F.create_map(F.lit("a"), F.struct(F.lit(1), F.create_map(F.lit(2), F.lit(3)))))
    benchmark = spark.createDataFrame([(1, "The quick brown fox jumps over the lazy dog while seven wise owls look on")], "item_id long, text string")
    assert shard(df, 3).count() == find_secrets(df).count() == near_duplicates(df).count() == df.count()
    assert contaminated(df, benchmark).count() > 0
