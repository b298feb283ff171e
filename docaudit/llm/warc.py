"""Web archives: records with segmented, chunked payloads, written and reassembled.

Pages become response records, or revisit records where an equal payload is kept elsewhere. Blocks
beyond a size go on in continuation records. Reading groups these by origin, orders them by segment
number, verifies the total length and undoes the chunked transfer framing. Archives are gzip files
of WARC 1.1 records in a folder that all executors reach.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SEGMENT_BYTES = 1 << 16
CHUNK_BYTES = 1 << 13
REVISIT_FROM = 1000  # bytes of the smallest payload that others revisit
RECORDS_A_FILE = 1024  # with the segment size, this bounds a file
DATE = "2000-01-01T00:00:00Z"
END = "\r\n\r\n"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"


def plan_records(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """page_id, url, body, digest, uid, is_revisit, refers_to and refers_uid for each page.

    Of pages with equal payloads of REVISIT_FROM bytes or more, that with the largest page_id is
    kept (all of them, where rows repeat that page_id) and the others revisit it, a null page_id
    counting as smallest. A group without any page_id is kept whole.
    """
    body = F.coalesce(F.col(payload), F.lit(""))
    rows = pages.select(F.col(key).alias("page_id"), F.col(url).alias("url"), body.alias("body"), F.monotonically_increasing_id().alias("uid"))
    rows = rows.withColumn("digest", F.sha1(F.col("body").cast("binary"))).withColumn("bytes", F.octet_length("body").cast("long"))
    large = rows.where(F.col("bytes") >= REVISIT_FROM).groupBy("digest", "bytes")
    kept = large.agg(F.max(F.struct("page_id", "uid")).alias("kept"), F.count("*").alias("n")).where("n > 1")
    kept = kept.select(F.col("digest").alias("kept_digest"), F.col("bytes").alias("kept_bytes"), "kept")
    joined = rows.join(kept, (F.col("digest") == F.col("kept_digest")) & (F.col("bytes") == F.col("kept_bytes")), "left")
    again = F.coalesce(F.col("kept.page_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("kept.page_id")), F.lit(False))
    return joined.select("page_id", "url", "body", "digest", "uid", again.alias("is_revisit"), F.when(again, F.col("kept.page_id")).alias("refers_to"), F.when(again, F.col("kept.uid")).alias("refers_uid"))


def _name(page_id: int | None, uid: int) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}:{uid}>"


def _record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    """A record without the two line ends that close it."""
    lines = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block


def _chunked(body: bytes, size: int) -> bytes:
    """Chunked transfer framing of a payload."""
    parts = [b"%x\r\n%b\r\n" % (len(c), c) for c in (body[n : n + size] for n in range(0, len(body), size))]
    return b"".join(parts) + b"0\r\n\r\n"


def records(page: dict, segment: int = SEGMENT_BYTES, chunk: int = CHUNK_BYTES) -> Iterator[bytes]:
    """The records of one page."""
    name, body = _name(page["page_id"], page["uid"]), page["body"].encode()
    uri = [("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", page["url"]))] if page["url"] is not None else []
    shared = [("WARC-Record-ID", name), ("WARC-Date", DATE), *uri, ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", f"sha1:{page['digest']}")]
    if page["is_revisit"]:
        kept = [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", _name(page["refers_to"], page["refers_uid"]))]
        yield _record([("WARC-Type", "revisit"), *shared, *kept], HTTP + b"Content-Length: %d\r\n\r\n" % len(body))
        return
    block = HTTP + b"Transfer-Encoding: chunked\r\n\r\n" + _chunked(body, chunk)
    if len(block) <= segment:
        yield _record([("WARC-Type", "response"), *shared], block)
        return
    yield _record([("WARC-Type", "response"), *shared, ("WARC-Segment-Number", "1")], block[:segment])
    for number, start in enumerate(range(segment, len(block), segment), 2):
        last = [("WARC-Segment-Total-Length", str(len(block)))] if start + segment >= len(block) else []
        own = [("WARC-Record-ID", name[:-1] + f":{number}>"), ("WARC-Date", DATE), ("WARC-Segment-Origin-ID", name), ("WARC-Segment-Number", str(number))]
        yield _record([("WARC-Type", "continuation"), *own, *last], block[start : start + segment])


def write_archives(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", payload: str = "html", segment: int = SEGMENT_BYTES, chunk: int = CHUNK_BYTES) -> None:
    """Writes the records of all pages as gzip archives. Null payloads are empty; a null url leaves its field out."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                made = [r for page in batch.slice(start, 256).to_pylist() for r in records(page, segment, chunk)]
                yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], ["record"])

    made = plan_records(pages, key, url, payload).mapInArrow(make, "record binary")
    text = made.select(F.col("record").cast("string").alias("value"))  # the bytes as they are
    text.write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", RECORDS_A_FILE).text(folder)


def parse(archive: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Fields and block of each record of an archive, gzip or plain."""
    data = memoryview(_inflated(archive) if archive[:2] == b"\x1f\x8b" else archive)
    whole, at = data.obj, 0
    while at < len(whole):
        end = whole.index(b"\r\n\r\n", at)
        lines = whole[at:end].decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        fields = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
        size = int(fields["content-length"])
        if end + 4 + size > len(whole):
            raise ValueError(f"record at byte {at} is cut short")
        yield fields, bytes(data[end + 4 : end + 4 + size])
        at = end + 4 + size + len(END)


def _inflated(data: bytes) -> bytes:
    """All members of a gzip file."""
    out = []
    while data:
        one = zlib.decompressobj(31)
        out.append(one.decompress(data))
        data = one.unused_data
    return b"".join(out)


def dechunked(body: bytes) -> bytes:
    """The payload under chunked transfer framing. Extensions and trailers are dropped; raises ValueError if broken."""
    parts, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].partition(b";")[0], 16)
        if not size:
            return b"".join(parts)
        if len(body) < end + 4 + size or body[end + 2 + size : end + 4 + size] != b"\r\n":
            raise ValueError("a chunk is cut short")
        parts.append(body[end + 2 : end + 2 + size])
        at = end + 4 + size


def payload_of(block: bytes) -> bytes:
    """The payload of a whole HTTP response."""
    head, gap, body = block.partition(b"\r\n\r\n")
    if not gap:
        raise ValueError("no HTTP header")
    return dechunked(body) if re.search(rb"(?mi)^transfer-encoding:\s*chunked\s*$", head) else body


FIELDS = "origin string, page_id long, record_type string, refers_to long, digest string, number long, total long, block binary"


def read_records(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each record of the archives below a folder; number is 0 for records in one piece."""

    def page(name: str | None) -> int | None:
        found = re.match(r"<urn:page:(-?\d+):", name or "")
        return int(found[1]) if found else None

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["origin", "page_id", "record_type", "refers_to", "digest", "number", "total", "block"]
        types = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
        for batch in batches:
            for content in batch["content"]:
                rows: list[tuple] = []
                for fields, block in parse(content.as_py()):
                    origin, total = fields.get("warc-segment-origin-id", fields["warc-record-id"]), fields.get("warc-segment-total-length")
                    rows.append((origin, page(origin), fields["warc-type"], page(fields.get("warc-refers-to")), fields.get("warc-payload-digest", "").removeprefix("sha1:") or None, int(fields.get("warc-segment-number", 0)), total and int(total), block))
                    if len(rows) == 256:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", "true").load(folder)
    return files.select("content").mapInArrow(read, FIELDS)


def reassembled(found: DataFrame) -> DataFrame:
    """page_id, record_type, refers_to, payload_bytes, payload_digest, payload and problem for each whole record.

    Segments of one origin are put in order; missing or surplus ones, a wrong total length, broken
    framing or a digest that differs from the stated one make the payload null and give `problem`.
    A revisit has no payload of its own: its size and digest are as its record states them.
    """
    single = found.where("number = 0").select("page_id", "record_type", "refers_to", "digest", F.lit(None).cast("long").alias("total"), F.array("block").alias("blocks"), F.array(F.lit(1).cast("long")).alias("numbers"))
    several = (
        found.where("number > 0")
        .groupBy("origin")
        .agg(F.max("page_id").alias("page_id"), F.max(F.when(F.col("record_type") != "continuation", F.col("record_type"))).alias("record_type"), F.max("refers_to").alias("refers_to"), F.max("digest").alias("digest"), F.max("total").alias("total"), F.array_sort(F.collect_list(F.struct("number", "block"))).alias("parts"))
        .select("page_id", "record_type", "refers_to", "digest", F.coalesce("total", F.lit(-1).cast("long")).alias("total"), F.col("parts.block").alias("blocks"), F.col("parts.number").alias("numbers"))
    )

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                rows = batch.slice(start, 256).to_pylist()
                for row in rows:
                    row |= {"payload": None, "payload_bytes": None, "problem": None}
                    block, numbers, total = b"".join(row.pop("blocks")), row.pop("numbers"), row.pop("total")
                    try:
                        if numbers != list(range(1, len(numbers) + 1)):
                            raise ValueError("segments are missing or repeated")
                        if total is not None and total != len(block):
                            raise ValueError("the total length differs")
                        if row["record_type"] == "revisit":
                            length = re.search(rb"(?mi)^content-length:\s*(\d+)\s*$", block)
                            row["payload_bytes"] = int(length[1]) if length else None
                        else:
                            row["payload"] = payload_of(block)
                    except ValueError as wrong:
                        row["problem"] = str(wrong)
                yield pa.RecordBatch.from_pylist(rows, schema)

    schema = pa.schema([("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("digest", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("problem", pa.string())])
    joined = single.unionByName(several).mapInArrow(whole, "page_id long, record_type string, refers_to long, digest string, payload binary, payload_bytes long, problem string")
    checked = joined.withColumn("seen", F.sha1("payload")).withColumn("problem", F.coalesce("problem", F.when(F.col("seen") != F.col("digest"), "the digest differs")))
    return checked.select("page_id", "record_type", "refers_to", F.coalesce("payload_bytes", F.octet_length("payload").cast("long")).alias("payload_bytes"), F.coalesce("seen", "digest").alias("payload_digest"), F.when(F.col("problem").isNull(), F.col("payload")).alias("payload"), "problem")
