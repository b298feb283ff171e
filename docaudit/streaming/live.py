"""Streaming forms: rate limit, latest status, trace append."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docaudit import fixed as fx
from docaudit.operators.ratelimit import open_windows, rate_limit
from docaudit.operators.records import latest_row, latest_status
from docaudit.sources.storage import scratch, stored

LIMIT_SCHEMA = "key string, request_id long, ts timestamp, allowed boolean, retry_after_ms long, window_start long"


def rate_limit_stream(requests: DataFrame, max_requests: int, window_ms: int, drop_silent: bool = False) -> DataFrame:
    """Streaming limiter over requests (key, request_id, ts); state is (start, count) per key.

    Every request is decided, also a late one, which counts in the window open at its arrival. The
    requests of a key are handled as they come, in time order within an Arrow batch, so that a key
    with very many of them is never in one frame; ``write_limited`` decides in time order throughout.
    The state is two numbers per key; with ``drop_silent``, for streams that run all the time, that
    of a key silent for two windows of processing time is dropped, since its next request opens a
    window anyway.
    """

    def decide(key: tuple, frames: Iterator, state) -> Iterator:
        import numpy as np
        import pandas as pd

        if state.hasTimedOut:
            state.remove()
            return
        start, count = state.get if state.exists else (None, 0)
        for rows in frames:
            rows = rows.sort_values(["ts", "request_id"])
            at = (rows["ts"].astype("int64") // {"ns": 10**6, "us": 10**3, "ms": 1}[np.datetime_data(rows["ts"].dtype)[0]]).to_numpy()
            allowed, starts, i = np.zeros(len(at), bool), np.zeros(len(at), "int64"), 0
            while i < len(at):
                if start is None or at[i] - start >= window_ms:
                    start, count = int(at[i]), 0
                end = int(np.searchsorted(at, start + window_ms))
                allowed[i : min(end, i + max_requests - count)] = True
                count, starts[i:end] = min(max_requests, count + end - i), start
                i = end
            retry = pd.Series(window_ms - (at - starts), dtype="Int64").where(~allowed)
            yield pd.DataFrame(
                {
                    "key": key[0], "request_id": rows["request_id"].to_numpy(), "ts": rows["ts"].to_numpy(),
                    "allowed": allowed, "retry_after_ms": retry, "window_start": starts,
                }
            )
        if start is not None:
            state.update((start, count))
        if drop_silent:
            state.setTimeoutDuration(2 * window_ms)

    req = requests.select(F.col("key").cast("string").alias("key"), "request_id", "ts")
    return req.groupBy("key").applyInPandasWithState(
        decide, LIMIT_SCHEMA, "start long, count long", "append", "ProcessingTimeTimeout" if drop_silent else "NoTimeout"
    )


FOLD_EVERY = 16  # batches after which the open windows are written as a whole


def open_windows_before(spark: SparkSession, path: str, number: int) -> DataFrame | None:
    """(key, start, count) as a batch finds them: the last whole state and the changes since."""
    whole = (number - 1) // FOLD_EVERY * FOLD_EVERY
    folders = ([f"{path}/open/whole={whole}"] if whole > 0 else []) + [f"{path}/open/batch={n}" for n in range(max(0, whole), number)]
    if not folders:
        return None
    parts = [spark.read.schema("key string, start long, count long").parquet(f).withColumn("n", F.lit(n)) for n, f in enumerate(folders)]
    return latest_row(reduce(DataFrame.unionAll, parts), ["key"], ["n"]).drop("n")


def write_limited(requests: DataFrame, path: str, checkpoint: str, max_requests: int, window_ms: int):
    """Decide the requests (key, request_id, ts) of each micro-batch in time order and append the decisions.

    A batch goes through the limiter for tables, with the windows that earlier batches left open, so
    that a key of any size is spread over tasks; a late request counts in the window open at its
    batch. Decisions and changed windows lie in a folder of the batch, which a repeated batch
    replaces; a batch reads at most FOLD_EVERY folders of changes. ``read_limited`` gives the decisions.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        with scratch(spark):
            opened = open_windows_before(spark, path, number)
            if opened is not None and number % FOLD_EVERY == 0:
                opened.write.mode("overwrite").parquet(f"{path}/open/whole={number}")
            opened = opened and stored(opened, "open")
            given = stored(batch.select(F.col("key").cast("string").alias("key"), "request_id", "ts"), "requests")
            folder = f"{path}/decided/batch={number}"
            rate_limit(given, max_requests, window_ms, opened).write.mode("overwrite").parquet(folder)
            changed = open_windows(spark.read.schema(LIMIT_SCHEMA).parquet(folder), max_requests, opened)
            changed.write.mode("overwrite").parquet(f"{path}/open/batch={number}")

    return requests.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(write)


def read_limited(spark: SparkSession, path: str) -> DataFrame:
    """The decisions written so far, with their batch."""
    return spark.read.schema(LIMIT_SCHEMA + ", batch int").option("basePath", f"{path}/decided").parquet(f"{path}/decided/batch=*")


def latest_status_stream(updates: DataFrame, key: str = "analysis_id") -> DataFrame:
    """Streaming form of ``latest_status`` (update mode); state is one row per analysis."""
    return latest_status(updates, key, ["seq"])


def write_latest(stream: DataFrame, path: str, checkpoint: str, key: str = "analysis_id", buckets: int = 64):
    """Append each batch of changed rows to a table of changes; ``read_latest`` gives the current rows.

    A batch writes its own rows only, into its own folder, so that its cost follows the batch and
    a repeated batch gives the same result. Rows lie in a bounded number of buckets of the key, each a
    file a batch: they are dealt by bucket, or every task would open a file for every bucket. Every
    FOLD_EVERY batches the rows current before the batch are written as a whole, so that readers fold
    at most that many changes.
    """

    def put(rows: DataFrame, folder: str) -> None:
        bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
        dealt = rows.withColumn("bucket", bucket).repartition(buckets, "bucket")
        dealt.write.mode("overwrite").partitionBy("bucket").parquet(folder)

    def write(batch: DataFrame, number: int) -> None:
        if number and number % FOLD_EVERY == 0:
            put(read_latest(batch.sparkSession, path, key, number), f"{path}/whole={number}")
        put(batch, f"{path}/batch={number}")

    return (
        stream.writeStream.outputMode("update")
        .option("checkpointLocation", checkpoint)
        .foreachBatch(write)
    )


def _numbers(spark: SparkSession, path: str, name: str) -> list[int]:
    """The numbers of a folder's parts `name=number`, once they are written."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [f.getPath() for f in files.listStatus(root)] if files.exists(root) else []
    done = [p for p in names if p.getName().startswith(f"{name}=") and files.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return sorted(int(p.getName().split("=")[1]) for p in done)


def read_latest(spark: SparkSession, path: str, key: str = "analysis_id", before: int | None = None) -> DataFrame:
    """Current row of each key from the last whole table and the changes written since.

    ``before`` gives the rows as a batch of that number finds them.
    """
    there = lambda n: before is None or n < before
    whole = max(filter(there, _numbers(spark, path, "whole")), default=0)
    parts = [f"{path}/whole={whole}"] * (whole > 0) + [f"{path}/batch={n}" for n in _numbers(spark, path, "batch") if n >= whole and there(n)]
    if not parts:  # nothing is marked as written: the changes alone tell it too
        changes = spark.read.option("basePath", path).parquet(f"{path}/batch=*").drop("bucket")
        return latest_row(changes, [key], ["batch"]).drop("batch")
    rows = [spark.read.parquet(p).drop("bucket").withColumn("batch", F.lit(n)) for n, p in enumerate(parts)]
    return latest_row(reduce(DataFrame.unionByName, rows), [key], ["batch"]).drop("batch")


def compact_latest(spark: SparkSession, path: str, target: str, key: str = "analysis_id", buckets: int = 64) -> None:
    """Write the current rows as the first batch of a new table, for readers to move over to."""
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
    read_latest(spark, path, key).withColumn("bucket", bucket).write.partitionBy("bucket").parquet(f"{target}/batch=0")


def trace_progress_stream(entries: DataFrame, key: str = "doc_id") -> DataFrame:
    """Streaming form of ``trace_progress`` (update mode); state is one set of bits per run, a bit for each role.

    ``write_latest`` writes it with the run as key.
    """
    bits = {role: 1 << n for n, role in enumerate(fx.AGENT_ROLES)}
    bit = reduce(lambda c, kv: c.when(F.col("role") == kv[0], kv[1]), bits.items(), F).otherwise(0)
    df = entries.groupBy(key).agg(F.bit_or(bit).alias("seen"))
    missing = [F.when(F.col("seen").bitwiseAND(F.lit(b)) == 0, role) for role, b in bits.items()]
    done = F.bit_count("seen")
    percent = F.floor(done * 100 / len(bits) + 0.5).cast("int")
    return df.select(key, done.alias("done"), percent.alias("percent"), F.coalesce(*missing).alias("first_missing"))


def append_trace(stream: DataFrame, path: str, checkpoint: str):
    """Append trace entries as they arrive; a batch replaces its own folder when repeated."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return (
        stream.writeStream.outputMode("append")
        .option("checkpointLocation", checkpoint)
        .foreachBatch(write)
    )
