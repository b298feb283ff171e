"""Artifacts and results on storage; plain Spark readers and writers."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docaudit.functions import text as tx
from docaudit.operators.archive import is_pdf


def read_artifacts(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Raw artifacts (path, length, content); a missing path raises AnalysisException."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern)
    return files.option("recursiveFileLookup", "true").load(path).select("path", "length", "content")


def decode_artifacts(files: DataFrame) -> DataFrame:
    """Text artifacts (path, text)."""
    return files.select("path", tx.decode_bytes(F.col("content")).alias("text"))


def split_pdfs(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(files with the PDF magic bytes, rejects)."""
    ok = is_pdf(F.col("content"))
    return files.where(ok), files.where(~ok).select("path", F.lit("invalid pdf header").alias("reason"))


BUCKETS = 64


def bucket_of(key: str, buckets: int = BUCKETS) -> Column:
    """One of a bounded number of folders for a key."""
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def write_documents(df: DataFrame, path: str, key: str | None = None, fmt: str = "json", buckets: int = BUCKETS, run: str | None = None) -> None:
    """Extract or result rows, one object per analysis (JSON lines) or Parquet.

    With ``key`` the rows lie in a bounded number of buckets of it; the key stays a column. With
    ``run`` they lie in folders of that run too, which a repeated write replaces: a run that is done
    again leaves the rows it left before. Without it each write appends.
    """
    folders = ([] if run is None else ["run"]) + ([] if key is None else ["bucket"])
    rows = df if run is None else df.withColumn("run", F.lit(run))
    writer = (rows if key is None else rows.withColumn("bucket", bucket_of(key, buckets))).write.format(fmt)
    # only the folders that get rows are replaced; a run's rows keep their buckets, so that is all of them
    writer = writer.mode("append") if run is None else writer.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    (writer.partitionBy(*folders) if folders else writer).save(path)


def read_documents(spark: SparkSession, path: str, schema) -> DataFrame:
    """Stored result documents with a fixed schema."""
    return spark.read.schema(schema).json(path)


def write_texts(df: DataFrame, path: str, text: str, key: str, buckets: int = BUCKETS, run: str | None = None) -> None:
    """Raw files, diffs and HTML with their id, in a bounded number of buckets."""
    write_documents(df.select(key, F.col(text).alias("text")), path, key, "parquet", buckets, run)


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("bucket", "run")


def append_records(df: DataFrame, path: str, run: str | None = None) -> None:
    """New records; with ``run`` a retried insert replaces what it wrote before."""
    write_documents(df, path, fmt="parquet", run=run)


def write_indexed(df: DataFrame, path: str, key: str, buckets: int = BUCKETS, run: str | None = None) -> None:
    """Records that ``lookup`` finds without reading the others.

    A bucket is one sorted file, so that the ranges of its row groups tell an id's place and their
    Bloom filters that it isn't there; only one folder is looked at. Rows are exchanged once.
    """
    rows = df.withColumn("bucket", bucket_of(key, buckets))
    folders = ["bucket"]
    if run is not None:
        rows, folders = rows.withColumn("run", F.lit(run)), ["run", "bucket"]
    dealt = rows.repartition(buckets, "bucket").sortWithinPartitions("bucket", key)
    writer = dealt.write.option(f"parquet.bloom.filter.enabled#{key}", "true").option("parquet.block.size", 8 << 20)
    writer = writer.mode("append") if run is None else writer.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(*folders).parquet(path)


def write_snapshot(df: DataFrame, path: str, table: str, key: str, buckets: int = BUCKETS) -> DataFrame:
    """Current rows as a table bucketed and sorted by the key, for ``records.with_changes``."""
    df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(table)
    return df.sparkSession.table(table)


def lookup(df: DataFrame, key: str, value, buckets: int | None = None) -> DataFrame:
    """Row with one id; the filter reaches the Parquet scan, and with ``buckets`` only one folder is read."""
    found = df.where(F.col(key) == F.lit(value))
    if buckets is None:
        return found
    bucket = df.sparkSession.range(1).select(F.pmod(F.xxhash64(F.lit(value).cast(df.schema[key].dataType)), F.lit(buckets))).first()[0]
    return found.where(F.col("bucket") == bucket)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, else the warehouse.

    Both are settings of the cluster. Where neither is set, the warehouse is Spark's default below
    the driver's working folder, which fits local mode alone: a cluster has to set one of them.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/intermediate"
    return found.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    for made in getattr(_SCRATCH, "made", [])[-1:]:
        made.append(path)
    return path


_SCRATCH = threading.local()


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Removes at its end the folders that were made within it: for jobs whose result is written by then."""
    held = getattr(_SCRATCH, "made", [])
    _SCRATCH.made = [*held, []]
    try:
        yield
    finally:
        paths, _SCRATCH.made = _SCRATCH.made[-1], held
        for path in paths:
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


ROWS_A_FILE = 500_000


def stored(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Writes the rows to the shared folder and reads them back.

    This cuts the lineage, survives lost executors, and tells the planner the size, so that the
    table is broadcast only where it is small. ``rows``, a bound of their number, keeps a table of
    few rows from being spread over many files.
    """
    path = new_folder(df.sparkSession, name)
    (df if rows is None else df.coalesce(max(1, -(-rows // ROWS_A_FILE)))).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
