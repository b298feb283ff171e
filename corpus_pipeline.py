"""The corpus pipeline: quality, near-duplicates, benchmark leaks, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its decisions take effect on the
rows that the next one gets. All but the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docaudit.llm import quality
from docaudit.llm.common import new_folder, stored, table
from docaudit.llm.decontam import contaminated
from docaudit.llm.packing import pack_texts
from docaudit.llm.secrets import find_secrets, redacted
from docaudit.llm.simhash import near_duplicates

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is below one half go."""
    classifier = quality.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    scored = quality.score_quality(docs.select(*COLUMNS), classifier, host=F.col("source"), path=F.col("lang"))
    return scored.where("keep").select(*COLUMNS)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates one document stays: that with the smallest doc_id, null last."""
    own = docs.select(*COLUMNS)
    found = near_duplicates(own)
    order = F.struct(F.col("key").isNull().alias("none"), F.col("key"), F.col("row_hash"))
    kept = found.groupBy("root").agg(F.min(order).alias("first"))
    kept = stored(kept.select(F.col("first.row_hash").alias("__row")).distinct(), "kept", own.count())
    left = own.withColumn("__row", F.xxhash64(*COLUMNS)).join(kept, "__row")
    return left.dropDuplicates(["__row"]).select(*COLUMNS)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    own = docs.select(*COLUMNS)
    leaks = stored(contaminated(own, table(spark, sf_dir, "benchmark")).select(F.col("row_hash").alias("__row")).distinct(), "leaks", own.count())
    return own.withColumn("__row", F.xxhash64(*COLUMNS)).join(leaks, "__row", "left_anti").select(*COLUMNS)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the texts; all documents stay."""
    found = find_secrets(docs.select(*COLUMNS))
    masked = found.withColumn("text", F.when(F.col("text").isNotNull(), redacted(F.col("text"), F.col("spans"))))
    changed = F.when(F.size("spans") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return masked.withColumn("n_chars", changed).select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces with their place in training sequences."""
    packed = pack_texts(docs, "doc_id")
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("quality classifier", quality_stage),
    ("simhash near-dedup", dedup_stage),
    ("benchmark decontamination", decontamination_stage),
    ("secret scans", secrets_stage),
    ("packing", packing_stage),
]

# No stage can be expressed in SQL; the tests hold each one against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to `documents`, each written as Parquet to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = new_folder(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
