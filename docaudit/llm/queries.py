"""Registered queries of this subpackage: each applies an operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docaudit.llm import quality, toxicity
from docaudit.llm.alignment import cross_alignment
from docaudit.llm.common import new_folder, table
from docaudit.llm.decontam import contaminated
from docaudit.llm.merkle import manifest
from docaudit.llm.naming import exact_duplicates
from docaudit.llm.packing import pack_texts
from docaudit.llm.secrets import BASE, described, find_secrets, of_kind
from docaudit.llm.sharding import shard
from docaudit.llm.simhash import fingerprint_text, near_duplicates
from docaudit.llm.token_counts import count_tokens
from docaudit.llm.topk import top_products
from docaudit.llm.warc import read_records, reassembled, write_archives


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    classifier = quality.train(documents, table(spark, sf_dir, "labels"))
    scored = quality.score_quality(documents, classifier, host=F.col("source"), path=F.col("lang"))
    return scored.select("doc_id", "doc_score", "host_score", "path_score", "score", "keep")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack_texts(table(spark, sf_dir, "documents"), "doc_id")
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("key").alias("doc_id"), fingerprint_text(F.col("fp")).alias("fingerprint"), F.col("component").alias("component_id"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents")).select("doc_id", "spans")
    counts = [F.size(F.filter("spans", partial(of_kind, n))).cast("long").alias(f"n_{kind}") for n, kind in enumerate(BASE)]
    base = F.filter("spans", lambda s: s["kind"] < len(BASE))
    return found.select("doc_id", *counts, F.sha2(described(base).cast("binary"), 256).alias("base_sha256"), described(F.col("spans")).alias("spans"))


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_products(table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 50 == 0)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    documents = table(spark, sf_dir, "documents")
    model = toxicity.train(documents, table(spark, sf_dir, "labels").where(~held_out))
    return toxicity.score_toxicity(documents, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "archives")
    write_archives(table(spark, sf_dir, "pages"), folder)
    pages = reassembled(read_records(spark, folder))
    return pages.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("key").alias("doc_id"), "item_id", "matched", "windows", "similarity")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    sharded = shard(table(spark, sf_dir, "documents"))
    checksum = F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32")
    return sharded.select("doc_id", "size", checksum, "law", "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    without_lines = F.replace("text", F.lit("\n"), F.lit(""))
    return manifest(table(spark, sf_dir, "documents"), ["doc_id", "source", "lang", "n_chars", "text"], "doc_id", "source", (tampered, {"text": without_lines}))


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_alignment(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_packing": op2_packing,
    "op3_simhash": op3_simhash,
    "op4_secrets": op4_secrets,
    "op5_topk": op5_topk,
    "op6_toxicity": op6_toxicity,
    "op7_token_counts": op7_token_counts,
    "op8_warc": op8_warc,
    "op9_decontamination": op9_decontamination,
    "op10_sharding": op10_sharding,
    "op11_merkle": op11_merkle,
    "op12_exact_dedup": op12_exact_dedup,
    "op13_alignment": op13_alignment,
}
