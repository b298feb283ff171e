"""Token counts by a map-side two-tier lookup.

Every executor gets one compact table of frequent pre-token lengths, bounded by the vocabulary;
what it lacks is encoded once and kept in a bounded cache of the worker. Nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docaudit.llm.pretokens import Counter, frequent

TOKENIZER = "byte_bpe_50k.json"
LIMIT = 1024


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def token_counter(spark, path: str):
    """A function from a text column to its number of tokens (null: 0)."""
    if path.endswith(".model"):
        return _pieces(path)
    tables = spark.sparkContext.broadcast(frequent(path))

    @F.arrow_udf("long")
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        counter = Counter.of(tables.value)
        for texts in batches:
            yield pa.array([counter.count(text.as_py() or "") for text in texts], pa.int64())

    return count


def _pieces(path: str):
    """The same for a piece model, whose pieces may join words and so are counted text by text."""
    with open(path, "rb") as file:
        model = file.read()

    @F.arrow_udf("long")
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import sentencepiece

        pieces = sentencepiece.SentencePieceProcessor(model_proto=model)
        for texts in batches:
            yield pa.array([len(pieces.encode(text.as_py() or "")) for text in texts], pa.int64())

    return count


def count_tokens(df: DataFrame, text: str = "text", path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """Adds n_bytes, n_tokens and over_limit to every row.

    Null and empty texts have 0 bytes and 0 tokens; special strings inside a text count as the
    tokenizer's library counts them by default. Columns of `df` with the names of the new ones
    are replaced, all others stay; repeated rows stay repeated; an empty table stays empty.
    """
    count = token_counter(df.sparkSession, path or default_tokenizer())
    whole: Column = F.coalesce(F.col(text), F.lit(""))
    sized = df.withColumn("n_tokens", count(F.col(text))).withColumn("n_bytes", F.octet_length(whole).cast("long"))
    return sized.withColumn("over_limit", F.col("n_tokens") > limit)
