"""Rule-based claim mining, as array expressions on the extract row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docaudit import fixed as fx
from docaudit.functions.plan import settle
from docaudit.functions import text as tx
from docaudit.functions.marks import marked, marks


def mine_claims(
    extracts: DataFrame,
    max_claims: int | None = None,
    min_claims: int | None = None,
    max_chars: int | None = None,
) -> DataFrame:
    """Add ``claims``: claim-like first sentences first, then the rest, in document order.

    If no paragraph gives a sentence of 12 characters, the non-empty ones stand in. With
    ``max_claims`` the column ``claims_left_out`` counts those beyond it; ``min_claims`` then
    limits the stand-ins further.
    """
    df = extracts.withColumn(
        "cand",
        F.transform(
            "paragraphs",
            lambda p: F.struct(
                tx.claim_text(p["text"], max_chars).alias("text"),
                p["para_id"].alias("para_id"),
                F.length(tx.js_trim(p["text"])).alias("chars"),
            ),
        ),
    )
    long_enough = F.filter(
        "cand",
        lambda c: (c["chars"] >= fx.CLAIM_MIN_CHARS)
        & (F.length(c["text"]) >= fx.CLAIM_MIN_CHARS),
    )
    df = settle(settle(df).withColumn("src", long_enough))
    df = settle(df.withColumn("likes", marks(F.transform("src", lambda c: c["text"]), [fx.CLAIM_PATTERNS])))
    like = lambda i: marked(F.get("likes", i), 0)
    likely = F.filter("src", lambda c, i: like(i))
    others = F.filter("src", lambda c, i: ~like(i))
    ranked = tx.first_items(F.concat(likely, others), max_claims)
    limits = [n for n in (max_claims, max(3, min_claims) if min_claims else None) if n is not None]
    short = F.filter("cand", lambda c: F.length(c["text"]) > 0)
    stand_ins = tx.first_items(short, min(limits) if limits else None)
    if limits:
        all_of = F.when(F.size("src") > 0, F.size("src")).otherwise(F.size(short))
        used = F.when(F.size("src") > 0, F.size(ranked)).otherwise(F.size(stand_ins))
        df = df.withColumn("claims_left_out", all_of - used)
    df = df.withColumn("picked", F.when(F.size("src") > 0, ranked).otherwise(stand_ins))
    claims = F.transform(
        "picked",
        lambda c, i: F.struct(
            F.format_string("claim_%d", i + 1).alias("claim_id"),
            c["text"].alias("text"),
            F.array(c["para_id"]).alias("para_ids"),
        ),
    )
    return settle(df.withColumn("claims", claims).drop("cand", "src", "likes", "picked"))


def claim_table(mined: DataFrame) -> DataFrame:
    """Child table (doc_id, ord, claim_id, text, para_ids)."""
    return mined.select("doc_id", F.posexplode("claims").alias("pos", "c")).select(
        "doc_id", (F.col("pos") + 1).alias("ord"), "c.claim_id", "c.text", "c.para_ids"
    )
