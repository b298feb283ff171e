"""Evidence audit: how well paragraphs support claims.

Two forms share one severity ladder.

``audit_documents`` claims and paragraphs sit in the same extract row. Each row is scored on its
                    own by an inverted index of its paragraphs: map-only, nothing is shuffled.
``audit_tables``    claims and paragraphs are separate tables (for example one claim list
                    against a whole corpus). They meet in equi-joins on a claim's rarer tokens.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docaudit import fixed as fx
from docaudit.functions.plan import settle
from docaudit.functions import text as tx
from docaudit.sources.storage import stored


def finding_code(
    best: Column, coverage: Column, strong: Column, n_paras: Column, claim_q: Column, para_q: Column
) -> Column:
    """The ladder; null means the claim is well supported."""
    return (
        F.when((n_paras == 0) | (best < fx.HIGH_BELOW), "no_evidence")
        .when((coverage < fx.COVERAGE_BELOW) | (strong == 0), "narrow_evidence")
        .when(claim_q & ~para_q, "numbers_unsupported")
        .when((best < fx.LOW_BELOW) | (n_paras < 2), "thin_evidence")
    )


def code_severity(code: Column) -> Column:
    return (
        F.when(code == "no_evidence", "HIGH")
        .when(code.isin("narrow_evidence", "numbers_unsupported"), "MEDIUM")
        .when(code == "thin_evidence", "LOW")
    )


def evidence_reason(code: Column, best: Column, avg: Column, coverage: Column) -> Column:
    """Sentence for a finding code."""

    values = {"best": best, "avg": avg, "coverage": coverage}

    def fill(name: str) -> Column:
        pieces = re.split(r"\{(\w+)\}", fx.MSG[name])  # text and names of values by turns
        return F.concat(*[tx.percent(values[p]) if n % 2 else F.lit(p) for n, p in enumerate(pieces)])

    names = ("no_evidence", "narrow_evidence", "numbers_unsupported", "thin_evidence")
    return F.coalesce(*[tx.either(code == n, fill(n), F.lit(None)) for n in names])


# ---- claims and paragraphs of the same artifact ------------------------------------------

SCORES = T.StructType(
    [
        T.StructField("best_score", T.DoubleType()),
        T.StructField("avg_score", T.DoubleType()),
        T.StructField("coverage", T.DoubleType()),
        T.StructField("strong_count", T.LongType()),
        T.StructField("support_count", T.LongType()),
        T.StructField("places", T.ArrayType(T.IntegerType())),
        T.StructField("support_scores", T.ArrayType(T.DoubleType())),
    ]
)


TEXT_AT_ONCE = 1 << 20  # bytes of texts of rows that are scored together
PAIRS_AT_ONCE = 2_000_000  # meetings of a claim's token and a paragraph that holds it, worked on together


def list_starts(lists: pa.ListArray) -> np.ndarray:
    """Where the items of each list begin in the flattened array, and their end; a null list is empty."""
    return np.append(0, np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)))


def score_batch(claims: pa.ListArray, paragraphs: pa.ListArray) -> pa.ListArray:
    """Scores of the claims of each row (tokens, repeats counted) against its paragraphs (distinct tokens).

    Tokens become numbers once for the whole batch. A claim's token meets the paragraphs of its row
    that hold it by search in their sorted numbers; all meetings of many rows are counted together.
    """
    claim_lists, para_lists = claims.flatten(), paragraphs.flatten()
    of = lambda lists: np.repeat(np.arange(len(lists)), np.diff(list_starts(lists)))
    return _score(list_starts(claims), list_starts(paragraphs), (claim_lists.flatten(), of(claim_lists)), (para_lists.flatten(), of(para_lists)))


def score_texts(claims: pa.ListArray, paragraphs: pa.ListArray) -> pa.ListArray:
    """The same for texts: the claims of each row against its paragraphs, by their evidence tokens."""

    def score(claims: pa.ListArray, paragraphs: pa.ListArray) -> pa.ListArray:
        tokens = [text_tokens(texts.flatten()) for texts in (claims, paragraphs)]
        return _score(list_starts(claims), list_starts(paragraphs), *tokens, stop_words=fx.EVIDENCE_STOP_WORDS)

    return in_runs(score, [claims, paragraphs])


def in_runs(work: Callable[..., pa.Array], lists: list[pa.ListArray]) -> pa.Array:
    """``work`` done for runs of rows with a bounded number of bytes in their texts (or one row), and put together."""

    def size(texts: pa.ListArray) -> np.ndarray:
        lengths = pc.fill_null(pc.binary_length(texts.flatten()), 0).to_numpy(zero_copy_only=False).astype("i8")
        return np.append(0, np.cumsum(lengths))[list_starts(texts)]

    sizes, done, start = sum(size(texts) for texts in lists), [], 0
    while start < len(sizes) - 1:
        end = max(start + 1, int(np.searchsorted(sizes, sizes[start] + TEXT_AT_ONCE, side="right")) - 1)
        done.append(work(*(texts.slice(start, end - start) for texts in lists)))
        start = end
    return pa.concat_arrays(done) if done else work(*lists)


def distinct(numbers: np.ndarray) -> np.ndarray:
    """Distinct numbers, ascending; by sorting, which is faster than the hash table of ``np.unique``."""
    ordered = np.sort(numbers)
    return ordered[np.append(True, ordered[1:] != ordered[:-1])[: len(ordered)]]


def _classes() -> tuple[np.ndarray, np.ndarray]:
    """By byte: its lower case, and whether it is an ASCII letter or digit."""
    lower, word = np.arange(256, dtype="u1"), np.zeros(256, "?")
    lower[ord("A") : ord("Z") + 1] += 32
    for first, last in ("az", "AZ", "09"):
        word[ord(first) : ord(last) + 1] = True
    return lower, word


LOWER, WORD = _classes()


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 of all texts, and where each begins, and their end."""
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    at = np.frombuffer(texts.buffers()[1], "i8")[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, "i8")
    data = np.frombuffer(texts.buffers()[2], "u1") if at[-1] > at[0] else np.zeros(0, "u1")
    return data[at[0] : at[-1]], at - at[0]


def text_tokens(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Evidence tokens of texts as ``functions.text.evidence_tokens`` gives them, and the place of each one's text.

    By the bytes of all texts at once: a token is a run of two or more characters of ``TOKEN_CLASS``.
    """
    data, at = _bytes(texts)
    if not len(data):
        return pa.array([], pa.large_binary()), np.zeros(0, "i8")
    if data.max() >= 0x80:  # the only characters beyond ASCII whose lower case holds a character of the class
        data, at = _bytes(pc.replace_substring(pc.replace_substring(texts, "\u212a", "k"), "\u0130", "i\u0307"))
    held, wide = WORD[data], np.zeros(0, "i8")
    if data.max() >= 0x80:
        lead = np.flatnonzero((data[:-2] >= 0xE3) & (data[:-2] <= 0xE9))
        code = (data[lead].astype("i4") & 15) << 12 | (data[lead + 1].astype("i4") & 63) << 6 | data[lead + 2] & 63
        wide = lead[((code >= 0x3040) & (code <= 0x30FF)) | ((code >= 0x3400) & (code <= 0x9FAF))]
        for n in range(3):
            held[wide + n] = True
    before, after = np.append(False, held[:-1]), np.append(held[1:], False)
    inner = at[(at > 0) & (at < len(data))]
    before[inner] = after[inner - 1] = False
    start, end = np.flatnonzero(held & ~before), np.flatnonzero(held & ~after) + 1
    size = end - start
    long = size - 2 * (np.searchsorted(wide, end) - np.searchsorted(wide, start)) >= fx.MIN_TOKEN_CHARS
    for n in range(3):  # a token of one character has up to three bytes
        held[start[~long & (size > n)] + n] = False
    start, size = start[long], size[long]
    body = LOWER[data[held]]
    ends = np.append(0, np.cumsum(size)).astype("i8")
    tokens = pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(ends), pa.py_buffer(body)])
    return tokens, np.searchsorted(at, start, side="right") - 1


def _score(claim_at: np.ndarray, para_at: np.ndarray, asking: tuple[pa.Array, np.ndarray], holding: tuple[pa.Array, np.ndarray], stop_words: list[str] = []) -> pa.ListArray:
    """Scores from the tokens of all claims and paragraphs, each with the place of its claim or paragraph."""
    (claim_tokens, claim_of), (para_tokens, para_of) = asking, holding
    coded = pa.chunked_array([claim_tokens, para_tokens]).combine_chunks().dictionary_encode()
    codes, kinds = coded.indices.to_numpy(zero_copy_only=False).astype("i8"), max(1, len(coded.dictionary))
    counts = ~pc.is_in(coded.dictionary, pa.array(stop_words, coded.dictionary.type)).to_numpy(zero_copy_only=False)
    counted = counts[codes]
    own, held_by = counted[: len(claim_of)], counted[len(claim_of) :]
    asked, held = codes[: len(claim_of)][own], codes[len(claim_of) :][held_by]
    claim_of, para_of = claim_of[own], para_of[held_by]
    n_claims, n_paras = int(claim_at[-1]), max(1, int(para_at[-1]))
    n_rows, n_tokens = len(claim_at) - 1, np.bincount(claim_of, minlength=n_claims)
    row_of_claim, row_of_para = np.repeat(np.arange(n_rows), np.diff(claim_at)), np.repeat(np.arange(n_rows), np.diff(para_at))
    asked = row_of_claim[claim_of] * kinds + asked
    held = distinct((row_of_para[para_of] * kinds + held) * n_paras + para_of)  # repeats within a paragraph count once
    held, para_of = np.divmod(held, n_paras)
    low, high = np.searchsorted(held, asked), np.searchsorted(held, asked, side="right")
    found = [_meetings(claim_of, para_of, low, high, n_tokens, part) for part in _parts(claim_of, high - low, n_claims)]
    totals = [np.concatenate(parts) if parts else np.zeros(0) for parts in (zip(*(f[:5] for f in found)) if found else [()] * 5)]
    top_claim, top_para, top_score = (np.concatenate([f[n] for f in found]) if found else np.zeros(0, "i8") for n in (5, 6, 7))
    places = (top_para - para_at[row_of_claim[top_claim]]).astype("i4") if len(top_claim) else np.zeros(0, "i4")
    ends = pa.array(np.searchsorted(top_claim, np.arange(n_claims + 1)).astype("i4"))
    listed = [pa.ListArray.from_arrays(ends, pa.array(v, t)) for v, t in ((places, pa.int32()), (top_score, pa.float64()))]
    kind = [pa.float64()] * 3 + [pa.int64()] * 2
    scores = pa.StructArray.from_arrays([*(pa.array(v.astype("f8" if t == pa.float64() else "i8"), t) for v, t in zip(totals, kind)), *listed], [f.name for f in SCORES])
    return pa.ListArray.from_arrays(pa.array(claim_at.astype("i4")), scores)


def _parts(claim_of: np.ndarray, sizes: np.ndarray, n_claims: int) -> Iterator[tuple[int, int]]:
    """Runs of claims with a bounded number of meetings together (or one claim)."""
    meetings = np.append(0, np.cumsum(np.bincount(claim_of, sizes, n_claims)))
    start = 0
    while start < n_claims:
        end = max(start + 1, int(np.searchsorted(meetings, meetings[start] + PAIRS_AT_ONCE, side="right")) - 1)
        yield start, end
        start = end


def _meetings(claim_of: np.ndarray, para_of: np.ndarray, low: np.ndarray, high: np.ndarray, n: np.ndarray, part: tuple[int, int]) -> tuple[np.ndarray, ...]:
    """Best, average, coverage, strong and support counts of a run of claims; claim, paragraph and score of the best paragraphs."""
    first, last = part
    own = slice(*np.searchsorted(claim_of, [first, last]))
    sizes = (high - low)[own]
    token = np.repeat(np.arange(own.start, own.stop), sizes)
    at = np.arange(sizes.sum()) + np.repeat(low[own] - np.cumsum(sizes) + sizes, sizes)
    paras = max(1, int(para_of.max(initial=0)) + 1)
    meeting = claim_of[token] * paras + para_of[at]
    pair, matched = np.unique(meeting, return_counts=True)
    claim, para = pair // paras, pair % paras
    score, count = matched / n[claim], last - first
    best = np.zeros(count)
    np.maximum.at(best, claim - first, score)
    strong = np.bincount(claim[score >= fx.STRONG_SCORE] - first, minlength=count)
    near = np.flatnonzero(score >= fx.SUPPORT_SCORE)
    support = np.bincount(claim[near] - first, minlength=count)
    near = near[np.lexsort((para[near], -score[near], claim[near]))]
    rank = np.arange(len(near)) - np.searchsorted(claim[near], claim[near])
    near = near[rank < fx.SUPPORT_LIMIT]
    total, kept = np.zeros(count), np.bincount(claim[near] - first, minlength=count)
    rank = rank[rank < fx.SUPPORT_LIMIT]
    for place in range(fx.SUPPORT_LIMIT):  # plain additions in order
        some = near[rank == place]
        total[claim[some] - first] += score[some]
    covered = np.unique(token[np.isin(meeting, pair[near])])
    covering = np.bincount(claim_of[covered] - first, minlength=count)
    average = np.divide(total, kept, out=np.zeros(count), where=kept > 0)
    coverage = np.divide(covering, n[first:last], out=np.zeros(count), where=kept > 0)
    return best, average, coverage, strong, support, claim[near], para[near], score[near]


@F.arrow_udf(T.ArrayType(SCORES))
def _scores(claims: pa.Array, paragraphs: pa.Array) -> pa.Array:
    return score_texts(claims, paragraphs)


def audit_rows(mined: DataFrame) -> DataFrame:
    """Add ``audit`` to rows with paragraphs and claims: one entry per claim, in claim order.

    Each has the claim's id and text, its scores, up to three support paragraphs, finding code
    and severity; ``para_ids`` are those of a risk.
    """
    texts = lambda name: F.transform(name, lambda x: x["text"])
    df = settle(mined.withColumn("__scores", _scores(texts("claims"), texts("paragraphs"))))
    none = F.array().cast("array<string>")

    def entry(claim: Column, place: Column, paragraphs: Column, scores: Column) -> Column:
        s = F.get(scores, place)
        ids = F.transform(s["places"], lambda i: F.get(paragraphs, i)["para_id"])
        para_q = F.exists(s["places"], lambda i: tx.has_quantity(F.get(paragraphs, i)["text"]))
        code = finding_code(s["best_score"], s["coverage"], s["strong_count"], F.size(s["places"]), tx.has_quantity(claim["text"]), para_q)

        def filled(code: Column) -> Column:
            return F.struct(
                (place + 1).alias("ord"), claim["claim_id"].alias("claim_id"), claim["text"].alias("text"),
                *[s[n].alias(n) for n in ("best_score", "avg_score", "coverage", "strong_count", "support_count")],
                ids.alias("support_ids"), s["support_scores"].alias("support_scores"), code.alias("code"),
                code_severity(code).alias("severity"), F.when(code == "no_evidence", none).otherwise(ids).alias("para_ids"),
            )

        return tx.let(code, filled)

    audit = tx.let(
        F.struct("paragraphs", "__scores"),
        lambda row: F.transform("claims", lambda c, i: entry(c, i, row["paragraphs"], row["__scores"])),
    )
    return settle(df.withColumn("audit", audit).drop("__scores"))


def audit_documents(mined: DataFrame) -> DataFrame:
    """One row per claim of its audit against the paragraphs of its own document."""
    return audit_rows(mined.select("doc_id", "paragraphs", "claims")).select("doc_id", F.inline("audit"))


def evidence_risks(claim_audit: DataFrame) -> DataFrame:
    """Rows of claims that are not well supported."""
    return claim_audit.where(F.col("code").isNotNull())


# ---- claims and paragraphs as tables -----------------------------------------------------

PARA_KEY = ["doc_id", "ord", "para_id"]
HOT_ROWS = 100_000  # paragraphs of a token beyond which they are spread over salts
FEW_TOKENS = 200_000  # claim tokens that every task can hold; then no paragraph moves to meet them
UNROLLED = 3  # frequent tokens of a claim that are looked at without a lambda, which is slow


def claim_token_table(claims: DataFrame, key: str, by: list[str]) -> DataFrame:
    """(by, key, token, cnt, n): every distinct claim token with its repeats."""
    df = claims.withColumn("toks", tx.evidence_tokens(F.col("text")))
    return df.select(*by, key, F.size("toks").alias("n"), F.explode("toks").alias("token")).groupBy(*by, key, "n", "token").agg(F.count("*").alias("cnt"))


def split_by_rarity(tokens: DataFrame, frequency: DataFrame, keys: list[str]) -> DataFrame:
    """Adds ``df``, ``needed``, ``sum`` (counts down to a token, from the most frequent) and ``last``.

    ``last`` marks a claim's most frequent tokens, which no candidate rests on.

    A supporting paragraph matches at least ``needed`` of a claim's ``n`` tokens. The most frequent
    tokens that together make fewer than that can't carry one alone, so that every supporting
    paragraph also holds one of the rarer tokens. A claim's tokens are bounded by its text.
    """
    df = tokens.join(frequency, "token", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    # the least count whose share reaches the threshold, by the same division as the score
    floor = F.ceil(F.col("n") * fx.SUPPORT_SCORE).cast("int")
    needed = F.when((floor - 1) / F.col("n") >= fx.SUPPORT_SCORE, floor - 1).when(floor / F.col("n") >= fx.SUPPORT_SCORE, floor).otherwise(floor + 1)
    common = Window.partitionBy(*keys).orderBy(F.desc("df"), "token").rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("needed", F.greatest(F.lit(1), needed)).withColumn("sum", F.sum("cnt").over(common))
    return df.withColumn("last", F.col("sum") < F.col("needed"))


def unbeaten(ranked: DataFrame, low: DataFrame, keys: list[str]) -> DataFrame:
    """The frequent tokens that a better paragraph than the best so far may rest on, with ``low``, its count.

    A claim without support has less than ``needed``. What holds none of its rarer tokens can beat
    ``low`` only with a frequent token beyond the most frequent ones whose counts together don't exceed it.
    """
    return ranked.where("last").join(low, keys).where((F.col("low") < F.col("needed") - 1) & (F.col("sum") > F.col("low")))


def audit_tables(
    claims: DataFrame, paragraphs: DataFrame, key: str = "claim_id", by: list[str] | None = None
) -> DataFrame:
    """Audit of a claim table against a paragraph table (doc_id, ord, para_id, text).

    ``by`` names columns that must agree (``["doc_id"]`` keeps matching inside documents).
    Claims without any shared token stay in the result with score 0. Candidates come from a
    claim's rarer tokens alone; those that could still reach the threshold are completed by its
    frequent ones. Of claims without any support the best score is all that counts: they meet
    the paragraphs of a frequent token only if these could still beat the best one known. Texts are
    read once; only tokens travel.
    """
    by = by or []
    keys = [*by, key]
    pair = ["place", *keys]
    tokens = claim_token_table(claims, key, by)
    held = F.array_distinct(tx.evidence_tokens(F.col("text"))).alias("held")
    places = settle(paragraphs.select(*PARA_KEY, tx.has_quantity(F.col("text")).alias("para_q"), held)).withColumn("place", F.monotonically_increasing_id())
    places = places.select("place", *PARA_KEY, "para_q", F.explode("held").alias("token"))
    places = stored(places.join(tokens.select("token").distinct(), "token", "left_semi"), "places")
    ranked = stored(split_by_rarity(tokens, places.groupBy("token").agg(F.count("*").alias("df")), keys), "ranked")
    hot = ranked.where(F.col("df") > HOT_ROWS).select("token", F.ceil(F.col("df") / HOT_ROWS).cast("int").alias("salts")).distinct()
    few = ranked.count() <= FEW_TOKENS
    common = ranked.where("last")
    frequent = places.join(common.select("token").distinct(), "token", "left_semi").groupBy("place").agg(F.collect_list("token").alias("frequent"))
    rest = common.groupBy(*keys).agg(F.collect_list(F.struct("token", "cnt", "sum")).alias("rest"))
    where = [F.max(c).alias(c) for c in (*PARA_KEY[:2], "para_q") if c not in keys]

    def meet(some: DataFrame, *more: Column) -> DataFrame:
        """Pairs of paragraphs and claims that share a token, with the counts met; a hot token is met in several parts.

        Paragraphs are dealt by place first: where the claims are few, they are sent to every task, no token is
        dealt in parts, and all up to the scores stays within a task.
        """
        dealt = places.drop("para_id").repartition("place")
        left = some.join(hot, "token", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)))
        right = dealt.join(hot, "token", "left").withColumn("salt", F.pmod("place", F.coalesce("salts", F.lit(1))).cast("int"))
        pairs = dealt.join(F.broadcast(some), [*by, "token"]) if few else right.drop("salts").join(left.drop("salts"), [*by, "token", "salt"])
        met = pairs.groupBy(*pair).agg(F.sum("cnt").alias("got"), F.max("n").alias("n"), *more)
        return met.join(frequent, "place", "left").join(rest, keys, "left")

    def completed(within: Column) -> Column:
        """The counts met and those of the claim's frequent tokens in the paragraph, none of them met before."""
        in_it = lambda t: (t["sum"] <= within) & F.array_contains("frequent", t["token"])
        tail = F.filter(F.slice("rest", UNROLLED + 1, 1 << 30), in_it)
        parts = [F.when(in_it(F.get("rest", F.lit(n))), F.get("rest", F.lit(n))["cnt"]) for n in range(UNROLLED)]
        parts.append(F.when(F.size("rest") > UNROLLED, F.aggregate(tail, F.lit(0).cast("long"), lambda s, t: s + t["cnt"])))
        return reduce(Column.__add__, (F.coalesce(p, F.lit(0)) for p in parts), F.col("got"))

    scored = meet(ranked.where(~F.col("last")), *where)
    scored = scored.withColumn("got", completed(F.lit(1 << 60))).withColumn("score", F.col("got") / F.col("n"))
    scored = stored(scored.drop("n", "frequent", "rest"), "scored")
    # a token that occurs gives its count; whether it does within the columns of ``by`` is only known once met
    single = ranked.groupBy(*keys).agg(F.max(F.when(F.col("df") > 0, F.col("cnt") if not by else 0).otherwise(0)).cast("long").alias("low"))
    low = single.unionByName(scored.groupBy(*keys).agg(F.max("got").alias("low"))).groupBy(*keys).agg(F.max("low").alias("low"))
    low, scored = stored(low, "low"), scored.where(F.col("score") >= fx.SUPPORT_SCORE)
    totals = scored.groupBy(*keys).agg(
        F.max("score").alias("best_score"),
        F.count_if(F.col("score") >= fx.STRONG_SCORE).alias("strong_count"),
        F.count("*").alias("support_count"),
    )
    best, poor = low, unbeaten(ranked, low, keys)
    if not poor.isEmpty():
        again = meet(poor.drop("df", "needed", "sum", "last"), F.max("low").alias("low")).select(*keys, completed(F.col("low")).alias("low"))
        best = low.unionByName(again).groupBy(*keys).agg(F.max("low").alias("low"))
    best = best.withColumnRenamed("low", "poor_count")
    w = Window.partitionBy(*keys).orderBy(F.desc("score"), "doc_id", "ord")
    top = scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= fx.SUPPORT_LIMIT)
    names = places.join(top.select("place").distinct(), "place", "left_semi").groupBy("place").agg(F.first("para_id").alias("para_id"))
    top = stored(top.join(names, "place"), "top")
    support = top.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("rank", "score", "doc_id", "para_id", "para_q"))).alias("top"))
    # A claim's tokens in any of its three best paragraphs, each counted once
    seen = places.select("place", "token").join(top.select(*pair), "place").select(*keys, "token").distinct()
    covered = seen.join(ranked.select(*keys, "token", "cnt"), [*keys, "token"]).groupBy(*keys).agg(F.sum("cnt").alias("covered"))
    df = claims
    for part in (totals, best, support, covered):
        df = df.join(part, keys, "left")
    df = df.withColumn("n", F.size(tx.evidence_tokens(F.col("text")))).withColumn(
        "top", F.coalesce("top", F.array().cast(support.schema["top"].dataType))
    )
    n_top = F.size("top")
    df = df.select(
        *claims.columns,
        F.coalesce("best_score", F.col("poor_count") / F.col("n"), F.lit(0.0)).alias("best_score"),
        F.when(
            n_top > 0, F.aggregate("top", F.lit(0.0), lambda a, x: a + x["score"]) / n_top
        ).otherwise(0.0).alias("avg_score"),
        F.when(F.col("n") > 0, F.coalesce("covered", F.lit(0)) / F.col("n")).otherwise(0.0).alias("coverage"),
        F.coalesce("strong_count", F.lit(0)).alias("strong_count"),
        F.coalesce("support_count", F.lit(0)).alias("support_count"),
        F.transform("top", lambda x: F.struct(x["doc_id"], x["para_id"])).alias("support"),
        F.exists("top", lambda x: x["para_q"]).alias("para_q"),
    )
    code = finding_code(
        F.col("best_score"),
        F.col("coverage"),
        F.col("strong_count"),
        F.size("support"),
        tx.has_quantity(F.col("text")),
        F.col("para_q"),
    )
    return df.withColumn("code", code).withColumn("severity", code_severity(F.col("code"))).drop("para_q")
