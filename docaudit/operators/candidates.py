"""Model candidates for claims: segments, prompts, output checks, scoring, merge, refinement."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docaudit import fixed as fx
from docaudit.functions import arrays as aa
from docaudit.functions import text as tx
from docaudit.functions.marks import marked, marks
from docaudit.functions.plan import settle
from docaudit.operators.evidence import distinct, in_runs, list_starts, text_tokens

# ---- segments and prompts ----------------------------------------------------------------


def _chunks(arr: Column, size: int, overlap: int) -> Column:
    """Overlapping slices; the last one is the first that reaches the end."""
    step = size - overlap
    n = F.greatest(F.lit(0), F.ceil((F.size(arr) - size) / F.lit(step)).cast("int"))
    cut = F.transform(F.sequence(F.lit(0), n), lambda i: F.slice(arr, i * step + 1, size))
    return F.filter(cut, lambda c: F.size(c) > 0)


def segments(
    extracts: DataFrame,
    size: int = fx.SEGMENT_SIZE,
    overlap: int = fx.SEGMENT_OVERLAP,
    limit: int | None = None,
) -> DataFrame:
    """Add ``segments``: paragraphs of each section in overlapping slices.

    With ``limit`` neighbouring slices are merged until so many are left; every paragraph stays.
    """
    cand = F.filter(
        F.transform(
            "paragraphs",
            lambda p: F.struct(
                p["para_id"].alias("para_id"),
                tx.collapse(p["text"]).alias("text"),
                F.coalesce(p["section_id"], F.lit("")).alias("sec"),
            ),
        ),
        lambda p: F.length(p["text"]) >= fx.CLAIM_MIN_CHARS,
    )
    df = settle(extracts.withColumn("cand", cand))
    by_section = F.flatten(
        F.transform(aa.groups(F.col("cand"), lambda p: p["sec"]), lambda g: _chunks(g["xs"], size, overlap))
    )
    df = settle(df.withColumn("basis", by_section))
    if limit is None:
        return settle(df.withColumnRenamed("basis", "segments").drop("cand"))

    def merged(basis: Column) -> Column:
        stride = F.ceil(F.size(basis) / F.lit(limit)).cast("int")
        blocks = F.ceil(F.size(basis) / stride).cast("int")
        return F.transform(
            F.sequence(F.lit(0), blocks - 1),
            lambda j: aa.first_of_each(
                F.flatten(F.slice(basis, j * stride + 1, stride)), lambda p: p["para_id"]
            ),
        )

    out = tx.let(F.col("basis"), lambda b: F.when(F.size(b) <= limit, b).otherwise(merged(b)))
    return settle(df.withColumn("segments", out).drop("cand", "basis"))


def segment_table(segmented: DataFrame) -> DataFrame:
    """(doc_id, segment, ord, para_id, text)."""
    df = segmented.select("doc_id", F.posexplode("segments").alias("seg", "ps"))
    df = df.select("doc_id", "seg", F.posexplode("ps").alias("pos", "p"))
    return df.select(
        "doc_id", (F.col("seg") + 1).alias("segment"), (F.col("pos") + 1).alias("ord"), "p.para_id", "p.text"
    )


def claims_per_segment(n_segments: Column) -> Column:
    """How many claims a prompt asks for; answers with more are kept."""
    share = F.ceil(F.lit(fx.MAX_CLAIMS) / F.greatest(F.lit(1), n_segments)) + 2
    return F.greatest(F.lit(4), F.least(F.lit(14), share)).cast("int")


def segment_text(paragraphs: Column, max_chars: int | None = None) -> Column:
    """Numbered paragraphs of a segment, one per line."""
    return F.array_join(
        F.transform(
            paragraphs,
            lambda p: F.concat(
                F.lit("["), p["para_id"], F.lit("] "),
                tx.first_chars(tx.collapse(p["text"]), max_chars),
            ),
        ),
        "\n",
    )


def _prompt(*lines: Column | str) -> Column:
    return F.concat_ws("\n", *[F.lit(x) if isinstance(x, str) else x for x in lines])


def claim_prompt(text: Column, max_claims: Column) -> Column:
    asked = F.concat(F.lit(fx.CLAIM_PROMPT["count"]), max_claims.cast("string"))
    return _prompt(fx.CLAIM_PROMPT["task"], *fx.COMMON_PROMPT_RULES, *fx.CLAIM_PROMPT["schema"], asked, *fx.CLAIM_PROMPT["input"], text)


def evidence_prompt(text: Column, claims: Column) -> Column:
    listed = F.array_join(
        F.transform(claims, lambda c: F.concat(F.lit("- "), c["claim_id"], F.lit(": "), c["text"])), "\n"
    )
    some = F.coalesce(F.nullif(listed, F.lit("")), F.lit(fx.EVIDENCE_PROMPT["none"]))
    p = fx.EVIDENCE_PROMPT
    return _prompt(p["task"], *fx.COMMON_PROMPT_RULES, *p["schema"], p["claims"], some, *p["input"], text)


def oral_prompt(text: Column, claim_id: Column, claim_text: Column) -> Column:
    p = fx.ORAL_PROMPT
    about = [F.concat(F.lit(p["id"]), claim_id), F.concat(F.lit(p["claim"]), claim_text)]
    return _prompt(p["task"], *fx.COMMON_PROMPT_RULES, *p["schema"], *about, *p["input"], text)


def claim_prompts(segmented: DataFrame) -> DataFrame:
    """(doc_id, segment, max_claims, first_para, prompt)."""
    df = segmented.select(
        "doc_id", claims_per_segment(F.size("segments")).alias("max_claims"),
        F.posexplode("segments").alias("seg", "ps"),
    )
    return df.select(
        "doc_id",
        (F.col("seg") + 1).alias("segment"),
        "max_claims",
        F.get("ps", F.lit(0))["para_id"].alias("first_para"),
        claim_prompt(segment_text(F.col("ps")), F.col("max_claims")).alias("prompt"),
    )


PROMPT_BYTES = 4 << 20  # of prompts that a transport gets at once (or one prompt)


def _pieces(prompts: pa.Array) -> Iterator[tuple[int, int]]:
    """Start and length of runs of prompts of bounded bytes together."""
    ends = np.append(0, np.cumsum(pc.fill_null(pc.binary_length(prompts), 0).to_numpy(zero_copy_only=False)))
    start = 0
    while start < len(prompts):
        end = max(start + 1, int(np.searchsorted(ends, ends[start] + PROMPT_BYTES, side="right")) - 1)
        yield start, end - start
        start = end


def run_model(prompts: DataFrame, transport: Callable[[list[str]], list[str | None]], keep: list[str] | None = None) -> DataFrame:
    """Send prompts through a user function, batch by batch; adds ``raw_json`` and ``model_error``.

    ``transport`` maps a list of prompts to raw answers (null for a failed call) and travels
    to the executors with the plan. An exception doesn't end the job: the prompts of the batch are
    sent one by one, and one that fails again has no answer and the exception's text as error. So
    does a batch that comes back with another number of answers. A batch holds ``PROMPT_BYTES`` at
    most, however many rows Spark hands over together. ``keep`` names the columns wanted back.
    """
    keep = prompts.columns if keep is None else keep
    schema = T.StructType([*prompts.select(*keep).schema.fields, T.StructField("raw_json", T.StringType()), T.StructField("model_error", T.StringType())])

    def ask(some: list[str]) -> list[tuple[str | None, str | None]]:
        try:
            answers = list(transport(some))
            if len(answers) != len(some):
                raise ValueError(f"{len(answers)} answers to {len(some)} prompts")
            return [(answer, None) for answer in answers]
        except Exception as failed:
            if len(some) == 1:
                return [(None, f"{type(failed).__name__}: {failed}")]
        return [ask([prompt])[0] for prompt in some]

    def call(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, size in _pieces(batch.column("prompt")):
                piece = batch.slice(start, size)
                told = zip(*ask(piece.column("prompt").to_pylist()))
                kind = piece.column("prompt").type
                more = [pa.array(list(values), kind, from_pandas=True) for values in told]
                yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in keep), *more], schema.names)

    return prompts.mapInArrow(call, schema)


ANSWERS = "prompt_hash string, raw_json string, model_error string"


def ask_once(prompts: DataFrame, transport: Callable[[list[str]], list[str | None]], path: str) -> DataFrame:
    """``run_model`` that sends equal prompts once and keeps the answers under ``path``.

    A later call with the same folder sends only prompts without an answer: those of failed calls
    and new ones. Each call appends its answers and errors as a folder of its own; ``prompts`` gets
    the answer of any call, or else the last error. Prompts meet their answers by hash.
    """
    spark = prompts.sparkSession
    hashed = prompts.withColumn("prompt_hash", F.sha2(F.coalesce("prompt", F.lit("")), 256))
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    calls = len(files.listStatus(root)) if files.exists(root) else 0
    wanted = hashed.where("prompt IS NOT NULL").groupBy("prompt_hash").agg(F.any_value("prompt").alias("prompt"))
    if calls:
        known = spark.read.schema(ANSWERS).parquet(f"{path}/call=*").where("raw_json IS NOT NULL")
        wanted = wanted.join(known.select("prompt_hash").distinct(), "prompt_hash", "left_anti")
    run_model(wanted, transport, ["prompt_hash"]).write.mode("overwrite").parquet(f"{path}/call={calls}")
    answers = spark.read.schema(ANSWERS + ", call int").option("basePath", path).parquet(f"{path}/call=*")
    best = answers.groupBy("prompt_hash").agg(F.max_by("raw_json", F.when(F.col("raw_json").isNotNull(), F.col("call"))).alias("raw_json"), F.max_by("model_error", "call").alias("error"), F.count("*").alias("calls"))
    found = hashed.join(best, "prompt_hash", "left").withColumn("model_error", F.when(F.col("raw_json").isNull(), F.col("error")))
    return found.select(*prompts.columns, "raw_json", "model_error", "calls")


# ---- model output ----------------------------------------------------------------------------


def json_candidate(raw: Column) -> Column:
    """JSON part of an answer: inside a code fence, else outermost braces, else brackets."""

    def pick(t: Column) -> Column:
        fenced = F.regexp_extract(t, f"(?is)\\A```(?:json)?{tx.WS}*(.*?){tx.WS}*```\\z", 1)
        braces = F.regexp_extract(t, "(?s)\\{.*\\}", 0)
        brackets = F.regexp_extract(t, "(?s)\\[.*\\]", 0)
        empty = F.lit("")
        return F.coalesce(
            tx.js_trim(F.nullif(fenced, empty)), F.nullif(braces, empty), F.nullif(brackets, empty), t
        )

    return tx.let(tx.js_trim(raw), pick)


def _kind(v: Column, path: str) -> Column:
    """Variant type name of a member; null if it is missing."""
    return F.schema_of_variant(F.try_variant_get(v, path, "variant"))


def _is_text(v: Column, path: str) -> Column:
    text = F.try_variant_get(v, path, "string")
    return F.coalesce((_kind(v, path) == "STRING") & (text != ""), F.lit(False))


def _is_text_list(v: Column, path: str) -> Column:
    items = F.try_variant_get(v, path, "array<variant>")
    ok = F.coalesce(_kind(v, path).startswith("ARRAY"), F.lit(False))
    return ok & F.coalesce(F.forall(items, lambda x: _is_text(x, "$")), F.lit(False))


def _optional(v: Column, path: str, test: Column) -> Column:
    return _kind(v, path).isNull() | test


def _items_valid(v: Column, path: str, test) -> Column:
    items = F.try_variant_get(v, path, "array<variant>")
    ok = F.coalesce(_kind(v, path).startswith("ARRAY"), F.lit(False))
    return ok & F.coalesce(F.forall(items, test), F.lit(False))


def valid_claims(v: Column) -> Column:
    """Schema check of a claim answer; one bad item rejects the whole answer."""

    def item(x: Column) -> Column:
        level = F.try_variant_get(x, "$.confidence", "string")
        known = F.coalesce(level.isin("low", "medium", "high"), F.lit(False))
        return (
            _is_text(x, "$.claimId")
            & _is_text(x, "$.text")
            & _is_text_list(x, "$.paragraphIds")
            & _optional(x, "$.confidence", known)
        )

    return _items_valid(v, "$.claims", item)


def valid_evidence(v: Column) -> Column:
    """Schema check of an evidence answer."""

    def item(x: Column) -> Column:
        return (
            _is_text(x, "$.claimId")
            & _is_text_list(x, "$.paragraphIds")
            & _optional(x, "$.figureIds", _is_text_list(x, "$.figureIds"))
            & _optional(x, "$.citationKeys", _is_text_list(x, "$.citationKeys"))
            & _optional(x, "$.reason", F.coalesce(_kind(x, "$.reason") == "STRING", F.lit(False)))
        )

    return _items_valid(v, "$.evidence", item)


def valid_oral(v: Column) -> Column:
    """Schema check of an oral-question answer."""
    return (
        _is_text(v, "$.question")
        & _is_text(v, "$.expectedAnswer")
        & _is_text(v, "$.claimId")
        & _is_text_list(v, "$.paragraphIds")
    )


SCHEMAS = {"claims": valid_claims, "evidence": valid_evidence, "oral": valid_oral}


def check_output(outputs: DataFrame, schema: str | Callable[[Column], Column] = "claims") -> DataFrame:
    """Adds ``parsed`` (variant) and ``valid``; the schema is a name or a column function."""
    test = SCHEMAS[schema] if isinstance(schema, str) else schema
    df = outputs.withColumn("parsed", F.try_parse_json(json_candidate(F.col("raw_json"))))
    return df.withColumn("valid", F.coalesce(test(F.col("parsed")), F.lit(False)))


ANSWER = "array<struct<claimId:string,text:string,paragraphIds:array<string>,confidence:string>>"


def read_answers(outputs: DataFrame, enforce: bool = False) -> DataFrame:
    """(doc_id, segment, first_para, items, warning) of claim answers (doc_id, segment, max_claims, raw_json).

    A failed or malformed segment has no items and a warning. Claims beyond the number asked for
    are kept, or with ``enforce`` left out and counted in a warning.
    """
    df = check_output(outputs, "claims")
    segment = F.col("segment").cast("int")
    items = F.when(F.col("valid"), F.from_json(F.to_json(F.try_variant_get("parsed", "$.claims", "variant")), ANSWER))
    warning = F.when(~F.col("valid"), F.format_string("claim extraction segment %d failed", segment))
    if enforce:
        beyond = F.size(items) - F.col("max_claims")
        warning = F.coalesce(warning, F.when(beyond > 0, F.format_string("claim extraction segment %d: %d claims left out", segment, beyond)))
        items = F.slice(items, 1, F.col("max_claims"))
    first = F.col("first_para") if "first_para" in outputs.columns else F.lit(None).cast("string")
    return df.select("doc_id", segment.alias("segment"), first.alias("first_para"), items.alias("items"), warning.alias("warning"))


def output_claims(outputs: DataFrame, enforce: bool = False) -> tuple[DataFrame, DataFrame]:
    """(candidate rows, warning rows) of claim answers."""
    df = read_answers(outputs, enforce)
    rows = df.select("doc_id", "segment", "first_para", F.posexplode("items").alias("pos", "c")).select(
        "doc_id", "segment", "first_para", (F.col("pos") + 1).alias("ord"), "c.text", F.col("c.paragraphIds").alias("para_ids"), "c.confidence"
    )
    return rows, df.where(F.col("warning").isNotNull()).select("doc_id", "segment", "warning")


# ---- candidate claims, in the row of their document ------------------------------------------------
#
# A candidate is (segment, ord, text, para_ids, first_para); rows hold paragraphs and claims.


def candidate_score(text: Column, para_ids: Column) -> Column:
    """2 claim-like + 1 digit + 1 cue word + up to 2 for references + up to 2 for length."""
    one = lambda test, v: F.when(test, F.lit(float(v))).otherwise(F.lit(0.0))
    return tx.two_decimals(
        one(tx.looks_like_claim(text), 2)
        + one(tx.has_digit(text), 1)
        + one(tx.matches(text, fx.CANDIDATE_CUE), 1)
        + F.least(F.lit(2.0), F.size(para_ids) * 0.5)
        + F.least(F.lit(2.0), F.length(text) / 120)
    )


def with_answers(rows: DataFrame, outputs: DataFrame, enforce: bool = False) -> DataFrame:
    """Add ``candidates`` and ``claim_warnings`` from the answers of each document: one join by document."""
    entry = F.struct("segment", "first_para", "items", "warning")
    listed = read_answers(outputs, enforce).groupBy("doc_id").agg(F.sort_array(F.collect_list(entry)).alias("answers"))
    df = rows.join(listed, "doc_id", "left")

    def claims(answer: Column) -> Column:
        return F.transform(
            F.coalesce(answer["items"], F.array().cast(ANSWER)),
            lambda c, i: F.struct(
                answer["segment"].alias("segment"), (i + 1).alias("ord"), c["text"].alias("text"),
                c["paragraphIds"].alias("para_ids"), answer["first_para"].alias("first_para"),
            ),
        )

    some = F.coalesce("answers", F.array().cast(listed.schema["answers"].dataType))
    df = settle(df.withColumn("answers", some))
    warnings = F.array_compact(F.transform("answers", lambda a: a["warning"]))
    return settle(df.withColumns({"candidates": F.flatten(F.transform("answers", claims)), "claim_warnings": warnings}).drop("answers"))


def resolve_candidates(rows: DataFrame) -> DataFrame:
    """``candidates`` with claim text, existing paragraph ids only, and a score.

    If no id exists the first paragraph of the segment, else of the document, is used.
    """

    def resolved(known: Column) -> Column:
        def one(c: Column) -> Column:
            ids = F.filter(c["para_ids"], lambda i: F.array_contains(known, i))
            first = F.array_compact(F.array(F.coalesce(c["first_para"], F.get(known, F.lit(0)))))
            return F.struct(
                c["segment"].alias("segment"), c["ord"].alias("ord"), tx.claim_text(c["text"]).alias("text"),
                tx.let(ids, lambda x: F.when(F.size(x) > 0, x).otherwise(first)).alias("para_ids"),
            )

        return F.transform("candidates", one)

    found = tx.let(F.transform("paragraphs", lambda p: p["para_id"]), resolved)
    df = settle(rows.withColumn("candidates", found))
    kept = F.filter("candidates", lambda c: (F.length(c["text"]) >= fx.CLAIM_MIN_CHARS) & (F.size(c["para_ids"]) > 0))
    scored = F.transform(kept, lambda c: c.withField("score", candidate_score(c["text"], c["para_ids"])))
    return settle(df.withColumn("candidates", scored))


def dedupe_best(rows: DataFrame) -> DataFrame:
    """Best score per normalised text; the place is that of the first occurrence."""

    def best(g: Column) -> Column:
        top = F.array_max(F.transform(g["xs"], lambda c: F.struct(c["score"], -c["segment"], -c["ord"], c["text"], c["para_ids"])))
        first = F.get(g["xs"], F.lit(0))
        return F.struct(
            first["segment"].alias("segment"), first["ord"].alias("ord"), top["text"].alias("text"),
            top["para_ids"].alias("para_ids"), top["score"].alias("score"),
        )

    found = F.transform(aa.groups(F.col("candidates"), lambda c: tx.claim_key(c["text"])), best)
    return settle(rows.withColumn("candidates", found))


def rank_candidates(rows: DataFrame, limit: int | None = None) -> DataFrame:
    """Best first; with ``limit`` also candidates_left_out."""
    keyed = F.sort_array(F.transform("candidates", lambda c: F.struct((-c["score"]).alias("neg"), c["segment"], c["ord"], c.alias("c"))))
    ranked = F.transform(tx.first_items(keyed, limit), lambda k: k["c"])
    left = {} if limit is None else {"candidates_left_out": tx.left_out(F.size("candidates"), limit)}
    return settle(rows.withColumns({"candidates": ranked} | left))


def merge_with_fallback(rows: DataFrame, limit: int | None = None) -> DataFrame:
    """``merged``: the candidates, then rule-based claims with new text; with ``limit`` also claims_left_out.

    Repeats among the candidates stay.
    """
    key = lambda text: F.lower(tx.collapse(F.lower(text)))
    plain = lambda c: F.struct(c["text"].alias("text"), c["para_ids"].alias("para_ids"))
    primary = F.transform("candidates", plain)
    seen = F.transform("candidates", lambda c: key(c["text"]))
    rest = tx.let(
        seen,
        lambda known: F.filter(
            aa.first_of_each(F.transform("claims", plain), lambda c: key(c["text"])),
            lambda c: ~F.array_contains(known, key(c["text"])),
        ),
    )
    df = settle(rows.withColumn("merged", F.concat(primary, rest)))
    if limit is None:
        return df
    cut = {"merged": tx.first_items("merged", limit), "claims_left_out": tx.left_out(F.size("merged"), limit)}
    return settle(df.withColumns(cut))


# ---- quality and refinement ----------------------------------------------------------------------


QUALITY_WORDS = [fx.CLAIM_PATTERNS, ["[0-9]"], [fx.CONDITION_CUE]]


def overlap_batch(claims: pa.ListArray, refs: pa.ListArray, ids: pa.ListArray, texts: pa.ListArray) -> pa.ListArray:
    """Share of each claim's tokens, repeats counted, that the first paragraph of its row with the id in ``refs`` holds."""
    claim_at, para_at = list_starts(claims), list_starts(ids)
    rows = lambda at: np.repeat(np.arange(len(claims)), np.diff(at))
    named = pa.chunked_array([refs.flatten(), ids.flatten()]).combine_chunks().dictionary_encode()
    codes, kinds = pc.fill_null(named.indices, -1).to_numpy(zero_copy_only=False).astype("i8"), len(named.dictionary) + 1
    asked, own = rows(claim_at) * kinds + codes[: claim_at[-1]], rows(para_at) * kinds + codes[claim_at[-1] :]
    own[codes[claim_at[-1] :] < 0] = -1
    known, place = np.unique(own, return_index=True)
    at = np.minimum(np.searchsorted(known, asked), max(0, len(known) - 1))
    para = np.full(len(asked), -1)
    if len(known):
        para = np.where((known[at] == asked) & (codes[: claim_at[-1]] >= 0), place[at], -1)
    (left, claim_of), (right, para_of) = text_tokens(claims.flatten()), text_tokens(texts.flatten())
    words = pa.chunked_array([left, right]).combine_chunks().dictionary_encode()
    tokens, kinds = words.indices.to_numpy(zero_copy_only=False).astype("i8"), max(1, len(words.dictionary))
    held = distinct(para_of * kinds + tokens[len(left) :])
    sought = para[claim_of] * kinds + tokens[: len(left)]
    found = np.searchsorted(held, sought, side="right") > np.searchsorted(held, sought)
    total = np.bincount(claim_of, minlength=len(asked))
    share = np.divide(np.bincount(claim_of[found], minlength=len(asked)), total, out=np.zeros(len(asked)), where=total > 0)
    return pa.ListArray.from_arrays(pa.array(claim_at.astype("i4")), pa.array(share), mask=claims.is_null())


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def _overlaps(claims: pa.Array, refs: pa.Array, ids: pa.Array, texts: pa.Array) -> pa.Array:
    return in_runs(overlap_batch, [claims, refs, ids, texts])


def with_quality(rows: DataFrame, name: str, to: str) -> DataFrame:
    """Add ``to``: ``quality_of`` the claims in the column ``name``; words and tokens are compared for a batch of rows at once."""
    part = lambda p: f"{to}_{p}"
    texts = settle(rows.withColumn(part("texts"), F.transform(name, lambda c: tx.claim_text(c["text"]))))
    shares = _overlaps(
        part("texts"), F.transform(name, lambda c: F.get(c["para_ids"], F.lit(0))), F.transform("paragraphs", lambda p: p["para_id"]), F.transform("paragraphs", lambda p: p["text"])
    )
    found = settle(texts.withColumns({part("marks"): marks(F.col(part("texts")), QUALITY_WORDS), part("shares"): shares}))
    ready = (part("texts"), part("marks"), part("shares"))
    return settle(found.withColumn(to, quality_of(F.col(name), F.col("paragraphs"), *map(F.col, ready))).drop(*ready))


def quality_of(
    claims: Column, paragraphs: Column, texts: Column | None = None, found: Column | None = None, shares: Column | None = None
) -> Column:
    """Claims (text, para_ids) with ``quality``, ``issues`` and the comparison ``key``.

    The first referenced paragraph is looked up in the row. Claim texts, the marks of
    ``QUALITY_WORDS`` in them and the shares of their tokens in that paragraph may be given as columns.
    """

    def judged(c: Column, place: Column, ids: Column) -> Column:
        first = F.get(c["para_ids"], F.lit(0))
        at = F.array_position(ids, first)
        para = F.coalesce(F.when(at > 0, F.get(paragraphs, (at - 1).cast("int"))["text"]), F.lit(""))
        norm, has_ref = tx.claim_text(c["text"]) if texts is None else F.get(texts, place), F.size(c["para_ids"]) > 0

        def words(n: Column) -> list[Column]:
            if found is None:
                return [tx.looks_like_claim(n), tx.has_digit(n), tx.matches(n, fx.CONDITION_CUE)]
            return [marked(F.get(found, place), bit) for bit in range(3)]

        def overlap(o: Column) -> Column:
            """Share of the left tokens, repeats counted, that the right ones hold."""
            both = F.array_intersect(o["left"], o["right"])
            shared = tx.let(both, lambda b: F.size(F.filter(o["left"], lambda t: F.array_contains(b, t))))
            return F.when(F.size(o["left"]) > 0, shared / F.size(o["left"])).otherwise(0.0)

        def points(v: Column) -> Column:
            like, number, condition = words(v["norm"])
            checks = [
                (F.length(v["norm"]) >= 20, 100, "too_short"),
                (like, 100, "not_claim_like"),
                (number, 80, "no_number"),
                (condition, 70, "no_condition_or_comparator"),
                (has_ref, 60, "no_paragraph_ref"),
            ]
            close = has_ref & (v["overlap"] >= 0.3)
            tests = F.array(*[t for t, _, _ in checks], close)

            def sums(held: Column) -> Column:
                total = F.when(F.get(held, F.lit(5)), 100).otherwise(0)
                for n, (_, value, _) in enumerate(checks):
                    total = total + F.when(F.get(held, F.lit(n)), value).otherwise(0)
                issues = [F.when(~F.get(held, F.lit(n)), name) for n, (_, _, name) in enumerate(checks)]
                issues.append(F.when(has_ref & ~F.get(held, F.lit(5)), "low_source_overlap"))
                return F.struct(
                    c["text"].alias("text"), c["para_ids"].alias("para_ids"), (total / 100).alias("quality"),
                    F.array_compact(F.array(*issues)).alias("issues"), tx.claim_key(c["text"]).alias("key"),
                )

            return tx.let(tests, sums)

        def share() -> Column:
            both = F.struct(tx.tokens(norm).alias("left"), tx.tokens(para).alias("right"))
            return tx.let(both, overlap) if shares is None else F.get(shares, place)

        return tx.let(F.struct(norm.alias("norm"), share().alias("overlap")), points)

    return tx.let(F.transform(paragraphs, lambda p: p["para_id"]), lambda ids: F.transform(claims, lambda c, i: judged(c, i, ids)))


def _weak(c: Column) -> Column:
    return (c["quality"] < fx.WEAK_QUALITY) | (F.size(c["issues"]) >= fx.WEAK_ISSUES)


def refine_claims(rows: DataFrame, initial: str = "claims", rounds: int = fx.REFINER_ROUNDS) -> DataFrame:
    """Replace weak and duplicate claims by the best unused claims of the pool, in each row.

    The pool holds every initial and rule-based claim; only keys of kept claims are excluded, so a
    removed claim may return. A document stops when nothing is to be replaced or nothing can be,
    which leaves a warning. ``claims`` gets the result with quality and issues, ``refine`` the
    iterations, replacements, weak claims left and warnings.
    """
    same = initial == "claims"
    df = with_quality(rows, initial, "__now")
    df = df if same else with_quality(df, "claims", "__own")
    known = F.col("__now") if same else F.concat("__now", "__own")
    unique = F.filter(aa.first_of_each(known, lambda c: c["key"]), lambda c: c["key"] != "")
    pool = F.transform(
        F.sort_array(F.transform(unique, lambda c, i: F.struct((-c["quality"]).alias("neg"), i.alias("i"), c.alias("c")))), lambda p: p["c"]
    )
    none = F.array().cast("array<string>")
    state = F.struct(
        F.col("__now").alias("now"), F.lit(0).alias("iterations"), F.lit(0).alias("replacements"), none.alias("warnings"), F.lit(False).alias("done")
    )
    df = settle(df.withColumns({"__pool": pool, "__state": state}).drop("__now", "__own"))
    for number in range(1, rounds + 1):
        df = settle(df.withColumn("__state", _round(F.col("__state"), F.col("__pool"), number)))
    last = F.col("__state")
    empty = F.size(last["now"]) == 0
    report = F.struct(
        F.when(empty, 0).otherwise(last["iterations"]).alias("iterations"),
        last["replacements"].alias("replacements"),
        F.size(F.filter(last["now"], _weak)).alias("weak_claims"),
        F.when(empty, F.array(F.lit(fx.MSG["no_claims"]))).otherwise(last["warnings"]).alias("warnings"),
    )
    claims = F.transform(
        last["now"],
        lambda c, i: F.struct(
            F.format_string("claim_%d", i + 1).alias("claim_id"), c["text"].alias("text"), c["para_ids"].alias("para_ids"),
            c["quality"].alias("quality"), c["issues"].alias("issues"),
        ),
    )
    return settle(df.withColumns({"claims": claims, "refine": report}).drop("__state", "__pool"))


def _round(state: Column, pool: Column, number: int) -> Column:
    def winners(now: Column) -> Column:
        """Places of the best claim of each key."""
        keyed = F.transform(now, lambda c, i: F.struct(c["key"].alias("key"), c["quality"].alias("quality"), (-i).alias("neg")))
        best = lambda g: F.array_max(F.transform(g["xs"], lambda x: F.struct(x["quality"], x["neg"].alias("neg"))))
        return F.transform(aa.groups(keyed, lambda x: x["key"]), lambda g: -best(g)["neg"])

    def kept(s: Column) -> Column:
        return tx.let(winners(s["now"]), lambda w: F.filter(s["now"], lambda c, i: ~_weak(c) & F.array_contains(w, i)))

    def taken(s: Column, stay: Column) -> Column:
        free = tx.let(F.transform(stay, lambda c: c["key"]), lambda used: F.filter(pool, lambda p: ~F.array_contains(used, p["key"])))
        return F.slice(free, 1, F.size(s["now"]) - F.size(stay))

    def step(v: Column) -> Column:
        s, stay, take = v["s"], v["stay"], v["take"]
        need = F.size(s["now"]) - F.size(stay)
        idle = s["done"] | (F.size(take) == 0)
        text = F.lit(fx.MSG["refiner_empty"].replace("{n}", str(number)))
        return F.struct(
            F.when(idle, s["now"]).otherwise(F.concat(stay, take)).alias("now"),
            F.when(s["done"], s["iterations"]).otherwise(F.lit(number)).alias("iterations"),
            (s["replacements"] + F.when(idle, 0).otherwise(F.size(take))).alias("replacements"),
            F.when(~s["done"] & (need > 0) & (F.size(take) == 0), F.array_append(s["warnings"], text)).otherwise(s["warnings"]).alias("warnings"),
            idle.alias("done"),
        )

    with_stay = tx.let(state, lambda s: F.struct(s.alias("s"), kept(s).alias("stay")))
    return tx.let(
        with_stay,
        lambda v: tx.let(F.struct(v["s"].alias("s"), v["stay"].alias("stay"), taken(v["s"], v["stay"]).alias("take")), step),
    )


def mine_with_model(mined: DataFrame, outputs: DataFrame | None = None, enforce: bool = False) -> DataFrame:
    """Rows whose claims come from model answers merged with the rule-based ones, then refined.

    ``mined`` carries the rule-based ``claims``; ``outputs`` (doc_id, segment, max_claims,
    raw_json) may be missing, then the rule-based claims alone are refined and nothing is
    shuffled. ``claim_warnings`` gathers those of the answers and of the refinement.
    """
    if outputs is None:
        df = refine_claims(mined.withColumn("claim_warnings", F.array().cast("array<string>")))
    else:
        df = rank_candidates(dedupe_best(resolve_candidates(with_answers(mined, outputs, enforce))))
        df = refine_claims(merge_with_fallback(df), "merged").drop("candidates", "merged")
    return df.withColumn("claim_warnings", F.concat("claim_warnings", F.col("refine.warnings")))
