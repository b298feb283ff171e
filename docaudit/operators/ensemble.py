"""Extraction candidates of several sources: normalise, score, rank, pick donors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docaudit import fixed as fx
from docaudit.functions import arrays as aa
from docaudit.functions import text as tx
from docaudit.functions.plan import settle
from docaudit.operators import markup as mk

NUMERIC_CITE, NUMERIC_CITE_KEYS = tx.spark_regex(fx.NUMERIC_CITE), tx.spark_regex(fx.NUMERIC_CITE_KEYS)
AUTHOR_YEAR, AUTHOR_YEAR_KEY = tx.spark_regex(fx.AUTHOR_YEAR), tx.spark_regex(fx.AUTHOR_YEAR_KEY)


def clean_title(c: Column) -> Column:
    """Leading digits, dots, dashes, brackets and blanks dropped."""
    return tx.js_trim(F.regexp_replace(tx.spaces(c), "^[0-9.\\-)" + tx.WS[1:-1] + "]+", ""))


def clean_sections(sections: Column) -> Column:
    kept = F.filter(
        F.transform(
            sections,
            lambda s: F.struct(
                clean_title(s["title"]).alias("title"),
                F.greatest(F.lit(1), F.least(F.lit(6), s["level"])).alias("level"),
            ),
        ),
        lambda s: F.length(s["title"]) >= 2,
    )
    return aa.first_of_each(kept, lambda s: F.lower(s["title"]))


def clean_bib(bib: Column) -> Column:
    kept = F.filter(
        F.transform(
            bib, lambda b: F.struct(tx.spaces(b["key"]).alias("key"), tx.spaces(b["raw"]).alias("raw"))
        ),
        lambda b: b["key"] != "",
    )
    return aa.first_of_each(kept, lambda b: b["key"])


def normalise_candidates(candidates: DataFrame) -> DataFrame:
    """Candidates (doc_id, ord, source, paragraphs, sections, bib, warnings) in clean form."""
    return settle(
        candidates.select(
            "doc_id",
            "ord",
            "source",
            mk.dedupe_paragraphs(mk.flat_paragraphs(F.col("paragraphs"))).alias("paragraphs"),
            clean_sections(F.col("sections")).alias("sections"),
            clean_bib(F.col("bib")).alias("bib"),
            F.transform("warnings", tx.spaces).alias("warnings"),
        )
    )


def has_citation_hint(c: Column) -> Column:
    return (c.contains("[") & c.rlike(NUMERIC_CITE)) | (c.contains("(") & c.rlike(AUTHOR_YEAR))


def candidate_stats(clean: DataFrame) -> DataFrame:
    """Counts behind the score, one row per candidate."""
    chars = F.aggregate("paragraphs", F.lit(0), lambda a, p: a + F.length(p))
    return clean.select(
        "*",
        F.size("paragraphs").alias("n_paragraphs"),
        chars.alias("n_chars"),
        F.size(F.filter("paragraphs", has_citation_hint)).alias("n_cited"),
        F.size("sections").alias("n_sections"),
        F.size("bib").alias("n_bib"),
        F.size("warnings").alias("n_warnings"),
    )


def candidate_score(df: DataFrame) -> DataFrame:
    """Adds ``score`` (two decimals)."""
    c = F.col
    n = c("n_paragraphs")
    mean = F.when(n > 0, c("n_chars") / n).otherwise(0.0)
    density = F.when(n > 0, c("n_cited") / n).otherwise(0.0)

    points = fx.SOURCE_SCORE
    (low, high, best), (least, some), none = fx.SOURCE_MEAN_CHARS

    def capped(name: str, value: Column) -> Column:
        return F.least(F.lit(float(points[name][0])), value)

    score = (
        capped("paragraphs", n * points["paragraphs"][1])
        + capped("chars_divided_by", c("n_chars") / points["chars_divided_by"][1])
        + F.when((mean >= low) & (mean <= high), best).when(mean >= least, some).otherwise(none)
        + capped("sections", c("n_sections") * points["sections"][1])
        + capped("bib", c("n_bib") * points["bib"][1])
        + capped("cited_share", density * points["cited_share"][1])
        - c("n_warnings") * points["warning"]
    )
    return df.withColumn("score", tx.two_decimals(score))


def _choices(takes_part: Column) -> list[Column]:
    """Aggregates over the scored candidates of a document: primary source, donors and ranking, of those that take part."""
    order = -F.col("ord")

    def most(name: str) -> Column:
        some = F.when(takes_part & (F.col(name) > 0), F.struct(F.col(name), order))
        return F.max_by("source", some)

    line = F.concat(
        F.col("source"), F.lit(":score="), F.regexp_replace(F.col("score").cast("string"), "\\.0$", ""),
        F.format_string(",p=%d,sec=%d,bib=%d", "n_paragraphs", "n_sections", "n_bib"),
    )
    # Candidates per document are the handful of extraction sources.
    entry = F.struct((-F.col("score")).alias("neg"), "ord", line.alias("line"))
    return [
        F.max_by("source", F.when(takes_part, F.struct("score", order))).alias("primary"),
        most("n_sections").alias("section_donor"),
        most("n_bib").alias("bib_donor"),
        F.array_sort(F.collect_list(F.when(takes_part, entry))).alias("ranked"),
    ]


def _chosen() -> list[Column]:
    return [
        F.col("primary"),
        F.coalesce("section_donor", "primary").alias("section_donor"),
        F.coalesce("bib_donor", "primary").alias("bib_donor"),
        F.array_join(F.col("ranked.line"), " | ").alias("ranking"),
    ]


def _takes_part(local_source: str) -> Column:
    return (F.col("source") == local_source) | (F.col("n_paragraphs") > 0)


def pick_sources(candidates: DataFrame, local_source: str = "local") -> DataFrame:
    """Per document: primary source, section and bibliography donors, ranking summary.

    The local source always takes part; other sources only with at least one paragraph.
    Earlier candidates win ties.
    """
    df = candidate_score(candidate_stats(normalise_candidates(candidates))).where(_takes_part(local_source))
    return df.groupBy("doc_id").agg(*_choices(F.lit(True))).select("doc_id", *_chosen())


def pdf_citation_keys(c: Column) -> Column:
    """``num:n`` for bracketed numbers, ``ay:Name,_year`` for author-year citations; distinct."""
    none = F.array().cast("array<string>")
    held = lambda mark, pattern: F.when(c.contains(mark), tx.regexp_all(c, pattern, 1)).when(c.isNotNull(), none)
    numbers = F.split(F.array_join(held("[", NUMERIC_CITE_KEYS), ","), ",")
    nums = F.transform(
        F.filter(F.transform(numbers, tx.js_trim), lambda x: x != ""), lambda x: F.concat(F.lit("num:"), x)
    )
    years = F.transform(
        held("(", AUTHOR_YEAR_KEY),
        lambda x: F.concat(F.lit("ay:"), F.regexp_replace(x, f"{tx.WS}+", "_")),
    )
    return F.array_distinct(F.concat(nums, years))


def ensemble_extract(candidates: DataFrame, local_source: str = "local") -> DataFrame:
    """Extract rows built from the primary source and the donors of each document."""
    takes_part = F.coalesce(_takes_part(local_source), F.lit(False))
    scored = settle(candidate_score(candidate_stats(normalise_candidates(candidates.where(F.col("doc_id").isNotNull())))))
    own = F.struct("source", "paragraphs", "sections", "bib", "warnings")
    mine = scored.groupBy("doc_id").agg(*_choices(takes_part), F.collect_list(own).alias("own"), F.count_if(takes_part).alias("parts"))
    mine = settle(mine.where("parts > 0").select("doc_id", "own", *_chosen()))

    def take(name: str, by: str) -> Column:
        """Of the candidates of that source."""
        return tx.let(F.col(by), lambda source: F.array_max(F.transform(F.filter("own", lambda c: c["source"] == source), lambda c: c[name])))

    df = settle(
        mine.select(
            "doc_id",
            take("paragraphs", "primary").alias("texts"),
            take("sections", "section_donor").alias("secs"),
            take("bib", "bib_donor").alias("bibs"),
            F.flatten(F.array_compact(F.transform("own", lambda c: c["warnings"]))).alias("notes"),
            "primary", "section_donor", "bib_donor", "ranking",
        )
    )
    paragraphs = F.transform(
        "texts",
        lambda t, i: F.struct(
            tx.seq_id("p", i + 1).alias("para_id"),
            F.lit(None).cast("string").alias("section_id"),
            t.alias("text"),
        ),
    )
    sections = F.transform(
        "secs",
        lambda s, i: F.struct(tx.seq_id("sec", i + 1).alias("section_id"), s["title"], s["level"]),
    )
    df = settle(df.select("*", paragraphs.alias("paragraphs"), sections.alias("sections")))
    cites = F.filter(
        F.transform(
            "paragraphs",
            lambda p: F.struct(p["para_id"], pdf_citation_keys(p["text"]).alias("keys")),
        ),
        lambda c: F.size(c["keys"]) > 0,
    )
    selection = F.format_string(
        "extractor_selection primary=%s section_donor=%s bib_donor=%s", "primary", "section_donor", "bib_donor"
    )
    ranking = F.concat(F.lit("extractor_ranking "), F.col("ranking"))
    return df.select(
        "doc_id",
        "sections",
        "paragraphs",
        F.array().cast("array<struct<figure_id:string,label:string,caption:string,mentioned_in:array<string>>>").alias("figures"),
        F.transform("bibs", lambda b: b["key"]).alias("bib"),
        cites.alias("cites"),
        F.concat("notes", F.array(selection, ranking)).alias("warnings"),
        F.lit("PAPER").alias("artifact_type"),
    )


def is_sparse(paragraphs: Column, text_items: Column) -> Column:
    """Extraction so thin that another source should be tried."""
    return (paragraphs < fx.SPARSE_MIN_PARAGRAPHS) | (text_items < fx.SPARSE_MIN_TEXT_ITEMS)
