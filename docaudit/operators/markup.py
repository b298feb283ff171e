"""Tagged markup and extraction payloads -> paragraphs, sections, bibliography."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docaudit.functions import arrays as aa
from docaudit.functions import text as tx

ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))


def decode_entities(c: Column) -> Column:
    """The five XML entities, ``&amp;`` last."""
    for code, char in ENTITIES:
        c = F.replace(c, F.lit(code), F.lit(char))
    return c


def strip_tags(c: Column) -> Column:
    return tx.spaces(decode_entities(F.regexp_replace(c, "<[^>]+>", " ")))


def tag_pattern(tag: str) -> str:
    return f"(?is)<{tag}{tx.BOUNDARY}[^>]*>(.*?)</{tag}>"


def tag_contents(c: Column, tag: str) -> Column:
    """Non-empty texts of every ``<tag>…</tag>``, inner tags stripped, in document order."""
    return F.filter(F.transform(tx.regexp_all(c, tag_pattern(tag), 1), strip_tags), lambda t: t != "")


def bibliography(c: Column) -> Column:
    """``biblStruct`` entries: key (``xml:id`` or ``bib_n``) and raw text."""
    pattern = f"(?is)<biblStruct{tx.BOUNDARY}([^>]*)>(.*?)</biblStruct>"
    found = F.struct(tx.regexp_all(c, pattern, 1).alias("attrs"), tx.regexp_all(c, pattern, 2).alias("bodies"))
    xml_id = f'(?i){tx.BOUNDARY}xml:id="([^"]+)"'

    def entry(attr: Column, body: Column, i: Column) -> Column:
        own = tx.js_trim(F.regexp_extract(attr, xml_id, 1))
        key = F.when(own != "", own).otherwise(F.format_string("bib_%d", i + 1))
        return F.struct(key.alias("key"), F.nullif(strip_tags(body), F.lit("")).alias("raw"))

    return tx.let(found, lambda f: F.transform(f["attrs"], lambda attr, i: entry(attr, F.get(f["bodies"], i), i)))


def tag_table(pages: DataFrame, key: str, text: str, tag: str) -> DataFrame:
    """(key, ord, text) rows of one tag."""
    df = pages.select(key, F.posexplode(tag_contents(F.col(text), tag)).alias("pos", "text"))
    return df.select(key, (F.col("pos") + 1).alias("ord"), "text")


def anchored_text(full: Column, segments: Column) -> Column:
    """Slices ``[start, end)`` of a text joined by line ends; invalid or blank ones skipped."""
    valid = F.filter(segments, lambda s: s["end"] > s["start"])
    parts = F.transform(
        valid, lambda s: F.substring(full, s["start"] + 1, s["end"] - s["start"])
    )
    return F.array_join(F.filter(parts, lambda p: ~tx.is_blank(p)), "\n")


def anchored_paragraphs(full: Column, paragraphs: Column) -> Column:
    """Non-blank anchored paragraphs; the whole text if there is none."""
    texts = F.filter(
        F.transform(paragraphs, lambda segs: anchored_text(full, segs)), lambda t: ~tx.is_blank(t)
    )
    whole = F.when(tx.is_blank(full), F.array().cast("array<string>")).otherwise(F.array(full))
    return tx.let(texts, lambda t: F.when(F.size(t) > 0, t).otherwise(whole))


def flat_paragraphs(texts: Column) -> Column:
    """Every text split on blank lines, flattened."""
    return F.flatten(F.transform(texts, lambda t: tx.paragraph_list(tx.extracted_text(t))))


def dedupe_paragraphs(texts: Column) -> Column:
    """Spaces normalised, at least three characters, first of equal lower-case texts."""
    clean = F.filter(F.transform(texts, tx.spaces), lambda t: F.length(t) >= 3)
    return aa.first_of_each(clean, lambda t: F.lower(t))


def _strings_of(v: Column, path: str) -> Column:
    """String elements of a JSON array member (others dropped); null if it is no array."""
    arr = F.try_variant_get(v, path, "array<variant>")
    is_array = F.schema_of_variant(F.try_variant_get(v, path, "variant")).startswith("ARRAY")
    texts = F.filter(
        F.transform(
            arr,
            lambda x: F.when(F.schema_of_variant(x) == "STRING", F.try_variant_get(x, "$", "string")),
        ),
        lambda t: t.isNotNull(),
    )
    return F.when(is_array, texts)


def _string_of(v: Column, path: str) -> Column:
    member = F.try_variant_get(v, path, "variant")
    return F.when(F.schema_of_variant(member) == "STRING", F.try_variant_get(v, path, "string"))


def _member_texts(v: Column, path: str, names: list[str]) -> Column:
    """First string member among ``names`` of each object of a JSON array."""
    arr = F.try_variant_get(v, path, "array<variant>")
    is_array = F.schema_of_variant(F.try_variant_get(v, path, "variant")).startswith("ARRAY")
    texts = F.transform(arr, lambda x: F.coalesce(*[_string_of(x, f"$.{n}") for n in names], F.lit("")))
    return F.when(is_array, F.filter(texts, lambda t: ~tx.is_blank(t)))


def payload_paragraphs(raw: Column) -> Column:
    """Service payload: ``paragraphs[]``, else ``text``, ``markdown``, ``chunks[].text|content``."""
    v = F.try_parse_json(raw)
    one = lambda c: F.when(c.isNotNull(), F.array(c))
    texts = F.coalesce(
        _strings_of(v, "$.paragraphs"),
        one(_string_of(v, "$.text")),
        one(_string_of(v, "$.markdown")),
        _member_texts(v, "$.chunks", ["text", "content"]),
        F.array().cast("array<string>"),
    )
    return flat_paragraphs(texts)


def model_paragraphs(raw: Column) -> Column:
    """Model payload: ``paragraphs[]`` deduped, else ``text``, else ``pages[].text``; null if none."""
    v = F.try_parse_json(raw)
    text = _string_of(v, "$.text")
    pages = _member_texts(v, "$.pages", ["text"])
    split = lambda c: tx.paragraph_list(tx.extracted_text(c))
    return F.coalesce(
        dedupe_paragraphs(_strings_of(v, "$.paragraphs")),
        F.when(text.isNotNull(), split(text)),
        F.when(pages.isNotNull(), split(F.array_join(pages, "\n\n"))),
    )
