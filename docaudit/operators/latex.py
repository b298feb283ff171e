"""LaTeX archives: member selection, includes, sections, figures, paragraphs, citations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docaudit import fixed as fx
from docaudit.functions import arrays as aa
from docaudit.functions import text as tx
from docaudit.functions.plan import settle
from docaudit.operators.archive import safe_path

SECTION, FIGURE, INCLUDE, CITE = fx.LATEX_SECTION, fx.LATEX_FIGURE, fx.LATEX_INCLUDE, fx.LATEX_CITE
BIB_KEY = r"@\w+" + tx.WS + r"*\{" + tx.WS + r"*([^," + tx.WS[1:-1] + "]+)" + tx.WS + "*,"
LABEL_REF = fx.LATEX_REF
NUMBER_REF = tx.spark_regex(fx.FIGURE_NUMBER, True)


# ---- archive members (archive_id, ordinal, path, text) ----------------------------------


def safe_members(members: DataFrame) -> DataFrame:
    """Members by their safe path. Of a repeated path the last one counts, at the place of the first."""
    clean = members.withColumn("path", safe_path(F.col("path"))).where(F.col("path").isNotNull())
    return clean.groupBy("archive_id", "path").agg(F.min("ordinal").alias("ordinal"), F.max_by("text", "ordinal").alias("text"))


def main_tex(members: DataFrame) -> DataFrame:
    """Main file per archive: first ``*/main.tex``, else ``main.tex``, else the first .tex; null without any."""
    rows = members.withColumn("path", safe_path(F.col("path")))
    is_tex = F.lower("path").endswith(".tex")
    rank = F.when(F.col("path").endswith("/main.tex"), 0).when(F.col("path") == "main.tex", 1).otherwise(2)
    return rows.groupBy("archive_id").agg(
        F.min_by(F.when(is_tex, F.col("path")), F.when(is_tex, F.struct(rank, F.col("ordinal")))).alias("main_path")
    )


def resolve_include(main_path: Column, target: Column) -> Column:
    """Path of an included file beside the main file; ``.tex`` added if there is no extension."""
    name = F.when(target.rlike(r"[^/]\.[^/.]*$"), target).otherwise(F.concat(target, F.lit(".tex")))
    folder = F.regexp_replace(main_path, "[^/]*$", "")
    none = F.array().cast("array<string>")

    def step(acc: Column, part: Column) -> Column:
        up = (part == "..") & (F.size(acc) > 0) & (F.element_at(acc, -1) != "..")
        return (
            F.when(part.isin("", "."), acc)
            .when(up, F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
            .otherwise(F.array_append(acc, part))
        )

    return F.array_join(F.aggregate(F.split(F.concat(folder, name), "/"), none, step), "/")


def expand_includes(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(archive_id, source) with one level of includes resolved, and a warning table.

    Missing or unsafe targets leave a line end and a warning, an archive without a .tex member an
    empty source and a warning.
    """
    members, entry = safe_members(members), main_tex(members)
    bare = entry.where(F.col("main_path").isNull()).select("archive_id")
    main = members.join(entry.withColumnRenamed("main_path", "path"), ["archive_id", "path"], "left_semi")
    text = tx.newlines(F.col("text"))
    pieces = F.arrays_zip(
        F.split(text, INCLUDE, -1).alias("before"), tx.regexp_all(text, INCLUDE, 1).alias("target")
    )
    parts = main.select("archive_id", F.col("path").alias("main"), F.posexplode(pieces).alias("pos", "x"))
    target = tx.js_trim(F.col("x.target"))
    parts = parts.select("archive_id", "pos", F.col("x.before").alias("before"), target.alias("target"),
                         resolve_include(F.col("main"), target).alias("path"))
    files = members.select("archive_id", "path", F.col("text").alias("included"))
    joined = parts.join(files, ["archive_id", "path"], "left")
    safe = safe_path(F.col("path")).isNotNull()
    body = F.when(F.col("target").isNull(), "").when(
        (F.col("target") != "") & safe & F.col("included").isNotNull(),
        F.concat(F.lit("\n"), F.col("included"), F.lit("\n")),
    ).otherwise("\n")
    joined = joined.withColumn("chunk", F.concat("before", body))
    # Pieces of one main file; their number is bounded by that file's size limit.
    source = joined.groupBy("archive_id").agg(
        F.array_sort(F.collect_list(F.struct("pos", "chunk"))).alias("chunks")
    ).select(
        F.col("archive_id"),
        tx.strip_latex_comments(F.array_join(F.col("chunks.chunk"), "")).alias("source"),
    )
    missing = (F.col("target") != "") & ~(safe & F.col("included").isNotNull())
    warnings = joined.where(missing).select(
        "archive_id", "pos",
        F.concat(F.lit("Included file not found: "), F.col("target")).alias("warning"),
    )
    source = source.unionByName(bare.select("archive_id", F.lit("").alias("source")))
    empty = bare.select("archive_id", F.lit(0).alias("pos"), F.lit(fx.MSG["archive_no_tex"]).alias("warning"))
    return source, warnings.unionByName(empty)


def bib_keys(members: DataFrame) -> DataFrame:
    """Bibliography keys of the .bib members, first occurrence wins."""
    bib = safe_members(members).where(F.lower("path").endswith(".bib"))
    keys = bib.select(
        "archive_id", "ordinal", F.posexplode(tx.regexp_all(F.col("text"), BIB_KEY, 1)).alias("pos", "key")
    )
    first = keys.where(F.col("key") != "").groupBy("archive_id", "key").agg(
        F.min(F.struct("ordinal", "pos")).alias("place")
    )
    w = Window.partitionBy("archive_id").orderBy("place")
    return first.select("archive_id", F.row_number().over(w).alias("ord"), "key")


# ---- source text (doc_id, source, bib array<string>) -------------------------------------


def starts(lengths: Column) -> Column:
    """Start offsets of consecutive pieces."""
    return tx.let(
        lengths,
        lambda sizes: tx.let(
            aa.running(sizes, lambda a, b: a + b, F.lit(0)),
            lambda ends: F.transform(sizes, lambda n, i: F.get(ends, i) - n),
        ),
    )


def section_list(source: Column) -> Column:
    """Sections with id, level, title and offset; commands with empty braces are skipped."""
    commands = tx.regexp_all(source, SECTION, 0)
    before = F.split(source, SECTION, -1)
    sizes = F.flatten(
        F.zip_with(before, commands, lambda b, c: F.array(F.length(b), F.coalesce(F.length(c), F.lit(0))))
    )
    at = starts(sizes)
    found = tx.let(
        at,
        lambda offsets: F.transform(
            commands,
            lambda c, i: F.struct(
                F.regexp_extract(c, SECTION, 1).alias("name"),
                F.regexp_extract(c, SECTION, 2).alias("raw"),
                F.get(offsets, i * 2 + 1).alias("start"),
            ),
        ),
    )
    kept = F.filter(found, lambda s: s["raw"] != "")
    return F.transform(
        kept,
        lambda s, i: F.struct(
            tx.seq_id("sec", i + 1).alias("section_id"),
            tx.spaces(s["raw"]).alias("title"),
            ((F.length(s["name"]) - 7) / 3 + 1).cast("int").alias("level"),
            s["start"].alias("start"),
        ),
    )


def mask(source: Column, pattern: str, fill: str) -> Column:
    """Replace every match by the same number of fill characters, so that offsets stay true."""
    found = F.transform(tx.regexp_all(source, pattern, 0), lambda m: F.repeat(F.lit(fill), F.length(m)))
    rest = F.split(source, pattern, -1)
    return F.array_join(
        F.zip_with(rest, found, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), ""
    )


def chunk_list(text: Column) -> Column:
    """Blank-line chunks (trimmed, non-empty) with their start offset."""
    parts = F.split(text, "\n{2,}", -1)
    seps = tx.regexp_all(text, "\n{2,}", 0)
    sizes = F.zip_with(parts, seps, lambda p, s: F.length(p) + F.coalesce(F.length(s), F.lit(0)))
    lead = f"^{tx.WS}+"
    chunks = tx.let(
        starts(sizes),
        lambda at: F.transform(
            parts,
            lambda p, i: F.struct(
                tx.js_trim(p).alias("text"),
                (F.get(at, i) + F.length(p) - F.length(F.regexp_replace(p, lead, ""))).alias("start"),
            ),
        ),
    )
    return F.filter(chunks, lambda c: c["text"] != "")


def citation_keys(text: Column) -> Column:
    """Keys of all ``\\cite`` commands, trimmed, distinct, in first-seen order."""
    raw = F.split(F.array_join(tx.regexp_all(text, CITE, 1), ","), ",")
    return F.array_distinct(F.filter(F.transform(raw, tx.js_trim), lambda k: k != ""))


def label_refs(text: Column) -> Column:
    """Labels referenced in a text, distinct, in first-seen order."""
    return F.array_distinct(
        F.filter(F.transform(tx.regexp_all(text, LABEL_REF, 1), tx.js_trim), lambda k: k != "")
    )


def number_refs(text: Column) -> Column:
    """Numbers of ``Fig. n`` and ``Figure n``, distinct, in first-seen order."""
    return F.array_distinct(tx.regexp_all(text, NUMBER_REF, 1))


def _with_section(chunks: Column, sections: Column) -> Column:
    """Chunks with the last section that starts at or before them: one pass over both, by offset."""
    none = F.lit(None).cast("string")
    event = lambda at, kind, id_, text: F.struct(at.alias("at"), F.lit(kind).alias("kind"), id_.alias("section_id"), text.alias("text"))
    events = F.concat(
        F.transform(sections, lambda s: event(s["start"], 0, s["section_id"], none)),
        F.transform(chunks, lambda c: event(c["start"], 1, none, c["text"])),
    )

    def carried(rows: Column) -> Column:
        ids = aa.running(F.transform(rows, lambda e: e["section_id"]), lambda a, b: F.coalesce(b, a), none)
        merged = tx.let(ids, lambda x: F.transform(rows, lambda e, i: e.withField("section_id", F.get(x, i))))
        return F.filter(merged, lambda e: e["kind"] == 1)

    return tx.let(F.sort_array(events), carried)


def paper_extract(docs: DataFrame) -> DataFrame:
    """Expanded LaTeX sources (doc_id, text) without a bibliography -> extract rows."""
    none = F.array().cast("array<string>")
    return latex_extract(docs.select("doc_id", tx.strip_latex_comments(F.col("text")).alias("source"), none.alias("bib")))


def latex_extract(sources: DataFrame) -> DataFrame:
    """(doc_id, source, bib) -> extract rows; map-only.

    Figures are masked with as many characters as they have. (Masking with fewer would let
    the offsets after a figure drift against the section offsets.)
    """
    df = sources.withColumn("sections", section_list(F.col("source")))
    df = df.withColumn("masked", mask(F.col("source"), FIGURE, "\n"))
    df = settle(df).withColumn("masked", mask(F.col("masked"), SECTION, " "))
    df = settle(df).withColumn("chunks", chunk_list(F.col("masked")))
    join_lines = f"{tx.WS}*\n{tx.WS}*"
    df = settle(df.drop("masked")).withColumn(
        "chunks",
        F.filter(
            F.transform(
                _with_section(F.col("chunks"), F.col("sections")),
                lambda c: F.struct(
                    tx.spaces(F.regexp_replace(c["text"], join_lines, " ")).alias("text"), c["section_id"].alias("section_id")
                ),
            ),
            lambda c: c["text"] != "",
        ),
    )
    df = settle(df).withColumn(
        "paragraphs",
        F.transform(
            "chunks",
            lambda c, i: F.struct(tx.seq_id("p", i + 1).alias("para_id"), c["section_id"], c["text"]),
        ),
    )
    df = settle(df.drop("chunks"))
    df = df.withColumn(
        "cites",
        F.filter(
            F.transform(
                "paragraphs",
                lambda p: F.struct(p["para_id"].alias("para_id"), citation_keys(p["text"]).alias("keys")),
            ),
            lambda c: F.size(c["keys"]) > 0,
        ),
    ).withColumn(
        "refs",
        F.transform(
            "paragraphs",
            lambda p: F.struct(
                p["para_id"].alias("para_id"),
                label_refs(p["text"]).alias("labels"),
                number_refs(p["text"]).alias("numbers"),
            ),
        ),
    )
    df = settle(df)
    blocks = tx.regexp_all(F.col("source"), FIGURE, 0)
    said = F.flatten(
        F.transform("refs", lambda r: F.transform(r["labels"], lambda x: F.struct(F.lower(x).alias("k"), r["para_id"].alias("v"))))
    )
    mentions = F.map_from_entries(
        F.transform(
            aa.groups(said, lambda x: x["k"]),
            lambda g: F.struct(g["k"], F.array_distinct(F.transform(g["xs"], lambda x: x["v"]))),
        )
    )

    def figure(by_label: Column, block: Column, i: Column) -> Column:
        label = F.nullif(tx.js_trim(F.regexp_extract(block, r"\\label\{([^}]*)\}", 1)), F.lit(""))
        caption = F.nullif(tx.spaces(F.regexp_extract(block, r"\\caption\{([^}]*)\}", 1)), F.lit(""))
        none = F.array().cast("array<string>")
        by = F.coalesce(F.try_element_at(by_label, F.lower(label)), none)
        return F.struct(
            tx.seq_id("fig", i + 1).alias("figure_id"),
            label.alias("label"),
            caption.alias("caption"),
            F.when(label.isNotNull(), by).otherwise(none).alias("mentioned_in"),
        )

    df = df.withColumn(
        "figures",
        tx.let(mentions, lambda by_label: F.transform(blocks, lambda b, i: figure(by_label, b, i))),
    )
    df = df.withColumn("bib", F.array_distinct("bib"))
    df = df.withColumn("warnings", F.array().cast("array<string>")).withColumn("artifact_type", F.lit("PAPER"))
    return settle(df.drop("source"))


# ---- child tables ---------------------------------------------------------------------------


def figure_table(extracts: DataFrame) -> DataFrame:
    return extracts.select("doc_id", F.posexplode("figures").alias("pos", "f")).select(
        "doc_id", (F.col("pos") + 1).alias("ord"), "f.*"
    )


def cite_table(extracts: DataFrame) -> DataFrame:
    """(doc_id, ord, para_id, key), one row per cited key and paragraph."""
    return extracts.select("doc_id", F.posexplode("cites").alias("pos", "c")).select(
        "doc_id", (F.col("pos") + 1).alias("ord"), "c.para_id", F.explode("c.keys").alias("key")
    )


def bib_table(extracts: DataFrame) -> DataFrame:
    return extracts.select("doc_id", F.posexplode("bib").alias("pos", "key")).select(
        "doc_id", (F.col("pos") + 1).alias("ord"), "key"
    )


def attach_mentions(figures: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """Figure mentions for separate tables: equi-join of labels with extracted references."""
    refs = paragraphs.select(
        "doc_id", F.col("ord").alias("p_ord"), "para_id", F.explode(label_refs(F.col("text"))).alias("ref")
    ).select("doc_id", "p_ord", "para_id", F.lower("ref").alias("k")).distinct()
    hits = figures.select("doc_id", "figure_id", F.lower("label").alias("k")).join(refs, ["doc_id", "k"])
    grouped = hits.groupBy("doc_id", "figure_id").agg(
        F.array_sort(F.collect_list(F.struct("p_ord", "para_id")))["para_id"].alias("mentioned_in")
    )
    none = F.array().cast("array<string>")
    return figures.drop("mentioned_in").join(grouped, ["doc_id", "figure_id"], "left").withColumn(
        "mentioned_in", F.coalesce("mentioned_in", none)
    )


def asof_section(paragraphs: DataFrame, sections: DataFrame, bucket: int = 65_536) -> DataFrame:
    """As-of join: each paragraph offset gets the last section that starts at or before it.

    ``paragraphs`` (doc_id, start, ...) and ``sections`` (doc_id, start, section_id). Offsets
    are cut into buckets, so that a huge document is spread over tasks: inside a bucket a
    running window finds the section, and the last section of the earlier buckets fills the
    gap at its beginning.
    """
    cut = F.floor(F.col("start") / bucket).alias("bucket")
    secs = sections.select("doc_id", cut, "start", "section_id")
    last = secs.groupBy("doc_id", "bucket").agg(F.max_by("section_id", "start").alias("last_id"))
    rows = paragraphs.select("*", cut, F.lit(1).alias("kind")).unionByName(
        secs.select("doc_id", "bucket", "start", F.col("section_id").alias("own_id"), F.lit(0).alias("kind")),
        allowMissingColumns=True,
    )
    run = Window.partitionBy("doc_id", "bucket").orderBy("start", "kind").rowsBetween(
        Window.unboundedPreceding, 0
    )
    rows = rows.withColumn("in_bucket", F.last("own_id", ignorenulls=True).over(run)).where("kind = 1")
    # Buckets in use per document: carry the last section forward over them.
    used = rows.select("doc_id", "bucket").distinct().join(last, ["doc_id", "bucket"], "full")
    prior = Window.partitionBy("doc_id").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    carry = used.select(
        "doc_id", "bucket", F.last("last_id", ignorenulls=True).over(prior).alias("carried_id")
    )
    return rows.join(carry, ["doc_id", "bucket"], "left").select(
        *paragraphs.columns, F.coalesce("in_bucket", "carried_id").alias("section_id")
    )
