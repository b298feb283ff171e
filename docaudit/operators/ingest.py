"""Validation of artifact and upload requests: first failing rule wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docaudit import fixed as fx
from docaudit.functions import text as tx
from docaudit.operators import archive as ar


def format_allowed(kind: Column, fmt: Column) -> Column:
    """Is the format allowed for the type? A missing format is."""
    allowed = F.lit(False)
    for k, formats in fx.FORMATS_BY_TYPE.items():
        allowed = allowed | ((kind == k) & fmt.isin(formats))
    return fmt.isNull() | F.coalesce(allowed, F.lit(False))


def _retention_error(v: Column, path: str, prefix: str = "") -> Column:
    """Error of a retention policy inside a variant; null if fine or missing."""
    member = F.try_variant_get(v, path, "variant")
    kind = F.schema_of_variant(member)
    mode = F.try_variant_get(v, f"{path}.mode", "string")
    mode_ok = F.coalesce(
        (F.schema_of_variant(F.try_variant_get(v, f"{path}.mode", "variant")) == "STRING")
        & mode.isin(fx.RETENTION_MODES),
        F.lit(False),
    )
    ttl_kind = F.schema_of_variant(F.try_variant_get(v, f"{path}.ttlHours", "variant"))
    number = ttl_kind.rlike("^(?:BIGINT|DECIMAL|DOUBLE|FLOAT|INT|SMALLINT|TINYINT)")
    return F.when(
        kind.isNotNull(),
        F.when(~kind.startswith("OBJECT"), f"{prefix}retentionPolicy must be object")
        .when(~mode_ok, f"{prefix}retentionPolicy.mode must be NO_SAVE or SAVE")
        .when(ttl_kind.isNotNull() & ~number, f"{prefix}retentionPolicy.ttlHours must be number"),
    )


def retention_error(mode: Column, ttl: Column, has_policy: Column) -> Column:
    """The same rule for a policy held in plain columns (``ttl`` as text)."""
    bad_ttl = ttl.isNotNull() & ttl.try_cast("double").isNull()
    return F.when(
        has_policy,
        F.when(~F.coalesce(mode.isin(fx.RETENTION_MODES), F.lit(False)), "retentionPolicy.mode must be NO_SAVE or SAVE")
        .when(bad_ttl, "retentionPolicy.ttlHours must be number"),
    )


def validate_artifacts(requests: DataFrame) -> DataFrame:
    """Adds ``error``: the first broken rule, null for a valid request.

    Columns: artifact_type, content, title, content_format, source_ref, mode, ttl_hours.
    """
    c = F.col
    n = F.length(tx.js_trim(c("content")))
    too_long = lambda name, limit: F.length(tx.js_trim(c(name))) > limit
    error = F.coalesce(
        F.when(
            ~F.coalesce(c("artifact_type").isin(fx.ARTIFACT_TYPES), F.lit(False)),
            "artifact_type must be PAPER|PR|DOC|SHEET",
        ),
        F.when(F.coalesce(n, F.lit(0)) == 0, "content must be a non-empty string"),
        F.when(n < fx.ARTIFACT_MIN_CHARS, f"content is too short (min {fx.ARTIFACT_MIN_CHARS} chars required)"),
        F.when(n > fx.ARTIFACT_MAX_CHARS, f"content is too long (max {fx.ARTIFACT_MAX_CHARS} chars)"),
        F.when(too_long("title", fx.ARTIFACT_MAX_TITLE), f"title is too long (max {fx.ARTIFACT_MAX_TITLE} chars)"),
        F.when(
            c("content_format").isNotNull() & ~c("content_format").isin(fx.ARTIFACT_FORMATS),
            "content_format must be plain|markdown|diff|json",
        ),
        F.when(
            ~format_allowed(c("artifact_type"), c("content_format")),
            F.concat(
                F.lit("content_format "), c("content_format"), F.lit(" is not allowed for "), c("artifact_type")
            ),
        ),
        F.when(
            too_long("source_ref", fx.ARTIFACT_MAX_SOURCE_REF),
            f"source_ref is too long (max {fx.ARTIFACT_MAX_SOURCE_REF} chars)",
        ),
        retention_error(c("mode"), c("ttl_hours"), c("mode").isNotNull() | c("ttl_hours").isNotNull()),
    )
    return requests.withColumn("error", error)


def validate_metadata(uploads: DataFrame, column: str = "metadata") -> DataFrame:
    """Adds ``error`` for upload metadata given as JSON text; null metadata is fine."""
    v = F.try_parse_json(F.col(column))
    kind = F.schema_of_variant(v)

    def not_text(name: str) -> Column:
        member = F.schema_of_variant(F.try_variant_get(v, f"$.{name}", "variant"))
        return F.when(member.isNotNull() & (member != "STRING"), f"metadata.{name} must be string")

    artifact = F.try_variant_get(v, "$.artifactType", "variant")
    type_ok = F.coalesce(
        F.try_variant_get(v, "$.artifactType", "string").isin(fx.ARTIFACT_TYPES)
        & (F.schema_of_variant(artifact) == "STRING"),
        F.lit(False),
    )
    error = F.coalesce(
        F.when(v.isNull(), "metadata is not valid JSON"),
        F.when(~kind.startswith("OBJECT"), "metadata must be a JSON object"),
        F.when(artifact.isNotNull() & ~type_ok, "metadata.artifactType must be PAPER|PR|DOC|SHEET"),
        not_text("language"),
        not_text("domainTag"),
        _retention_error(v, "$.retentionPolicy", "metadata."),
    )
    return uploads.withColumn("error", F.when(F.col(column).isNotNull(), error))


def accept(validated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid rows, rejects)."""
    return validated.where(F.col("error").isNull()), validated.where(F.col("error").isNotNull())


def artifact_objects(valid: DataFrame) -> DataFrame:
    """Input type, content type and file name of accepted artifacts."""
    fmt, kind = F.col("content_format"), F.col("artifact_type")
    base = F.coalesce(
        F.nullif(tx.js_trim(F.col("title")), F.lit("")), F.concat(F.lower(kind), F.lit("_artifact"))
    )
    return valid.select(
        "*",
        ar.input_type_of(kind).alias("input_type"),
        ar.content_type_of(fmt).alias("content_type"),
        F.concat(base, ar.suffix_of(fmt)).alias("file_name"),
    )
