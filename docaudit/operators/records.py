"""Session, submission and analysis records: defaults, merges, latest rows, monitoring."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docaudit import fixed as fx
from docaudit.functions import text as tx
from docaudit.functions.times import millis
from docaudit.operators import archive as ar

DEFAULTS = {
    "submission": {"artifact_type": "PAPER", "status": "UPLOADED"},
    "analysis": {"status": "QUEUED", "progress": 0.0},
}


def with_defaults(records: DataFrame, kind: str) -> DataFrame:
    """New records: missing fields get their default, missing times the current time."""
    out = records
    for name, value in DEFAULTS.get(kind, {}).items():
        column = F.col(name) if name in records.columns else F.lit(None)
        out = out.withColumn(name, F.coalesce(column, F.lit(value)))
    for name in ("created_at", "updated_at"):
        if name in records.columns:
            now = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
            out = out.withColumn(name, F.coalesce(F.col(name), now))
    return out


def _order(order: list[str]) -> Column:
    return F.struct(*[F.col(c) for c in order])


def merge_updates(updates: DataFrame, key: str, fields: list[str], order: list[str]) -> DataFrame:
    """Newest non-null value per field; an absent field keeps the older value.

    A plain aggregate with map-side combine, so a key with very many updates is no hot spot.
    """
    newest = [
        F.max_by(f, F.when(F.col(f).isNotNull(), _order(order))).alias(f) for f in fields
    ]
    return updates.groupBy(key).agg(*newest)


def with_changes(snapshot: DataFrame, changes: DataFrame, key: str, buckets: int, kept: list[str] = ()) -> DataFrame:
    """A snapshot's rows with the newer rows of ``changes`` (one for each key, the same columns) put over them.

    A changed key takes the new row as a whole, except that fields in ``kept`` keep the older value
    where the new one is null. The changes are exchanged to the buckets of the snapshot, which
    itself (``storage.write_snapshot``) is read as it lies: no part of it travels. Keys aren't null.
    """
    rest = [c for c in snapshot.columns if c != key]
    new = changes.repartition(buckets, key).select(F.col(key), F.struct(*rest).alias("new"))
    both = snapshot.select(key, F.struct(*rest).alias("old")).join(new, key, "full")

    def field(name: str) -> Column:
        fresh, old = F.col("new")[name], F.col("old")[name]
        return (F.coalesce(fresh, old) if name in kept else F.when(F.col("new").isNotNull(), fresh).otherwise(old)).alias(name)

    return both.select(key, *map(field, rest))


def latest_status(updates: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Last status update as a whole: a missing error removes an older one; step is kept."""
    at = _order(order)
    last = F.max_by(F.struct("status", "progress", "error"), at)
    step = F.max_by("step", F.when(F.col("step").isNotNull(), at))
    df = updates.groupBy(key).agg(last.alias("last"), step.alias("step"))
    return df.select(key, "last.status", "last.progress", "step", "last.error").withColumn(
        "terminal", F.col("status").isin("READY", "FAILED")
    )


def latest_row(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One whole row per key, the last by ``order`` (turns by id, trace snapshots, ...)."""
    rest = [c for c in rows.columns if c not in keys]
    last = F.max_by(F.struct(*rest), _order(order)).alias("r")
    return rows.groupBy(*keys).agg(last).select(*keys, "r.*")


def to_millis(c: Column) -> Column:
    """Milliseconds of an ISO time text; 0 if it is missing or no date."""
    return F.coalesce(F.unix_millis(F.try_to_timestamp(c)), F.lit(0))


def latest_per_session(rows: DataFrame, time: str, order: str) -> DataFrame:
    """Newest row per session; an invalid time counts as 0, ties go to the earlier row."""
    at = F.struct(to_millis(F.col(time)).alias("ms"), (-F.col(order)).alias("neg"))
    rest = [c for c in rows.columns if c != "session_id"]
    return rows.groupBy("session_id").agg(F.max_by(F.struct(*rest), at).alias("r")).select(
        "session_id", "r.*"
    )


def session_status(status: Column) -> Column:
    return (
        F.when(status.isNull(), "active")
        .when(status == "READY", "completed")
        .when(status == "FAILED", "error")
        .otherwise("analyzing")
    )


def retention_days(mode: Column, ttl_hours: Column) -> Column:
    days = F.greatest(F.lit(1), F.floor(ttl_hours / 24 + 0.5)).cast("int")
    default = F.when(mode == "SAVE", 30).otherwise(1)
    return F.when(ttl_hours.isNotNull() & (ttl_hours != 0), days).otherwise(default)


def session_view(sessions: DataFrame, analyses: DataFrame, submissions: DataFrame) -> DataFrame:
    """Session with its latest analysis and submission, file name, status and settings."""
    a = latest_per_session(analyses, "updated_at", "ord").select(
        "session_id", "analysis_id", F.col("status").alias("analysis_status")
    )
    s = latest_per_session(submissions, "created_at", "ord").select(
        "session_id", "submission_id", "artifact_type", "input_type", "path"
    )
    df = sessions.join(a, "session_id", "left").join(s, "session_id", "left")
    name = F.when(F.col("submission_id").isNotNull(), ar.file_name(F.col("path")))
    kind = F.when(F.col("submission_id").isNotNull(), F.coalesce("artifact_type", F.lit("PAPER")))
    file_type = F.when(kind == "PAPER", F.when(F.col("input_type") == "PDF", "pdf").otherwise("zip")).when(
        kind.isNotNull(), "artifact"
    )
    return df.select(
        "session_id",
        "analysis_id",
        "submission_id",
        F.concat(F.lit("upl_"), F.col("submission_id")).alias("upload_id"),
        name.alias("filename"),
        F.when(name.isNotNull(), ar.title_of(name)).alias("title"),
        file_type.alias("file_type"),
        kind.alias("artifact_type"),
        session_status(F.col("analysis_status")).alias("status"),
        (F.col("mode") == "SAVE").alias("save_enabled"),
        retention_days(F.col("mode"), F.col("ttl_hours")).alias("retention_days"),
        F.when(F.col("language") == "en", "en").otherwise("ja").alias("language"),
    )


def recent_sessions(sessions: DataFrame, kept: int = 10, shown: int = 3) -> DataFrame:
    """The last ten sessions, newest first, with the first three marked."""
    last = sessions.orderBy(F.desc("created_at"), F.desc("session_id")).limit(kept)
    # At most ten rows: numbering them needs no window over the whole table.
    ranked = last.agg(F.reverse(F.array_sort(F.collect_list(F.struct("created_at", "session_id")))).alias("s"))
    df = ranked.select(F.posexplode("s").alias("pos", "r"))
    return df.select(
        (F.col("pos") + 1).alias("rank"), "r.session_id", "r.created_at", (F.col("pos") < shown).alias("shown")
    )


# ---- progress and agents -------------------------------------------------------------------


def normal_progress(p: Column) -> Column:
    return F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.when(p <= 1, p * 100).otherwise(p)))


def progress_message(error: Column, status: Column, step: Column) -> Column:
    by_status = reduce(lambda c, kv: c.when(status == kv[0], kv[1]), fx.PROGRESS_BY_STATUS.items(), F)
    by_step = reduce(lambda c, kv: c.when(step == kv[0], kv[1]), fx.PROGRESS_BY_STEP.items(), F)
    return F.coalesce(
        F.nullif(error, F.lit("")), by_status, by_step, F.when(status == "QUEUED", fx.PROGRESS_QUEUED)
    )


def trace_entries(stages: DataFrame, max_highlights: int | None = None) -> DataFrame:
    """Stage rows (doc_id, seq, agent_id, role, status, started_at, ended_at, summary, highlights)."""
    ms = millis(stages, "ended_at") - millis(stages, "started_at")
    return stages.withColumn("status", F.coalesce("status", F.lit("DONE"))).withColumn(
        "duration_ms", F.greatest(F.lit(1).cast("long"), ms)
    ).withColumn("highlights", tx.first_items("highlights", max_highlights))


def trace_progress(trace: DataFrame, key: str = "doc_id") -> DataFrame:
    """Distinct roles seen of the eight, percent done, first missing role."""
    roles = F.array(*[F.lit(r) for r in fx.AGENT_ROLES])
    known = F.when(F.col("role").isin(fx.AGENT_ROLES), F.col("role"))
    df = trace.groupBy(key).agg(F.collect_set(known).alias("seen"))
    n = F.size("seen")
    return df.select(
        key,
        n.alias("done"),
        F.floor(n * 100 / len(fx.AGENT_ROLES) + 0.5).cast("int").alias("percent"),
        F.get(F.array_except(roles, F.col("seen")), F.lit(0)).alias("first_missing"),
    )


def step_states(trace: DataFrame, analyses: DataFrame, key: str = "analysis_id") -> DataFrame:
    """State of each of the eight steps: done, warn, active or pending."""
    # The last entry of a role counts; a map has at most the eight roles.
    per_role = trace.groupBy(key, "role").agg(F.max_by("status", "seq").alias("status"))
    last = per_role.groupBy(key).agg(
        F.map_from_entries(F.collect_list(F.struct("role", "status"))).alias("by_role")
    )
    roles = F.array(*[F.lit(r) for r in fx.AGENT_ROLES])
    df = analyses.select(key, F.col("status").alias("run_status")).join(last, key, "left")
    none = F.create_map().cast("map<string,string>")
    df = df.withColumn("by_role", F.coalesce("by_role", none))
    df = df.withColumn(
        "first_missing", F.get(F.array_except(roles, F.map_keys("by_role")), F.lit(0))
    )
    df = df.select(key, "run_status", "by_role", "first_missing", F.posexplode(roles).alias("pos", "role"))
    status = F.try_element_at("by_role", F.col("role"))
    state = (
        F.when(status.isin("DONE", "SKIPPED"), "done")
        .when(status == "WARN", "warn")
        .when(F.col("run_status").isin("READY", "FAILED"), "pending")
        .when(F.col("role") == F.col("first_missing"), "active")
        .otherwise("pending")
    )
    return df.select(key, (F.col("pos") + 1).alias("step"), "role", state.alias("state"))


def lease_status(status: Column, owner: Column, expires: Column, now: Column) -> Column:
    """finished, locked (owner set and lease not over) or free."""
    ms = F.unix_millis(F.try_to_timestamp(expires))
    held = F.coalesce((owner != "") & (ms > F.unix_millis(now)), F.lit(False))
    return F.when(status.isin("READY", "FAILED"), "finished").when(held, "locked").otherwise("free")


def token_hash(token: Column) -> Column:
    t = F.coalesce(F.nullif(tx.js_trim(token), F.lit("")), F.lit("anonymous"))
    return F.sha2(t, 256)
