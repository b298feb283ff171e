"""Anchored fixed-window rate limit over a request table.

A key's window starts at its first request and lasts ``window_ms``; the first request after
that opens the next window. Denied requests neither count nor extend, so the chain of window
starts depends on the request times alone. That chain is sequential per key, but a stretch of time
is a function of it: from the time at which the next window may open when the chain enters, to that
time when it leaves. These exit functions are made for each hour and composed up a tree of days and
months; the months of a key then tell where its chain enters each of them, and going down again each
day and hour. The steps are the same for any window, span and number of requests. A function has a
piece for each request time it tells apart, at most one a millisecond of a window; no step holds all
requests of a key with many. A key with few is one stretch.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docaudit import fixed as fx
from docaudit.functions.times import millis
from docaudit.sources.storage import stored

HOUR_MS = 3_600_000
HOURS, DAYS = 24, 30  # of the next level
FEW = 10_000  # request times of a key that are one stretch
FIRST = -(1 << 62)  # before every time: a key's first request opens a window
Exit = tuple[np.ndarray, np.ndarray]  # sorted entries up to which, and the time of opening that each leads to


def compressed(upto: np.ndarray, out: np.ndarray) -> Exit:
    """Neighbouring pieces that lead to the same time are one."""
    kept = np.append(out[1:] != out[:-1], True)
    return upto[kept], out[kept]


def exit_of(at: np.ndarray, window_ms: int) -> Exit:
    """The exit function of sorted request times: pointers to the next window's start, doubled until they settle."""
    after = np.searchsorted(at, at + window_ms)
    step = np.where(after < len(at), after, np.arange(len(at)))
    while not np.array_equal(step, jumped := step[step]):
        step = jumped
    return compressed(at, at[step] + window_ms)


def through(stretch: Exit, entries: np.ndarray) -> np.ndarray:
    """Where entries lead; behind the last request of a stretch nothing opens."""
    upto, out = stretch
    at = np.searchsorted(upto, entries)
    return np.where(at < len(upto), out[np.minimum(at, len(upto) - 1)], entries)


def composed(stretches: list[Exit]) -> Exit:
    """The exit function of neighbouring stretches in order of time."""
    whole = stretches[0]
    for stretch in stretches[1:]:
        whole = compressed(np.append(whole[0], stretch[0]), np.append(through(stretch, whole[1]), stretch[1]))
    return whole


TIMES = T.ArrayType(T.LongType())
EXIT = T.StructType([T.StructField("upto", TIMES), T.StructField("out", TIMES)])
PLACED = T.ArrayType(T.StructType([T.StructField("window", T.LongType()), T.StructField("before", T.LongType())]))


def _array(values: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, values)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(values) if values else [], pa.int64()))


def _exits(found: list[Exit]) -> pa.StructArray:
    return pa.StructArray.from_arrays([_array([f[n] for f in found]) for n in (0, 1)], ["upto", "out"])


def _stretches(exits: pa.ListScalar) -> list[Exit]:
    upto, out = (exits.values.field(n) for n in (0, 1))
    return [(upto[n].values.to_numpy(), out[n].values.to_numpy()) for n in range(len(upto))]


def _exit_udf(window_ms: int):
    @F.arrow_udf(EXIT)
    def exits(times: pa.Array) -> pa.Array:
        return _exits([exit_of(t.values.to_numpy(), window_ms) for t in times])

    return exits


@F.arrow_udf(EXIT)
def _composed(exits: pa.Array) -> pa.Array:
    return _exits([composed(_stretches(e)) for e in exits])


@F.arrow_udf(TIMES)
def _entries(exits: pa.Array, entry: pa.Array) -> pa.Array:
    """Where the chain enters each of some neighbouring stretches."""
    out = []
    for some, first in zip(exits, entry):
        held = [np.array([first.as_py()])]
        for stretch in _stretches(some)[:-1]:
            held.append(through(stretch, held[-1]))
        out.append(np.concatenate(held))
    return _array(out)


def _placed_udf(window_ms: int):
    """UDF: an hour's times with their numbers of requests, and the entry -> window start and requests before, within the hour."""

    @F.arrow_udf(PLACED)
    def placed(times: pa.Array, numbers: pa.Array, entries: pa.Array) -> pa.Array:
        windows, before = [], []
        for at, n, entry in zip(times, numbers, entries.to_pylist()):
            at, n = at.values.to_numpy(), n.values.to_numpy()
            own, i = np.full(len(at), entry - window_ms), int(np.searchsorted(at, entry))
            while i < len(at):
                j = int(np.searchsorted(at, at[i] + window_ms))
                own[i:j], i = at[i], j
            sums = np.cumsum(n) - n
            opened = np.append(True, own[1:] != own[:-1])
            windows.append(own)
            before.append(sums - sums[opened][np.cumsum(opened) - 1])
        ends = pa.array(np.cumsum([0, *map(len, windows)]), pa.int32())
        flat = [pa.array(np.concatenate(v) if v else [], pa.int64()) for v in (windows, before)]
        return pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays(flat, ["window", "before"]))

    return placed


def _level(below: DataFrame, name: str, at: Column, part: str) -> DataFrame:
    """(key, the level's number, parts below it in order, their composed exit function), stored."""
    parts = F.sort_array(F.collect_list(F.struct(F.col(part).alias("at"), F.col("exit")))).alias("parts")
    grouped = below.select("key", part, "exit", at.alias(name)).groupBy("key", name).agg(parts)
    return stored(grouped.withColumn("exit", _composed(F.col("parts.exit"))), name)


def _down(level: DataFrame, name: str, entries: DataFrame, part: str) -> DataFrame:
    """(key, part, entry) of the parts of a level, from the entries of that level."""
    rows = level.drop("exit").join(entries, ["key", name])
    return rows.select("key", F.inline(F.arrays_zip(F.col("parts.at").alias(part), _entries(F.col("parts.exit"), F.col("entry")).alias("entry"))))


def window_starts(instants: DataFrame, window_ms: int, opened: DataFrame | None = None) -> DataFrame:
    """(key, ms, n) distinct request times -> (key, ms, window_start, before), before: requests earlier in the window.

    ``key`` must not be null. ``opened`` has key, start and count of windows that earlier requests opened.
    """
    times = F.sort_array(F.collect_list(F.struct("ms", "n"))).alias("times")
    many = instants.groupBy("key").agg(F.count("*").alias("many")).where(F.col("many") > FEW)
    hour = F.when(F.col("many").isNotNull(), F.floor(F.col("ms") / HOUR_MS)).otherwise(0).alias("hour")
    hours = instants.join(many, "key", "left").groupBy("key", hour).agg(times)
    hours = stored(hours.withColumn("exit", _exit_udf(window_ms)(F.col("times.ms"))), "hours")
    days = _level(hours, "day", F.floor(F.col("hour") / HOURS), "hour")
    months = _level(days, "month", F.floor(F.col("day") / DAYS), "day")
    whole = months.groupBy("key").agg(F.sort_array(F.collect_list(F.struct(F.col("month").alias("at"), "exit"))).alias("parts"))
    first = F.lit(FIRST).cast("long")
    if opened is not None:
        whole = whole.join(opened.select("key", "start"), "key", "left")
        first = F.coalesce(F.col("start") + window_ms, first)
    entries = whole.select("key", F.inline(F.arrays_zip(F.col("parts.at").alias("month"), _entries(F.col("parts.exit"), first).alias("entry"))))
    entries = _down(days, "day", _down(months, "month", entries, "day"), "hour")
    rows = hours.drop("exit").join(entries, ["key", "hour"])
    rows = rows.withColumn("placed", _placed_udf(window_ms)(F.col("times.ms"), F.col("times.n"), F.col("entry")))
    rows = stored(rows.select("key", "hour", F.inline(F.arrays_zip("times", "placed"))).select("key", "hour", "times.*", "placed.*"), "placed")
    # a window that goes on over hours: what the hours before hold of it
    held = rows.groupBy("key", "window", "hour").agg(F.sum("n").alias("held"))
    before = Window.partitionBy("key", "window").orderBy("hour").rowsBetween(Window.unboundedPreceding, -1)
    carried = held.select("key", "window", "hour", F.sum("held").over(before).alias("carried")).where("carried IS NOT NULL")
    found = rows.join(carried, ["key", "window", "hour"], "left")
    if opened is not None:
        found = found.join(opened.select("key", F.col("start").alias("window"), F.col("count").alias("counted")), ["key", "window"], "left")
        found = found.withColumn("before", F.col("before") + F.coalesce("counted", F.lit(0)))
    return found.select("key", "ms", F.col("window").alias("window_start"), (F.col("before") + F.coalesce("carried", F.lit(0))).alias("before"))


def rate_limit(
    requests: DataFrame, max_requests: int = 20, window_ms: int = 60_000, opened: DataFrame | None = None
) -> DataFrame:
    """Requests (key, request_id, ts) -> allowed, retry_after_ms, window_start (ms).

    Requests without a key share one, those without a time get no decision (null). ``opened``
    (key, start, count) has the window that earlier requests of a key opened and how many count in
    it; a request before that window's end counts in it, also one from before its start.
    """
    # the key within a struct, since joins drop null keys but compare structs that hold null
    req = requests.withColumn("__key", F.struct("key")).withColumn("__ms", millis(requests, "ts"))
    timed = req.where(F.col("__ms").isNotNull())
    placed = window_starts(timed.groupBy(F.col("__key").alias("key"), F.col("__ms").alias("ms")).agg(F.count("*").alias("n")), window_ms, opened and opened.withColumn("key", F.struct("key")))
    tie = Window.partitionBy("__key", "__ms").orderBy("request_id")
    df = req.withColumn("__rank", F.row_number().over(tie)).join(placed.toDF("__key", "__ms", "window_start", "__before"), ["__key", "__ms"], "left")
    allowed = F.col("__before") + F.col("__rank") <= max_requests
    retry = F.when(~allowed, window_ms - (F.col("__ms") - F.col("window_start")))
    return df.select(
        *requests.columns, allowed.alias("allowed"), retry.alias("retry_after_ms"), "window_start"
    )


def open_windows(decided: DataFrame, max_requests: int, opened: DataFrame | None = None) -> DataFrame:
    """(key, start, count) of the last window of each key with decisions, for the requests that follow."""
    timed = decided.where(F.col("window_start").isNotNull()).groupBy("key", F.col("window_start").alias("start"))
    last = timed.agg(F.count_if("allowed").alias("count")).groupBy(F.struct("key").alias("key")).agg(F.max(F.struct("start", "count")).alias("last"))
    df = last.select("key", "last.*")
    if opened is not None:
        before = opened.select(F.struct("key").alias("key"), "start", F.col("count").alias("counted"))
        df = df.join(before, ["key", "start"], "left").withColumn("count", F.col("count") + F.coalesce("counted", F.lit(0)))
    return df.select("key.key", "start", F.least("count", F.lit(max_requests).cast("long")).alias("count"))


def limit_for(route: str) -> tuple[int, int]:
    """(max requests, window in ms) of a route."""
    return fx.RATE_LIMITS[route]
