"""Streaming twins of the batch operators, on Structured Streaming.

Each builder takes a streaming DataFrame and returns one; start it with any
sink. Keyed state lives in the state store and is checkpointed with the
query, so a restarted query (or a lost executor) resumes where it stopped.
Keys are dealt to ``groups`` key groups (see ``key_groups``): one call of
Python takes the rows of a group, with the states of its keys, so these
should fit a task; take more groups for very many keys. A query keeps the
number of groups it was started with.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepool.contracts import require_columns
from tidepool.operators.completion import GRAPH, JOB, LEVELS, TASK, declared_parts, level_keys
from tidepool.session import STATE_STORE
from tidepool.streaming.key_groups import GROUP, KEY_GROUPS, KeyGroups, bundled, grouped_rows
from tidepool.streaming.processors import (LATE_FIELDS, CompletionProcessor, FinalSessionProcessor,
                                           SyncProcessor)

# Event time at which the watermark means "end of stream" (an end marker
# row carries a later time): year 9999, as far as Python datetimes reach.
END_OF_STREAM_MS = 253370764800000
SESSION_FIELDS = [
    T.StructField("session_seq", T.LongType()), T.StructField("session_start_us", T.LongType()),
    T.StructField("session_end_us", T.LongType()), T.StructField("closed", T.BooleanType()),
    T.StructField("n_events", T.LongType()), T.StructField("value_cents", T.LongType())]


def _need_rocksdb(df: DataFrame) -> None:
    """transformWithState needs the RocksDB state store. The caller's
    configuration is not touched: a session without it is told what to set
    (``build_session`` sets it; ``session_settings(spark, STATE_STORE)`` sets it
    around the start of one query)."""
    key = "spark.sql.streaming.stateStore.providerClass"
    if df.sparkSession.conf.get(key, "") != STATE_STORE[key]:
        raise RuntimeError(f"set {key} to {STATE_STORE[key]}")


def _keys(keys) -> list[str]:
    return [keys] if isinstance(keys, str) else list(keys)


def _fields(df: DataFrame, names: Sequence[str]) -> list[T.StructField]:
    return [df.schema[n] for n in names]


def _by_key(rows: DataFrame, keys: Sequence[str], processor, out: T.StructType, time_mode: str,
            groups: int, event_time: str = "") -> DataFrame:
    """``processor`` of one key over ``rows``, for all keys of a key group at
    once (see ``KeyGroups``)."""
    _need_rocksdb(rows)
    if groups < 1:
        raise ValueError("need at least one key group")
    dealt, packed = grouped_rows(rows, keys, groups)
    if len(dealt.columns) == 2 and time_mode == "None":
        dealt = bundled(dealt)
    return dealt.groupBy(GROUP).transformWithState(
        KeyGroups(processor, keys, packed), out, "Append", time_mode,
        eventTimeColumnName=event_time)


def _arrival(rows: DataFrame, order: Sequence[str]) -> list[Column]:
    """The order columns as arr0, arr1, ...; times as microseconds. (Names with
    a leading underscore arrived renamed _1, _2, ... in the Python worker.)"""
    times = (T.TimestampType, T.TimestampNTZType)
    return [(F.unix_micros(F.col(c).cast("timestamp"))
             if isinstance(rows.schema[c].dataType, times) else F.col(c)).alias(f"arr{i}")
            for i, c in enumerate(order)]


def _prepare_event_time(stream: DataFrame, event_time: str, watermark: str,
                        end_marker: Column | None) -> DataFrame:
    et = F.col(event_time).cast("timestamp")
    # rows without an event time are in no window or session, as in batch
    s = stream.withColumn(event_time, et).where(F.col(event_time).isNotNull()) \
              .withWatermark(event_time, watermark)
    if end_marker is None:
        return s
    # End-of-stream markers only move the watermark; they never reach the
    # operator. The predicate names the event-time column on purpose: Spark
    # pushes filters that do not mention it below the watermark node, and
    # the marker would then never be seen by the watermark.
    is_marker = F.coalesce(end_marker & F.col(event_time).isNotNull(), F.lit(False))
    return s.where(~is_marker)


def stream_sessions_with_final(stream: DataFrame, keys: str | Sequence[str], event_time: str,
                               gap_seconds: float, is_final: Column | None = None,
                               tiebreak: str | None = None, value: Column | None = None,
                               lone_final: str = "close", watermark: str = "0 seconds",
                               end_marker: Column | None = None,
                               late: str = "drop", groups: int = KEY_GROUPS) -> DataFrame:
    """Sessions per key on a stream (see ``FinalSessionProcessor``): rows
    ``(keys..., session_seq, session_start_us, session_end_us, closed,
    n_events, value_cents)`` appended as sessions close. Without
    ``is_final`` these are the strict gap sessions. ``watermark`` is the
    allowed lateness; ``end_marker`` flags rows that only push the
    watermark (an end-of-stream sentinel).

    ``late="emit"``: rows that come too late for any session are not dropped
    but appended with the session columns NULL and ``late_event_us,
    late_tiebreak, late_value, watermark_us`` filled (:func:`on_time` and
    :func:`late_only` tell them apart), so that every input row with an event
    time is in a session or in the late rows."""
    if late not in ("drop", "emit"):
        raise ValueError("late must be 'drop' or 'emit'")
    ks = _keys(keys)
    require_columns(stream, *ks, event_time, where="stream_sessions_with_final")
    s = _prepare_event_time(stream, event_time, watermark, end_marker)
    prepared = s.select(
        *ks, F.unix_micros(F.col(event_time)).alias("ev_t"),
        F.coalesce(is_final, F.lit(False)).alias("ev_final") if is_final is not None
        else F.lit(False).alias("ev_final"),
        _tiebreak(tiebreak),
        F.coalesce(value, F.lit(0)).cast("long").alias("ev_v") if value is not None
        else F.lit(0).cast("long").alias("ev_v"))
    out = T.StructType(_fields(stream, ks) + SESSION_FIELDS)
    if late == "emit":
        for name in LATE_FIELDS:
            out = out.add(name, T.LongType())
    gap_us = int(round(gap_seconds * 1_000_000))
    return _by_key(prepared, ks, FinalSessionProcessor(ks, gap_us, lone_final, late == "emit"),
                   out, "EventTime", groups)


def _tiebreak(name: str | None) -> Column:
    """NULL first."""
    return F.coalesce((F.col(name) if name else F.lit(0)).cast("long"),
                      F.lit(-(2 ** 63))).alias("ev_tb")


def on_time(sessions: DataFrame) -> DataFrame:
    """The sessions of a result with late rows."""
    return sessions.where(F.col("session_seq").isNotNull()).drop(*LATE_FIELDS)


def late_only(sessions: DataFrame) -> DataFrame:
    """The late rows of a result with late rows: key, time, tiebreak, value
    and the watermark that had passed them."""
    none = {"session_seq", "session_start_us", "session_end_us", "closed", "n_events",
            "value_cents"}
    return sessions.where(F.col("session_seq").isNull()).select(
        *[c for c in sessions.columns if c not in none])


def stream_sync(inputs: Sequence[DataFrame], key: str = "key", value: str = "value",
                order: Sequence[str] = ("arrival_ts", "arrival_id"),
                match: str = "occurrence", groups: int = KEY_GROUPS) -> DataFrame:
    """Keyed alignment of several streams; arrival order is processing order
    (within a micro-batch, ``order``). occurrence: ``(key, occurrence,
    value_0..)``; arrival: ``(key, group, srcs, items)``. When the streams
    are slices of one stream, tag it once and use :func:`stream_sync_tagged`."""
    if not isinstance(inputs, (list, tuple)) or not inputs:
        raise ValueError("stream_sync needs a non-empty list of streaming DataFrames")
    n = len(inputs)
    types = [d.schema[value].dataType for d in inputs]
    parts = []
    for i, d in enumerate(inputs):
        require_columns(d, key, value, *order, where="stream_sync input")
        vals = [(F.col(value) if j == i else F.lit(None).cast(types[j])).alias(f"value_{j}")
                for j in range(n)]
        parts.append(d.select(F.col(key).alias("key"), F.lit(i).alias("src"), *vals,
                              *[F.col(c) for c in order]))
    return stream_sync_tagged(reduce(lambda a, b: a.unionByName(b), parts), n, order, match,
                              groups=groups)


def stream_sync_tagged(tagged: DataFrame, n_inputs: int,
                       order: Sequence[str] = ("arrival_ts", "arrival_id"),
                       match: str = "occurrence", mode: str = "synced",
                       end_marker: Column | None = None,
                       groups: int = KEY_GROUPS) -> DataFrame:
    """:func:`stream_sync` over one stream carrying all inputs: ``key``,
    ``src``, ``value_0 .. value_{n-1}`` and the ``order`` columns.

    ``mode``: ``synced`` / ``shortest`` emit complete rows only.
    ``longest`` also emits the incomplete rest of each key at the end of the
    stream: the first ``order`` column is then the event time (watermark
    without delay), and ``end_marker`` flags rows that end the stream.
    """
    if mode not in ("synced", "shortest", "longest"):
        raise ValueError("mode must be 'synced', 'shortest' or 'longest'")
    if mode == "longest" and end_marker is None:
        raise ValueError("mode='longest' needs an end_marker to know the stream ended")
    n = n_inputs
    vals = [f"value_{j}" for j in range(n)]
    require_columns(tagged, "key", "src", *vals, *order, where="stream_sync_tagged")
    if mode == "longest":
        tagged = _prepare_event_time(tagged, order[0], "0 seconds", end_marker)
    types = [tagged.schema[v].dataType for v in vals]
    u = tagged.select("key", F.col("src").cast("int").alias("src"), *_arrival(tagged, order), *vals)
    order_ddl = [u.schema[f"arr{i}"].dataType.simpleString() for i in range(len(order))]
    vfields = [T.StructField(v, t) for v, t in zip(vals, types)]
    kf = T.StructField("key", tagged.schema["key"].dataType)
    if match == "occurrence":
        out = T.StructType([kf, T.StructField("occurrence", T.LongType())] + vfields)
    else:
        item = T.StructType([T.StructField("src", T.IntegerType())] + vfields)
        out = T.StructType([kf, T.StructField("group", T.LongType()),
                            T.StructField("srcs", T.StringType()),
                            T.StructField("items", T.ArrayType(item))])
    ddl = [t.simpleString() for t in types]
    if mode == "longest":
        return _by_key(u, ["key"], SyncProcessor(
            n, ddl, order_ddl, match, flush_at_ms=END_OF_STREAM_MS), out, "EventTime", groups)
    return _by_key(u, ["key"], SyncProcessor(n, ddl, order_ddl, match), out, "None", groups)


def stream_job_output(payloads: DataFrame, level: str = GRAPH, arrival: Sequence[str] = (),
                      scope: str = "graph", idle_seconds: float | None = None,
                      event_time: str | None = None, watermark: str = "0 seconds",
                      end_marker: Column | None = None,
                      groups: int = KEY_GROUPS) -> DataFrame:
    """Completion on a stream: per key, every time the payload count reaches
    the declared number, ``(keys..., fire, n_payloads, outputs)``. Task level
    is stateless.

    With ``idle_seconds`` (and the ``event_time`` column it is measured by) a
    key without payloads for that long is forgotten, so state stays bounded by
    the keys that are active; what it had collected is a row too:
    ``(keys..., fire, n_payloads, outputs, complete, first_us, last_us)``, see
    ``CompletionProcessor``. Payloads without an event time are then left
    out."""
    if level not in LEVELS:
        raise ValueError(f"level must be one of {LEVELS}")
    require_columns(payloads, GRAPH, JOB, TASK, "jobtasks", "output", *arrival,
                    where="stream_job_output")
    if level == TASK:
        return payloads.select(GRAPH, JOB, TASK, F.col("output").alias("outputs"))
    ks = level_keys(level, scope)
    timed = []
    if idle_seconds is not None:
        if event_time is None:
            raise ValueError("idle_seconds needs an event_time column")
        payloads = _prepare_event_time(payloads, event_time, watermark, end_marker)
        timed = [F.unix_micros(F.col(event_time)).alias("ev_t")]
    # the processor sorts on the arrival columns
    prepared = payloads.select(*ks, *_arrival(payloads, arrival), *timed, declared_parts(level).alias("expected"),
                               "output")
    out = T.StructType(_fields(payloads, ks) + [
        T.StructField("fire", T.LongType()), T.StructField("n_payloads", T.LongType()),
        T.StructField("outputs", T.ArrayType(T.StringType()))])
    if not timed:
        return _by_key(prepared, ks, CompletionProcessor(ks, len(arrival)), out, "None", groups)
    out = out.add("complete", T.BooleanType()).add("first_us", T.LongType()) \
             .add("last_us", T.LongType())
    idle_us = int(round(idle_seconds * 1_000_000))
    return _by_key(prepared, ks, CompletionProcessor(ks, len(arrival), idle_us), out,
                   "EventTime", groups)


def stream_session_totals(stream: DataFrame, keys: str | Sequence[str], event_time: str,
                          gap_seconds: float, tiebreak: str | None = None,
                          value: Column | None = None, watermark: str = "0 seconds",
                          end_marker: Column | None = None,
                          groups: int = KEY_GROUPS) -> DataFrame:
    """Strict gap sessions re-grouped per key in one window over all time: a
    row ``(keys..., n_sessions, n_events, longest_session, value_cents)`` per
    key, appended when the watermark passes the end of that window (year 9999),
    that is with the end-of-stream marker.

    Two stateful operators in a row: the sessions carry their end as event
    time, so the watermark goes on to a streaming aggregation, whose partial
    sums are taken before its shuffle."""
    ks = _keys(keys)
    require_columns(stream, *ks, event_time, where="stream_session_totals")
    s = _prepare_event_time(stream, event_time, watermark, end_marker)
    prepared = s.select(
        *ks, F.unix_micros(F.col(event_time)).alias("ev_t"), F.lit(False).alias("ev_final"),
        _tiebreak(tiebreak),
        (F.coalesce(value, F.lit(0)) if value is not None else F.lit(0)).cast("long").alias("ev_v"))
    out = T.StructType(_fields(stream, ks) + SESSION_FIELDS
                       + [T.StructField("session_end", T.TimestampType())])
    gap_us = int(round(gap_seconds * 1_000_000))
    sessions = _by_key(prepared, ks, FinalSessionProcessor(ks, gap_us, end_time=True), out,
                       "EventTime", groups, "session_end")
    all_time = F.window("session_end", f"{END_OF_STREAM_MS} milliseconds")
    return sessions.groupBy(*ks, all_time.alias("all_time")).agg(
        F.count(F.lit(1)).alias("n_sessions"), F.sum("n_events").alias("n_events"),
        F.max("n_events").alias("longest_session"),
        F.sum("value_cents").alias("value_cents")).drop("all_time")


def stream_group_values(stream: DataFrame, keys: str | Sequence[str], value: str) -> DataFrame:
    """Values per key on a stream as ``(keys..., value, n)`` runs (the
    batch ``group_values``): a stateful streaming aggregation, partial
    counts combined before the shuffle, state in the state store. Run it in
    ``update`` mode (e.g. ``replay.run_updates_to_table``)."""
    ks = _keys(keys)
    require_columns(stream, *ks, value, where="stream_group_values")
    return stream.groupBy(*ks, value).agg(F.count(F.lit(1)).alias("n"))


def stream_fixed_window_counts(stream: DataFrame, event_time: str, size_seconds: float,
                               keys: Sequence[str] = (), watermark: str = "0 seconds",
                               end_marker: Column | None = None) -> DataFrame:
    """Rows per tumbling window (and keys) on a stream, ``(window, keys...,
    n)``, appended once the watermark passes the window's end."""
    s = _prepare_event_time(stream, event_time, watermark, end_marker)
    w = F.window(event_time, f"{int(size_seconds * 1e6)} microseconds")
    return s.groupBy(w.alias("window"), *keys).agg(F.count(F.lit(1)).alias("n"))
