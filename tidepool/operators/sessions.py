"""Event-time windows: gap sessions, sessions closed by a final event,
fixed windows, and the re-grouping of sessions into one global window.

Session boundaries come from the skew-safe ordered scan
(:mod:`tidepool.operators.ordered`); the per-session numbers are then
ordinary aggregates, which Spark combines partially before the shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepool.contracts import require_columns
from tidepool.operators.ordered import (EDGE_BROADCAST_MAX_ROWS, _num_partitions,
                                        hot_key_threshold, hot_keys, number_sessions)
from tidepool.session import dropped, written


def _keys(keys) -> list[str]:
    return [keys] if isinstance(keys, str) else list(keys)


def _session_rows(df, keys, event_time, gap_seconds, tiebreak, final, partitions,
                  keep_untimed=False):
    return number_sessions(df, keys, event_time, gap_seconds, tiebreak=tiebreak,
                           final=final, out="session_seq", partitions=partitions,
                           keep_untimed=keep_untimed)


def assign_sessions(df: DataFrame, keys: str | Sequence[str], event_time: str,
                    gap_seconds: float, tiebreak: Sequence[str] = (),
                    final: Column | None = None,
                    partitions: int | None = None) -> DataFrame:
    """Every row with ``session_seq``, the 1-based number of its session
    within its key (strict gap: rows exactly ``gap_seconds`` apart are in
    different sessions; with ``final``, a final row closes its session). A
    row without an event time is in no session: its number is NULL."""
    ks = _keys(keys)
    require_columns(df, *ks, event_time, *tiebreak, where="assign_sessions")
    return _session_rows(df, ks, event_time, gap_seconds, list(tiebreak), final, partitions,
                         keep_untimed=True)


def session_windows(df: DataFrame, keys: str | Sequence[str], event_time: str,
                    gap_seconds: float, tiebreak: Sequence[str] = (),
                    aggs: Sequence[Column] = (),
                    partitions: int | None = None) -> DataFrame:
    """Gap sessions per key: one row per session with ``session_seq``,
    ``session_start``, ``session_end`` (last event + gap: the session's
    window is the union of ``[t, t + gap)``), ``event_time`` = window end
    (output at end of window), ``n_events`` and any extra ``aggs``.

    Two events exactly one gap apart are in different sessions; rows without
    an event time are in none.
    """
    ks = _keys(keys)
    require_columns(df, *ks, event_time, *tiebreak, where="session_windows")
    rows = _session_rows(df, ks, event_time, gap_seconds, list(tiebreak), None, partitions)
    gap = F.make_dt_interval(secs=F.lit(float(gap_seconds)))
    return (rows.groupBy(*ks, "session_seq")
                .agg(F.min(event_time).alias("session_start"),
                     F.max(event_time).alias("_last"),
                     F.count(F.lit(1)).alias("n_events"), *aggs)
                .withColumn("session_end", F.col("_last") + gap)
                .withColumn("event_time", F.col("session_end"))
                .drop("_last"))


def sessions_with_final(df: DataFrame, keys: str | Sequence[str], event_time: str,
                        gap_seconds: float, is_final: Column,
                        tiebreak: Sequence[str] = (), aggs: Sequence[Column] = (),
                        lone_final: str = "close",
                        partitions: int | None = None) -> DataFrame:
    """Gap sessions that a final event ends early.

    Rows are taken in ``(event_time, final, tiebreak)`` order. A session
    starts at a key's first row, after a final row, or after a step
    ``>= gap``. A session containing a final is ``closed`` and ends at the
    final's time (the final is a member); otherwise it ends at last + gap.
    ``lone_final="close"``: a final that starts a session is a closed
    one-row session. ``"absorb"``: such a session takes every later row of
    its key, whatever the gaps, until the next final closes it; while none
    comes it is not closed and its end is NULL (a stream does not emit it
    yet). Absorbing depends on all rows before, so the rows of a key pass a
    small state machine one by one, without being gathered; a hot key's rows
    pass it in parts, from each of its states. Both split hot keys.
    """
    if gap_seconds <= 0:
        raise ValueError("gap must be strictly positive")
    if lone_final not in ("close", "absorb"):
        raise ValueError("lone_final must be 'close' or 'absorb'")
    ks = _keys(keys)
    require_columns(df, *ks, event_time, *tiebreak, where="sessions_with_final")
    marked = df.withColumn("_final", F.coalesce(is_final, F.lit(False)))
    gap = F.make_dt_interval(secs=F.lit(float(gap_seconds)))
    if lone_final == "absorb":
        rows = _absorbing_rows(marked, ks, event_time, gap_seconds, list(tiebreak), partitions)
    else:
        rows = _session_rows(marked, ks, event_time, gap_seconds, list(tiebreak),
                             F.col("_final"), partitions)
        # a closing final ends any session here, a lone one its own
        rows = rows.withColumns({"_ends": F.col("_final"), "_lone": F.lit(False)})
    return (rows.groupBy(*ks, "session_seq")
                .agg(F.min(event_time).alias("session_start"),
                     F.max(event_time).alias("_last"),
                     F.bool_or("_ends").alias("closed"), F.bool_or("_lone").alias("_open"),
                     F.count(F.lit(1)).alias("n_events"), *aggs)
                .withColumn("session_end",
                            F.when(F.col("closed"), F.col("_last"))
                             .when(~F.col("_open"), F.col("_last") + gap))
                .drop("_last", "_open"))


def _absorbing_rows(df: DataFrame, keys: list[str], event_time: str, gap_seconds: float,
                    tiebreak: list[str], partitions: int | None = None) -> DataFrame:
    """Rows with ``session_seq``, ``_ends`` (this final closes its session)
    and ``_lone`` (this final began one that absorbs)."""
    gap_us = int(round(gap_seconds * 1_000_000))
    timed = df.where(F.col(event_time).isNotNull()).withColumn(
        "_us", F.unix_micros(F.col(event_time).cast("timestamp")))
    threshold = hot_key_threshold(df.sparkSession)
    if threshold < 1:  # every key counts as hot
        return _absorbing_split(timed, keys, gap_us, tiebreak, partitions)
    hot = hot_keys(timed, keys, threshold)
    n_hot = hot.count()
    if not n_hot:
        dropped(hot)
        return _absorbing_whole(timed, keys, gap_us, tiebreak)
    names = [f"_tp_h{i}" for i in range(len(keys))]
    some = hot.toDF(*names)
    if n_hot <= EDGE_BROADCAST_MAX_ROWS:
        some = F.broadcast(some)
    is_hot = [F.col(k).eqNullSafe(F.col(h)) for k, h in zip(keys, names)]
    return _absorbing_whole(timed.join(some, is_hot, "left_anti"), keys, gap_us, tiebreak) \
        .unionByName(_absorbing_split(timed.join(some, is_hot, "left_semi"), keys, gap_us,
                                      tiebreak, partitions))


def _absorbing_split(timed: DataFrame, keys: list[str], gap_us: int, tiebreak: list[str],
                     partitions: int | None) -> DataFrame:
    """The rows of hot keys, range-partitioned (see ``ordered``): a partition
    passes each of its key runs from all three states the rows before may
    leave; the runs of a key, a row per partition, are then composed, which
    says from which state a run was entered and after how many sessions."""
    idle, opened, absorbing = range(3)
    with_ids = written(timed.withColumn("_tie", F.monotonically_increasing_id()), "absorb-ids")
    order = [*keys, "_us", "_final", *tiebreak, "_tie"]

    def passes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        pid = TaskContext.get().partitionId()
        last, before, rn, states, seqs = None, 0, 0, [], []
        for batch in batches:
            rows = []
            own = zip(*[batch.column(k).to_pylist() for k in keys])
            for key, t, final in zip(own, batch.column("_us").to_pylist(),
                                     batch.column("_final").to_pylist()):
                if key != last:  # the step from the partition before is composed later
                    last, before, rn, states, seqs = key, t, 0, [idle, opened, absorbing], [0] * 3
                rn += 1
                row = [rn]
                for x in range(3):
                    state = states[x]
                    if state == opened and t - before >= gap_us:
                        state = idle
                    begins = state == idle
                    if begins:
                        seqs[x] += 1
                        state = absorbing if final else opened
                    elif final:
                        state = idle
                    states[x] = state
                    row += [seqs[x], state, final and not begins, final and begins]
                rows.append(row)
                before = t
            new = list(zip(*rows)) if rows else [()] * 13
            kinds = [pa.int64()] + [pa.int64(), pa.int32(), pa.bool_(), pa.bool_()] * 3
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([pid] * batch.num_rows, pa.int32()),
                 *[pa.array(v, k) for v, k in zip(new, kinds)]],
                names=[*batch.schema.names, *added.names])

    added = T.StructType([T.StructField("_pid", T.IntegerType()), T.StructField("_rn", T.LongType())])
    for x in range(3):
        added = (added.add(f"_seq{x}", T.LongType()).add(f"_state{x}", T.IntegerType())
                 .add(f"_ends{x}", T.BooleanType()).add(f"_lone{x}", T.BooleanType()))
    n_parts = _num_partitions(with_ids, partitions)
    rows = written(with_ids.repartitionByRange(n_parts, *order).sortWithinPartitions(*order)
                   .mapInArrow(passes, T.StructType(with_ids.schema.fields + added.fields)),
                   "absorb-scan")
    dropped(with_ids)
    ends = F.struct("_us", *[f"_{c}{x}" for x in range(3) for c in ("seq", "state")])
    names = [f"_tp_k{i}" for i in range(len(keys))]
    runs = rows.groupBy(*[F.col(k).alias(n) for k, n in zip(keys, names)],
                        F.col("_pid").alias("_in")).agg(
        F.min("_us").alias("_first"), F.max_by(ends, "_rn").alias("_end")).select(
        *names, "_in", "_first", "_end.*")

    def composed(table: pa.Table) -> pa.Table:
        table = table.sort_by("_in")
        state, seq, before = idle, 0, 0
        entered, offset = [], []
        for run in table.drop_columns(names).to_pylist():
            if state == opened and run["_first"] - before >= gap_us:
                state = idle
            entered.append(state)
            offset.append(seq)
            seq += run[f"_seq{state}"]
            state, before = run[f"_state{state}"], run["_us"]
        return table.select([*names, "_in"]).append_column(
            "_entered", pa.array(entered, pa.int32())).append_column(
            "_offset", pa.array(offset, pa.int64()))

    found = T.StructType([*[runs.schema[n] for n in (*names, "_in")],
                          T.StructField("_entered", T.IntegerType()),
                          T.StructField("_offset", T.LongType())])
    entry = written(runs.groupBy(*names).applyInArrow(composed, found), "absorb-entries")
    if entry.count() <= EDGE_BROADCAST_MAX_ROWS:
        entry = F.broadcast(entry)
    cond = [F.col("_pid") == F.col("_in")] + [F.col(k).eqNullSafe(F.col(n))
                                              for k, n in zip(keys, names)]

    def of(c: str) -> Column:
        return F.when(F.col("_entered") == idle, F.col(f"_{c}{idle}")).when(
            F.col("_entered") == opened, F.col(f"_{c}{opened}")).otherwise(
            F.col(f"_{c}{absorbing}"))

    return rows.join(entry, cond).select(
        *[c for c in timed.columns if c != "_us"],
        (F.col("_offset") + of("seq")).alias("session_seq"), of("ends").alias("_ends"),
        of("lone").alias("_lone"))


def _absorbing_whole(timed: DataFrame, keys: list[str], gap_us: int,
                     tiebreak: list[str]) -> DataFrame:
    """The rows of keys that fit a task each."""
    idle, opened, absorbing = range(3)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state, seq, before = None, idle, 0, 0
        for batch in batches:
            own = zip(*[batch.column(k).to_pylist() for k in keys])
            seqs, ends, lone = [], [], []
            for key, t, final in zip(own, batch.column("_us").to_pylist(),
                                     batch.column("_final").to_pylist()):
                if key != last:
                    last, state, seq = key, idle, 0
                if state == opened and t - before >= gap_us:
                    state = idle
                begins = state == idle
                if begins:
                    seq += 1
                    state = absorbing if final else opened
                seqs.append(seq)
                ends.append(final and not begins)
                lone.append(final and begins)
                if final and not begins:
                    state = idle
                before = t
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(seqs, pa.int64()), pa.array(ends, pa.bool_()),
                 pa.array(lone, pa.bool_())],
                names=[*batch.schema.names, "session_seq", "_ends", "_lone"])

    schema = T.StructType([*timed.schema.fields, T.StructField("session_seq", T.LongType()),
                           T.StructField("_ends", T.BooleanType()),
                           T.StructField("_lone", T.BooleanType())])
    return (timed.repartition(*keys).sortWithinPartitions(*keys, "_us", "_final", *tiebreak)
            .mapInArrow(fold, schema).drop("_us"))


def to_global_window(sessions: DataFrame, keys: str | Sequence[str],
                     aggs: Sequence[Column]) -> DataFrame:
    """Forget the session identity and combine all sessions of a key."""
    ks = _keys(keys)
    return sessions.groupBy(*ks).agg(*aggs)


def fixed_windows(df: DataFrame, event_time: str, size_seconds: float,
                  out: str = "window") -> DataFrame:
    """Assign each row its tumbling window ``[start, end)`` of the given size."""
    require_columns(df, event_time, where="fixed_windows")
    return df.withColumn(out, F.window(event_time, f"{int(size_seconds * 1e6)} microseconds"))
