"""Merging event-time windows: every row has a window of its own length, and
windows of a key that overlap become one.

A row opens a new merged window if it starts at or after the largest end of
all rows before it. That largest end is a prefix maximum, which composes: for
a key that is cut into range partitions, the maximum inside the partition and
the maximum of the partitions before give it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepool.contracts import require_columns
from tidepool.operators.ordered import (EDGE_BROADCAST_MAX_ROWS, _num_partitions,
                                        hot_key_threshold, hot_keys)
from tidepool.session import dropped, written

_START, _END, _TIE, _PID, _SEQ, _TOP = "_mw_s", "_mw_e", "_mw_tie", "_mw_pid", "_mw_seq", "_mw_top"


def _as_us(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp"))


def _opens(before: Column) -> Column:
    return F.when(before.isNull() | (F.col(_START) >= before), 1).otherwise(0).cast("bigint")


def _whole(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that fit a task each: two running sums and maxima per key."""
    order = Window.partitionBy(*keys).orderBy(_START, _END)
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("_mw_new", _opens(F.max(_END).over(before))) \
        .withColumn(_SEQ, F.sum("_mw_new").over(upto)).drop("_mw_new")


def _split(rows: DataFrame, keys: list[str], partitions: int | None) -> DataFrame:
    """Hot keys, cut into range partitions of (key, start): each partition
    takes the largest end of the partitions before it from a small table,
    numbers its windows, and adds the number of windows before."""
    with_ids = written(rows.withColumn(_TIE, F.monotonically_increasing_id()), "windows-ids")
    order = [*keys, _START, _END, _TIE]
    ranged = written(with_ids.repartitionByRange(_num_partitions(with_ids, partitions), *order)
                     .withColumn(_PID, F.spark_partition_id()), "windows-ranged")
    dropped(with_ids)
    names = [f"_mw_k{i}" for i in range(len(keys))]
    earlier = Window.partitionBy(*names).orderBy("_mw_p").rowsBetween(Window.unboundedPreceding, -1)

    def joined(table: DataFrame, what: Column, out: str, combine) -> DataFrame:
        # one row per partition and hot key in it
        of = table.groupBy(F.col(_PID).alias("_mw_p"),
                           *[F.col(k).alias(n) for k, n in zip(keys, names)]).agg(what.alias("_mw_x"))
        of = written(of.withColumn(out, combine(F.col("_mw_x")).over(earlier)).drop("_mw_x"),
                     "windows-edges")
        if of.count() <= EDGE_BROADCAST_MAX_ROWS:
            of = F.broadcast(of)
        cond = [F.col(_PID) == F.col("_mw_p")] + [F.col(k).eqNullSafe(F.col(n))
                                                  for k, n in zip(keys, names)]
        return table.join(of, cond).drop("_mw_p", *names)

    inside = Window.partitionBy(_PID, *keys).orderBy(_START, _END, _TIE)
    before = F.greatest(F.max(_END).over(inside.rowsBetween(Window.unboundedPreceding, -1)),
                        F.col(_TOP))
    counted = written(
        joined(ranged, F.max(_END), _TOP, F.max).withColumn("_mw_new", _opens(before))
        .withColumn(_SEQ, F.sum("_mw_new").over(inside.rowsBetween(Window.unboundedPreceding, 0))),
        "windows-counted")
    dropped(ranged)
    return joined(counted, F.sum("_mw_new"), "_mw_off", F.sum).withColumn(
        _SEQ, F.col(_SEQ) + F.coalesce("_mw_off", F.lit(0))) \
        .drop(_TIE, _PID, _TOP, "_mw_new", "_mw_off")


def assign_merged_windows(df: DataFrame, keys: str | Sequence[str], start: str | Column,
                          end: str | Column, out: str = "window_seq",
                          partitions: int | None = None,
                          hot_key_rows: int | None = None) -> DataFrame:
    """Every row with ``out``, the 1-based number of its merged window within
    its key. A row's window is ``[start, end)``; windows that overlap merge,
    windows that only touch do not. Rows without a start or an end, or whose
    window is empty, are in no window and left out. NULL keys are one key.

    Keys with more than ``tidepool.hotKeyRows`` rows are cut into range
    partitions; the others take one window function per key."""
    ks = [keys] if isinstance(keys, str) else list(keys)
    s, e = (F.col(c) if isinstance(c, str) else c for c in (start, end))
    require_columns(df, *ks, where="assign_merged_windows")
    rows = df.withColumns({_START: _as_us(s), _END: _as_us(e)}).where(F.col(_END) > F.col(_START))
    threshold = hot_key_threshold(df.sparkSession, hot_key_rows)

    def shown(table: DataFrame) -> DataFrame:
        return table.select(*[c for c in df.columns if c != out], F.col(_SEQ).alias(out),
                            _START, _END)

    if threshold < 1:  # every key counts as hot
        return shown(_split(rows, ks, partitions))
    hot = hot_keys(rows, ks, threshold)
    n_hot = hot.count()
    if not n_hot:
        dropped(hot)
        return shown(_whole(rows, ks))
    names = [f"_mw_h{i}" for i in range(len(ks))]
    some = hot.toDF(*names)
    if n_hot <= EDGE_BROADCAST_MAX_ROWS:
        some = F.broadcast(some)
    is_hot = [F.col(k).eqNullSafe(F.col(h)) for k, h in zip(ks, names)]
    return shown(_whole(rows.join(some, is_hot, "left_anti"), ks)).unionByName(
        shown(_split(rows.join(some, is_hot, "left_semi"), ks, partitions)))


def merged_windows(df: DataFrame, keys: str | Sequence[str], start: str | Column,
                   end: str | Column, aggs: Sequence[Column] = (),
                   partitions: int | None = None,
                   hot_key_rows: int | None = None) -> DataFrame:
    """One row per merged window: ``(keys..., window_seq, window_start,
    window_end, n_events)`` and ``aggs``; see :func:`assign_merged_windows`.
    Sums and counts are combined before the shuffle."""
    ks = [keys] if isinstance(keys, str) else list(keys)
    rows = assign_merged_windows(df, ks, start, end, "window_seq", partitions, hot_key_rows)
    return (rows.groupBy(*ks, "window_seq")
                .agg(F.min(_START).alias(_START), F.max(_END).alias(_END),
                     F.count(F.lit(1)).alias("n_events"), *aggs)
                .withColumns({"window_start": F.timestamp_micros(_START),
                              "window_end": F.timestamp_micros(_END)}).drop(_START, _END))
