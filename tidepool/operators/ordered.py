"""Per-key ordered scans that stay balanced when one key holds most rows.

A window ``partitionBy(key).orderBy(t)`` puts every row of a key into one
task; a key with a third of all rows then runs on one core. The scans here
instead

1. range-partition on ``(keys..., order...)`` - the sampler cuts a hot key
   into as many partitions as its share of the rows calls for - and sort
   within each partition (one shuffle);
2. scan each partition in Arrow batches (``mapInArrow``; numpy on the
   key and time columns only, every other column passed through as is),
   numbering rows / numbering sessions as if the partition were the whole
   key;
3. reconcile the partition edges: only the first and the last key run of a
   partition can continue across a partition boundary, so a table of at most
   two rows per partition - a bound known before the job runs - says how to
   shift each partition's local numbers. That table is resolved with a window
   over its few rows and broadcast back.

The data is shuffled once and passes through Python once. Rows are counted
per key first: only the rows of keys with more than ``tidepool.hotKeyRows``
rows take this way; for the others one plain window per key (JVM only) gives
the same numbers at less cost.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepool.session import dropped, written

# The edge table has at most two rows per range partition; below this many
# rows it is broadcast (up to 100,000 partitions), above it it is joined by
# a shuffle instead.
EDGE_BROADCAST_MAX_ROWS = 200_000

# A key with more rows than this is hot: it would hold one task for too long.
HOT_KEY_ROWS = 1_000_000

_RN, _SEQ, _PID, _T, _FIN = "_tp_rn", "_tp_seq", "_tp_pid", "_tp_t", "_tp_final"
_TIE = "_tp_tie"


def _parse_bytes(text: str) -> int:
    units = {"b": 1, "k": 1 << 10, "m": 1 << 20, "g": 1 << 30, "t": 1 << 40}
    t = text.strip().lower().rstrip("b") or "0"
    return int(float(t[:-1]) * units[t[-1]]) if t[-1] in units else int(t)


def _num_partitions(table: DataFrame, partitions: int | None) -> int:
    """Range partitions for the scan of a written table: as given, else enough
    for its size at AQE's advisory partition size (never fewer than
    ``spark.sql.shuffle.partitions``). A fixed count would leave partitions
    of hundreds of GB at 100 TB."""
    if partitions:
        return int(partitions)
    conf = table.sparkSession.conf
    base = int(conf.get("spark.sql.shuffle.partitions"))
    target = _parse_bytes(conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64m"))
    size = int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(base, -(-size // max(target, 1)))


def _as_cols(cols) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in cols]


def _new_run(batch, keys: Sequence[str], carry_key) -> np.ndarray:
    """True where a row starts a new key run (compared with the row before,
    or for row 0 with the last row of the previous batch). Compares Arrow
    arrays in C++; NULL keys are equal to each other."""
    n = batch.num_rows
    new = np.zeros(n, dtype=bool)
    for i, k in enumerate(keys):
        a = batch.column(k)
        if n > 1:
            x, y = a.slice(1), a.slice(0, n - 1)
            same = pc.or_kleene(pc.fill_null(pc.equal(x, y), False),
                                pc.and_(pc.is_null(x), pc.is_null(y)))
            new[1:] |= ~same.to_numpy(zero_copy_only=False)
        if carry_key is not None:
            x, y = a.slice(0, 1), carry_key[i]
            same = pc.or_kleene(pc.fill_null(pc.equal(x, y), False),
                                pc.and_(pc.is_null(x), pc.is_null(y)))
            if not same.to_numpy(zero_copy_only=False)[0]:
                new[0] = True
    if carry_key is None and n:
        new[0] = True
    return new


def _scan(batches, keys, gap_us, with_t, with_final):
    """Local pass over one sorted partition (Arrow record batches in, the
    same batches plus three columns out; other columns are passed through
    without conversion).

    Adds ``_tp_rn`` (row number within the key run of this partition),
    ``_tp_seq`` (session number within the run; a session breaks on a new
    key, after a final row, or when the time step is >= gap) and the
    partition id. State of the last row is carried across batches.
    """
    pid = TaskContext.get().partitionId()
    carry = None
    for rb in batches:
        n = rb.num_rows
        if n == 0:
            continue
        new = _new_run(rb, keys, None if carry is None else carry["key"])
        idx = np.arange(n)
        start = np.maximum.accumulate(np.where(new, idx, -1))
        cont = start < 0  # rows continuing the run of the previous batch
        rn = np.where(cont, idx + 1 + (carry["rn"] if carry else 0), idx - start + 1)
        if with_t:
            t = rb.column(_T).to_numpy(zero_copy_only=False).astype(np.int64, copy=False)
            fin = (rb.column(_FIN).to_numpy(zero_copy_only=False).astype(bool)
                   if with_final else np.zeros(n, dtype=bool))
            prev_t = np.empty(n, dtype=np.int64)
            prev_f = np.zeros(n, dtype=bool)
            prev_t[1:], prev_f[1:] = t[:-1], fin[:-1]
            if carry is not None:
                prev_t[0], prev_f[0] = carry["t"], carry["final"]
            brk = new | prev_f | ((t - prev_t) >= gap_us)
            c = np.cumsum(brk)
            base = (c - 1)[np.maximum(start, 0)]
            seq = np.where(cont, c + (carry["seq"] if carry else 0), c - base)
            carry_t, carry_f = int(t[-1]), bool(fin[-1])
        else:
            seq = np.ones(n, dtype=np.int64)
            carry_t, carry_f = 0, False
        carry = {"key": [rb.column(k).slice(n - 1, 1) for k in keys], "rn": int(rn[-1]),
                 "seq": int(seq[-1]), "t": carry_t, "final": carry_f}
        yield pa.RecordBatch.from_arrays(
            list(rb.columns) + [pa.array(rn.astype(np.int64)), pa.array(seq.astype(np.int64)),
                                pa.array(np.full(n, pid, dtype=np.int32))],
            names=list(rb.schema.names) + [_RN, _SEQ, _PID])


def _range_scan(work: DataFrame, keys: list[str], sort_cols: list[Column],
                gap_us: int | None, with_final: bool, partitions: int | None) -> DataFrame:
    """Numbering through range partitions (see module doc).

    The local scan is written once, as a Parquet table under the session's
    checkpoint folder, and read back: the range partitioner samples with a
    seed drawn from the RDD id, so the partition bounds must be fixed once
    and seen alike by the edge summary and the final join. The table also
    cuts the lineage (a lost executor does not re-run the scan), and the
    edge summary reads only the few columns it needs from it.
    """
    with_t = gap_us is not None
    # Rows equal on every sort column would all fall into one range
    # partition (a group of copies can be a third of the data); a row id as
    # the last sort column lets the sampler cut such a group too. The ids are
    # written before they are sorted on: a map task that runs again (a lost
    # executor) must send every row to the range it went to before.
    with_ids = written(work.withColumn(_TIE, F.monotonically_increasing_id()), "ordered-ids")
    n_parts = _num_partitions(with_ids, partitions)
    sort_cols = list(sort_cols) + [F.col(_TIE)]
    ranged = with_ids.repartitionByRange(n_parts, *sort_cols).sortWithinPartitions(*sort_cols)
    row_schema = T.StructType(ranged.schema.fields + [
        T.StructField(_RN, T.LongType(), False),
        T.StructField(_SEQ, T.LongType(), False),
        T.StructField(_PID, T.IntegerType(), False),
    ])

    def rows_fn(it):
        return _scan(it, keys, gap_us or 0, with_t, with_final)

    rows = written(ranged.mapInArrow(rows_fn, row_schema), "ordered-scan")
    dropped(with_ids)

    # One summary row per (partition, key): counts and the time/final state
    # of the key's last row in the partition. Only a partition's first and
    # last key can continue across a boundary, so at most two rows per
    # partition are kept.
    seg = rows.groupBy(_PID, *keys).agg(
        F.count(F.lit(1)).alias("n"), F.max(_SEQ).alias("n_sess"),
        F.min(_T).alias("first_t"), F.max(_T).alias("last_t"),
        F.max_by(_FIN, _RN).alias("last_final"))
    kst = F.struct(*[F.col(k) for k in keys])
    wp = Window.partitionBy(_PID)
    seg = (seg.withColumn("_kmin", F.min(kst).over(wp))
              .withColumn("_kmax", F.max(kst).over(wp))
              .where(kst.eqNullSafe(F.col("_kmin")) | kst.eqNullSafe(F.col("_kmax")))
              .drop("_kmin", "_kmax"))

    w = Window.partitionBy(*keys).orderBy(_PID)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    if with_t:
        prev_t = F.lag("last_t").over(w)
        cont = (prev_t.isNotNull() & ~F.lag("last_final").over(w)
                & ((F.col("first_t") - prev_t) < F.lit(gap_us)))
        seg = seg.withColumn("_cont", cont.cast("long"))
    else:
        seg = seg.withColumn("_cont", F.lit(0).cast("long"))
    skeys = [f"_tp_k{i}" for i in range(len(keys))]
    seg = seg.select(
        *[F.col(k).alias(sk) for k, sk in zip(keys, skeys)], F.col(_PID).alias("_tp_spid"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_rn_off"),
        (F.coalesce(F.sum("n_sess").over(before), F.lit(0))
         - F.sum("_cont").over(upto)).alias("_seq_off"))
    if 2 * n_parts <= EDGE_BROADCAST_MAX_ROWS:
        seg = F.broadcast(seg)
    cond = [F.col(_PID) == F.col("_tp_spid")] + [
        F.col(k).eqNullSafe(F.col(sk)) for k, sk in zip(keys, skeys)]
    joined = rows.join(seg, cond, "left")
    return joined.select(
        *[c for c in work.columns if c != _TIE],
        (F.col(_RN) + F.coalesce(F.col("_rn_off"), F.lit(0))).alias(_RN),
        (F.col(_SEQ) + F.coalesce(F.col("_seq_off"), F.lit(0))).alias(_SEQ),
    )


def _window_scan(work: DataFrame, keys: list[str], sort_cols: list[Column],
                 gap_us: int | None, cluster_by: list[str] | None = None) -> DataFrame:
    """The same numbers from one window per key (JVM, whole-stage codegen),
    for data without hot keys: every key then fits one task. With
    ``cluster_by`` (a subset of the keys) the rows are hash-partitioned on
    those columns only, so a later grouping on them needs no new shuffle."""
    if cluster_by:
        work = work.repartition(*cluster_by)
    w = Window.partitionBy(*keys).orderBy(*sort_cols[len(keys):])
    out = work.withColumn(_RN, F.row_number().over(w).cast("long"))
    if gap_us is None:
        return out.withColumn(_SEQ, F.lit(1).cast("long"))
    prev_t = F.lag(_T).over(w)
    brk = (prev_t.isNull() | F.coalesce(F.lag(_FIN).over(w), F.lit(False))
           | ((F.col(_T) - prev_t) >= F.lit(gap_us))).cast("long")
    return (out.withColumn("_tp_brk", brk)
               .withColumn(_SEQ, F.sum("_tp_brk").over(
                   w.rowsBetween(Window.unboundedPreceding, 0)))
               .drop("_tp_brk"))


def hot_key_threshold(spark, hot_key_rows: int | None = None) -> int:
    if hot_key_rows is not None:
        return int(hot_key_rows)
    return int(spark.conf.get("tidepool.hotKeyRows", str(HOT_KEY_ROWS)))


def hot_keys(df: DataFrame, keys: Sequence[str], threshold: int) -> DataFrame:
    """The keys with more than ``threshold`` rows, as a written table: one
    partial aggregate that reads the key columns only. The table has fewer
    rows than the input has per ``threshold``."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return written(counts.where(F.col("_n") > F.lit(threshold)).select(*keys), "hot-keys")


def _ordered_scan(df: DataFrame, keys: Sequence[str], order: Sequence,
                  gap_us: int | None, final: Column | None,
                  partitions: int | None, hot_key_rows: int | None = None,
                  cluster_by: Sequence[str] | None = None,
                  counts: DataFrame | None = None) -> DataFrame:
    """Rows of ``df`` plus ``_tp_rn`` / ``_tp_seq`` numbered per key.

    Keys are counted first, unless ``counts`` has their rows as ``_n``. The rows of keys up to the hot-key threshold
    (``tidepool.hotKeyRows``, default one million rows) fit one task per key
    and take a plain window; the rows of the other keys - only these - go
    through the range-partitioned scan, which cuts a key into many tasks.
    Both give the same numbers.
    """
    keys = list(keys)
    with_t = gap_us is not None
    with_final = final is not None
    work = df.withColumn(
        _T, F.unix_micros(order[0].cast("timestamp")) if with_t else F.lit(0).cast("long"))
    work = work.withColumn(
        _FIN, F.coalesce(final, F.lit(False)) if with_final else F.lit(False))
    sort_cols = _as_cols(keys) + [order[0]] + ([F.col(_FIN)] if with_final else []) \
        + list(order[1:])
    threshold = hot_key_threshold(df.sparkSession, hot_key_rows)
    cluster = list(cluster_by) if cluster_by else None
    if cluster and not set(cluster) <= set(keys):
        raise ValueError("cluster_by must be a subset of the keys")
    if threshold < 1:  # every key counts as hot
        out = _range_scan(work, keys, sort_cols, gap_us, with_final, partitions)
        return out.select(*df.columns, _RN, _SEQ)
    if counts is None:
        hot = hot_keys(df, cluster or keys, threshold)
    else:
        hot = counts.where(F.col("_n") > F.lit(threshold)).select(*(cluster or keys))
    n_hot = hot.count()
    if not n_hot:
        if counts is None:
            dropped(hot)
        return _window_scan(work, keys, sort_cols, gap_us, cluster).select(
            *df.columns, _RN, _SEQ)
    names = [f"_tp_h{i}" for i in range(len(hot.columns))]
    some = hot.toDF(*names)
    if n_hot <= EDGE_BROADCAST_MAX_ROWS:
        some = F.broadcast(some)
    is_hot = [F.col(k).eqNullSafe(F.col(h)) for k, h in zip(cluster or keys, names)]
    cold = _window_scan(work.join(some, is_hot, "left_anti"), keys, sort_cols, gap_us, cluster)
    split = _range_scan(work.join(some, is_hot, "left_semi"), keys, sort_cols, gap_us,
                        with_final, partitions)
    return cold.select(*df.columns, _RN, _SEQ).unionByName(split.select(*df.columns, _RN, _SEQ))


def number_rows(df: DataFrame, keys: Sequence[str], order: Sequence,
                out: str = "rn", partitions: int | None = None,
                hot_key_rows: int | None = None,
                cluster_by: Sequence[str] | None = None,
                counts: DataFrame | None = None) -> DataFrame:
    """Add ``out`` = 1, 2, 3, ... per key in ``order`` (the numbers of
    ``row_number() over (partition by keys order by order)``), without
    holding a key in one task. ``order`` should be a total order (end it
    with a unique column) for repeatable numbers. ``counts``, a written table
    ``(keys or cluster_by..., _n)`` of rows per key, saves counting them."""
    order = _as_cols(order)
    scanned = _ordered_scan(df, keys, order, None, None, partitions, hot_key_rows,
                            cluster_by, counts)
    return scanned.select(*df.columns, F.col(_RN).alias(out))


def number_sessions(df: DataFrame, keys: Sequence[str], event_time: str | Column,
                    gap_seconds: float, tiebreak: Sequence = (),
                    final: Column | None = None, out: str = "session_seq",
                    partitions: int | None = None,
                    hot_key_rows: int | None = None,
                    keep_untimed: bool = False) -> DataFrame:
    """Add ``out`` = 1, 2, 3, ... numbering the sessions of each key.

    Rows are taken in ``(event_time, final, tiebreak...)`` order; a new
    session starts at a key's first row, after a final row, and where the
    time step from the previous row is ``>= gap_seconds`` (so rows exactly
    one gap apart are in different sessions). A row without an event time is
    in no session: it is left out, or with ``keep_untimed`` kept with a NULL
    number.
    """
    gap_us = int(round(gap_seconds * 1_000_000))
    if gap_us <= 0:
        raise ValueError("gap must be strictly positive")
    et = F.col(event_time) if isinstance(event_time, str) else event_time
    order = [et] + _as_cols(tiebreak)
    scanned = _ordered_scan(df.where(et.isNotNull()), keys, order, gap_us, final, partitions,
                            hot_key_rows).select(*df.columns, F.col(_SEQ).alias(out))
    if not keep_untimed:
        return scanned
    return scanned.unionByName(df.where(et.isNull()).withColumn(out, F.lit(None).cast("long")))
