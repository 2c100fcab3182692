"""Replaying a table as a stream, and running a stream to a table.

``write_replay_files`` cuts a DataFrame into time-ordered slices, each of the
same number of files (written slice after slice, so a file source that takes
that many files per micro-batch reads one slice at a time); an optional last
slice holds end-of-stream rows that push the watermark past all data.
``run_to_table`` runs a streaming DataFrame with the ``availableNow`` trigger
into a Parquet sink and returns the sink as a batch DataFrame. Both write
under the session's checkpoint folder; :func:`tidepool.session.dropped` deletes
what they wrote.
"""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tidepool.session import FREE_SHUFFLES, claimed_path, dropped, session_settings, written

# A slice has files of about this many bytes, and at least so many files; a
# table of more bytes than a slice may have is cut into more slices.
FILE_BYTES, MIN_FILES = 128 << 20, 4
SLICE_BYTES = 4 << 30


def _folder(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def _data_files(spark: SparkSession, path: str) -> tuple[int, int]:
    """Data files of a folder and their bytes."""
    at, fs = _folder(spark, path)
    if not fs.exists(at):
        return 0, 0
    found = [f for f in fs.listStatus(at) if f.getPath().getName().startswith("part-")]
    return len(found), sum(f.getLen() for f in found)


def _read_again(table: DataFrame) -> DataFrame:
    out = table.sparkSession.read.schema(table.schema).parquet(table.scratch)
    out.scratch = table.scratch
    return out


def write_replay_files(df: DataFrame | Sequence[DataFrame], order_col: str, n_slices: int = 3,
                       end_rows: DataFrame | None = None, path: str | None = None,
                       min_files: int = MIN_FILES, bounds: list | None = None
                       ) -> tuple[str, int]:
    """``(path, files per slice)``: ``df`` as ``n_slices`` slices - more if
    they would be larger than ``SLICE_BYTES``, so that a micro-batch does not
    grow with the table - split at approximate quantiles of ``order_col`` (rows with equal values share a
    slice) or after the given ``bounds``, and ``end_rows`` as a last one. The
    input - or its parts, one after the other - is computed once, into a staging copy that is
    dropped again; each slice is then cut from the copy
    (Parquet statistics skip the other ranges) and written by as many tasks as
    it has files. A slice of fewer files is filled up with empty
    files, so that every micro-batch is one slice."""
    df, *others = [df] if isinstance(df, DataFrame) else df
    spark = df.sparkSession
    path = path or claimed_path(spark, "replay")
    with session_settings(spark, FREE_SHUFFLES):
        staged = written(df, "replay-staging", compression="zstd")
        for other in others:
            other.write.mode("append").parquet(staged.scratch, compression="zstd")
        if others:  # the files are listed again
            staged = _read_again(staged)
    is_time = df.schema[order_col].dataType.typeName().startswith("timestamp")
    key = (F.unix_micros(F.col(order_col).cast("timestamp")) if is_time
           else F.col(order_col).cast("double"))
    staged_bytes = _data_files(spark, staged.scratch)[1]
    if bounds is None:
        n_slices = max(n_slices, -(-staged_bytes // SLICE_BYTES))
        probs = [i / n_slices for i in range(1, n_slices)]
        bounds = (sorted(set(staged.select(key.alias("k")).approxQuantile("k", probs, 0.001)))
                  if probs else [])
    n_files = max(min_files, -(-staged_bytes // ((len(bounds) + 1) * FILE_BYTES)))
    nothing = spark.createDataFrame([], df.schema)
    written_files = 0

    def add(part: DataFrame) -> None:
        nonlocal written_files
        # the copy's files are dealt to as many tasks: no row is shuffled
        part.coalesce(n_files).write.mode("append").option("compression", "zstd").parquet(path)
        written_files += n_files
        for _ in range(written_files - _data_files(spark, path)[0]):
            nothing.repartition(1).write.mode("append").parquet(path)

    edges = [None] + bounds + [None]
    for lo, hi in zip(edges[:-1], edges[1:]):
        # rows without an order value go first
        part = staged if lo is None else staged.where(key > F.lit(lo))
        if hi is not None:
            part = part.where((key <= F.lit(hi)) | key.isNull() if lo is None
                              else key <= F.lit(hi))
        add(part)
    if end_rows is not None:
        add(end_rows)
    dropped(staged)
    return path, n_files


def replay_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 1,
                  consume: bool = False) -> DataFrame:
    """A streaming DataFrame over the replay files, ``files_per_trigger``
    files (one slice) per micro-batch, oldest first. With ``consume`` Spark
    deletes a slice once it is done: for files that one stream reads once."""
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
                 .option("cleanSource", "delete" if consume else "off").parquet(path))


def run_to_table(stream: DataFrame, name: str = "stream", progress: list | None = None
                 ) -> DataFrame:
    """Run ``stream`` until its sources are drained (``availableNow``), into
    a Parquet sink with its own checkpoint; return the sink's rows. The
    progress of the micro-batches is appended to ``progress`` if given."""
    spark = stream.sparkSession
    base = claimed_path(spark, name)
    out, ckpt = os.path.join(base, "out"), os.path.join(base, "checkpoint")
    with session_settings(spark, FREE_SHUFFLES):
        q: StreamingQuery = (stream.writeStream.format("parquet").option("path", out)
                             .option("checkpointLocation", ckpt).outputMode("append")
                             .trigger(availableNow=True).start())
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(f"streaming query failed: {q.exception()}")
    if progress is not None:
        progress.extend(q.recentProgress)
    return spark.read.schema(stream.schema).parquet(out)


def late_rows(progress: list) -> int:
    """Rows that stateful operators dropped as late, as Spark counts them (a
    windowed count drops rows after its partial sums)."""
    return sum(int(op.get("numRowsDroppedByWatermark", 0)) for p in progress
               for op in p["stateOperators"])


def run_updates_to_table(stream: DataFrame, key_cols: list[str], name: str = "updates") -> DataFrame:
    """Run an aggregating stream in ``update`` mode until drained: every
    micro-batch appends its changed rows, tagged with the batch id, to a
    Parquet table; the result keeps the latest row of each key. A re-run
    micro-batch writes the same rows again under the same id, so the result
    does not change."""
    spark = stream.sparkSession
    base = claimed_path(spark, name)
    out, ckpt = os.path.join(base, "out"), os.path.join(base, "checkpoint")

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("_tp_batch", F.lit(batch_id).cast("bigint")).write.mode("append").parquet(out)

    q = (stream.writeStream.outputMode("update").foreachBatch(write)
               .option("checkpointLocation", ckpt).trigger(availableNow=True).start())
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(f"streaming query failed: {q.exception()}")
    fields = [c for c in stream.columns if c not in key_cols]
    if not _data_files(spark, out)[0]:  # nothing was written: no rows
        return spark.createDataFrame([], stream.schema)
    rows = spark.read.schema(T.StructType(
        [*stream.schema.fields, T.StructField("_tp_batch", T.LongType())])).parquet(out)
    latest = F.max_by(F.struct(*fields), "_tp_batch").alias("_tp_last")
    return rows.groupBy(*key_cols).agg(latest).select(*key_cols, "_tp_last.*")
