"""Bounded and paced sources: text lines, inline rows, sequences, one row."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_lines(spark: SparkSession, pattern: str, streaming: bool = False,
               max_files_per_trigger: int | None = None) -> DataFrame:
    """One row ``value STRING`` per text line of the files matching
    ``pattern`` (globs allowed). ``streaming`` watches the folder."""
    if not streaming:
        return spark.read.text(pattern)
    r = spark.readStream.format("text")
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.load(pattern)


def inline_rows(spark: SparkSession, rows: Iterable, schema: T.StructType | str) -> DataFrame:
    """Rows given in code, with a declared schema (small inputs and tests)."""
    return spark.createDataFrame(list(rows), schema)


def generate_sequence(spark: SparkSession, start: int = 0, stop: int | None = None,
                      streaming: bool = False, rows_per_second: int = 1) -> DataFrame:
    """Integers ``value`` in ``[start, stop)``.

    Bounded: ``spark.range`` (generated in parallel). Streaming: the ``rate``
    source paced at ``rows_per_second``, shifted by ``start`` and cut at
    ``stop`` (unbounded when ``stop`` is None), with the generation time as
    ``event_time``.
    """
    if not streaming:
        if stop is None:
            raise ValueError("a bounded sequence needs stop")
        return spark.range(start, stop).select(F.col("id").alias("value"))
    s = (spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load()
              .select((F.col("value") + F.lit(start)).alias("value"),
                      F.col("timestamp").alias("event_time")))
    return s if stop is None else s.where(F.col("value") < F.lit(stop))


def single_row(spark: SparkSession) -> DataFrame:
    """Exactly one row (``id = 0``), used to trigger a computation once."""
    return spark.range(1)
