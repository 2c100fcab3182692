"""Combining the values of a key with a combiner of the caller's own.

Rows are folded into one accumulator per key where they lie, accumulators of
a key are merged in levels of bounded fan-in, and only then finished: a key
with a third of all rows is folded by all tasks, and no task or group holds
its rows or all of its accumulators.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence
from typing import Any, Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepool.contracts import require_columns
from tidepool.session import dropped, written

# Accumulators a task holds before it hands them on.
HELD_KEYS = 50_000
# Accumulators of a key merged by one task per level.
FAN_IN = 64


class Combiner(Protocol):
    """``merge`` must be associative and commutative, and ``start()`` neutral:
    rows come in any order and any grouping. Accumulators are pickled."""

    def start(self) -> Any: ...

    def add(self, state: Any, values: pa.RecordBatch) -> Any:
        """``state`` with rows of one key (the value columns only)."""

    def merge(self, a: Any, b: Any) -> Any: ...

    def finish(self, state: Any) -> Sequence:
        """The values of the result columns."""


def _runs(batch: pa.RecordBatch, keys: Sequence[str]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """``(key, its rows)`` of a batch; NULL keys are equal."""
    code = np.zeros(batch.num_rows, dtype=np.int64)
    for k in keys:
        part = pc.dictionary_encode(batch.column(k), null_encoding="encode")
        code = code * (len(part.dictionary) + 1) + part.indices.to_numpy(zero_copy_only=False)
        _, code = np.unique(code, return_inverse=True)  # small again, whatever the keys
    order = np.argsort(code, kind="stable")
    first = np.flatnonzero(np.diff(code[order], prepend=-1))
    ordered = batch.take(pa.array(order))
    for a, b in zip(first, np.append(first[1:], len(order))):
        yield tuple(ordered.column(k)[int(a)].as_py() for k in keys), ordered.slice(a, b - a)


def combine_by_key(df: DataFrame, keys: str | Sequence[str], values: Sequence[str],
                   combiner: Combiner, result: T.StructType | str,
                   fan_in: int = FAN_IN) -> DataFrame:
    """``(keys..., result columns)``, one row per key of ``df``: its ``values``
    rows added by ``combiner`` task by task, merged in levels of ``fan_in``
    accumulators, and finished. ``result`` is the schema of what ``finish``
    returns. NULL keys are one key; NULL values reach ``add``; an empty table
    gives an empty result."""
    ks = [keys] if isinstance(keys, str) else list(keys)
    vs = list(values)
    require_columns(df, *ks, *vs, where="combine_by_key")
    if fan_in < 2:
        raise ValueError("fan_in must be 2 or more")
    fields = [df.schema[k] for k in ks]
    partial = T.StructType([*fields, T.StructField("_task", T.LongType()),
                            T.StructField("_acc", T.BinaryType())])
    key_types = [f.type for f in _arrow(T.StructType(fields))]
    if isinstance(result, str):
        result = T._parse_datatype_string(result)
    result_types = [f.type for f in _arrow(result)]

    def rows_of(found: list[tuple[tuple, bytes]], task: int) -> pa.RecordBatch:
        columns = [pa.array([k[i] for k, _ in found], t) for i, t in enumerate(key_types)]
        return pa.RecordBatch.from_arrays(
            [*columns, pa.array([task] * len(found), pa.int64()),
             pa.array([a for _, a in found], pa.binary())], names=[*ks, "_task", "_acc"])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, flushed = TaskContext.get().partitionId() << 32, 0
        held: dict[tuple, Any] = {}
        for batch in batches:
            for key, rows in _runs(batch, ks):
                state = held[key] if key in held else combiner.start()
                held[key] = combiner.add(state, rows.select(vs))
            if len(held) > HELD_KEYS:
                yield rows_of([(k, pickle.dumps(a)) for k, a in held.items()], task + flushed)
                held, flushed = {}, flushed + 1
        if held:
            yield rows_of([(k, pickle.dumps(a)) for k, a in held.items()], task + flushed)

    def merged(batches: Iterator[pa.RecordBatch], upto: Sequence[str]) -> Iterator[tuple]:
        """``(key, accumulator)`` of sorted partials, run by run."""
        last, state = None, None
        for batch in batches:
            own = list(zip(*[batch.column(c).to_pylist() for c in upto]))
            for key, acc in zip(own, batch.column("_acc").to_pylist()):
                if last is not None and key == last:
                    state = combiner.merge(state, pickle.loads(acc))
                    continue
                if last is not None:
                    yield last[:len(ks)], state
                last, state = key, pickle.loads(acc)
        if last is not None:
            yield last[:len(ks)], state

    def level(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId() << 32
        for n, (key, state) in enumerate(merged(batches, [*ks, "_lot"])):
            yield rows_of([(key, pickle.dumps(state))], task + n)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, state in merged(batches, ks):
            columns = [pa.array([v], t) for v, t in zip(key, key_types)]
            columns += [pa.array([v], t) for v, t in zip(combiner.finish(state), result_types)]
            yield pa.RecordBatch.from_arrays(columns, names=[*ks, *result.names])

    parts = written(df.select(*ks, *[v for v in vs if v not in ks]).mapInArrow(fold, partial),
                    "combine")
    most = parts.groupBy(*ks).count().agg(F.max("count")).first()[0] or 0
    while most > fan_in:
        lots = -(-most // fan_in)
        lot = F.pmod(F.xxhash64("_task"), F.lit(lots)).cast("int")
        dealt = parts.withColumn("_lot", lot).repartition(*ks, "_lot") \
            .sortWithinPartitions(*ks, "_lot")
        fewer = written(dealt.mapInArrow(level, partial), "combine")
        dropped(parts)
        parts, most = fewer, lots
    return parts.repartition(*ks).sortWithinPartitions(*ks).mapInArrow(
        finish, T.StructType([*fields, *result.fields]))


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    return to_arrow_schema(schema)
