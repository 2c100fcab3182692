"""Keyed N-way alignment (sync) and bag union (flatten).

``sync`` emits one row per key as soon as every input has contributed. Two
matchings are offered:

* ``match="occurrence"`` (default, the documented intent): the n-th value
  of key k from every input forms the n-th row of k, fields in input order.
* ``match="arrival"`` (what the reference's code does): every N consecutive
  arrivals of a key form a row, in arrival order, whatever input they came
  from.

Numbering within a key uses the skew-safe ordered scan, and every group then
has at most N rows, so no key is gathered into one task.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.contracts import require_columns
from tidepool.operators.ordered import number_rows

MODES = ("synced", "shortest", "longest")
MATCHES = ("occurrence", "arrival")


def flatten(*inputs: DataFrame) -> DataFrame:
    """Bag union of inputs with the same columns (duplicates kept)."""
    if len(inputs) == 1 and isinstance(inputs[0], (list, tuple)):
        inputs = tuple(inputs[0])
    if not inputs:
        raise ValueError("flatten needs at least one input")
    return reduce(lambda a, b: a.unionByName(b), inputs)


def _tagged(inputs, key, value, order):
    n = len(inputs)
    types = [d.schema[value].dataType for d in inputs]
    parts = []
    for i, d in enumerate(inputs):
        vals = [(F.col(value) if j == i else F.lit(None).cast(types[j])).alias(f"value_{j}")
                for j in range(n)]
        parts.append(d.select(F.col(key).alias("key"), *[F.col(c) for c in order],
                              F.lit(i).alias("src"), *vals))
    return reduce(lambda a, b: a.unionByName(b), parts)


def sync(inputs: Sequence[DataFrame], key: str = "key", value: str = "value",
         order: Sequence[str] = ("arrival_ts", "arrival_id"), match: str = "occurrence",
         mode: str = "synced", partitions: int | None = None) -> DataFrame:
    """Align keyed inputs ``(key, value, order...)``.

    occurrence: rows ``(key, occurrence, value_0, ..., value_{N-1})``.
    arrival: rows ``(key, group, items)`` where ``items`` is the array of
    ``struct(src, value_0, ..., value_{N-1})`` in arrival order (only the
    ``src`` field of each item is set). ``mode``: ``synced`` / ``shortest``
    keep complete rows only; ``longest`` also keeps incomplete ones (absent
    values NULL) - a definition of ours, the reference leaves it open.
    When the inputs are slices of one table, tag it once and call
    :func:`sync_tagged` instead (one scan instead of N).
    """
    if not isinstance(inputs, (list, tuple)) or not inputs:
        raise ValueError("sync needs a non-empty list or tuple of DataFrames")
    spark = inputs[0].sparkSession
    for d in inputs:
        if d.sparkSession is not spark:
            raise ValueError("all inputs must belong to one SparkSession")
        require_columns(d, key, value, *order, where="sync input")
    return sync_tagged(_tagged(inputs, key, value, list(order)), len(inputs), order=order,
                       match=match, mode=mode, partitions=partitions)


def sync_tagged(tagged: DataFrame, n_inputs: int, order: Sequence[str] = ("arrival_ts",
                "arrival_id"), match: str = "occurrence", mode: str = "synced",
                partitions: int | None = None) -> DataFrame:
    """:func:`sync` over one DataFrame that carries all inputs: columns
    ``key``, ``src`` (input index ``0 .. n_inputs-1``), ``value_0 ..
    value_{n_inputs-1}`` (only ``value_<src>`` set) and the ``order``
    columns."""
    if n_inputs <= 0:
        raise ValueError("sync needs at least one input")
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    if match not in MATCHES:
        raise ValueError(f"match must be one of {MATCHES}")
    n = n_inputs
    order = list(order)
    vals = [f"value_{j}" for j in range(n)]
    require_columns(tagged, "key", "src", *vals, *order, where="sync_tagged")
    u = tagged
    if match == "occurrence":
        # hash on key alone: the numbering window and the grouping by
        # (key, occurrence) then share one shuffle
        numbered = number_rows(u, ["key", "src"], order, out="occurrence",
                               partitions=partitions, cluster_by=["key"])
        out = (numbered.groupBy("key", "occurrence")
                       .agg(F.count(F.lit(1)).alias("_n"),
                            *[F.any_value(v, ignoreNulls=True).alias(v) for v in vals]))
        if mode != "longest":
            out = out.where(F.col("_n") == n)
        return out.select("key", "occurrence", *vals)
    numbered = number_rows(u, ["key"], order + ["src"], out="_rn", partitions=partitions)
    grp = F.floor((F.col("_rn") - 1) / n).cast("bigint")
    out = (numbered.withColumn("group", grp + 1)
                   .groupBy("key", "group")
                   .agg(F.count(F.lit(1)).alias("_n"),
                        F.sort_array(F.collect_list(F.struct("_rn", "src", *vals))).alias("_it")))
    if mode != "longest":
        out = out.where(F.col("_n") == n)
    return out.select("key", "group", F.transform(
        "_it", lambda x: F.struct(x["src"].alias("src"), *[x[v].alias(v) for v in vals]))
        .alias("items"))
