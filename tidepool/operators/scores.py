"""Grouping of values per key: group_values, merge_sorted, scores, totals.

A key's values are returned as a multiset - one row per (key, value) with
its multiplicity ``n``. This is the ascending list of the reference in a form
that stays distributed: it is pre-aggregated map-side (a key holding a third
of all rows is reduced to its distinct values before the shuffle) and no key
is ever gathered into one row. ``as_list=True`` gives the literal sorted
arrays, built from the pre-aggregated runs; use it where a key's distinct
values are known to be few.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tidepool.contracts import require_columns
from tidepool.functions.parse import parse_game_event


def _keys(keys) -> list[str]:
    return [keys] if isinstance(keys, str) else list(keys)


def group_values(df: DataFrame, keys: str | Sequence[str], value: str,
                 as_list: bool = False, out: str = "values") -> DataFrame:
    """All values per key (GroupByKey), as ``(keys..., value, n)`` runs or,
    with ``as_list``, as ``(keys..., values ARRAY)`` in ascending order."""
    ks = _keys(keys)
    require_columns(df, *ks, value, where="group_values")
    runs = df.groupBy(*ks, value).agg(F.count(F.lit(1)).alias("n"))
    if not as_list:
        return runs
    return (runs.groupBy(*ks)
                .agg(F.sort_array(F.collect_list(F.struct(value, "n"))).alias("_runs"))
                .select(*ks, F.flatten(F.transform(
                    "_runs", lambda r: F.array_repeat(r[value], r["n"].cast("int"))))
                    .alias(out)))


def merge_sorted(df: DataFrame, keys: str | Sequence[str], value: str,
                 as_list: bool = False, out: str = "values") -> DataFrame:
    """Combine values (or lists of values, one or two levels deep) per key
    into one ascending list; see the module doc for the output forms."""
    ks = _keys(keys)
    require_columns(df, *ks, value, where="merge_sorted")
    dtype = df.schema[value].dataType.simpleString()
    col = F.col(value)
    if dtype.startswith("array<array<"):
        df = df.select(*ks, F.explode(F.flatten(col)).alias(value))
    elif dtype.startswith("array<"):
        df = df.select(*ks, F.explode(col).alias(value))
    return group_values(df, ks, value, as_list=as_list, out=out)


def scores_by_field(events: DataFrame, field: str = "user", as_list: bool = False,
                    out: str = "scores") -> DataFrame:
    """Every score per ``field`` (``user`` or ``team``), ascending.

    The reference first cuts each key's events into 2-hour sessions and
    then joins all sessions of the key again, which cannot change the final
    multiset; here the values are grouped once, in one shuffle.
    """
    if field not in ("user", "team"):
        raise ValueError("field must be 'user' or 'team'")
    require_columns(events, field, "score", where="scores_by_field")
    return merge_sorted(events.select(field, "score"), field, "score",
                        as_list=as_list, out=out)


def total_score(events: DataFrame, field: str = "user") -> DataFrame:
    """Sum of scores per ``field`` (partial sums combine map-side)."""
    require_columns(events, field, "score", where="total_score")
    return events.groupBy(field).agg(F.sum("score").alias("total_score"))


def user_score(lines: DataFrame, line: str = "value", as_list: bool = False,
               observation: Observation | None = None) -> DataFrame:
    """Lines -> parsed events -> scores per user; rejects are counted on
    ``observation`` when one is given."""
    events = parse_game_event(lines, line=line, observation=observation)
    return scores_by_field(events, "user", as_list=as_list)
