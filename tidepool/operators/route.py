"""Filters, routes, guards, dead letters, retries, taps and counters."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepool.contracts import ERROR, MESSAGE, require_columns, require_schema
from tidepool.functions.parse import parse_json_payload

# --- attribute filter -------------------------------------------------------


def _want(filter_value, match: str) -> list[str]:
    if match == "chars":
        # A string filter is a set of characters; a list filter a set of its
        # elements (a multi-character element can then never match).
        if isinstance(filter_value, str):
            return sorted(set(filter_value))
        if isinstance(filter_value, Iterable):
            return sorted({str(v) for v in filter_value})
        return [str(filter_value)]
    if isinstance(filter_value, (list, tuple, set, frozenset)):
        return sorted({str(v) for v in filter_value})
    return [str(filter_value)]


def attribute_predicate(filters: dict | None, attributes: str = "attributes",
                        match: str = "value") -> Column:
    """True when every filter key is present and its wanted values are a
    subset of the attribute's: ``match="value"`` compares whole values
    (a scalar filter is equality, a list filter must hold only the
    attribute's value); ``match="chars"`` compares sets of characters.
    A missing key gives false or NULL; use the predicate in ``where``."""
    if match not in ("value", "chars"):
        raise ValueError("match must be 'value' or 'chars'")
    if not filters:
        return F.lit(True)
    attrs = F.col(attributes)
    conds = []
    for k, fv in filters.items():
        have_v = attrs[k]
        want = _want(fv, match)
        present = F.map_contains_key(attrs, F.lit(k))
        if match == "chars":
            w = F.array(*[F.lit(x) for x in want]).cast("array<string>")
            conds.append(present & (F.size(F.array_except(w, F.split(have_v, ""))) == 0))
        elif not want:               # the empty set is a subset of anything
            conds.append(present)
        elif len(want) == 1:         # {w} is a subset of {value} iff w == value
            conds.append(have_v == F.lit(want[0]))
        else:                        # two different values never fit in one
            conds.append(F.lit(False))
    out = conds[0]
    for c in conds[1:]:
        out = out & c
    # no coalesce(.., false): in a filter NULL already drops the row, and a
    # bare comparison lets Catalyst push the test into the Parquet scan
    return out


def filter_by_attributes(messages: DataFrame, filters: dict | None = None,
                         schema: T.StructType | str | None = None, match: str = "value",
                         json_mode: str = "reject") -> DataFrame:
    """Keep messages whose attributes pass ``filters`` (all of them), then
    decode their JSON ``data`` with ``schema`` into ``payload`` (see
    :func:`tidepool.functions.parse.parse_json_payload`). No filters: every
    message is kept and decoded."""
    require_schema(messages, T.StructType([MESSAGE["data"], MESSAGE["attributes"]]),
                   where="filter_by_attributes")
    kept = messages.where(attribute_predicate(filters, match=match)) if filters else messages
    if schema is None:
        return kept
    return parse_json_payload(kept, schema, data="data", mode=json_mode)


# --- routes -----------------------------------------------------------------


def split_threshold(df: DataFrame, value: str, split: float = 0.5,
                    out: str = "route") -> DataFrame:
    """Tag rows ``lower`` (value < split) or ``upper``."""
    require_columns(df, value, where="split_threshold")
    return df.withColumn(out, F.when(F.col(value) < F.lit(split), F.lit("lower"))
                               .otherwise(F.lit("upper")))


def routes(df: DataFrame, route: str = "route") -> dict[str, Callable[[], DataFrame]]:
    """One lazily filtered DataFrame per tag: ``routes(df)['lower']()``."""
    def pick(tag):
        return lambda: df.where(F.col(route) == tag).drop(route)
    return {"lower": pick("lower"), "upper": pick("upper")}


# --- guards -----------------------------------------------------------------


def fail_on_value(df: DataFrame, bad: Column, message: str = "bad value") -> DataFrame:
    """Pass rows through; the job fails on the first row where ``bad``."""
    check = F.when(F.coalesce(bad, F.lit(False)), F.raise_error(F.lit(message))) \
             .otherwise(F.lit(True))
    return df.where(check)


def row_budget_guard(df: DataFrame, limit: int, keys: Sequence[str]) -> DataFrame:
    """Pass every row through, those with null keys too; the job fails if a
    key has more than ``limit`` rows. The largest count per key is one
    number: a partial aggregate and a one-row subquery, no keyed join."""
    require_columns(df, *keys, where="row_budget_guard")
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    most = counts.agg(F.max("_n").alias("_most")).scalar()
    return df.where(F.when(most > F.lit(limit), F.raise_error(F.concat(
        F.lit(f"row budget {limit} exceeded by a key with "), most.cast("string"),
        F.lit(" rows")))).otherwise(F.lit(True)))


# --- retries and dead letters -----------------------------------------------


# The defaults (retries, delays, error class) are fixed values.
def retry_call(fn: Callable, retries: int = 5, initial_delay: float = 0.1,
               max_delay: float = 10.0, retry_on: tuple = (ValueError,)) -> Callable:
    """Wrap ``fn``: on an exception of a ``retry_on`` class call again, up to
    ``retries`` more times, sleeping ``initial_delay * 2**i`` (at most
    ``max_delay``) between attempts; then re-raise."""
    def wrapped(*args):
        delay = initial_delay
        for attempt in range(retries + 1):
            try:
                return fn(*args)
            except retry_on:
                if attempt == retries:
                    raise
                if delay > 0:
                    time.sleep(min(delay, max_delay))
                delay = delay * 2
    return wrapped


def dead_letter(df: DataFrame, fn: Callable, cols: Sequence[str], retries: int = 5,
                initial_delay: float = 0.1, max_delay: float = 10.0,
                retry_on: tuple = (ValueError,), keep_failed: bool = True,
                out: str = "error") -> DataFrame:
    """Call ``fn(*row[cols])`` for every row (with :func:`retry_call`) and add
    ``out`` = ``struct(error_class, message)`` of the final exception, NULL
    on success. ``keep_failed=True`` keeps failed rows in the result (the
    reference sends them to the main output too); ``False`` drops them. Use
    :func:`errors` for the dead-letter side. ``fn`` is called once per row and
    attempt, in Arrow batches through a pandas UDF (again only where Spark
    retries a task). A failure that a Column can tell needs no call: see
    :func:`dead_letter_expr`."""
    require_columns(df, *cols, where="dead_letter")
    call = retry_call(fn, retries, initial_delay, max_delay, retry_on)

    @F.pandas_udf(ERROR)
    def guarded(*series: pd.Series) -> pd.DataFrame:
        cls, msg = [], []
        for row in zip(*series):
            try:
                call(*row)
                cls.append(None)
                msg.append(None)
            except Exception as e:  # the error becomes data
                cls.append(type(e).__name__)
                msg.append(str(e))
        return pd.DataFrame({"error_class": cls, "message": msg})

    # Not deterministic, and a column of its own before anything reads it: else
    # the optimizer copies the call into every expression that names it.
    call_result = guarded.asNondeterministic()(*[F.col(c) for c in cols])
    tried = df.withColumn("_tried", call_result)
    res = tried.withColumn(out, F.when(F.col("_tried.error_class").isNotNull(),
                                       F.col("_tried"))).drop("_tried")
    return res if keep_failed else res.where(F.col(out).isNull())


def dead_letter_expr(df: DataFrame, failed: Column, error_class: str, message: Column | str,
                     keep_failed: bool = True, out: str = "error") -> DataFrame:
    """The same split for a failure expressible as a Column (stays in the
    JVM): ``out`` is set where ``failed``."""
    msg = F.lit(message) if isinstance(message, str) else message
    err = F.when(F.coalesce(failed, F.lit(False)),
                 F.struct(F.lit(error_class).alias("error_class"), msg.alias("message")))
    res = df.withColumn(out, err)
    return res if keep_failed else res.where(F.col(out).isNull())


def errors(df: DataFrame, out: str = "error") -> DataFrame:
    """The dead-letter side: rows whose call failed."""
    return df.where(F.col(out).isNotNull())


# --- taps, counters, fan-out ------------------------------------------------


def tap(df: DataFrame, name: str, observation: Observation | None = None,
        *metrics: Column) -> DataFrame:
    """Pass-through that reports the rows seen under ``name``: a row count
    (plus any ``metrics``) on ``observation`` - read it after an action -
    or, for streams, in ``StreamingQueryProgress.observedMetrics``."""
    obs = observation if observation is not None else name
    return df.observe(obs, F.count(F.lit(1)).alias(f"{name}_rows"), *metrics)


def tap_sample(df: DataFrame, name: str, n: int = 20, log=None):
    """Show up to ``n`` rows under ``name`` without changing anything: a
    batch DataFrame is logged now (``take(n)``); a stream returns a writer
    whose every micro-batch logs its first ``n`` rows (``foreachBatch``;
    start it next to the real sink). Only ``n`` rows ever reach the driver.
    ``log`` defaults to the ``tidepool.tap`` logger."""
    import logging
    log = log or logging.getLogger(f"tidepool.tap.{name}").info
    if not df.isStreaming:
        for row in df.take(n):
            log(f"{name}: {row!r}")
        return None

    def show(batch: DataFrame, batch_id: int) -> None:
        for row in batch.take(n):
            log(f"{name}[{batch_id}]: {row!r}")

    return df.writeStream.foreachBatch(show)


def count_where(df: DataFrame, observation: Observation | str, **conditions: Column) -> DataFrame:
    """Named counters beside the data: ``count_where(df, obs,
    num_parse_errors=col('reason').isNotNull())``."""
    return df.observe(observation, *[F.count_if(c).alias(k) for k, c in conditions.items()])


def fan_out(df: DataFrame, *branches: Callable[[DataFrame], DataFrame],
            persist: bool = False, materialize: bool = False) -> list[DataFrame]:
    """Feed the same rows to several branches.

    By default each branch plans the shared input again (Spark reuses
    shared exchanges within one plan). ``materialize`` writes the input once
    as a Parquet table under the session's checkpoint folder and feeds every
    branch from it - each branch then reads only the columns it uses, and
    the lineage is cut; drop the table with ``session.dropped(...)`` once the
    branches' results are written (``session.live_tables()`` names it). ``persist`` caches it instead (for repeated actions
    in one session; release it with ``unpersist``)."""
    if materialize:
        from tidepool.session import written
        src = written(df, "fan-out")
    else:
        src = df.persist() if persist else df
    return [b(src) for b in branches]
